"""Token ids in files of fixed-width bit fields.

A file is a run of blocks, perhaps spare 0x0A, then an index, then the place of the index; numbers are little-endian:

    block   magic FLB1, id width in bits, file number, documents n, tokens t, token before the block, bytes b
            (7 x uint64 but for the 8-byte magic), n doc ids (int64), n bytes 1 = id is null,
            n token counts (uint64), b bytes: token i has bits [i * width, (i + 1) * width),
            lowest bit first, and 8 spare bytes
    index   magic FLX1, blocks m (uint64), m byte offsets, m first tokens, m first documents (uint64)
    end     byte offset of the index (uint64)

Spark's text writer ends each of them with one 0x0A, which belongs to the format. A task writes as many files as
its bytes need: all but its last have the same number of records, which is what the writer cuts files by, so a file
that is full early is filled up with empty records.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm import tokens as T
from formlake.llm import words as W
from formlake.llm.common import distinct_names, sized, store
from formlake.session import scratch_path

_HEAD = struct.Struct("<8s6Q")
_BLOCK, _INDEX = b"FLB1\0\0\0\0", b"FLX1\0\0\0\0"
#: A block is closed by the document that fills it up to so many tokens.
BLOCK_TOKENS = 1 << 18
#: A file is closed by the block that fills it up to so many bytes, or is the last of so many blocks.
FILE_BYTES = 64 << 20
FILE_BLOCKS = 1000


def width_of(vocabulary: int) -> int:
    """Least number of bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as bit fields of ``width`` bits, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: np.ndarray, width: int, first: int, n: int) -> np.ndarray:
    """Ids first .. first + n - 1 of a bit field array that has 8 spare bytes at its end."""
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(data, f"<u{size}", n, first * size).astype(np.uint32)
    bit = (first + np.arange(n, dtype=np.int64)) * width
    at, shift = bit >> 3, (bit & 7).astype(np.uint64)
    value = np.zeros(n, np.uint64)
    for j in range((width + 7 + 7) // 8):
        value |= data[at + j].astype(np.uint64) << np.uint64(8 * j)
    return ((value >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


class PackedFile:
    """Reads one file: its documents in order, or any run of its tokens."""

    def __init__(self, content: bytes):
        self.data = np.frombuffer(content, np.uint8)
        (index,) = struct.unpack_from("<Q", content, len(content) - 9)
        magic, m = struct.unpack_from("<8sQ", content, index)
        if magic != _INDEX:
            raise ValueError("not a packed token file")
        table = np.frombuffer(content, "<u8", 3 * m, index + 16).astype(np.int64).reshape(3, m)
        self.offsets, self.first_tokens, self.first_docs = table
        self.blocks = [_HEAD.unpack_from(content, o) for o in self.offsets]

    def _parts(self, k: int):
        _, width, _, n, t, _, size = self.blocks[k]
        at = int(self.offsets[k]) + _HEAD.size
        ids = np.frombuffer(self.data, "<i8", n, at)
        null = self.data[at + 8 * n:at + 9 * n]
        counts = np.frombuffer(self.data, "<u8", n, at + 9 * n).astype(np.int64)
        start = at + 17 * n
        return ids, null, counts, self.data[start:start + size + 8], width, t

    def documents(self):
        """(doc_id, first token in the file, ids) of every document."""
        for k in range(len(self.blocks)):
            doc_ids, null, counts, fields, width, t = self._parts(k)
            flat = unpack(fields, width, 0, t)
            ends = np.cumsum(counts)
            for d, gone, a, b in zip(doc_ids.tolist(), null.tolist(), (ends - counts).tolist(), ends.tolist(),
                                     strict=True):
                yield (None if gone else d), int(self.first_tokens[k]) + a, flat[a:b]

    def tokens(self, first: int, n: int) -> np.ndarray:
        """Any n tokens of the file, unpacking only what is asked for."""
        out = []
        k = int(np.searchsorted(self.first_tokens, first, side="right")) - 1
        while n > 0 and 0 <= k < len(self.blocks):
            fields, width, t = self._parts(k)[3:]
            inside = first - int(self.first_tokens[k])
            take = min(n, t - inside)
            out.append(unpack(fields, width, inside, take))
            first, n, k = first + take, n - take, k + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _block(file_no, doc_ids, counts, ids, width, before) -> bytes:
    fields = pack(ids, width)
    null = np.array([d is None for d in doc_ids], np.uint8)
    plain = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = _HEAD.pack(_BLOCK, width, file_no, len(doc_ids), len(ids), before, len(fields))
    return b"".join([head, plain.tobytes(), null.tobytes(), np.array(counts, "<u8").tobytes(), fields, b"\0" * 8])


def _writer(path: str, end: int, vocabulary: int | None, block_tokens: int, special_ids: bool, file_bytes: int):
    def write(batches):
        encoder = T.encoder(path, special_ids)
        width = width_of(max(vocabulary or encoder.vocabulary, end + 1))
        file_no = TaskContext.get().partitionId() << 32
        place = before = docs = 0
        index: list[tuple[int, int, int]] = []
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal place, before, docs, held
            doc_ids = [d for part in held for d in part[0]]
            counts = np.concatenate([part[1] for part in held])
            ids = np.concatenate([part[2] for part in held])
            block = _block(file_no, doc_ids, counts, ids, width, before)
            index.append((place, before, docs))
            place, before, docs, held = place + len(block) + 1, before + len(ids), docs + len(doc_ids), []
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["value"])

        def close(last: bool):
            nonlocal file_no, place, before, docs, index
            spare = 0 if last else FILE_BLOCKS - len(index)
            table = np.array(index, "<u8").T.tobytes()
            values = [*[b""] * spare, struct.pack("<8sQ", _INDEX, len(index)) + table, struct.pack("<Q", place + spare)]
            file_no, place, before, docs, index = file_no + 1, 0, 0, 0, []
            return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])

        size = 0
        for part in W.slices(batches, "text", T.SLICE_BYTES):
            ids, at = encoder.encode_with_end(part.column("text"), end)
            doc_ids, counts = part.column("doc_id").to_pylist(), np.diff(at)
            row = 0
            while row < len(doc_ids):
                if place >= file_bytes or len(index) == FILE_BLOCKS:
                    yield close(last=False)
                last = int(np.searchsorted(at, at[row] + block_tokens - size, side="left"))
                last = min(max(last, row + 1), len(doc_ids))
                held.append((doc_ids[row:last], counts[row:last], ids[at[row]:at[last]]))
                size += int(at[last] - at[row])
                row = last
                if size >= block_tokens:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        if index:
            yield close(last=True)

    return write


def write_packed(
    df: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS,
    special_ids: bool = False, file_bytes: int = FILE_BYTES,
) -> None:
    """Encodes every text, appends ``end_id``, and writes the files to ``path`` in ascending order of the id.

    Null texts are empty and have only the end id; null ids come first. Rows with equal ids are ordered by
    a hash of the text, so many of them can be dealt to several files. An empty table writes no file with
    blocks. Files follow each other in the order of their numbers, and none is longer than ``file_bytes`` by more than its
    last block, whatever the size of the table. ``vocabulary`` sets the width of the
    fields, by default the tokenizer's size. ``special_ids`` is that of ``Encoder``.
    """
    docs = distinct_names(df, doc_id=id_col, text=text_col)
    # The last key deals out rows that are equal altogether; they are interchangeable.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"),
                        F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = ranged.mapInArrow(_writer(tokenizer_path, end_id, vocabulary, block_tokens, special_ids, file_bytes), "value binary")
    # The text writer puts the bytes of a string out as they are.
    blocks.select(F.col("value").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", FILE_BLOCKS + 2).text(path, lineSep="\n")


def _reader(batches):
    for batch in batches:
        for content in batch.column(0):
            raw = content.as_buffer().to_pybytes()
            if not raw:
                continue
            file = PackedFile(raw)
            del raw
            number = file.blocks[0][2]
            rows = [(number, d, a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, a, ids in file.documents()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns], ["file_no", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_packed(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").load(path).select("content")
    docs = files.mapInArrow(_reader, "file_no long, doc_id long, at long, n_tokens long, ids_crc32 long")
    docs = store(docs, "packed-documents")
    # One row per file: few beside the files themselves.
    totals = docs.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return docs.join(sized(totals), "file_no").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def packed_documents(
    df: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int | None = None, special_ids: bool = False,
    **columns: str,
) -> DataFrame:
    """Writes the files to the shared scratch folder and returns what reading them back gives."""
    spark = df.sparkSession
    path = scratch_path(spark, "packed")
    write_packed(df, path, tokenizer_path, end_id, vocabulary, special_ids=special_ids, **columns)
    return read_packed(spark, path)
