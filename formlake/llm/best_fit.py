"""Best-fit packing of tokenised documents into sequences, as supersteps over all documents of a length.

The documents are range-sorted by length, which gives each its rank among those of equal length. The open
sequences are kept as runs of equal gaps, sorted by gap. A superstep takes all documents of one
length, longest first, sweeps the gap runs upwards from the first that is large enough (the
successor), hands out places in order of rank, so that no two documents claim the same place, opens new
sequences for those that found none, and updates the gaps. As lengths and gaps are at most the capacity,
the runs of a superstep number at most a few thousand however many documents there are: the driver
works on runs, never on documents, and each document finds its place in the rank intervals by itself.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm import tokens as T
from formlake.llm import words as W
from formlake.llm.common import distinct_names, sized, store

CAPACITY = 1024


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, documents per sequence, offset).

    Documents of that length with ranks first .. first + ranks - 1 go to consecutive sequences, so many in
    each, one behind the other from the offset on. ``histogram`` counts documents by length.
    """
    gaps: list[int] = []  # sorted, each once
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    rows, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in runs:
                gaps.insert(bisect_left(gaps, gap), gap)
                runs[gap] = []
            runs[gap].append((first, n))

    def place(length: int, rank: int, left: int, gap: int, first: int, n: int) -> int:
        """Fills up to n sequences of that gap; returns the number of documents placed."""
        each = gap // length
        full = min(n, left // each)
        if full:
            rows.append((length, rank, full * each, first, each, capacity - gap))
            put(gap - each * length, first, full)
        done, more = full * each, min(left - full * each, each) if full < n else 0
        if more:
            rows.append((length, rank + done, more, first + full, more, capacity - gap))
            put(gap - more * length, first + full, 1)
        put(gap, first + full + (more > 0), n - full - (more > 0))
        return done + more

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                break
            gap = gaps[k]
            first, n = runs[gap].pop()
            if not runs[gap]:
                gaps.pop(k)
                del runs[gap]
            done = place(length, rank, left, gap, first, n)
            rank, left = rank + done, left - done
        if left:
            new = -(-left // (capacity // length))
            place(length, rank, left, capacity, opened, new)
            opened += new
    return rows


def _cutter(path: str, end: int, capacity: int, special_ids: bool):
    def cut(batches):
        encoder = T.encoder(path, special_ids)
        for part in W.slices(batches, "text", T.SLICE_BYTES):
            ids, at = encoder.encode_with_end(part.column("text"), end)
            raw = ids.astype("<u4")
            sizes = np.diff(at)
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = sizes[row] - (pieces[row] - 1) * capacity  # the first piece has what is over
            start = np.where(number == 0, 0, head + (number - 1) * capacity)
            length = np.where(number == 0, head, capacity)
            begin = at[row] + start
            sums = [zlib.crc32(raw[a:b].data) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64()),
            ], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_pieces(
    df: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    special_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32; the first may be shorter."""
    docs = distinct_names(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(
        _cutter(tokenizer_path, end_id, capacity, special_ids), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _numbered(batches):
    """The place of each row within its task, which is a stretch of the sorted table."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        numbers = pa.array(np.arange(n, n + batch.num_rows), pa.int64())
        n += batch.num_rows
        yield batch.append_column("stretch", pa.array(np.full(batch.num_rows, task), pa.int32())).append_column(
            "at", numbers)


def _placer(rows: np.ndarray):
    """Looks up each piece's rank interval; ``rows`` are sorted by length and first rank."""
    keys = rows[:, 0] << 48 | rows[:, 1]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = rows[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            inside = rank - row[:, 1]
            sequence, nth = row[:, 3] + inside // row[:, 4], inside % row[:, 4]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(sequence), pa.array(row[:, 5] + nth * length)],
                [*names, "sequence_id", "offset"])

    return place


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces; no sequence holds more than ``capacity``."""
    spark = pieces.sparkSession
    ordered = pieces.repartitionByRange("length", "doc_id", "start").sortWithinPartitions("length", "doc_id", "start")
    schema = ordered.select("*").schema.add("stretch", "integer").add("at", "long")
    ordered = store(ordered.mapInArrow(_numbered, schema), "ordered")
    # One row per stretch and length: its first place in the stretch, and the pieces of that length before it.
    parts = ordered.groupBy("length", "stretch").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = store(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "stretches")
    # At most one row for each length up to the capacity.
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    ranked = ordered.join(sized(parts.drop("n")), ["length", "stretch"]).withColumn(
        "rank", F.col("before") + F.col("at") - F.col("first"))
    schema = pieces.select("*").schema.add("sequence_id", "long").add("offset", "long")
    if not len(rows):
        return spark.createDataFrame([], schema)
    return ranked.mapInArrow(_placer(rows), schema)


def best_fit(
    df: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    special_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row is a document of its own, also when ids repeat or are null; null and empty texts consist of
    the end id only. Ties of length are broken by doc_id and start. Only documents longer than the
    capacity are cut. ``special_ids`` is that of ``Encoder``. An empty table gives an empty table; extra columns
    are ignored.
    """
    pieces = store(cut_pieces(df, tokenizer_path, end_id, capacity, id_col, text_col, special_ids), "pieces")
    return pack_pieces(pieces, capacity)
