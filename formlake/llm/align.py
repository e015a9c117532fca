"""Alignment of two tokenizers' tokens on the same texts.

Both tokenizers cut the bytes of space + text. Byte offsets where a token of each ends cut the tokens into
groups. They are found by diagonal run skipping: while the end arrays agree at the present index shift, runs of
growing length are compared as a whole, so one-to-one stretches are jumped; where they part, the two ends
are walked until they meet again, which gives an irregular group and a new shift.

Links are all pairs of tokens with a byte in common. How many documents hold a linked pair of ids is counted
within tasks and then by Spark. Documents look their pairs up in a broadcast table of the most frequent ones, of a
fixed size; the other pairs are joined.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm import tokens as T
from formlake.llm import words as W
from formlake.llm.common import distinct_names
from formlake.llm.ppm import Table, tally
from formlake.session import scratch_path

#: The most frequent pairs are broadcast, about 35 bytes each; the others are joined.
HEAD_PAIRS = 500_000
#: Pairs a task counts before it hands them on.
HELD_PAIRS = 2_000_000
#: Pieces that a worker remembers, and the longest in bytes.
KEPT_PIECES, KEPT_BYTES = 300_000, 64
#: Longest part of an end array that is worked on as a Python list.
WINDOW = 1 << 18

_SPACED = re.compile(rb"(?: +|\n)[^ \n]*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def group_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """For every group, how many tokens of ``a`` and of ``b`` end with it; both lists of ends close alike.

    Ends grow within a list, so a part of ``a`` that equals a part of ``b`` is a run of one-to-one groups.
    """
    out_a: list[int] = []
    out_b: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        begin, step = i, 1
        while i < n and a[i:i + step] == b[j:j + step]:  # probe ahead, twice as far each time
            i, j, step = i + step, j + step, step * 2
        if i >= n:
            out_a.extend(range(begin + 1, n + 1))
            out_b.extend(range(len(b) - n + begin + 1, len(b) + 1))
            break
        while step > 1:  # the run ends within the last probe
            step //= 2
            if a[i:i + step] == b[j:j + step]:
                i, j = i + step, j + step
        if i > begin:
            out_a.extend(range(begin + 1, i + 1))
            out_b.extend(range(j - i + begin + 1, j + 1))
            if i >= n:
                break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        out_a.append(i)
        out_b.append(j)
    return out_a, out_b


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``group_ends`` of two arrays, in windows that end where both have an end."""
    if len(a) <= WINDOW and len(b) <= WINDOW:
        return tuple(np.array(x, np.int64) for x in group_ends(a.tolist(), b.tolist()))
    parts, i, j = [], 0, 0
    common = np.intersect1d(a, b, assume_unique=True)
    last_a, last_b = np.searchsorted(a, common) + 1, np.searchsorted(b, common) + 1
    while i < len(a):
        k = min(np.searchsorted(last_a, i + WINDOW, "right"), np.searchsorted(last_b, j + WINDOW, "right")) - 1
        k = max(k, int(np.searchsorted(last_a, i, "right")))  # a group longer than a window
        to_a, to_b = int(last_a[k]), int(last_b[k])
        x, y = group_ends(a[i:to_a].tolist(), b[j:to_b].tolist())
        parts.append((np.array(x, np.int64) + i, np.array(y, np.int64) + j))
        i, j = to_a, to_b
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class ByteTokens:
    """A byte-level tokenizer file: ids of texts, and the bytes each id stands for."""

    def __init__(self, path: str):
        self.encoder = T.encoder(path)
        if not self.encoder.spaced:
            raise ValueError("the tokenizer drops white space")
        names = self.encoder.tokenizer.get_vocab()
        self.size = max(names.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for name, i in names.items():
            self.lengths[i] = len(name)  # each character stands for one byte

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, at = self.encoder.encode(texts)
        return ids.astype(np.int64), at


class PieceTokens:
    """A piece model with byte fallback. No piece holds a space after another character, or a line feed, so texts are
    cut before runs of spaces and before line feeds, and every distinct part is encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        if any("▁" in p[1:] and p.strip("▁") for p in pieces):
            raise ValueError("a piece holds a space after another character")
        if any("\n" in p for p in pieces):
            raise ValueError("a piece holds a line feed")
        self.space = self.model.piece_to_id("▁")
        self.bytes = [self._plain(p, i) for i, p in enumerate(pieces)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.kept: dict[bytes, list[int]] = {}
        self.changed: set[bytes] = set()  # parts whose pieces have other bytes

    def _plain(self, piece: str, i: int) -> bytes:
        byte = _BYTE.fullmatch(piece) if self.model.IsByte(i) else None
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, raw: bytes, at: list[int]) -> list[list[int] | None]:
        """Ids of every text; None where the tokens' bytes aren't those of the text."""
        if len(self.kept) > KEPT_PIECES:
            self.kept, self.changed = {}, set()
        parts = [_SPACED.findall(raw, a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
        new = list(set(chain.from_iterable(parts)) - self.kept.keys())
        # The model puts one space before each part: it stands for a part's own space, or is a piece before a line feed.
        found = self.model.encode([p.decode() if p[0] == 10 else p[1:].decode() for p in new], num_threads=1)
        known, plain = self.kept, self.bytes
        for part, ids in zip(new, found, strict=True):
            if part[0] == 10:
                ids = ids[1:] if ids[0] == self.space else [self.space]  # the latter isn't the text's bytes
            elif part == b" ":  # the model gives nothing for an empty text
                ids = [self.space]
            known[part] = ids
            if b"".join([plain[i] for i in ids]) != part:
                self.changed.add(part)
        out: list[list[int] | None] = []
        for row in parts:
            same = self.changed.isdisjoint(row) if self.changed else True
            out.append(list(chain.from_iterable(map(known.__getitem__, row))) if same else None)
        for part in new:
            if len(part) > KEPT_BYTES:
                del known[part]
                self.changed.discard(part)
        return out


@lru_cache(maxsize=2)
def _tokenizers(a_path: str, b_path: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(a_path), PieceTokens(b_path)


@lru_cache(maxsize=2)
def _printed(size: int) -> list[str]:
    """Decimal ids before a comma, a bar and a semicolon."""
    return [f"{i}{mark}" for i in range(size) for mark in ",|;"]


@dataclass
class Alignment:
    """The tokens of one text and, for every group, how many of them end with it."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (in a, in b) of all pairs with a byte in common: between two ends of either lies one pair."""
        cuts = np.concatenate([self.a_ends, self.b_ends])
        cuts.sort(kind="stable")  # merges two sorted runs
        cuts = cuts[np.flatnonzero(np.diff(cuts, append=-1))]
        return np.searchsorted(self.a_ends, cuts), np.searchsorted(self.b_ends, cuts)

    def digest(self, size: int) -> str:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``."""
        mark_a, mark_b = np.zeros(len(self.a_ids), np.int64), np.zeros(len(self.b_ids), np.int64)
        mark_a[self.a_groups - 1], mark_b[self.b_groups - 1] = 1, 2
        first_b = np.concatenate([[0], self.b_groups[:-1]])
        counts = np.diff(self.a_groups, prepend=0)
        place = np.arange(len(self.a_ids)) + np.repeat(first_b, counts)
        line = np.empty(len(self.a_ids) + len(self.b_ids), np.int64)
        in_a = np.zeros(len(line), bool)
        in_a[place] = True
        line[in_a] = self.a_ids * 3 + mark_a
        line[~in_a] = self.b_ids * 3 + mark_b
        text = "".join(map(_printed(size).__getitem__, line.tolist()))
        return hashlib.sha256(text[:-1].encode()).hexdigest()


def _alignments(texts: pa.Array, a_path: str, b_path: str) -> list[Alignment | None]:
    """One alignment a row; None for null and empty texts and those that a tokenizer changes."""
    a_tokens, b_tokens = _tokenizers(a_path, b_path)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    spaced = pc.if_else(pc.equal(texts, ""), "", spaced)
    data, at = W.text_bytes(spaced)
    if not len(data):
        return [None] * len(texts)
    a_ids, a_at = a_tokens.encode(spaced)
    found = b_tokens.encode(data.tobytes(), at.tolist())
    out: list[Alignment | None] = []
    for row, b_list in enumerate(found):
        size = int(at[row + 1] - at[row])
        a = a_ids[a_at[row]:a_at[row + 1]]
        a_ends = np.cumsum(a_tokens.lengths[a])
        if not size or b_list is None or not len(a) or a_ends[-1] != size:
            out.append(None)
            continue
        b = np.array(b_list, np.int64)
        b_ends = np.cumsum(b_tokens.lengths[b])
        out.append(Alignment(a, b, *align(a_ends, b_ends), a_ends, b_ends))
    return out


def _aligner(a_path: str, b_path: str):
    def run(batches):
        for part in W.slices(batches, "text"):
            found = _alignments(part.column("text"), a_path, b_path)
            lists = [[[] if x is None else getattr(x, name) for x in found]
                     for name in ("a_ids", "b_ids", "a_groups", "b_groups")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(x, pa.list_(pa.int64())) for x in lists]],
                ["doc_id", "a_ids", "b_ids", "a_groups", "b_groups"])

    return run


def alignments(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, and for every group how many ids of each end with it (a_groups, b_groups).

    ``a_path`` is a byte-level tokenizer file and reads space + text, ``b_path`` a piece model that puts the
    space there itself. Special tokens' strings are plain text. Null and empty texts, and those whose tokens
    aren't made of the same bytes as space + text, have empty lists. A text is worked on as a whole;
    repeated rows and null ids are kept as they are; an empty table gives an empty table; other columns are ignored.
    """
    docs = distinct_names(df, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_aligner(a_path, b_path), (
        f"doc_id {kind}, a_ids array<long>, b_ids array<long>, a_groups array<long>, b_groups array<long>"))


_FOUND = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<int>, times array<int>, pair long, docs long"
)


def _linker(a_path: str, b_path: str):
    """Rows of documents with their distinct linked pairs, and rows (pair, docs) that count these in a task."""

    def counted(keys, docs):
        schema = pa.schema([(n, t) for n, t in zip(
            ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links"), [pa.int64()] * 6, strict=True)])
        rest = [pa.nulls(len(keys), f.type) for f in schema]
        lists = [pa.nulls(len(keys), pa.list_(pa.int32()))] * 2
        return pa.RecordBatch.from_arrays(
            [*rest, pa.nulls(len(keys), pa.string()), *lists, pa.array(keys, pa.int64()), pa.array(docs, pa.int64())],
            [*schema.names, "groups_sha256", "pairs", "times", "pair", "docs"])

    def run(batches):
        a_tokens, b_tokens = _tokenizers(a_path, b_path)
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        held: list[np.ndarray] = []
        size = 0
        for part in W.slices(batches, "text"):
            found = _alignments(part.column("text"), a_path, b_path)
            n = len(found)
            figures = np.zeros((4, n), np.int64)
            digests, codes, owner = [], [], []
            for row, x in enumerate(found):
                if x is None:
                    digests.append("")
                    continue
                i, j = x.links()
                figures[:, row] = len(x.a_ids), len(x.b_ids), len(x.a_groups), len(i)
                digests.append(x.digest(max(a_tokens.size, b_tokens.size)))
                codes.append(x.a_ids[i] * b_tokens.size + x.b_ids[j])
                owner.append(np.full(len(i), row))
            if codes:
                span = a_tokens.size * b_tokens.size
                one, times = np.unique(np.concatenate(codes) + np.concatenate(owner) * span, return_counts=True)
                doc, pair = np.divmod(one, span)
            else:
                doc = pair = times = np.zeros(0, np.int64)
            places = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column("row"), part.column("doc_id"), *[pa.array(x) for x in figures],
                pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(places, pa.array(pair, pa.int64()).cast(pa.int32())),
                pa.ListArray.from_arrays(places, pa.array(times, pa.int32())),
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
            ], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "pair", "docs"])
            held.append(pair)
            size += len(pair)
            if size > HELD_PAIRS:
                fresh = tally(np.concatenate(held))
                kept = list(tally(np.concatenate([kept[0], fresh[0]]), np.concatenate([kept[1], fresh[1]])))
                held, size = [], 0
                if len(kept[0]) > HELD_PAIRS:
                    yield counted(*kept)
                    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        fresh = tally(np.concatenate([*held, np.zeros(0, np.int64)]))
        kept = tally(np.concatenate([kept[0], fresh[0]]), np.concatenate([kept[1], fresh[1]]))
        if len(kept[0]):
            yield counted(*kept)

    return run


def _stored(df: DataFrame, label: str) -> DataFrame:
    """As ``common.store``, packed closer: lists of pairs are large beside the texts."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _head(pairs: DataFrame, limit: int):
    """(broadcast of the most frequent pairs, condition of the pairs that aren't in it)."""
    step = F.floor(F.log2("count") * 8)
    bins = pairs.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    cut, held = None, 0
    for r in bins:  # at most 8 * 63 rows
        if held + r["n"] > limit:
            break
        cut, held = r["step"], held + r["n"]
    frequent = F.lit(False) if cut is None else step >= cut
    head = pairs.where(frequent).select("pair", "count", "best").toArrow()
    table = Table(head.column("pair").to_numpy().astype(np.uint64))
    values = [table.arrange(head.column(c).to_numpy().astype(np.int64)) for c in ("count", "best")]
    table.order = None
    return pairs.sparkSession.sparkContext.broadcast((table, *values)), ~frequent


def _summer(head):
    def run(batches):
        table, count, best = head.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            keys = lists.flatten().to_numpy().astype(np.int64)
            place = table.find(keys.astype(np.uint64))
            known = place >= 0
            sums = []
            for column in (best, count):
                value = np.zeros(len(keys) + 1, np.int64)
                value[1:][known] = column[place[known]] * times[known]
                sums.append(np.diff(np.cumsum(value)[at]))
            left = np.flatnonzero(~known)
            rest = pa.StructArray.from_arrays([pa.array(keys[left]), pa.array(times[left].astype(np.int64))], ["pair", "times"])
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(left, at), pa.int32()), rest)
            plain = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*plain, *[pa.array(x) for x in sums], tail], [
                "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "tail"])

    return run


def alignment_figures(
    df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """One row per input row: doc_id, n_a and n_b (tokens), n_groups, n_links (pairs of tokens with a byte in
    common), n_best (links whose pair of ids is in as many documents as any pair of that A id, ties
    included), count_sum (documents that hold the pair, summed over links), groups_sha256.

    Texts are read as by ``alignments``; those without tokens have zeros and the digest ''. Every row counts as a
    document, repeated rows too. A null id stays null. An empty table gives an empty table; other columns are ignored.
    """
    b_size = _tokenizers(a_path, b_path)[1].size
    if _tokenizers(a_path, b_path)[0].size * b_size >= 1 << 31:
        raise ValueError("pairs of ids don't fit 31 bits")
    docs = distinct_names(df, doc_id=id_col, text=text_col)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _stored(docs.mapInArrow(_linker(a_path, b_path), _FOUND), "linked")
    counts = found.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("count"))
    # At most as many rows to an A id as tokenizer B has ids.
    same_a = Window.partitionBy(F.expr(f"pair div {b_size}"))
    pairs = _stored(counts.withColumn("best", F.col("count") == F.max("count").over(same_a)), "pairs")
    head, in_tail = _head(pairs, head_pairs)
    rows = found.where("row is not null").drop("pair", "docs")
    summed = _stored(rows.mapInArrow(_summer(head), (
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, "
        "count_sum long, tail array<struct<pair: long, times: long>>")), "summed")
    rest = summed.where(F.size("tail") > 0).select("row", F.inline("tail")).join(pairs.where(in_tail), "pair")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("count")).alias("more_count"))
    out = summed.drop("tail").join(rest, "row", "left").fillna(0, ["more_best", "more_count"])
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.col("more_best")).alias("n_best"),
        (F.col("count_sum") + F.col("more_count")).alias("count_sum"), "groups_sha256")
