"""Benchmark decontamination by greedy string tiling.

Running Karp-Rabin hashes over k words of a text are looked up among those of the benchmark items (the seeds
that both share). Seeds on one diagonal make a match. The longest match of unmarked words is marked as a tile,
again and again, so that reordered passages are covered piece by piece; what overlaps a tile is cut down
to its unmarked rest. An item counts as contained if tiles cover enough of its words. An item with fewer than k words is
one seed of its own length.

The benchmark is read in blocks of bounded size, each broadcast and held against all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm import words as W
from formlake.llm.common import distinct_names

MIN_MATCH = 5
COVERAGE = 0.5
#: Words of benchmark items in a block: about 50 MB with its index.
BLOCK_WORDS = 1_000_000
#: Seeds times items that hold them, looked at together; one text may have up to all of a block.
ENTRIES = 1_000_000

_U = np.uint64


class Index:
    """Runs of k words of some items: which items hold a run, how often and where."""

    def __init__(self, k: int, hashes: np.ndarray, item: np.ndarray, place: np.ndarray, n_items: int):
        self.k = k
        self.seeds, seed = np.unique(hashes, return_inverse=True)
        # By item, for tiling: the seeds of each in order, with their places.
        order = np.lexsort((place, seed, item))
        self.own_seed, self.own_place = seed[order], place[order]
        self.own = np.searchsorted(item[order], np.arange(n_items + 1))
        # By seed: each item that holds it once, with the number of places.
        held, self.times = np.unique(seed * n_items + item, return_counts=True)
        holder_seed, self.holder = np.divmod(held, max(n_items, 1))
        self.first = np.searchsorted(holder_seed, np.arange(len(self.seeds) + 1))
        bits = max(12, (16 * len(self.seeds)).bit_length())
        self.mask = _U((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.seeds & self.mask).view(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of seeds, and which seed each is."""
        at = np.flatnonzero(self.maybe[(hashes & self.mask).view(np.int64)])
        found = np.searchsorted(self.seeds, hashes[at])
        found[found == len(self.seeds)] = 0
        same = self.seeds[found] == hashes[at] if len(self.seeds) else np.zeros(len(at), bool)
        return at[same], found[same]


class Items:
    """A block of benchmark items. Items with fewer than k words are held as runs of their own length."""

    def __init__(self, ids: list, texts: list[str | None], k: int, id_type: pa.DataType | None = None):
        w = W.words(pa.array(texts, pa.string()), fold=True)
        self.ids, self.k, self.sizes = pa.array(ids, id_type), k, w.counts
        self.indexes = []
        for length in sorted({k, *(int(n) for n in self.sizes[(self.sizes > 0) & (self.sizes < k)])}):
            hashes, at = W.shingles(w, length)
            item = np.repeat(np.arange(len(ids)), np.diff(at))
            place = np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))
            mine = self.sizes[item] >= k if length == k else self.sizes[item] == length
            self.indexes.append(Index(length, hashes[mine], item[mine], place[mine], len(ids)))


def _runs(place: np.ndarray, seed: np.ndarray, places: dict[int, np.ndarray], size: int):
    """At each place of the text: the item places with its seed, and the seeds matched on their diagonals so far."""
    so_far = np.zeros(size + 2, np.int64)  # of the item place before
    last, touched = -2, np.zeros(0, np.int64)
    for i, s in zip(place.tolist(), seed.tolist()):
        at = places.get(s)
        if at is None:
            continue
        length = so_far[at] + 1 if i == last + 1 else np.ones(len(at), np.int64)
        so_far[touched] = 0
        touched = at + 1
        so_far[touched] = length
        last = i
        yield i, at, length


def tile(
    place: np.ndarray, seed: np.ndarray, own_seed: np.ndarray, own_place: np.ndarray, k: int, size: int,
) -> tuple[int, int]:
    """(tiles, words covered) of an item of ``size`` words.

    ``place`` and ``seed`` are the seeds of the text in order, the others those of the item, by seed. Each round finds the
    longest match of unmarked words, then marks all of that length in order of text and item, so what is left is
    shorter. A place of the text is held against the item's places one after the other: memory is that of
    the text and the item, however often either repeats a seed.
    """
    shared = np.isin(seed, own_seed)
    place, seed = place[shared] - place[shared][0], seed[shared]
    in_text, in_item = np.zeros(int(place[-1]) + k, bool), np.zeros(size, bool)
    tiles = covered = 0
    longest = size - k + 1

    def unmarked(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(marks)])
        return before[at + k] == before[at]

    while covered < size and longest > 0:
        open_text, open_item = unmarked(in_text, place), unmarked(in_item, own_place)
        at, of, item_seed, item_at = place[open_text], seed[open_text], own_seed[open_item], own_place[open_item]
        if not len(at) or not len(item_at):
            break
        cuts = np.flatnonzero(np.diff(item_seed)) + 1
        places = dict(zip(item_seed[np.append(0, cuts)].tolist(), np.split(item_at, cuts)))
        best = 0
        for _, _, length in _runs(at, of, places, size):
            best = max(best, int(length.max()))
            if best == longest:
                break
        if not best:
            break
        n = best + k - 1
        free_from = 0  # of the text: what earlier rounds have marked is in no run
        left = np.ones(size, bool)  # item places where a match can still begin
        for i, js, length in _runs(at, of, places, size):
            i0 = i - best + 1
            if i0 < free_from:
                continue
            begins = js[length == best] - best + 1
            begins = begins[left[begins]]
            if len(begins):
                j0 = int(begins[0])
                in_text[i0:i0 + n] = in_item[j0:j0 + n] = True
                left[max(0, j0 - n + 1):j0 + n] = False
                free_from, tiles, covered = i0 + n, tiles + 1, covered + n
                if not unmarked(in_item, item_at).any():
                    break
        longest = best - 1
    return tiles, covered


def _candidates(row: np.ndarray, seed: np.ndarray, index: Index, sizes: np.ndarray, coverage: float):
    """(row, item) with enough shared seeds for the coverage; whole rows at a time, about ``ENTRIES`` entries at once."""
    if not len(row):
        return
    r, s = np.divmod(np.unique(row * len(index.seeds) + seed), len(index.seeds))
    n = index.first[s + 1] - index.first[s]
    ends = np.cumsum(n)
    begin = 0
    while begin < len(r):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + ENTRIES, side="right")))
        stop = int(np.searchsorted(r, r[stop - 1], side="right"))
        m = n[begin:stop]
        entry = np.arange(m.sum()) + np.repeat(index.first[s[begin:stop]] - (np.cumsum(m) - m), m)
        pair, which = np.unique(np.repeat(r[begin:stop], m) * len(sizes) + index.holder[entry], return_inverse=True)
        shared = np.bincount(which, weights=index.times[entry])
        size = sizes[pair % len(sizes)]
        enough = np.minimum(size, index.k * shared) >= coverage * size
        yield from (divmod(int(p), len(sizes)) for p in pair[enough])
        begin = stop


def contained(texts: pa.Array, items: Items, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, tiles, words covered) of every item that a text contains."""
    w = W.words(texts, fold=True)
    for index in items.indexes:
        hashes, at = W.shingles(w, index.k)
        place, seed = index.hits(hashes)
        row = np.searchsorted(at, place, side="right") - 1
        long = w.counts[row] >= index.k
        place, seed, row = place[long], seed[long], row[long]
        for r, item in _candidates(row, seed, index, items.sizes, coverage):
            size = int(items.sizes[item])
            if size == index.k:  # the item is the seed
                yield r, item, 1, size
                continue
            mine, own = slice(*np.searchsorted(row, [r, r + 1])), slice(index.own[item], index.own[item + 1])
            tiles, covered = tile(place[mine] - at[r], seed[mine], index.own_seed[own], index.own_place[own], index.k, size)
            if covered >= coverage * size:
                yield r, item, tiles, covered


def blocks(benchmark: DataFrame, item_col: str, text_col: str, k: int, block_words: int):
    """Broadcasts of the benchmark, block by block; the driver holds one block at a time."""
    spark = benchmark.sparkSession
    id_type = benchmark.select(benchmark[item_col]).limit(0).toArrow().schema.field(0).type
    ids: list = []
    texts: list[str | None] = []
    size = 0
    for row in distinct_names(benchmark, item=item_col, text=text_col).toLocalIterator():
        ids.append(row["item"])
        texts.append(row["text"])
        size += len(row["text"] or "") // 2 + 1  # a word has a letter and a separator
        if size >= block_words:
            yield spark.sparkContext.broadcast(Items(ids, texts, k, id_type))
            ids, texts, size = [], [], 0
    if ids:
        yield spark.sparkContext.broadcast(Items(ids, texts, k, id_type))


def _finder(shared, coverage: float):
    def find(batches):
        items = shared.value
        for part in W.slices(batches, "text"):
            found = list(contained(part.column("text"), items, coverage))
            rows, numbers = (pa.array([f[j] for f in found], pa.int64()) for j in (0, 1))
            sizes = [int(items.sizes[f[1]]) for f in found]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(rows), items.ids.take(numbers),
                pa.array(sizes, pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                pa.array([f[3] for f in found], pa.int64()),
            ], ["doc_id", "item_id", "item_words", "tiles", "covered_words"])

    return find


def _types(df: DataFrame, benchmark: DataFrame, id_col: str, item_col: str) -> tuple[str, str]:
    return df.select(df[id_col]).schema[0].dataType.simpleString(), benchmark.select(
        benchmark[item_col]).schema[0].dataType.simpleString()


def contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row for each text and benchmark item it contains; texts that contain none have no row.

    Columns: doc_id, item_id, item_words, tiles, covered_words, coverage (share of the item's words under tiles),
    contaminated (true). Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Null and empty texts contain
    nothing, and items without words are in no text. Items with fewer than ``min_match`` words count where a text has them
    word for word, which for an item of one or two words may be in many texts. Repeated rows, of texts or of items,
    are told apart and each has its rows. Of matches of equal length the one that begins first in the
    text, then in the item, is marked. An empty table on either side gives an empty table.
    """
    docs = distinct_names(df, doc_id=id_col, text=text_col)
    id_type, item_type = _types(df, benchmark, id_col, item_col)
    schema = f"doc_id {id_type}, item_id {item_type}, item_words long, tiles long, covered_words long"
    parts = [
        docs.mapInArrow(_finder(shared, coverage), schema)
        for shared in blocks(benchmark, item_col, item_text_col, min_match, block_words)
    ]
    found = reduce(DataFrame.union, parts) if parts else df.sparkSession.createDataFrame([], schema)
    return found.withColumns({
        "coverage": F.col("covered_words") / F.col("item_words"), "contaminated": F.lit(True),
    })


def _keeper(shared, column: int, coverage: float):
    def keep(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            texts = pa.RecordBatch.from_arrays([batch.column(column), pa.array(np.arange(batch.num_rows))], ["text", "row"])
            for part in W.slices([texts], "text"):
                rows = part.column("row").to_numpy()
                for row, *_ in contained(part.column("text"), shared.value, coverage):
                    clean[rows[row]] = False
            yield batch.filter(pa.array(clean))

    return keep


def decontaminated(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``df``, unchanged, whose texts contain no benchmark item (see ``contamination``)."""
    column = df.columns.index(text_col)
    for shared in blocks(benchmark, item_col, item_text_col, min_match, block_words):
        df = df.mapInArrow(_keeper(shared, column, coverage), df.schema)
    return df
