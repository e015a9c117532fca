"""Exact top-k inner products from an impact-ordered index, a score at a time.

Vectors are integers. A block of the index holds, for every dimension, its postings in segments of equal quantised
size of the component, largest first. A query takes the segments of all dimensions by descending impact (its own
component times the segment's), adds the quantised products to one accumulator per vector and stops when it
is proven who can still be among the best: the sum so far, plus all that quantisation may hide, plus all that
segments not yet taken can add, stays below the k-th best. Those left are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm import words as W
from formlake.llm.common import distinct_names, store

#: Vectors in a block, and in a partition of the index.
BLOCK_ROWS, PART_ROWS = 16_384, 65_536
#: Queries that are broadcast together: 8 bytes a component.
QUERY_ROWS = 20_000
#: Segments span 2^3 values of a component.
SHIFT = 3
#: The search goes on to smaller impacts while more vectors than this could still be members.
FEW = 64

_INDEX = (
    "n int, dim int, row binary, vec_id binary, no_id binary, components binary, postings binary, levels binary, "
    "bounds binary"
)
_LONG = (1 << 63) - 1


# ---- vectors


def integers(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that take part, their floor(scale * x) padded with 0 to equal length)."""
    lists = vectors.cast(pa.list_(pa.float64()))
    at = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    null = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=null[1:])  # null components are NaN here
    good = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (null[at[1:]] == null[at[:-1]]))
    sizes = (at[1:] - at[:-1])[good]
    out = np.zeros((len(good), int(sizes.max()) if len(good) else 0))
    row = np.repeat(np.arange(len(good)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = values[place + np.repeat(at[good], sizes)]
    return good, np.clip(np.floor(out * scale), -(1 << 62), 1 << 62).astype(np.int64)


def exact_scores(components: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; beyond the range of a long they stay at its end."""
    most = np.abs(components).max(initial=0).astype(float) * np.abs(query.astype(float)).sum()
    if most < 1 << 52:  # sums of doubles are exact up to here
        return (components.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    wide = components.astype(object) @ query.astype(object)
    return np.array([max(-_LONG, min(_LONG, int(x))) for x in wide], np.int64)


# ---- the index


def _encode(row, ids, vectors: np.ndarray) -> list:
    """One block as a row: postings of each dimension by descending quantised size."""
    n, dim = vectors.shape
    level = np.abs(vectors) >> SHIFT
    postings = np.argsort(-level, axis=0, kind="stable").T.astype("<i4")  # dim x n
    signed = np.take_along_axis(np.sign(vectors) * ((level << SHIFT) + (1 << SHIFT) // 2), postings.T, axis=0).T
    sizes = np.take_along_axis(level, postings.T, axis=0).T
    no_id = np.array([x is None for x in ids], np.uint8)
    ids = np.array([0 if x is None else x for x in ids], "<i8")
    return [n, dim, *[x.tobytes() for x in (
        np.asarray(row, "<i8"), ids, no_id, vectors.astype("<i8"), postings, signed.astype("<i8"), sizes.astype("<i8"))]]


class Block:
    def __init__(self, r: dict):
        n, dim = r["n"], r["dim"]
        self.n, self.dim = n, dim
        self.row, self.ids = np.frombuffer(r["row"], "<i8"), np.frombuffer(r["vec_id"], "<i8")
        self.no_id = np.frombuffer(r["no_id"], np.uint8)
        self.components = np.frombuffer(r["components"], "<i8").reshape(n, dim)
        self.postings = np.frombuffer(r["postings"], "<i4").reshape(dim, n).ravel()
        self.signed = np.frombuffer(r["levels"], "<i8").reshape(dim, n).astype(np.float64).ravel()
        sizes = np.frombuffer(r["bounds"], "<i8").reshape(dim, n)
        self.falling = -sizes  # ascending, for searches
        self.largest = ((sizes[:, 0] + 1) << SHIFT).astype(np.float64) if n else np.zeros(dim)

    def candidates(self, query: np.ndarray, k: int, least: int) -> np.ndarray:
        """Places of all vectors that can be among the k best and reach a score of ``least``; a few more may be in it."""
        if self.n <= k + FEW:
            return np.arange(self.n)
        q = np.zeros(self.dim)
        q[:min(self.dim, len(query))] = query[:self.dim]
        weight = np.abs(q)
        used = np.flatnonzero(weight)
        taken = np.zeros(self.dim, np.int64)
        sums = np.zeros(self.n)
        hidden = weight.sum() * ((1 << SHIFT) // 2)  # a component differs from its level by this much at most
        impact = float((weight * self.largest).max(initial=0.0))
        while True:
            impact /= 2
            # Every segment whose products reach this impact: a prefix of each dimension's postings.
            floor = np.zeros(self.dim, np.int64)
            floor[used] = np.minimum(np.ceil(impact / weight[used]), 1 << 62).astype(np.int64) >> SHIFT
            end = taken.copy()
            for d in used.tolist():
                end[d] = np.searchsorted(self.falling[d], -floor[d], side="right")
            end = np.maximum(end, taken)
            counts = end - taken
            total = int(counts.sum())
            if total:
                at = np.repeat(np.arange(self.dim) * self.n + taken - (np.cumsum(counts) - counts), counts)
                at += np.arange(total)
                products = self.signed[at] * np.repeat(q, counts)
                sums += np.bincount(self.postings[at], products, self.n)
            taken = end
            open_ = used[taken[used] < self.n]
            # The largest component among those not taken bounds each open dimension.
            rest = float((weight[open_] * ((-self.falling[open_, taken[open_]] + 1) << SHIFT)).sum())
            slack = hidden + rest
            slack += 1e-9 * (np.abs(sums).max(initial=0.0) + slack)  # rounding of the sums
            known = max(float(least), float(np.partition(sums, self.n - k)[self.n - k]) - slack)
            possible = np.flatnonzero(sums + slack >= known)
            if not len(open_) or len(possible) <= FEW + k:
                return possible


def _indexer(scale: float):
    def run(batches):
        names = ["n", "dim", "row", "vec_id", "no_id", "components", "postings", "levels", "bounds"]
        held: list[pa.RecordBatch] = []
        size = 0

        def block(batch):
            good, vectors = integers(batch.column("vector").combine_chunks(), scale)
            if not len(good):
                return
            row = batch.column("row").to_numpy()[good]
            ids = batch.column("vec_id").take(pa.array(good)).to_pylist()
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
            columns = [pa.array([x], t) for x, t in zip(_encode(row, ids, vectors), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                if size + part.num_rows > BLOCK_ROWS:
                    yield from block(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield from block(pa.Table.from_batches(held))
        W.give_back()

    return run


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The stored index: every row's vector that has neither a null nor a component that isn't finite."""
    rows = distinct_names(df, vec_id=id_col, vector=vector_col).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "vector")
    n = df.count()
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, -(-n // 1024)), -(-n // PART_ROWS), 1)
    return store(rows.repartition(parts).mapInArrow(_indexer(scale), _INDEX), "impact-index")


# ---- the search


def _best(score, vec_id, no_id, row, k):
    """Places of the k highest scores; ties go to the smaller id, no id last."""
    return np.lexsort((row, vec_id, no_id, -score))[:k]


def _searcher(queries, k: int):
    def run(batches):
        own, vectors = queries.value
        best = [tuple(np.zeros(0, np.int64) for _ in range(4)) for _ in own]
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r)
                for i, query in enumerate(vectors):
                    held = best[i]
                    least = int(held[0][k - 1]) if len(held[0]) >= k else -_LONG
                    # One more than k: the query itself may be among them.
                    at = block.candidates(query, k + 1, least)
                    at = at[block.row[at] != own[i]]
                    width = min(block.dim, len(query))
                    score = exact_scores(block.components[at, :width], query[:width])
                    new = [np.concatenate(x) for x in zip(
                        held, (score, block.ids[at], block.no_id[at].astype(np.int64), block.row[at]), strict=True)]
                    place = _best(*new, k)
                    best[i] = tuple(x[place] for x in new)
        for i in range(0, len(own), 1000):
            some = best[i:i + 1000]
            columns = [np.repeat(own[i:i + 1000], [len(x[0]) for x in some])]
            columns += [np.concatenate([x[c] for x in some]) for c in range(4)]
            score, ids, no_id = columns[1], columns[2], columns[3].astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(ids, mask=no_id), pa.array(columns[4]), pa.array(score)],
                ["query_row", "vec_id", "row", "score"])
        W.give_back()

    return run


def _queries(index: DataFrame, every: int) -> DataFrame:
    """(query_row, query_id, vector) of the rows whose id is divisible by ``every``."""

    def pick(batches):
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r)
                at = np.flatnonzero((block.ids % every == 0) & (block.no_id == 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.row[at]), pa.array(block.ids[at]),
                     pa.array(list(block.components[at]), pa.list_(pa.int64()))],
                    ["query_row", "query_id", "vector"])

    picked = index.select("n", "dim", "row", "vec_id", "no_id", "components", "postings", "levels", "bounds")
    return picked.mapInArrow(pick, "query_row long, query_id long, vector array<long>")


def top_k(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100,
    scale: float = 1024.0, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row whose id is divisible by ``every``, the k other rows with
    the highest inner product of the integers floor(scale * x), all if there are fewer.

    Ties go to the smaller id, rows without one come last, then any order among equal ids. Null vectors and
    those with a null or infinite component or NaN take no part, neither as queries. A shorter vector counts
    as padded with 0. A repeated id that is divisible gives results for each of its rows, and its other rows are found
    like any other. Products beyond a long stay at its end. An empty table gives an empty table. Other columns are ignored.

    The index is stored once and read once for each ``query_rows`` queries, which are broadcast.
    """
    spark = df.sparkSession
    index = build_index(df, id_col, vector_col, scale)
    queries = store(_queries(index, every), "queries")
    groups = max(1, -(-queries.count() // query_rows))
    parts = []
    for g in range(groups):
        some = queries.where(F.pmod(F.xxhash64("query_row"), F.lit(groups)) == g).select("query_row", "vector").toArrow()
        own = some.column("query_row").to_numpy()
        vectors = [np.array(x, np.int64) for x in some.column("vector").to_pylist()]
        shared = spark.sparkContext.broadcast((own, vectors))
        found = index.mapInArrow(_searcher(shared, k), "query_row long, vec_id long, row long, score long")
        parts.append(store(found, "nearest"))
        shared.unpersist()
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("row")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order)))
    ids = queries.select("query_row", "query_id")
    return ranked.where(F.col("rank") <= k).join(ids, "query_row").select("query_id", "rank", "vec_id", "score")


def top_k_sql(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    return f"""
    WITH numbered AS (
      SELECT vec_id, row_number() OVER () AS row,
             list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), part AS (
      SELECT q.vec_id AS query_id, q.row AS query_row, c.vec_id, c.row,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM numbered q JOIN numbered c ON q.row <> c.row
      WHERE q.vec_id % {every} = 0
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row) AS rank FROM part
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}
    """
