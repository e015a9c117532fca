"""Building blocks that stay exact and parallel when one key holds much of the data.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here the keys
with more than ``split_rows`` rows are found first (one map-side combined count); if there
are none, the plain window is the whole plan. Otherwise the rows of those keys are
range-partitioned by (key, order), which makes balanced *chunks* whatever the distribution
of the key, and what a chunk must know of the earlier ones travels as a small table: running
totals (one row per key and chunk) or the last few rows of the earlier chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.session import cut_lineage

SPLIT_ROWS_CONF = "formlake.split.rows"
MAX_KEYS_CONF = "formlake.split.maxKeys"
MAX_CHUNKS_CONF = "formlake.split.maxChunks"

#: Rows that a task sorts in memory, also where they are wide.
TASK_ROWS = 180_000

_CHUNK = "_chunk"
_HALO = "_halo"


@dataclass(frozen=True)
class SplitPolicy:
    """All keys above ``split_rows`` rows are split, into chunks of about a quarter of that, and of ``TASK_ROWS`` at most.

    Tables with one row per split key, or per split key and chunk, are broadcast up to ``max_keys``
    keys and ``max_chunks`` chunks, and joined by shuffle beyond.
    """

    split_rows: int = 2_000_000
    max_keys: int = 10_000
    max_chunks: int = 20_000

    @property
    def chunk_rows(self) -> int:
        return max(1, min(self.split_rows // 4, TASK_ROWS))

    def chunks(self, n_rows: int) -> int:
        return max(2, -(-n_rows // self.chunk_rows))

    def sized(self, df: DataFrame, n_keys: int, n_rows: int = 0) -> DataFrame:
        """Marks a table of split keys (and chunks of ``n_rows`` rows) for broadcast if it is small."""
        few_chunks = not n_rows or self.chunks(n_rows) <= self.max_chunks
        return F.broadcast(df) if n_keys <= self.max_keys and few_chunks else df

    @classmethod
    def of(cls, spark: SparkSession) -> SplitPolicy:
        return cls(
            int(spark.conf.get(SPLIT_ROWS_CONF, str(cls.split_rows))),
            int(spark.conf.get(MAX_KEYS_CONF, str(cls.max_keys))),
            int(spark.conf.get(MAX_CHUNKS_CONF, str(cls.max_chunks))),
        )


@dataclass(frozen=True)
class HotKeys:
    """The split keys, as a table however many there are; ``n_rows`` are the rows they have together."""

    keys: tuple[str, ...]
    frame: DataFrame
    n_keys: int
    n_rows: int
    policy: SplitPolicy


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join where NULL keys match each other; the right keys are dropped."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    # Null-safe equality is still hashable, so this stays a hash or merge join.
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(right, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


class KeyScan:
    """Finds the over-full keys of a table, counting its rows only once."""

    def __init__(self, df: DataFrame, policy: SplitPolicy | None = None):
        self.df = df
        self.policy = policy or SplitPolicy.of(df.sparkSession)
        self._rows: int | None = None
        self._known: dict[tuple[str, ...], HotKeys | None] = {}

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    def hot(self, keys: Sequence[str]) -> HotKeys | None:
        keys = tuple(keys)
        if keys not in self._known:
            self._known[keys] = self._find(keys)
        return self._known[keys]

    def _find(self, keys: tuple[str, ...]) -> HotKeys | None:
        coarser_is_fine = any(
            found is None and set(known) <= set(keys) for known, found in self._known.items()
        )
        if coarser_is_fine or self.rows <= self.policy.split_rows:
            return None
        over = (
            self.df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") > self.policy.split_rows)
        )
        found = over.limit(self.policy.max_keys + 1).collect()
        if not found:
            return None
        if len(found) <= self.policy.max_keys:
            frame = self.df.sparkSession.createDataFrame(found, over.schema)
        else:
            frame = cut_lineage(over)
        n_keys, n_rows = frame.agg(F.count(F.lit(1)), F.sum("_rows")).first()
        return HotKeys(keys, frame.select(*keys), n_keys, n_rows, self.policy)


def dealt(df: DataFrame, keys: Sequence[str], n_rows: int) -> DataFrame:
    """The rows dealt by key to as many tasks as keep each below ``TASK_ROWS`` on average, so that sorts don't spill.

    Where ``spark.sql.shuffle.partitions`` is enough for that, Spark's own exchange does it.
    """
    tasks = -(-n_rows // TASK_ROWS)
    enough = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if tasks <= enough else df.repartition(tasks, *[F.col(k) for k in keys])


def regrouped(df: DataFrame, keys: Sequence[str], n_rows: int) -> DataFrame:
    """As ``dealt``, but dealt by just these keys in any case, so that groupings by finer keys find their rows there."""
    enough = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(enough, -(-n_rows // TASK_ROWS)), *[F.col(k) for k in keys])


def split_hot(df: DataFrame, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of over-full keys)."""
    keys = hot.policy.sized(hot.frame, hot.n_keys)
    return match(df, keys, hot.keys, "left_anti"), match(df, keys, hot.keys, "left_semi")


def ordered_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n_rows: int, policy: SplitPolicy
) -> DataFrame:
    """Adds ``_chunk``: balanced, contiguous in (keys, order), increasing in that order.

    The checkpoint makes the chunk numbers the same for every reader: range bounds are
    sampled, so a second evaluation could cut elsewhere.
    """
    ranged = df.repartitionByRange(policy.chunks(n_rows), *[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn(_CHUNK, F.spark_partition_id()))


def _sums_before(df: DataFrame, part: Sequence[str], order, totals: dict[str, Column]) -> DataFrame:
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({
        name: F.coalesce(F.sum(value).over(frame), F.lit(0)) for name, value in totals.items()
    })


def chunked_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: dict[str, Column], n_rows: int,
    policy: SplitPolicy, n_keys: int = 1,
) -> DataFrame:
    """``running_totals`` where all keys are split; ``n_rows`` only sets the number of chunks."""
    parts = ordered_chunks(df, keys, order, n_rows, policy)
    per_chunk = parts.groupBy(*keys, _CHUNK).agg(
        *[F.sum(value).alias(f"_t_{name}") for name, value in totals.items()]
    )
    # One row per key and chunk: at most (number of chunks + number of split keys).
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *keys, _CHUNK,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in totals],
    )
    rows = _sums_before(dealt(parts, [*keys, _CHUNK], n_rows), [*keys, _CHUNK], order, totals)
    out = match(rows, policy.sized(carry, n_keys, n_rows), [*keys, _CHUNK], "left")
    return out.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in totals}).drop(
        _CHUNK, *[f"_c_{n}" for n in totals]
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: dict[str, Column],
    scan: KeyScan | None = None,
) -> DataFrame:
    """Adds, per output name, the sum of a value over the earlier rows of the same key.

    With no keys the whole table is one ordered sequence, cut into chunks unless one chunk
    holds it.
    """
    scan = scan or KeyScan(df)
    if not keys:
        if scan.rows <= scan.policy.chunk_rows:
            return _sums_before(df, [], order, totals)
        return chunked_totals(df, [], order, totals, scan.rows, scan.policy)
    hot = scan.hot(keys)
    if hot is None:
        return _sums_before(df, keys, order, totals)
    cold_rows, hot_rows = split_hot(df, hot)
    return _sums_before(cold_rows, keys, order, totals).unionByName(
        chunked_totals(hot_rows, keys, order, totals, hot.n_rows, scan.policy, hot.n_keys)
    )


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, scan: KeyScan | None = None
) -> DataFrame:
    """Adds the 1-based position of each row in its key's order (``row_number``, split-safe)."""
    out = running_totals(df, keys, order, {name: F.lit(1)}, scan)
    return out.withColumn(name, (F.col(name) + 1).cast("long"))


def _with_halo(parts, keys, order, depth, carried, observed) -> DataFrame:
    """Prepends to every chunk the last ``depth`` observed rows of the key's earlier chunks."""
    newest_first = [F.desc(c) for c in order]
    seen = parts.where(observed) if observed is not None else parts
    tails = (
        seen.select(*keys, _CHUNK, *order, *carried)
        .withColumn("_back", F.row_number().over(
            Window.partitionBy(*keys, _CHUNK).orderBy(*newest_first)))
        .where(F.col("_back") <= depth)
        .drop("_back")
    )
    # All of what follows has at most depth rows per key and chunk.
    has_tail = F.max(F.lit(True) if observed is None else observed)
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    chunks = parts.groupBy(*keys, _CHUNK).agg(has_tail.cast("int").alias("_has")).withColumn(
        "_filled", F.coalesce(F.sum("_has").over(before), F.lit(0))
    )
    numbered = match(tails, chunks.select(*keys, _CHUNK, "_filled"), [*keys, _CHUNK], "inner")
    numbered = numbered.withColumnsRenamed({_CHUNK: "_from", "_filled": "_slot"})
    slots = F.sequence(F.greatest(F.col("_filled") - depth, F.lit(0)), F.col("_filled") - 1)
    targets = chunks.where("_filled > 0").select(*keys, _CHUNK, F.explode(slots).alias("_slot"))
    halo = (
        match(targets, numbered, [*keys, "_slot"], "inner")
        .withColumn("_back", F.row_number().over(
            Window.partitionBy(*keys, _CHUNK).orderBy(*newest_first)))
        .where(F.col("_back") <= depth)
        .drop("_back", "_slot", "_from")
        .withColumn(_HALO, F.lit(True))
    )
    return parts.withColumn(_HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)


def with_lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    depth: int,
    carried: Sequence[str],
    apply: Callable[[DataFrame, list[str]], DataFrame],
    scan: KeyScan | None = None,
    observed: Column | None = None,
) -> DataFrame:
    """Runs ``apply(rows, partition_columns)`` where it reads at most ``depth`` rows back.

    ``carried`` are the columns it reads of earlier rows; with ``observed`` only rows meeting
    that condition count as history.
    """
    scan = scan or KeyScan(df)
    hot = scan.hot(keys)
    if hot is None:
        return apply(df, list(keys))
    cold_rows, hot_rows = split_hot(df, hot)
    parts = ordered_chunks(hot_rows, keys, [F.col(c) for c in order], hot.n_rows, scan.policy)
    carried = [c for c in dict.fromkeys(carried) if c not in {*keys, *order}]
    haloed = _with_halo(parts, keys, order, depth, carried, observed)
    done = apply(dealt(haloed, [*keys, _CHUNK], hot.n_rows), [*keys, _CHUNK]).where(~F.col(_HALO)).drop(_HALO, _CHUNK)
    return apply(cold_rows, list(keys)).unionByName(done)


def with_group_values(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], scan: KeyScan | None = None
) -> DataFrame:
    """Adds aggregates of the row's group to every row."""
    scan = scan or KeyScan(df)
    hot = scan.hot(keys)
    over = Window.partitionBy(*keys)
    if hot is None:
        return df.withColumns({name: agg.over(over) for name, agg in values.items()})
    cold_rows, hot_rows = split_hot(df, hot)
    cold = cold_rows.withColumns({name: agg.over(over) for name, agg in values.items()})
    # One row per split key.
    per_key = hot_rows.groupBy(*keys).agg(*[agg.alias(name) for name, agg in values.items()])
    return cold.unionByName(match(hot_rows, hot.policy.sized(per_key, hot.n_keys), keys, "left"))


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    scan: KeyScan | None = None,
) -> DataFrame:
    """Join to a table with one row per key; over-full left keys meet a broadcast slice of it."""
    scan = scan or KeyScan(left)
    hot = scan.hot(keys)
    if hot is None:
        return match(left, right, keys, how)
    cold_rows, hot_rows = split_hot(left, hot)
    _, hot_right = split_hot(right, hot)  # unique keys: one row per split key
    return match(cold_rows, right, keys, how).unionByName(
        match(hot_rows, hot.policy.sized(hot_right, hot.n_keys), keys, how)
    )
