"""The newest row of every key, kept up to date by a stream of results, for scoring without a scan of all history.

The state is a table in hash buckets of the key. An update reads and rewrites only the buckets that the new rows fall into,
each as a folder of its own, and one pointer then names the folders of all buckets. It grows with the number of
keys, not with the results; updating again with rows already seen changes nothing, so a retried batch is harmless.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.operators.context import CONTEXT_COLUMNS
from formlake.sources.versions import new_version, read_pointer, set_pointer

_BUCKET = "_bucket"


@dataclass(frozen=True)
class LatestRows:
    """The newest row by ``order`` of each ``key``, with the ``payload`` columns. Rows without a key aren't kept."""

    path: str
    key: str = "horse"
    order: Sequence[str] = ("date", "id")
    payload: Sequence[str] = tuple(CONTEXT_COLUMNS)
    buckets: int = 64

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.key, *self.order, *self.payload]))

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folders(self, spark: SparkSession) -> dict[str, str]:
        pointer = read_pointer(spark, self.path)
        return pointer["buckets"] if pointer else {}

    def _read(self, spark: SparkSession, numbers: Sequence[int], like: DataFrame | None = None) -> DataFrame | None:
        """The stored rows of some buckets; nothing else is opened."""
        folders = self._folders(spark)
        paths = sorted(f"{self.path}/{folders[str(b)]}/{_BUCKET}={b}" for b in numbers if str(b) in folders)
        if not paths:
            return None
        reader = spark.read if like is None else spark.read.schema(like.schema)
        return reader.parquet(*paths).select(*self.columns)

    def _touched(self, rows: DataFrame) -> list[int]:
        found = rows.select(self._bucket().alias("b")).distinct().collect()  # at most ``buckets`` numbers
        return sorted(r["b"] for r in found)

    def update(self, rows: DataFrame) -> None:
        """Takes in new results, in any order, seen before or not."""
        spark = rows.sparkSession
        rows = rows.select(*self.columns).where(F.col(self.key).isNotNull())
        touched = self._touched(rows)
        if not touched:
            return
        known = self._read(spark, touched, rows)
        every = rows if known is None else rows.unionByName(known)
        # Spark keeps one row of a key in every task before it shuffles (its window group limit).
        newest = Window.partitionBy(self.key).orderBy(*[F.col(c).desc_nulls_last() for c in self.order])
        kept = every.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")
        version = new_version()
        kept.withColumn(_BUCKET, self._bucket()).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{version}")
        folders = self._folders(spark) | {str(b): version for b in touched}
        set_pointer(spark, self.path, {"buckets": folders})

    def rows(self, spark: SparkSession) -> DataFrame | None:
        return self._read(spark, range(self.buckets))

    def of(self, batch: DataFrame) -> DataFrame | None:
        """The newest rows of the batch's keys, read from their buckets only."""
        keys = batch.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        known = self._read(batch.sparkSession, self._touched(keys))
        return None if known is None else known.join(keys, self.key, "left_semi")


def follow_results(
    spark: SparkSession, in_dir: str, schema, state: LatestRows, checkpoint: str, files_per_batch: int = 10_000
) -> None:
    """Takes the result files (Parquet, with their features) not seen before into the state."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.parquet(in_dir).writeStream.foreachBatch(lambda batch, _: state.update(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def score_with_state(state: LatestRows, empty: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame]):
    """For ``score_cards_stream``: ``score(cards, newest rows)`` of a batch's runners. ``empty`` has the columns of
    history and no row, for a batch of which nothing is known."""

    def run(cards: DataFrame) -> DataFrame:
        known = state.of(cards)
        return score(cards, empty if known is None else known)

    return run
