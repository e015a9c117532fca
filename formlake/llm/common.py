"""Stored intermediate tables and joins whose broadcast side is counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.session import scratch_path

#: A side of a join is broadcast up to so many rows of a few numbers each (about 20 MB).
BROADCAST_ROWS = 500_000


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared scratch folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch = path
    return stored


def release(*tables: DataFrame) -> None:
    """Frees what ``store`` wrote, by writing nothing over it."""
    for table in tables:
        table.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(table._scratch)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.select(F.lit(1).alias("one")).limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if it has at most ``rows`` rows; beyond that the join shuffles."""
    return F.broadcast(df) if is_small(df, rows) else df


def distinct_names(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Only the wanted columns, under the operator's own names, so that extra columns can't clash.

    A column that is named None is null.
    """
    return df.select(*[
        (F.lit(None).cast("string") if column is None else df[column]).alias(name)
        for name, column in wanted.items()
    ])
