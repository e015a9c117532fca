"""CSV, results, feature-table and matrix readers and writers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions.parsing import na_to_null
from formlake.operators.skew import positions
from formlake.sources.versions import current_table, new_version, read_pointer, replace_table, set_pointer

# Columns each history family reads.
FAMILY_COLUMNS = {
    "synergy": ["id", "date", "trainer", "jockey", "pos"],
    "course": ["id", "date", "horse", "course", "pos"],
    "form": ["id", "date", "horse", "pos", "btn"],
    "class": ["id", "date", "horse", "class"],
    "micro": ["id", "race_id", "horse", "date", "hg", "official_rating", "jockey_allowance",
              "wgt_lbs", "prize"],
}


def read_results_csv(
    spark: SparkSession, path: str, nrows: int | None = None, multiline: bool = False
) -> DataFrame:
    """Header CSV as text columns by name; missing-value tokens become NULL.

    Quotes are doubled inside quoted fields. ``multiline`` allows line breaks in them, at the
    price that a file can no longer be split between tasks.
    """
    raw = spark.read.csv(path, header=True, escape='"', multiLine=multiline)
    if nrows is not None:
        raw = raw.limit(nrows)
    return raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def stored_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_results(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Appends rows to the results table with fresh ids, and returns the table.

    Ids count up from the largest one stored, in order of date, race, number and horse (then
    all other columns, so ties are equal rows). The numbering is a distributed running count.
    """
    spark = df.sparkSession
    first = 0
    known = stored_results(spark, path) if mode == "append" else None
    if known is not None:
        first = known.agg(F.max("id")).first()[0] or 0
    columns = [c for c in df.columns if c != "id"]
    leading = [c for c in ("date", "race_id", "num", "horse") if c in columns]
    order = [F.col(f"`{c}`") for c in [*leading, *[c for c in columns if c not in leading]]]
    numbered = positions(df.select(*columns), [], order, "id")
    out = numbered.withColumn("id", F.col("id") + first).withColumn("year", F.year("date"))
    out.select("id", *columns, "year").write.mode(mode).partitionBy("year").parquet(path)
    return read_results(spark, path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unknown_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str] = ("race_id", "horse")) -> DataFrame:
    """The new rows whose key is not there yet, one of each key.

    A NULL in a key matches nothing: such rows are all kept.
    """
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    fresh = new.where(keyed).dropDuplicates(list(keys))
    fresh = fresh.join(existing.select(*keys).where(keyed), list(keys), "left_anti")
    return fresh.select(*new.columns).unionByName(new.where(~keyed))


def dedupe_append(
    new: DataFrame, existing: DataFrame, keys: Sequence[str] = ("race_id", "horse")
) -> DataFrame:
    """Existing rows plus the new ones whose key is not there yet (see ``unknown_rows``)."""
    return existing.unionByName(unknown_rows(new, existing, keys), allowMissingColumns=True)


def write_features(
    df: DataFrame, path: str, key: str = "res_id", buckets: int | None = None, table: str | None = None
) -> DataFrame:
    """Replaces a feature table as a whole (see ``versions``): a write that fails leaves the old one readable.

    With ``buckets`` it is saved as a table bucketed by its key, one sorted file a bucket, so that joins on the key
    need no shuffle. The new table takes the name when it is complete.
    """
    spark = df.sparkSession
    if not buckets:
        return replace_table(df, path)
    if not table:
        raise ValueError("a bucketed feature table needs a table name")
    version = new_version()
    draft = f"{table}_{version[2:]}"
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{version}").saveAsTable(draft)
    set_pointer(spark, path, {"version": version, "table": table})
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    spark.sql(f"ALTER TABLE `{draft}` RENAME TO `{table}`")  # its files stay where they are
    return spark.table(table)


def read_features(spark: SparkSession, path: str) -> DataFrame | None:
    """The feature table last written whole to ``path``."""
    pointer = read_pointer(spark, path)
    if pointer is None:
        return None
    name = pointer.get("table")
    return spark.table(name) if name and spark.catalog.tableExists(name) else current_table(spark, path)


def scan_history(spark: SparkSession, path: str, family: str) -> DataFrame:
    """The columns one feature family needs; order belongs to the windows, not to the scan."""
    return spark.read.parquet(path).select(*FAMILY_COLUMNS[family])


def write_matrix(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").parquet(path)
    return read_matrix(df.sparkSession, path, fmt, df)


def read_matrix(
    spark: SparkSession, path: str, fmt: str = "parquet", like: DataFrame | None = None
) -> DataFrame:
    """The training matrix with ``date`` as a date; a CSV takes its types from ``like``."""
    if fmt == "csv":
        reader = spark.read.schema(like.schema) if like is not None else spark.read
        return reader.csv(path, header=True).withColumn("date", F.col("date").cast("date"))
    return spark.read.parquet(path).withColumn("date", F.col("date").cast("date"))


def table_profile(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Every table of the catalog: row count, and ordinal, name, type and key flag of its columns."""
    out = None
    for found in spark.catalog.listTables(database):
        name = found.name if found.isTemporary or not database else f"{database}.{found.name}"
        rows = spark.table(name).agg(F.count(F.lit(1)).alias("row_count"))
        columns = spark.catalog.listColumns(name)
        described = [
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(c.name).alias("column_name"),
                F.lit(c.dataType).alias("column_type"),
                F.lit(bool(c.isBucket) or c.name in ("id", "res_id")).alias("is_key"),
            )
            for i, c in enumerate(columns)
        ]
        part = rows.select(
            F.lit(found.name).alias("table_name"), "row_count", F.explode(F.array(*described)).alias("c")
        ).select("table_name", "row_count", "c.*")
        out = part if out is None else out.unionByName(part)
    return out
