"""Raw CSV to the results table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake import courses
from formlake.functions import parsing
from formlake.operators import cleaning
from formlake.session import scratch_path
from formlake.sources import tables

LIGHT_NUMERIC = ["age", "ran", "pos", "draw", "official_rating", "rpr", "ts", "prize"]
LIGHT_STRINGS = ["horse", "jockey", "trainer", "sex", "going", "type", "class", "race_name"]


def clean_results(raw: DataFrame, values: Iterable[str] = courses.ALLOWED_COURSES) -> DataFrame:
    """Allowlist, dates, weights and the declared columns, with ``id`` still NULL."""
    kept = cleaning.allowlist_filter(raw, "course", values)
    kept = cleaning.coerce_date(kept, "date")
    if "wgt" in kept.columns:
        kept = kept.withColumn("wgt_lbs", parsing.parse_weight("wgt"))
    return cleaning.conform_schema(kept)


def clean_light(raw: DataFrame, values: Iterable[str] = courses.ALLOWED_COURSES) -> DataFrame:
    """The exploratory load: every column kept, numbers and strings cleaned, nothing stored."""
    kept = cleaning.coerce_date(raw.withColumnsRenamed({"[or]": "official_rating"}), "date")
    kept = cleaning.allowlist_filter(kept, "course", values)
    kept = cleaning.coerce_numeric(kept, LIGHT_NUMERIC)
    return cleaning.clean_strings(kept, LIGHT_STRINGS)


def ingest(
    spark: SparkSession,
    csv: str,
    out: str | None = None,
    profile: str = "full",
    values: Iterable[str] = courses.ALLOWED_COURSES,
    nrows: int | None = None,
    mode: str = "append",
) -> DataFrame:
    """Reads, cleans and (profile 'full') stores the CSV; returns the results.

    Appending adds only rows whose race and horse are not stored yet, so a rerun adds nothing; rows without
    a race or horse can't be told apart and are added again. Rows without a usable date cannot be ordered, so
    they go to ``<out>_quarantine``, which a run replaces.
    """
    raw = tables.read_results_csv(spark, csv, nrows)
    if profile == "light":
        return clean_light(raw, values)
    # Parse the text once; numbering and the quarantine then read columns.
    staged = scratch_path(spark, "ingest-staging")
    clean_results(raw, values).write.parquet(staged)
    stored = store_cleaned(spark.read.parquet(staged), out, mode)
    spark.range(0).write.mode("overwrite").parquet(staged)  # frees the staged copy
    return stored


def store_cleaned(cleaned: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Numbers cleaned rows and adds those that are new to the results table; undated rows go to quarantine.

    This also compacts what ``incremental_ingest`` has written, as often as one likes.
    """
    cleaned.where(F.col("date").isNull()).write.mode("overwrite").parquet(f"{out}_quarantine")
    dated = cleaned.where(F.col("date").isNotNull())
    known = tables.stored_results(cleaned.sparkSession, out) if mode == "append" else None
    if known is not None:
        dated = tables.unknown_rows(dated, known)
    return tables.write_results(dated, out, mode)
