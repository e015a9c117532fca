"""Data-quality counts and summaries.

Everything per race is counted on a table already aggregated by race on the map side, so a
race of any size arrives as one partial row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake import courses
from formlake.functions import parsing


def _pos(df: DataFrame) -> tuple[Column, Column]:
    raw = F.col("pos_raw") if "pos_raw" in df.columns else F.col("pos")
    num = F.col("pos_num") if "pos_num" in df.columns else parsing.position_number("pos")
    return raw, num


def _weight(df: DataFrame) -> Column:
    return F.col("wgt_lbs") if "wgt_lbs" in df.columns else parsing.parse_weight("wgt")


def audit_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    races = F.approx_count_distinct("race_id") if approx else F.count_distinct("race_id")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), races.alias("unique_races"))


def audit_winners(df: DataFrame) -> DataFrame:
    """Races with no winner, and with several."""
    _, num = _pos(df)
    per_race = df.where(F.col("race_id").isNotNull()).groupBy("race_id").agg(
        F.sum(parsing.is_win(num)).alias("wins")
    )
    return per_race.agg(
        F.count_if(F.col("wins") == 0).alias("no_winner"),
        F.count_if(F.col("wins") > 1).alias("multi_winner"),
    )


def _null_checks(df: DataFrame) -> dict[str, Column]:
    raw, num = _pos(df)
    return {
        "null_pos": raw.isNull(),
        "null_btn": F.col("btn").isNull() & parsing.beyond(raw, num, 1),
        "null_wgt": _weight(df).isNull(),
    }


def audit_nulls(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(check).alias(name) for name, check in _null_checks(df).items()])


def audit_yearly(df: DataFrame) -> DataFrame:
    """Distinct races per year, in order of year."""
    return (
        df.groupBy(F.year("date").alias("year"))
        .agg(F.count_distinct("race_id").alias("race_count"))
        .orderBy("year")
    )


def _logical_error(df: DataFrame) -> Column:
    raw, num = _pos(df)
    return parsing.beyond(raw, num, 1) & (F.col("btn") == 0)


def audit_logical_errors(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(_logical_error(df)).alias("logical_errors"))


def data_audit(df: DataFrame) -> DataFrame:
    """Every audit as (metric, period, value) rows, in one pass over the results.

    Rows are counted by race and year, which gives the races of each year, and then by race; every race emits
    its share of each metric, and the shares are summed. All of it is counts, so no task gathers sets.
    """
    _, num = _pos(df)
    checks = {**_null_checks(df), "logical_errors": _logical_error(df)}
    counted = ["_wins", "total_rows", *checks]
    parts = df.groupBy("race_id", F.year("date").alias("_year")).agg(
        F.sum(parsing.is_win(num)).alias("_wins"), F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(check).alias(name) for name, check in checks.items()],
    )
    races = parts.groupBy("race_id").agg(*[F.sum(c).alias(c) for c in counted])
    known = F.col("race_id").isNotNull()
    shares = {
        "total_rows": F.col("total_rows"),
        "unique_races": known,
        "no_winner": known & (F.col("_wins") == 0),
        "multi_winner": known & (F.col("_wins") > 1),
        **{name: F.col(name) for name in checks},
    }

    def share(metric: str, period, value) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), period.cast("int").alias("period"),
            value.cast("long").alias("value"),
        )

    nothing = F.lit(None)
    scalars = F.array(*[share(metric, nothing, value) for metric, value in shares.items()])
    # An empty table still reports its zeros.
    zeros = df.sparkSession.range(1).select(
        F.explode(F.array(*[share(metric, nothing, F.lit(0)) for metric in shares])).alias("m")
    )
    yearly = parts.where(F.col("_year").isNotNull()).groupBy("_year").agg(F.count("race_id").alias("value")).select(
        F.lit("races_in_year").alias("metric"), F.col("_year").alias("period"), "value")
    emitted = races.select(F.explode(scalars).alias("m")).unionByName(zeros).select("m.*")
    return emitted.groupBy("metric", "period").agg(F.sum("value").alias("value")).unionByName(yearly)


def coverage_summary(
    raw: DataFrame, values: Iterable[str] = courses.ALLOWED_COURSES, col: str = "course"
) -> DataFrame:
    """Total rows, allowlisted rows and their share in percent."""
    listed = F.coalesce(F.trim(col).isin(list(values)), F.lit(False))
    counted = raw.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(listed).alias("listed_rows"))
    share = F.col("listed_rows") / F.nullif(F.col("total_rows"), F.lit(0)) * 100
    return counted.withColumn("listed_pc", F.round(share, 2))


def date_range(df: DataFrame, col: str = "date") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.min(col).alias("first_date"),
        F.max(col).alias("last_date"),
    )


def feature_null_check(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row with the NULL count of one column per feature table."""
    counts = [
        df.agg(F.count_if(F.col(col).isNull()).alias("nulls")).withColumn("_table", F.lit(name))
        for name, (df, col) in tables.items()
    ]
    stacked = reduce(DataFrame.unionByName, counts)  # one row per table
    return stacked.agg(*[
        F.max(F.when(F.col("_table") == name, F.col("nulls"))).alias(f"null_{name}") for name in tables
    ])


def frequent_entity(df: DataFrame, key: str = "horse", min_runs: int = 15) -> DataFrame:
    """The entity with most runs, if it has more than ``min_runs``; ties go to the first name."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("runs"))
        .where(F.col("runs") > min_runs)
        .orderBy(F.desc("runs"), key)
        .limit(1)
    )


def matrix_summary(matrix: DataFrame) -> DataFrame:
    return matrix.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct("race_id").alias("unique_races"),
        F.avg("target_win").alias("win_rate"),
    )


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runners per group, in group order; rows with a NULL key belong to no group."""
    whole = df.dropna(subset=list(keys))
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("runners")).orderBy(*keys)
