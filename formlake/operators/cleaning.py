"""Projections, filters and repairs on results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formlake import courses, schema
from formlake.functions import parsing


def allowlist_filter(
    df: DataFrame, col: str = "course", values: DataFrame | Iterable[str] = courses.ALLOWED_COURSES
) -> DataFrame:
    """Trims the column and keeps the listed values.

    A Python list becomes an ``isin`` at the scan. A one-column table of any size is met by a semi-join, also of a
    stream; the optimizer broadcasts it if it is small, and can split a course with very many rows.
    """
    trimmed = df.withColumn(col, F.trim(col))
    if not isinstance(values, DataFrame):
        return trimmed.where(F.col(col).isin(list(values)))
    allowed = values.toDF(col).dropna().distinct()
    return trimmed.join(allowed, col, "left_semi")


def coerce_date(
    df: DataFrame, col: str = "date", formats: Sequence[str] = parsing.DATE_FORMATS
) -> DataFrame:
    return df.withColumn(col, parsing.to_date_or_null(col, formats))


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Listed columns that exist become doubles, NULL where they are not numbers."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: parsing.to_number(F.col(f"`{c}`")) for c in present})


def clean_strings(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: parsing.clean_string(c) for c in present})


def conform_schema(
    df: DataFrame,
    target: T.StructType = schema.RESULTS_SCHEMA,
    renames: dict[str, str] = schema.RAW_RENAMES,
) -> DataFrame:
    """Rename, add missing columns as NULL, cast, put in order; other columns are dropped.

    Text that is not a number becomes NULL; integer columns accept '7.0'.
    """
    renamed = df.withColumnsRenamed(renames)
    types = dict(renamed.dtypes)

    def column(field: T.StructField) -> Column:
        if field.name not in types:
            return F.lit(None).cast(field.dataType)
        c = F.col(f"`{field.name}`")
        if types[field.name] == "string" and isinstance(field.dataType, T.NumericType):
            if isinstance(field.dataType, T.LongType):  # a double would lose digits of long ids
                whole = F.trim(c).try_cast("bigint")
                return F.coalesce(whole, parsing.to_number(c).try_cast("bigint"))
            return parsing.to_number(c).try_cast(field.dataType)
        if types[field.name] == "string" and isinstance(field.dataType, T.DateType):
            return parsing.to_date_or_null(c)
        return c.cast(field.dataType)

    return renamed.select(*[column(f).alias(f.name) for f in target.fields])


def split_position(df: DataFrame, col: str = "pos") -> DataFrame:
    """Position text to ``pos_raw``, ``pos_num`` and ``finished``."""
    num = parsing.position_number(col)
    return df.withColumns({"pos_raw": F.col(col), "pos_num": num, "finished": num.isNotNull()})


def _late_zero(df: DataFrame) -> tuple[Column, Column]:
    raw = F.col("pos_raw") if "pos_raw" in df.columns else F.col("pos")
    num = F.col("pos_num") if "pos_num" in df.columns else parsing.position_number("pos")
    zero = F.coalesce(F.col("btn") == 0, F.lit(False))
    near = zero & F.coalesce(num.isin(2, 3), F.lit(False))
    return near, zero & parsing.beyond(raw, num, 3)


def fix_margins(df: DataFrame, near: float = 0.01, far: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """Zero margins of beaten runners: a nose for 2nd and 3rd, trailed off for the rest.

    Returns the repaired rows and the two counts of adjusted rows.
    """
    close, late = _late_zero(df)
    fixed = df.withColumn("btn", F.when(close, near).when(late, far).otherwise(F.col("btn")))
    counts = df.agg(
        F.count_if(close).alias("close_fixed"), F.count_if(late).alias("far_fixed")
    )
    return fixed, counts


def fill_nulls(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def win_place_flags(df: DataFrame, places: int = 3) -> DataFrame:
    num = F.col("pos_num") if "pos_num" in df.columns else parsing.position_number("pos")
    return df.withColumns({
        "is_win": parsing.is_win(num), "is_place": parsing.is_place(num, places),
        "target_win": parsing.is_win(num),
    })


TYPES = ("Flat", "AWT")


def type_matches(patterns: Sequence[str] = TYPES) -> Column:
    """The type contains one of the patterns, in any case."""
    return reduce(lambda a, b: a | b, [F.col("type").ilike(f"%{p}%") for p in patterns])


def type_filter(
    df: DataFrame, patterns: Sequence[str] = TYPES, required: Sequence[str] = ("avg_btn_3",)
) -> DataFrame:
    """Rows of matching type whose required columns are set."""
    wanted = type_matches(patterns)
    for name in required:
        wanted = wanted & F.col(name).isNotNull()
    return df.where(wanted)


def _since(df: DataFrame, col: str, cutoff: date, later: bool) -> Column:
    day = F.lit(cutoff)
    if later:
        condition = F.col(col) >= day
        return condition & (F.col("year") >= cutoff.year) if "year" in df.columns else condition
    condition = F.col(col) < day
    return condition & (F.col("year") <= cutoff.year) if "year" in df.columns else condition


def temporal_split(df: DataFrame, cutoff: date, col: str = "date") -> tuple[DataFrame, DataFrame]:
    """(before the cutoff, from the cutoff on); prunes ``year`` folders where there are any."""
    return df.where(_since(df, col, cutoff, False)), df.where(_since(df, col, cutoff, True))


def error_sample(df: DataFrame, n: int = 20) -> DataFrame:
    """First rows, by id, placed after 1st with margin 0."""
    raw = F.col("pos_raw") if "pos_raw" in df.columns else F.col("pos")
    num = F.col("pos_num") if "pos_num" in df.columns else parsing.position_number("pos")
    wrong = df.where(parsing.beyond(raw, num, 1) & (F.col("btn") == 0))
    shown = [c for c in ("date", "course", "race_name", "pos", "btn", "horse", "comment") if c in df.columns]
    return wrong.orderBy("id").select("id", *shown).limit(n)
