"""All history features in one pass, and the training matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake import schema
from formlake.functions import parsing
from formlake.operators import history
from formlake.operators.cleaning import fill_nulls, type_filter, type_matches
from formlake.operators.skew import KeyScan


FAMILY_KEYS = (["race_id"], ["trainer", "jockey"], ["horse"], ["horse", "course"])


def build_features(
    results: DataFrame,
    same_day: str = "earlier_rows",
    null_keys: str = "shared",
) -> DataFrame:
    """Results plus the five feature families.

    Three shuffles while no key is over-full: by race, by trainer and jockey, by horse (which
    also serves horse and course). Rows get wider with every family, so the one that adds one
    column goes first and the one that adds nine goes last, after the last shuffle.

    A family with over-full keys is computed from its own few columns and joined by id, as its chunks are written
    out and would repeat the families before it; the others stay in the one pass.
    """
    scan = KeyScan(results)
    split = {tuple(keys): scan.hot(keys) is not None for keys in FAMILY_KEYS}
    how = {"scan": scan, "null_keys": null_keys}

    def race(df: DataFrame) -> DataFrame:
        return history.add_race_value(df, scan=scan).drop("race_value")

    def pair(df: DataFrame) -> DataFrame:
        return history.add_pair_stats(df, same_day=same_day, **how)

    def horse(df: DataFrame) -> DataFrame:
        return history.add_lookbacks(df, "horse", history.horse_families(df), scan, null_keys)

    def course(df: DataFrame) -> DataFrame:
        return history.add_place_stats(df, **how)

    families = (
        (("race_id",), race, ["race_id", "prize"], ["log_prize"]),
        (("trainer", "jockey"), pair, ["date", "trainer", "jockey", "pos"], schema.SYNERGY_COLUMNS),
        (("horse",), horse, ["date", "horse", "pos", "btn", "class", "hg", "official_rating"],
         [*schema.FORM_COLUMNS, *schema.CLASS_COLUMNS, "gear_change", "or_change"]),
        (("horse", "course"), course, ["date", "horse", "course", "pos"], schema.COURSE_COLUMNS),
    )
    out, apart, before = results.withColumn("true_wgt", history.true_weight_of(results)), [], None
    for keys, add, needed, added in families:
        if split[keys]:
            apart.append(add(history.narrow(results, *needed)).select("id", *added))
            continue
        # Rows dealt by horse are dealt by horse and course as well.
        with_it = before and set(before) <= set(keys)
        out, before = add(out if with_it else history.deal(out, keys, scan, null_keys)), keys
    for table in apart:
        out = out.join(table, "id")
    return out


def _to_matrix(kept: DataFrame) -> DataFrame:
    pos = F.col("pos_num") if "pos_num" in kept.columns else parsing.position_number("pos")
    kept = kept.withColumn("target_win", parsing.is_win(pos))
    if "wgt_lbs" not in kept.columns:
        kept = kept.withColumn("wgt_lbs", parsing.parse_weight("wgt"))
    return fill_nulls(kept.select(*schema.MATRIX_COLUMNS), {c: 0 for c in schema.MICRO_COLUMNS})


def build_matrix(results: DataFrame) -> DataFrame:
    """The training matrix straight from results: no feature tables, no id joins."""
    # The type is needed once, so a flag travels through the shuffles instead of the text.
    flagged = results.withColumn("_kept", type_matches()).drop("type")
    return _to_matrix(build_features(flagged).where("_kept AND avg_btn_3 IS NOT NULL"))


def matrix_of(featured: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns of the training matrix, from results that have their features already."""
    micro = [c for c in schema.MICRO_COLUMNS if c in columns]
    return fill_nulls(type_filter(featured).select(*columns), {c: 0 for c in micro})


def assemble_matrix(
    results: DataFrame,
    synergy: DataFrame,
    course: DataFrame,
    form: DataFrame,
    class_: DataFrame,
    micro: DataFrame,
) -> DataFrame:
    """The training matrix from stored feature tables: inner joins, micro left-joined."""
    out = results
    for table in (synergy, course, form, class_):
        out = out.join(table.withColumnRenamed("res_id", "id"), "id")
    return _to_matrix(type_filter(out.join(micro, "id", "left")))
