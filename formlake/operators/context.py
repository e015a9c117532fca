"""Joins of results, feature tables and race cards."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake import schema
from formlake.functions import parsing
from formlake.operators import history
from formlake.operators.skew import KeyScan, lookup, with_lookback
from formlake.sources.versions import new_version, read_pointer, set_pointer

CONTEXT_COLUMNS = [
    "avg_btn_3", "avg_btn_5", "last_pos", "combo_runs", "combo_win_pc", "h_course_runs",
    "h_course_wins", "class_diff", "avg_class_3", "gear_change", "or_change", "true_wgt",
    "log_prize", "hg", "official_rating",
]


def with_feature_tables(
    results: DataFrame, features: dict[str, DataFrame], how: str = "left"
) -> DataFrame:
    """Results joined by id to feature tables (key ``res_id`` or ``id``)."""
    out = results
    for table in features.values():
        key = "res_id" if "res_id" in table.columns else "id"
        out = out.join(table.withColumnRenamed(key, "id"), "id", how)
    return out


def _month_before(as_of: date | str, months: int) -> Column:
    return F.add_months(F.lit(as_of).cast("date"), -months)


def recent_snapshot(
    tables: dict[str, DataFrame], months: int = 6, as_of: date | str | None = None
) -> dict[str, DataFrame]:
    """The last months of ``results`` and of the feature tables; other tables whole."""
    start = _month_before(as_of, months) if as_of else F.add_months(F.current_date(), -months)
    results = tables["results"]
    kept = results.where(F.col("date") >= start)
    if "year" in results.columns:
        kept = kept.where(F.col("year") >= F.year(start))
    first, last = kept.agg(F.min("id"), F.max("id")).first()
    out = {}
    for name, table in tables.items():
        if name == "results":
            out[name] = kept
        elif name.startswith("features_"):
            key = "res_id" if "res_id" in table.columns else "id"
            ids = kept.select(F.col("id").alias(key))
            # Ids rise with the date, so their range skips most files of the feature table.
            recent = table.where(F.col(key).between(F.lit(first), F.lit(last)))
            out[name] = recent.join(ids, key, "left_semi")
        else:
            out[name] = table
    return out


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Replaces the snapshot as a whole: all its tables go to a new folder, which then becomes the current one."""
    version = new_version()
    for name, table in tables.items():
        table.write.parquet(f"{path}/{version}/{name}")
    set_pointer(next(iter(tables.values())).sparkSession, path, {"version": version, "tables": list(tables)})


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    pointer = read_pointer(spark, path)
    names = pointer["tables"] if pointer else []
    return {name: spark.read.parquet(f"{path}/{pointer['version']}/{name}") for name in names}


def entity_timeline(
    results: DataFrame, features: dict[str, DataFrame], entity: str, key: str = "horse"
) -> DataFrame:
    """One entity's runs with their features, in date order."""
    runs = results.where(F.col(key) == entity)
    out = with_feature_tables(runs, features)
    shown = ["id", "date", "course", "pos", "btn", "combo_win_pc", "h_course_runs", "avg_btn_3",
             "days_since_last"]
    return out.select(*[c for c in shown if c in out.columns]).orderBy("date", "id")


def _newest(df: DataFrame, keys: Sequence[str], payload: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key; every task sends one row per key to the shuffle (Spark's window group limit)."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    best = df.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") == 1)
    return best.select(*keys, *payload)


def latest_context(
    cards: DataFrame,
    history: DataFrame,
    key: str = "horse",
    order: Sequence[str] = ("date", "id"),
    payload: Sequence[str] = tuple(CONTEXT_COLUMNS),
) -> DataFrame:
    """Card rows with the features of each runner's newest result, and ``found``.

    Results of horses on no card are dropped before anything is shuffled by horse.
    """
    wanted = cards.select(key).dropna().distinct()
    seen = lookup(history, wanted, [key], "left_semi")
    newest = _newest(seen, [key], payload, order).withColumn("found", F.lit(True))
    out = lookup(cards, newest.withColumnsRenamed({c: f"ctx_{c}" for c in payload}), [key])
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def asof_context(
    cards: DataFrame,
    history: DataFrame,
    key: str = "horse",
    order: Sequence[str] = ("date", "id"),
    payload: Sequence[str] = tuple(CONTEXT_COLUMNS),
    card_id: Sequence[str] = ("card_date", "region", "course", "off", "number"),
) -> DataFrame:
    """As ``latest_context``, but only results dated before the card count.

    Cards and results form one ordered sequence per horse in which a card row takes the last
    result before it, so cost is linear however many cards a horse is on.
    """
    wanted = cards.select(key).dropna().distinct()
    seen = lookup(history, wanted, [key], "left_semi")
    when, tie = order
    row = F.struct(*[F.col(c) for c in payload])
    past = seen.select(
        key, F.col(when).alias("_when"), F.lit(1).alias("_kind"), F.col(tie).alias("_tie"),
        row.alias("_row"),
    )
    asked = cards.withColumns({
        "_when": F.col("card_date"), "_kind": F.lit(0), "_card": F.lit(True),
    })
    both = asked.unionByName(past, allowMissingColumns=True)

    def apply(rows: DataFrame, part: list[str]) -> DataFrame:
        earlier = Window.partitionBy(*part).orderBy("_when", "_kind", "_tie").rowsBetween(
            Window.unboundedPreceding, -1
        )
        return rows.withColumn("_last", F.last("_row", ignorenulls=True).over(earlier))

    # A card (kind 0) precedes the results of its own day (kind 1).
    out = with_lookback(
        both, [key], ("_when", "_kind", "_tie"), 1, ["_row"], apply, observed=F.col("_kind") == 1
    )
    out = out.where("_card").withColumn("found", F.col("_last").isNotNull())
    fields = {f"ctx_{c}": F.col("_last")[c] for c in payload}
    return out.withColumns(fields).drop("_when", "_kind", "_tie", "_row", "_card", "_last")


def pair_context(
    cards: DataFrame,
    results: DataFrame,
    synergy: DataFrame,
    keys: Sequence[str] = ("trainer", "jockey"),
    order: Sequence[str] = ("date", "id"),
    payload: Sequence[str] = ("combo_runs", "combo_win_pc"),
) -> DataFrame:
    """Card rows with the newest stored statistics of their trainer and jockey.

    The newest result of each pair comes first, so that not all results are joined to the table.
    """
    pairs = cards.select(*keys).distinct()
    runs = lookup(results.select("id", "date", *keys), pairs, keys, "left_semi")
    last = _newest(runs, keys, ["id"], order)
    stored = synergy.withColumnRenamed("res_id", "id").select("id", *payload)
    newest = last.join(stored, "id", "left").drop("id").dropDuplicates(list(keys))  # where the table repeats an id
    newest = newest.withColumn("pair_found", F.lit(True))
    out = lookup(cards, newest.withColumnsRenamed({c: f"pair_{c}" for c in payload}), keys)
    return out.withColumn("pair_found", F.coalesce("pair_found", F.lit(False)))


def card_history(cards: DataFrame, results: DataFrame) -> DataFrame:
    """History features of card runners, as if each were its horse's next result.

    Cards of any number of dates go through together: their rows get features but are nobody's
    history, and as they come before the results of their own day only earlier days count.
    ``cards`` has the identifying columns of results (date, course, horse, trainer, jockey,
    class, hg, official_rating, wgt_lbs, jockey_allowance, prize, race_id) and an ``id``.
    """
    needed = [
        "id", "date", "race_id", "course", "horse", "trainer", "jockey", "class", "hg",
        "official_rating", "wgt_lbs", "jockey_allowance", "prize",
    ]
    past = results.select(*needed, "pos_num", "btn").withColumn("_ran", F.lit(True))
    # A pending row sorts before every result of its day; its own id comes back at the end.
    asked = cards.select(*needed).withColumns({
        "_ran": F.lit(False), "_card_id": F.col("id"), "id": F.lit(-1) - F.col("id"),
    })
    horses, pairs = cards.select("horse").distinct(), cards.select("trainer", "jockey").distinct()

    past_scan = KeyScan(past)
    of_horses = lookup(past, horses, ["horse"], "left_semi", past_scan)
    both = asked.unionByName(of_horses, allowMissingColumns=True)
    scan = KeyScan(both)
    families = history.horse_families(both)
    out = history.add_lookbacks(both, "horse", families, scan, observed="_ran")
    out = history.add_place_stats(out, scan=scan, observed="_ran").where(~F.col("_ran"))

    of_pairs = lookup(past, pairs, ["trainer", "jockey"], "left_semi", past_scan)
    out = out.unionByName(of_pairs, allowMissingColumns=True)
    out = history.add_pair_stats(out, observed="_ran").where(~F.col("_ran"))
    out = history.add_race_value(out).withColumn("true_wgt", history.true_weight_of(out))
    features = [
        *schema.FORM_COLUMNS, *schema.CLASS_COLUMNS, *schema.COURSE_COLUMNS,
        *schema.SYNERGY_COLUMNS, *schema.MICRO_COLUMNS,
    ]
    return out.select(F.col("_card_id").alias("id"), "date", "horse", "race_id", *features)


def one_race_sample(df: DataFrame) -> DataFrame:
    """All runners of the first race (by id) that has prize money."""
    first = df.where(parsing.parse_prize("prize") > 0).agg(F.min("race_id").alias("_race"))
    return df.join(F.broadcast(first), F.col("race_id") == F.col("_race"), "left_semi").select(
        "horse", "pos", "prize", "official_rating", "race_id"
    )

