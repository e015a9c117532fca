"""The registered queries: every operator run over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake import fixtures, schema
from formlake.functions import parsing
from formlake.ml import boost, metrics, prepare, store, train
from formlake.operators import audit, cleaning, context, history, ranking
from formlake.operators import cards as card_ops
from formlake.operators.skew import SPLIT_ROWS_CONF
from formlake.plans import features, ingest, scoring
from formlake.session import cut_lineage, scratch_path
from formlake.sources import racecards, tables
from formlake.streaming import files
from formlake.streaming.state import LatestRows, follow_results, score_with_state

Query = Callable[[SparkSession, str], DataFrame]

CUTOFF = date(2000, 1, 1)
AS_OF = date(2001, 8, 1)
QUERIES: dict[str, Query] = {}

ALL_FEATURE_COLUMNS = [
    *schema.FORM_COLUMNS, *schema.CLASS_COLUMNS, *schema.COURSE_COLUMNS, *schema.SYNERGY_COLUMNS,
    *schema.MICRO_COLUMNS,
]
CLEAN_COLUMNS = [
    "date", "course", "race_id", "type", "class", "dist", "going", "ran", "draw", "pos", "btn", "horse",
    "wgt_lbs", "hg", "jockey", "trainer", "prize", "official_rating", "jockey_allowance",
]
CARD_KEY = ["off", "number"]
#: What is read of a matrix of which only races and labels count, or only a few numbers.
RACE_COLUMNS = ["id", "race_id", *schema.RACE_KEY, "target_win"]
FEW_NUMBERS = ["draw", "avg_btn_3", "wgt_lbs"]
#: What learners on the base inputs read: without the families that need all runners of a race, equipment or ratings.
BASE_COLUMNS = list(dict.fromkeys([*RACE_COLUMNS, *schema.BASE_FEATURES, *schema.CATEGORIES]))
#: What cards are given of their horses' earlier results.
KNOWN_COLUMNS = ["horse", "date", "id", *context.CONTEXT_COLUMNS]
#: What the ensembles read, and their rows' ids and dates; the planted label needs no more.
ENSEMBLE_COLUMNS = ["id", "date", *schema.ALL_FEATURES, *schema.CATEGORIES]
#: What scoring cards reads of results with features: for the runners, and for the model.
SCORING_COLUMNS = list(dict.fromkeys([*KNOWN_COLUMNS, "type", *ENSEMBLE_COLUMNS]))
#: What is read of results with a score.
SCORED_COLUMNS = [
    "id", "race_id", *schema.RACE_KEY, "pos_num", "official_rating", "avg_btn_3", "combo_win_pc", "combo_place_pc",
    "h_course_place_pc",
]
GIVEN_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _log9(df: DataFrame, col: str = "log_prize") -> DataFrame:
    """Logarithms may differ in the last bit between engines."""
    return df.withColumn(col, F.round(col, 9))


def _split(spark: SparkSession, df: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """Builds a plan in which a key above a fiftieth of the rows is split into chunks."""
    before = spark.conf.get(SPLIT_ROWS_CONF, None)
    spark.conf.set(SPLIT_ROWS_CONF, str(max(1, df.count() // 50)))
    try:
        return build()
    finally:
        if before is None:
            spark.conf.unset(SPLIT_ROWS_CONF)
        else:
            spark.conf.set(SPLIT_ROWS_CONF, before)


# --- derived tables the queries share -------------------------------------------------------


def results(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.results(spark, sf)


def featured(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Results with all features, stored; with ``columns`` only these, so that no others are shuffled."""
    return _only(spark, "featured", sf, columns, lambda: features.build_features(results(spark, sf)))


def matrix(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return _only(spark, "matrix", sf, columns, lambda: features.build_matrix(results(spark, sf)))


def _only(spark: SparkSession, name: str, sf: str, columns: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
    if not columns:
        return fixtures.stored(spark, name, sf, make)
    return fixtures.stored(spark, "-".join([name, *columns]), sf, lambda: make().select(*columns))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """A score that SQL can repeat, for everything downstream of a model."""
    df = featured(spark, sf, *SCORED_COLUMNS)
    zero = F.lit(0)
    prob = (
        F.coalesce("official_rating", zero) * F.lit(0.01)
        - F.coalesce("avg_btn_3", zero) * F.lit(0.02)
        + F.coalesce("combo_win_pc", zero)
    )
    return df.withColumn("prob", F.round(prob, 6)).withColumn("target_win", parsing.is_win("pos_num"))


FAMILIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "synergy": history.pair_trailing_stats, "course": history.entity_place_stats,
    "form": history.recent_form, "class": history.class_moves, "micro": history.micro_features,
}


def feature_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One family as a stored feature table."""
    return fixtures.stored(spark, f"features_{name}", sf, lambda: FAMILIES[name](results(spark, sf)))


def feature_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The five families as stored feature tables."""
    return {name: feature_table(spark, sf, name) for name in FAMILIES}


def races(spark: SparkSession, sf: str) -> DataFrame:
    return racecards.parse_races(fixtures.cards(spark, sf))


def runners(spark: SparkSession, sf: str) -> DataFrame:
    return racecards.explode_runners(races(spark, sf))


def listed_courses(spark: SparkSession, sf: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    return nation.where(F.col("n_regionkey").isin(0, 3)).select("n_name")


# --- sources and sinks ----------------------------------------------------------------------


@query
def read_results_csv(spark, sf):
    raw = tables.read_results_csv(spark, fixtures.raw_csv(spark, sf))
    return raw.withColumnRenamed("[or]", "official_rating")


@query
def write_results(spark, sf):
    rows = fixtures.results_view(spark, sf).drop("id", "seq")
    out = tables.write_results(rows, scratch_path(spark, "write-results"))
    return out.select("id", "date", "race_id", "horse", "pos", F.col("year").cast("int").alias("year"))


@query
def dedupe_append(spark, sf):
    r = results(spark, sf)
    old = cleaning.temporal_split(r, CUTOFF)[0]
    return tables.dedupe_append(r, old).select("race_id", "horse")


@query
def write_features(spark, sf):
    return tables.write_features(history.recent_form(results(spark, sf)), scratch_path(spark, "form"))


@query
def write_features_failed(spark, sf):
    """A second write dies half-way; the table of the first one is still there."""
    path, form = scratch_path(spark, "form"), history.recent_form(results(spark, sf))
    tables.write_features(form, path)
    broken = form.withColumn("res_id", F.when(F.col("res_id") % 100 == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("res_id")))
    try:
        tables.write_features(broken, path)
    except Exception as e:
        if "lost" not in str(e):
            raise
    return tables.read_features(spark, path)


@query
def scan_history(spark, sf):
    path = scratch_path(spark, "history")
    results(spark, sf).write.parquet(path)
    return tables.scan_history(spark, path, "form")


def _scan_family(family: str) -> Query:
    def scan(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(spark, "history")
        results(spark, sf).write.parquet(path)
        return tables.scan_history(spark, path, family)

    return scan


for _family in ("synergy", "course", "class", "micro"):
    QUERIES[f"scan_history_{_family}"] = _scan_family(_family)


@query
def matrix_io(spark, sf):
    return _log9(tables.write_matrix(matrix(spark, sf), scratch_path(spark, "matrix-io")))


@query
def read_racecards(spark, sf):
    cards = racecards.read_racecards(spark, fixtures.card_files(spark, sf), latest=False, lines=True)
    return cards.select(
        "card_date", "region", "course", "off", "race_name", "prize", "distance", "race_class", "horse",
        "trainer", "jockey", "number", "lbs", "draw", "headgear", "ofr", "rpr", "jockey_allowance",
        "non_runner",
    )


@query
def table_profile(spark, sf):
    for name in GIVEN_TABLES:
        spark.read.parquet(f"{sf}/{name}.parquet").createOrReplaceTempView(name)
    profile = tables.table_profile(spark).where(F.col("table_name").isin(*GIVEN_TABLES))
    return profile.select("table_name", "row_count", "ordinal", "column_name")


@query
def model_io(spark, sf):
    model, path = _classifier(spark, sf), scratch_path(spark, "model")
    store.save_model(model, path)
    again = scoring.score_matrix(path, planted(spark, sf, *BASE_COLUMNS), CUTOFF, "prob_loaded")
    both = model.score(again)
    return both.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.max(F.abs(F.col("prob") - F.col("prob_loaded"))).alias("largest_difference"),
    )


@query
def incremental_ingest(spark, sf):
    out = files.incremental_ingest(
        spark, fixtures.raw_csv(spark, sf), scratch_path(spark, "stream"),
        scratch_path(spark, "stream-checkpoint"), columns=fixtures.raw_text(spark, sf).columns,
        values=listed_courses(spark, sf),
    )
    return out.select(*CLEAN_COLUMNS)


@query
def deduplicating_ingest(spark, sf):
    """Every file is there twice, under two names."""
    path = scratch_path(spark, "csv-twice")
    for _ in range(2):
        fixtures.write_csv(fixtures.raw_text(spark, sf), path)
    out = files.deduplicating_ingest(
        spark, path, scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint"),
        columns=fixtures.raw_text(spark, sf).columns, values=listed_courses(spark, sf))
    return out.select("race_id", "horse")


@query
def incremental_ingest_compacted(spark, sf):
    streamed = files.incremental_ingest(
        spark, fixtures.raw_csv(spark, sf), scratch_path(spark, "stream"),
        scratch_path(spark, "stream-checkpoint"), columns=fixtures.raw_text(spark, sf).columns,
        values=listed_courses(spark, sf),
    )
    path = scratch_path(spark, "compacted")
    ingest.store_cleaned(streamed, path)
    return ingest.store_cleaned(streamed, path).select(*CLEAN_COLUMNS)


@query
def ingest_full(spark, sf):
    out = ingest.ingest(
        spark, fixtures.raw_csv(spark, sf), scratch_path(spark, "ingest"), values=listed_courses(spark, sf)
    )
    return out.select(*CLEAN_COLUMNS)


QUERIES["ingest"] = QUERIES.pop("ingest_full")


@query
def ingest_light(spark, sf):
    out = ingest.ingest(
        spark, fixtures.raw_csv(spark, sf), profile="light", values=listed_courses(spark, sf)
    )
    return out.select(
        "date", "course", "race_id", "type", "class", "going", "horse", "ran", "pos", "draw",
        "official_rating", "jockey", "trainer",
    )


# --- projections, filters, cleaning ---------------------------------------------------------


@query
def allowlist_filter(spark, sf):
    padded = results(spark, sf).select("id", F.concat(F.lit(" "), "course", F.lit(" ")).alias("course"))
    return cleaning.allowlist_filter(padded, "course", listed_courses(spark, sf))


@query
def coerce_date(spark, sf):
    text = F.when(F.col("hg") == "t", "31/31/2000").otherwise(F.col("date").cast("string"))
    return cleaning.coerce_date(results(spark, sf).select("id", text.alias("date")))


@query
def coerce_numeric(spark, sf):
    text = results(spark, sf).select("id", "pos", "wgt", F.col("ran").cast("string").alias("ran"))
    return cleaning.coerce_numeric(text, ["pos", "wgt", "ran", "or"])


@query
def clean_strings(spark, sf):
    padded = F.concat(F.lit(" "), "horse", F.lit(" "))
    text = results(spark, sf).select("id", F.coalesce(F.when(F.col("hg").isNotNull(), padded),
                                                      F.lit(" nan ")).alias("horse"), "going")
    return cleaning.clean_strings(text, ["horse", "going"])


@query
def parse_weight(spark, sf):
    plain = (F.col("draw") + 120).cast("string")
    text = F.when(F.col("hg") == "b", plain).when(F.col("hg") == "t", F.replace("wgt", F.lit("-"), F.lit("-x")))
    return results(spark, sf).select("id", parsing.parse_weight(text.otherwise(F.col("wgt"))).alias("wgt_lbs"))


@query
def coerce_date_formats(spark, sf):
    day = F.col("date")
    kind = F.col("draw") % 7
    text = F.coalesce(*[
        F.when(kind == i, F.date_format(day, f)) for i, f in enumerate((
            "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy/MM/dd", "yyyyMMdd", "dd/MM/yyyy", "dd-MM-yyyy"))
    ], F.lit("soon"))
    return cleaning.coerce_date(results(spark, sf).select("id", text.alias("date")))


@query
def parse_weight_dirty(spark, sf):
    text = F.when(F.col("hg") == "b", "999999999-1").when(F.col("hg") == "t", "99999999999").otherwise(F.col("wgt"))
    return results(spark, sf).select("id", parsing.parse_weight(text).alias("wgt_lbs"))


@query
def class_moves_dirty(spark, sf):
    text = F.when(F.col("draw") == 3, "Class 99999999999").otherwise(F.col("class"))
    return history.class_moves(results(spark, sf).withColumn("class", text)).select("res_id", "class_diff", "avg_class_3")


@query
def cards_without_runners(spark, sf):
    races_ = races(spark, sf).withColumn(
        "runners", F.when(F.col("race_class") != 3, F.col("runners")))
    out = ranking.top_by_rating(racecards.explode_runners(races_))
    out = out.withColumn("rank", F.col("rank").cast("long"))
    return out.select("card_date", "region", "course", "off", "number", "horse", "rpr", "rank")


@query
def broken_cards(spark, sf):
    text = F.when(F.dayofmonth("card_date") == 7, F.substring("value", 1, 20)).otherwise(F.col("value"))
    return racecards.broken_documents(fixtures.cards(spark, sf).withColumn("value", text))


@query
def dedupe_append_nulls(spark, sf):
    rows = results(spark, sf).withColumn("horse", F.when(F.col("draw") != 2, F.col("horse")))
    old, new = cleaning.temporal_split(rows, CUTOFF)
    out = tables.dedupe_append(new.union(new).union(old), old)
    return out.groupBy("race_id").agg(F.count(F.lit(1)).alias("n"))


@query
def ingest_twice(spark, sf):
    path, csv = scratch_path(spark, "ingest"), fixtures.raw_csv(spark, sf)
    ingest.ingest(spark, csv, path, values=listed_courses(spark, sf))
    again = ingest.ingest(spark, csv, path, values=listed_courses(spark, sf))
    return again.select(*CLEAN_COLUMNS)


@query
def conform_schema(spark, sf):
    raw = fixtures.results_view(spark, sf)
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    text = text.withColumn("wgt_lbs", parsing.parse_weight("wgt"))
    out = cleaning.conform_schema(text.withColumnRenamed("official_rating", "[or]"))
    return out.select(*CLEAN_COLUMNS, "id", "comment", "trainer_rtf")


@query
def split_position(spark, sf):
    out = cleaning.split_position(fixtures.results_view(spark, sf))
    return out.select("id", "pos_raw", "pos_num", "finished")


@query
def extract_class(spark, sf):
    return results(spark, sf).select("id", parsing.extract_class("class").alias("class_no"))


@query
def parse_prize(spark, sf):
    text = F.when(F.col("hg").isNull(), "n/a").otherwise(F.concat("prize", F.lit(".50")))
    out = results(spark, sf).select("id", parsing.parse_prize(text).alias("prize"))
    return out.withColumn("log_prize", F.round(F.log1p("prize"), 9))


@query
def fix_margins(spark, sf):
    return cleaning.fix_margins(results(spark, sf))[0].select("id", "btn")


@query
def fix_margins_counts(spark, sf):
    return cleaning.fix_margins(results(spark, sf))[1]


@query
def fill_nulls(spark, sf):
    rows = results(spark, sf).select("id", "btn", "hg", "official_rating")
    return cleaning.fill_nulls(rows, {"btn": 20.0, "hg": "", "official_rating": 0})


@query
def win_place_flags(spark, sf):
    return cleaning.win_place_flags(results(spark, sf)).select("id", "is_win", "is_place", "target_win")


@query
def type_filter(spark, sf):
    r = results(spark, sf)
    return cleaning.type_filter(history.add_lookbacks(r, "horse", [history.form_family(r)])).select(
        "id", "type", "avg_btn_3"
    )


@query
def temporal_split(spark, sf):
    before, after = cleaning.temporal_split(results(spark, sf), CUTOFF)
    total = F.count(F.lit(1)).alias("total_rows")
    return before.agg(total).select(F.lit("train").alias("side"), "total_rows").unionByName(
        after.agg(total).select(F.lit("test").alias("side"), "total_rows")
    )


@query
def drop_non_runners(spark, sf):
    return card_ops.drop_non_runners(runners(spark, sf)).select("card_date", *CARD_KEY, "horse")


@query
def error_sample(spark, sf):
    return cleaning.error_sample(results(spark, sf))


@query
def card_defaults(spark, sf):
    read = tuple(card_ops.DEFAULTS["weighted"])
    known = context.latest_context(runners(spark, sf), featured(spark, sf, "horse", "date", "id", *read), payload=read)
    out = card_ops.card_defaults(known)
    return out.select(*CARD_KEY, *card_ops.DEFAULTS["weighted"], "wgt_lbs", "draw", "days_since_last",
                      "race_class")


@query
def card_features(spark, sf):
    read = ("hg", "official_rating")
    known = context.latest_context(runners(spark, sf), featured(spark, sf, "horse", "date", "id", *read), payload=read)
    return _log9(card_ops.card_features(known).select(*CARD_KEY, *schema.MICRO_COLUMNS))


@query
def card_features_legacy_gear(spark, sf):
    known = context.latest_context(runners(spark, sf), featured(spark, sf))
    return card_ops.card_features(known, legacy_gear=True).select(*CARD_KEY, "gear_change")


# --- joins ----------------------------------------------------------------------------------


@query
def assemble_matrix(spark, sf):
    t = feature_tables(spark, sf)
    return _log9(features.assemble_matrix(
        results(spark, sf), t["synergy"], t["course"], t["form"], t["class"], t["micro"]
    ))


def bucketed_tables(spark: SparkSession, sf: str, buckets: int = 16) -> dict[str, DataFrame]:
    """Results and the feature tables, stored in as many buckets of their id each; made once per application."""
    key = (spark.sparkContext.applicationId, sf, "bucketed")
    if key not in _models:
        whole = {"results": results(spark, sf), **feature_tables(spark, sf)}
        _models[key] = {
            name: tables.write_features(
                df, scratch_path(spark, f"bucketed-{name}"), "res_id" if "res_id" in df.columns else "id", buckets,
                f"bucketed_{name}_{abs(hash(key))}")
            for name, df in whole.items()
        }
    return _models[key]


@query
def assemble_matrix_copartitioned(spark, sf):
    """The joins find the rows of an id in the same bucket of every table: no exchange."""
    t = bucketed_tables(spark, sf)
    with_merge = {n: df.hint("merge") for n, df in t.items()}
    return _log9(features.assemble_matrix(
        t["results"], *[with_merge[n] for n in ("synergy", "course", "form", "class", "micro")]))


@query
def assemble_matrix_fused(spark, sf):
    return _log9(features.build_matrix(results(spark, sf)))


@query
def recent_snapshot(spark, sf):
    t = feature_tables(spark, sf)
    whole = {"results": results(spark, sf), **{f"features_{name}": table for name, table in t.items()}}
    whole["courses"] = listed_courses(spark, sf).select(F.lit(None).cast("long").alias("id"), "n_name")
    path = scratch_path(spark, "snapshot")
    context.write_snapshot(context.recent_snapshot(whole, 6, AS_OF), path)
    lite = context.read_snapshot(spark, path)
    ids = [
        df.select(F.lit(name).alias("table_name"), df["res_id" if "res_id" in df.columns else "id"].alias("id"))
        for name, df in lite.items()
    ]
    return reduce(DataFrame.unionByName, ids)


@query
def entity_timeline(spark, sf):
    r, t = results(spark, sf), feature_tables(spark, sf)
    horse = audit.frequent_entity(r).first()["horse"]
    return context.entity_timeline(r, {n: t[n] for n in ("synergy", "course", "form")}, horse)


@query
def latest_context(spark, sf):
    out = context.latest_context(runners(spark, sf), featured(spark, sf))
    out = _log9(out, "ctx_log_prize")
    return out.select(*CARD_KEY, "horse", "found", *[f"ctx_{c}" for c in context.CONTEXT_COLUMNS])


@query
def asof_context(spark, sf):
    out = context.asof_context(runners(spark, sf), featured(spark, sf))
    out = _log9(out, "ctx_log_prize")
    return out.select(*CARD_KEY, "horse", "found", *[f"ctx_{c}" for c in context.CONTEXT_COLUMNS])


@query
def card_history(spark, sf):
    r = results(spark, sf)
    return _log9(context.card_history(r.drop("pos", "pos_num", "btn"), r))


@query
def pair_context(spark, sf):
    out = context.pair_context(runners(spark, sf), results(spark, sf), feature_table(spark, sf, "synergy"))
    return out.select(*CARD_KEY, "pair_found", "pair_combo_runs", "pair_combo_win_pc")


@query
def one_race_sample(spark, sf):
    return context.one_race_sample(results(spark, sf))


# --- aggregations ---------------------------------------------------------------------------


@query
def audit_counts(spark, sf):
    return audit.audit_counts(results(spark, sf))


@query
def audit_winners(spark, sf):
    return audit.audit_winners(results(spark, sf))


@query
def audit_nulls(spark, sf):
    return audit.audit_nulls(results(spark, sf))


@query
def audit_yearly(spark, sf):
    return audit.audit_yearly(results(spark, sf))


@query
def audit_logical_errors(spark, sf):
    return audit.audit_logical_errors(results(spark, sf))


@query
def data_audit(spark, sf):
    return audit.data_audit(results(spark, sf))


@query
def coverage_summary(spark, sf):
    names = [row["n_name"] for row in listed_courses(spark, sf).collect()]
    return audit.coverage_summary(results(spark, sf), names)


@query
def date_range(spark, sf):
    return audit.date_range(results(spark, sf))


@query
def feature_null_check(spark, sf):
    t = feature_tables(spark, sf)
    return audit.feature_null_check({
        "synergy": (t["synergy"], "combo_win_pc"), "course": (t["course"], "h_course_runs"),
        "form": (t["form"], "avg_btn_3"),
    })


@query
def frequent_entity(spark, sf):
    return audit.frequent_entity(results(spark, sf))


@query
def matrix_summary(spark, sf):
    out = audit.matrix_summary(matrix(spark, sf, *RACE_COLUMNS))
    return out.withColumn("win_rate", F.round("win_rate", 9))


@query
def group_sizes(spark, sf):
    return audit.group_sizes(matrix(spark, sf, *RACE_COLUMNS), schema.RACE_KEY)


@query
def split_count_importance(spark, sf):
    model, path = _classifier(spark, sf), scratch_path(spark, "importance")
    store.save_model(model, path)
    names = prepare.feature_names(model.prep)
    used = metrics.split_count_importance(f"{path}/learner", names)
    return used.agg(
        F.coalesce(F.max(F.col("feature") == "avg_btn_3"), F.lit(False)).alias("uses_planted_feature"),
        F.count_if(~F.col("feature").isin(names) | (F.col("splits") < 1)).alias("wrong_rows"),
    )


# --- history windows ------------------------------------------------------------------------


@query
def recent_form(spark, sf):
    return history.recent_form(results(spark, sf))


@query
def class_moves(spark, sf):
    return history.class_moves(results(spark, sf))


@query
def entity_place_stats(spark, sf):
    return history.entity_place_stats(results(spark, sf))


@query
def pair_trailing_stats(spark, sf):
    return history.pair_trailing_stats(results(spark, sf))


@query
def pair_trailing_stats_exclude(spark, sf):
    return history.pair_trailing_stats(results(spark, sf), same_day="exclude")


@query
def gear_change(spark, sf):
    return history.gear_change(results(spark, sf))


@query
def rating_change(spark, sf):
    return history.rating_change(results(spark, sf))


@query
def true_weight(spark, sf):
    return history.true_weight(results(spark, sf))


@query
def race_value(spark, sf):
    return _log9(history.race_value(results(spark, sf)))


@query
def micro_features(spark, sf):
    return _log9(history.micro_features(results(spark, sf)))


@query
def build_features(spark, sf):
    return _log9(features.build_features(results(spark, sf)).select("id", *ALL_FEATURE_COLUMNS))


# The same operators keyed by columns of a few values, so that every key is over-full.


@query
def recent_form_split(spark, sf):
    r = results(spark, sf)
    return _split(spark, r, lambda: history.recent_form(r, key="going"))


@query
def class_moves_split(spark, sf):
    r = results(spark, sf)
    return _split(spark, r, lambda: history.class_moves(r, key="going"))


@query
def entity_place_stats_split(spark, sf):
    r = results(spark, sf)
    return _split(spark, r, lambda: history.entity_place_stats(r, keys=("going", "type")))


@query
def pair_trailing_stats_split(spark, sf):
    r = results(spark, sf)
    return _split(spark, r, lambda: history.pair_trailing_stats(r, keys=("going",)))


@query
def race_value_split(spark, sf):
    r = results(spark, sf)
    return _log9(_split(spark, r, lambda: history.race_value(r, group="going")))


@query
def place_stats_events(spark, sf):
    """Course records on the event stream: user as entity, event type as place."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    pos = F.when(F.col("value") > 50, 1).when(F.col("value") > 20, 3).otherwise(4)
    runs = events.select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("date"), F.col("user_id").alias("horse"),
        F.col("event_type").alias("course"), pos.alias("pos_num"),
    )
    return history.entity_place_stats(runs)


# --- ranking --------------------------------------------------------------------------------


@query
def group_index(spark, sf):
    return ranking.group_index(matrix(spark, sf, *RACE_COLUMNS)).select("id", "group_id")


@query
def top_pick(spark, sf):
    rows = scored(spark, sf).select("id", *schema.RACE_KEY, "prob", "target_win")
    return ranking.top_pick(rows)


@query
def rank_runners(spark, sf):
    rows = scored(spark, sf).select("id", "race_id", "prob")
    out = ranking.rank_runners(rows, ["race_id"], "prob")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query
def top_by_rating(spark, sf):
    out = ranking.top_by_rating(runners(spark, sf))
    out = out.withColumn("rank", F.col("rank").cast("long"))
    return out.select("card_date", "region", "course", "off", "number", "horse", "rpr", "rank")


@query
def meeting_index(spark, sf):
    return card_ops.meeting_index(races(spark, sf))


@query
def strike_rate(spark, sf):
    return ranking.strike_rate(scored(spark, sf), CUTOFF)


# --- models ---------------------------------------------------------------------------------

_models: dict[tuple[str, str, str], object] = {}


def planted(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The matrix with a label that a learner can find: a small recent margin."""
    return with_planted(matrix(spark, sf, *columns))


def with_planted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("target_win", F.coalesce(F.col("avg_btn_3") < 6, F.lit(False)).cast("int"))


def _fitted(spark: SparkSession, sf: str, name: str, fit: Callable[[DataFrame], object], columns: Sequence[str] = BASE_COLUMNS,
            rows: DataFrame | None = None):
    """Models are fitted once per application, on ``rows`` if the matrix needn't be stored for them."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _models:
        every = planted(spark, sf, *columns) if rows is None else with_planted(rows)
        _models[key] = fit(cleaning.temporal_split(every, CUTOFF)[0])
    return _models[key]


def _classifier(spark, sf) -> train.Model:
    return _fitted(spark, sf, "classifier", lambda t: train.train_classifier(t, trees=20, depth=4, rate=0.05))


def _ensemble(spark, sf, rows: DataFrame | None = None) -> train.Ensemble:
    return _fitted(spark, sf, "ensemble", lambda t: train.train_ensemble(
        t, boosted={"trees": 5, "depth": 4}, forest={"trees": 10, "depth": 6},
        extra={"trees": 10, "depth": 6, "batch": 10}, wide={"trees": 4, "depth": 6},
    ), columns=ENSEMBLE_COLUMNS, rows=rows)


def _scoring(spark, sf, *more: str) -> tuple[DataFrame, train.Ensemble]:
    """Results with their features for the cards, and the ensemble. One pass over the history makes both: the matrix is
    taken from the stored rows."""
    known = featured(spark, sf, *SCORING_COLUMNS, *more)
    return known, _ensemble(spark, sf, features.matrix_of(known, ENSEMBLE_COLUMNS))


def _whole_ensemble(spark, sf) -> train.Ensemble:
    """With members of full size: 1000 boosted trees of depth 6, 600 of depth 12 in the forest and of the random ones, 1000 of 256 leaves."""
    return _fitted(spark, sf, "whole ensemble", train.train_ensemble, columns=ENSEMBLE_COLUMNS)


def _tested(spark, sf, model: train.Model | train.GroupModel) -> DataFrame:
    out = scoring.score_matrix(model, planted(spark, sf, *BASE_COLUMNS), CUTOFF)
    return out.select("id", *schema.RACE_KEY, "target_win", "prob")


def _verdict(scored_rows: DataFrame, score: str = "prob") -> DataFrame:
    """Rows scored, whether all scores are probabilities, and whether the planted label is found."""
    scored_rows = cut_lineage(scored_rows.select("target_win", score))  # read twice, scored once
    found = metrics.auc(scored_rows, "target_win", [score]).select((F.col("auc") > 0.7).alias("finds_label"))
    rows = scored_rows.agg(
        F.count(F.lit(1)).alias("scored_rows"), F.count_if(~F.col(score).between(0, 1)).alias("out_of_range"))
    return rows.crossJoin(found)  # one row each


def _member(spark, sf, name: str) -> DataFrame:
    ensemble = _whole_ensemble(spark, sf)
    test = cleaning.temporal_split(planted(spark, sf, *ENSEMBLE_COLUMNS), CUTOFF)[1]
    alone = train.Ensemble(ensemble.prep, {name: ensemble.members[name]})
    return _verdict(alone.score(test).select("id", "target_win", f"p_{name}"), f"p_{name}")


def noisy(rows: DataFrame) -> DataFrame:
    """The planted label with every tenth one turned round, so that growing on and on doesn't pay."""
    turned = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    return rows.withColumn("target_win", F.when(turned, 1 - F.col("target_win")).otherwise(F.col("target_win")))


def _classified(spark, sf) -> boost.Boosted:
    """Of full size: up to 1000 trees of depth 6 at a rate of 0.05, until 50 are no better."""
    return _fitted(spark, sf, "classified", lambda t: boost.train_boosted_trees(noisy(t)))


def _boosted(spark, sf) -> boost.Boosted:
    """Grown fast, to see where growth ends."""
    params = boost.Params(trees=1000, depth=4, rate=0.5, patience=4)
    return _fitted(spark, sf, "boosted trees", lambda t: boost.train_boosted_trees(noisy(t), params=params))


@query
def train_classifier(spark, sf):
    return _verdict(_tested(spark, sf, _classified(spark, sf)))


@query
def early_stopping(spark, sf):
    """Of up to 1000 trees: whether growth ended ``patience`` trees after the best, and whether the best ones are kept."""
    model = _boosted(spark, sf)
    best = model.losses.index(min(model.losses))
    rows = [(len(model.losses) - 1 - best, best == len(model.trees), len(model.losses) < 1000)]
    return spark.createDataFrame(rows, "trees_after_best int, keeps_best boolean, stopped_early boolean")


@query
def boosted_leaf_values(spark, sf):
    """One split on the draw: sums and values of both leaves."""
    rows = matrix(spark, sf, *FEW_NUMBERS).withColumn("target_win", (F.col("draw") <= 3).cast("int"))
    params = boost.Params(trees=1, depth=1, rate=1.0, l2=2.0)
    model = boost.train_boosted_trees(rows, ["draw"], [], params=params, holdout=0)
    leaves = model.nodes(spark).where("feature is null")
    return leaves.select("node", F.round("gradient", 6).alias("gradient"), F.round("hessian", 6).alias("hessian"),
                         F.round("value", 9).alias("value"))


@query
def missing_direction(spark, sf):
    """Rows that a label of "is missing" is found for, and rows with a number that are taken for them."""
    label = F.col("avg_btn_3").isNull().cast("int")
    rows = matrix(spark, sf, *FEW_NUMBERS).withColumn("target_win", label)
    params = boost.Params(trees=3, depth=2, rate=1.0)
    model = boost.train_boosted_trees(rows, ["avg_btn_3", "draw"], [], params=params, holdout=0)
    found = F.col("prob") > 0.5
    return model.score(rows).agg(
        F.count_if(found & (F.col("target_win") == 1)).alias("missing_found"), F.count_if(found & (F.col("target_win") == 0)).alias("wrong"))


@query
def leafwise_growth(spark, sf):
    """A tree that grows its best leaf first: its number of leaves, and how its loss compares with level by level."""
    rare = F.col("draw").between(2, 3) & F.col("avg_btn_3").between(3, 9) & F.col("wgt_lbs").between(115, 125)
    rows = matrix(spark, sf, *FEW_NUMBERS).withColumn("target_win", F.coalesce(rare, F.lit(False)).cast("int"))
    inputs = ["draw", "avg_btn_3", "wgt_lbs"]
    found = []
    for params in (boost.Params(trees=1, depth=9, leaves=8, rate=1.0), boost.Params(trees=1, depth=3, rate=1.0)):
        model = boost.train_boosted_trees(rows, inputs, [], params=params, holdout=0)
        scored = boost.logistic_gradients(model.margin(rows, "_margin").withColumn("_y", F.col("target_win")))
        found.append((sum(x < 0 for x in model.trees[0].left), model.trees[0].depth, scored.agg(F.avg("_loss")).first()[0]))
    (leaves, depth, loss), (_, _, level_loss) = found
    return spark.createDataFrame([(leaves <= 8, depth > 3, loss < level_loss)], "within_leaves boolean, uneven boolean, less_loss boolean")


@query
def score_matrix(spark, sf):
    out = scoring.score_matrix(_classifier(spark, sf), planted(spark, sf, *BASE_COLUMNS), CUTOFF)
    return out.select("id", "race_id", F.col("prob").between(0, 1).alias("in_range"))


def ordered(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The matrix, and in every race the runner nearest to the middle weight of 125 wins: a matter of order only. Stored, as
    every pass over it would find the winners again."""
    def make() -> DataFrame:
        rows = matrix(spark, sf, *columns).dropna(subset=list(schema.RACE_KEY))
        first = F.struct(F.abs(F.coalesce("wgt_lbs", F.lit(0)) - 125), "id")
        best = rows.groupBy(*schema.RACE_KEY).agg(F.min(first).getField("id").alias("_best"))
        return rows.join(best, list(schema.RACE_KEY)).withColumn(
            "target_win", (F.col("id") == F.col("_best")).cast("int")).drop("_best")

    return fixtures.stored(spark, "-".join(["ordered", *columns]), sf, make)


def _ranked(spark, sf, params: boost.Params, features, columns: Sequence[str] = ()) -> DataFrame:
    """Mean NDCG of the listwise and of the linear ranker on the test rows."""
    train_rows, test = cleaning.temporal_split(ordered(spark, sf, *columns), CUTOFF)
    with_inputs = [*schema.RACE_KEY, "id", "target_win"]
    models = {
        "listwise": boost.train_listwise_ranker(train_rows, features=features, params=params),
        "linear": train.train_ranker(train_rows, features=features),
    }
    parts = [
        metrics.ndcg(m.score(test).select(*with_inputs, "prob"), schema.RACE_KEY, "target_win", "prob").select(
            F.lit(name).alias("model"), "groups", "ndcg") for name, m in models.items()
    ]
    both = parts[0].unionByName(parts[1]).groupBy().pivot("model", ["listwise", "linear"]).agg(
        F.first("ndcg").alias("ndcg"), F.first("groups").alias("groups"))
    return both.select(
        F.col("listwise_groups").alias("groups"), (F.col("listwise_ndcg") > F.col("linear_ndcg") + 0.05).alias("beats_linear"),
        (F.col("listwise_ndcg") > 0.9).alias("finds_order"))


@query
def train_ranker(spark, sf):
    return _ranked(spark, sf, boost.Params(trees=1000, depth=4, rate=0.5, patience=4), schema.BASE_FEATURES, BASE_COLUMNS)


@query
def train_deep_ranker(spark, sf):
    params = boost.Params(trees=2000, depth=8, rate=0.01, min_child=5, rows=0.8, columns=0.8, patience=100)
    return _ranked(spark, sf, params, schema.ALL_FEATURES)


@query
def train_linear_ranker(spark, sf):
    model = _fitted(spark, sf, "ranker", lambda t: train.train_ranker(t, iterations=20))
    return _verdict(_tested(spark, sf, model))


@query
def train_boosted(spark, sf):
    return _member(spark, sf, "boosted")


@query
def train_forest(spark, sf):
    return _member(spark, sf, "forest")


@query
def train_extra_trees(spark, sf):
    return _member(spark, sf, "extra")


@query
def train_gbm_wide(spark, sf):
    return _member(spark, sf, "wide")


@query
def ensemble_auc(spark, sf):
    ensemble = _ensemble(spark, sf)
    test = cleaning.temporal_split(planted(spark, sf, *ENSEMBLE_COLUMNS), CUTOFF)[1]
    members = [f"p_{m}" for m in ensemble.members]
    out = train.ensemble_mean(ensemble.score(test), members, "p_ensemble")
    found = metrics.auc(out, "target_win", [*members, "p_ensemble"])
    return found.select("name", (F.col("auc") > 0.7).alias("finds_label"))


@query
def feature_importance(spark, sf):
    """Ten features, the planted one first."""
    place = F.row_number().over(Window.orderBy(F.desc("gain"), "feature"))  # of ten rows
    top = _boosted(spark, sf).importance(spark, 10).withColumn("place", place)
    return top.select("place", F.when(F.col("place") == 1, F.col("feature")).alias("first"), (F.col("gain") >= 0).alias("has_gain"))


def _places(ranked: DataFrame) -> DataFrame:
    """The places given in every race, and whether each goes to a runner with a probability."""
    good = F.col("horse").isNotNull() & F.col("score").between(0, 1)
    return ranked.select(*scoring.RACE, F.col("rank").cast("long").alias("rank"), good.alias("good"))


@query
def score_cards(spark, sf):
    known, ensemble = _scoring(spark, sf)
    return _places(scoring.score_cards(runners(spark, sf), known.select(*KNOWN_COLUMNS), ensemble))


@query
def score_cards_mean(spark, sf):
    known, ensemble = _scoring(spark, sf, "trainer", "jockey")
    return _places(scoring.score_cards(
        runners(spark, sf), known.select(*KNOWN_COLUMNS, "trainer", "jockey"), ensemble, profile="mean",
        synergy=feature_table(spark, sf, "synergy").select("res_id", "combo_runs", "combo_win_pc"),
    ))


@query
def score_cards_stream(spark, sf):
    known, ensemble = _scoring(spark, sf)
    known = known.select(*KNOWN_COLUMNS)
    return _places(files.score_cards_stream(
        spark, fixtures.card_files(spark, sf), scratch_path(spark, "scores"),
        scratch_path(spark, "scores-checkpoint"), lambda c: scoring.score_cards(c, known, ensemble), lines=True,
        columns=scoring.CARD_COLUMNS,
    ))


@query
def score_cards_state(spark, sf):
    """Results stream into the newest row of each horse; cards are scored with those as they land."""
    state = LatestRows(scratch_path(spark, "latest"), buckets=16)
    known, ensemble = _scoring(spark, sf)
    landed = scratch_path(spark, "landed")
    known.select(*state.columns).write.parquet(landed)
    follow_results(spark, landed, known.select(*state.columns).schema, state, scratch_path(spark, "latest-checkpoint"), 4)
    score = score_with_state(state, known.select(*state.columns).limit(0), lambda cards, rows: scoring.score_cards(
        cards, rows, ensemble, context=context.latest_context))
    return _places(files.score_cards_stream(
        spark, fixtures.card_files(spark, sf), scratch_path(spark, "scores"), scratch_path(spark, "scores-checkpoint"), score,
        lines=True, columns=scoring.CARD_COLUMNS))


@query
def latest_rows(spark, sf):
    """The state after the results came twice and out of order: one row a horse."""
    state = LatestRows(scratch_path(spark, "latest"), payload=("course",), buckets=8)
    rows = results(spark, sf)
    for part in (rows.where("id % 3 = 1"), rows.where("id % 3 <> 1"), rows.where("id % 2 = 0")):
        state.update(part)
    return state.rows(spark).select("horse", "id", "date", "course")


# --- model inputs, blends, metrics ----------------------------------------------------------


@query
def encode_categories(spark, sf):
    out = prepare.encode_categories(matrix(spark, sf, "id", *schema.CATEGORIES), fit_on="all")
    return out.select("id", *[f"{c}_code" for c in schema.CATEGORIES])


@query
def standardize(spark, sf):
    cols = ["wgt_lbs", "combo_win_pc", "avg_btn_3", "days_since_last", "or_change"]
    out = prepare.standardize(matrix(spark, sf, "id", "date", *cols), cols, "train", CUTOFF)
    return out.select("id", *[F.round(c, 6).alias(c) for c in cols])


@query
def fill_missing(spark, sf):
    rows = featured(spark, sf, "id", "btn", "avg_btn_3")
    return prepare.fill_missing(rows, ["btn", "avg_btn_3"])


@query
def group_deviations(spark, sf):
    rows = matrix(spark, sf, "id", *schema.RACE_KEY, "wgt_lbs", "avg_btn_3")
    out = ranking.group_deviations(rows, schema.RACE_KEY, ["wgt_lbs", "avg_btn_3"])
    return out.select("id", *[F.round(f"dev_{c}", 6).alias(f"dev_{c}") for c in ("wgt_lbs", "avg_btn_3")])


@query
def balanced_weights(spark, sf):
    return train.balanced_weights(matrix(spark, sf, *RACE_COLUMNS))


@query
def ensemble_mean(spark, sf):
    out = train.ensemble_mean(scored(spark, sf), ["prob", "combo_win_pc", "combo_place_pc"])
    return out.select("id", F.round("score", 9).alias("score"))


@query
def ensemble_weighted(spark, sf):
    weights = {"prob": 0.40, "combo_win_pc": 0.30, "combo_place_pc": 0.15, "h_course_place_pc": 0.15}
    out = train.ensemble_weighted(scored(spark, sf), weights)
    return out.select("id", F.round("score", 9).alias("score"))


@query
def auc(spark, sf):
    out = metrics.auc(scored(spark, sf), "target_win", ["prob", "combo_win_pc", "avg_btn_3"])
    return out.select("name", F.round("auc", 9).alias("auc"))


@query
def ndcg(spark, sf):
    out = metrics.ndcg(scored(spark, sf), ["race_id"], "target_win", "prob")
    return out.select("groups", F.round("ndcg", 9).alias("ndcg"))


@query
def leak_check(spark, sf):
    out = metrics.leak_check(matrix(spark, sf, "race_id", "target_win", *schema.ALL_FEATURES))
    return out.select("check", "name", F.round("value", 9).alias("value"))
