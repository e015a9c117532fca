from datetime import date

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from formlake import schema
from formlake.ml import metrics, prepare, store, train
from formlake.operators.cleaning import temporal_split
from formlake.plans.scoring import score_matrix

CUTOFF = date(2021, 6, 1)


@pytest.fixture(scope="module")
def planted(spark):
    """Races of six in which a low `avg_btn_3` wins, with some noise and missing values."""
    base = spark.range(3000).withColumn("race_id", (F.col("id") / 6).cast("long"))
    noise = F.abs(F.xxhash64("id")) % 1000 / 1000
    df = base.withColumns({
        "date": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("race_id") * 2).cast("int")),
        "avg_btn_3": F.when(F.abs(F.xxhash64("id", F.lit(2))) % 20 > 0, noise * 20),
        "course": F.when(F.col("race_id") % 7 > 0, F.concat(F.lit("C"), F.col("race_id") % 5)),
        "going": F.lit("Good"), "dist": F.concat(F.col("race_id") % 4 + 5, F.lit("f")),
        "class": F.concat(F.lit("Class "), F.col("race_id") % 3),
    })
    others = [c for c in schema.ALL_FEATURES if c != "avg_btn_3"]
    df = df.withColumns({c: (F.abs(F.xxhash64("id", F.lit(c))) % 50).cast("double") for c in others})
    strength = F.coalesce("avg_btn_3", F.lit(15.0)) + F.abs(F.xxhash64("id", F.lit(3))) % 5
    best = df.withColumn("_s", strength).groupBy("race_id").agg(F.min_by("id", "_s").alias("_best"))
    df = df.join(best, "race_id").withColumn("target_win", (F.col("id") == F.col("_best")).cast("int"))
    return df.drop("_best").persist()


@pytest.fixture(scope="module")
def halves(planted):
    return temporal_split(planted, CUTOFF)


def auc_of(scored, name="prob"):
    return metrics.auc(scored, "target_win", [name]).first()["auc"]


@pytest.fixture(scope="module")
def classifier(halves):
    return train.train_classifier(halves[0], trees=10, depth=4, rate=0.3)


def test_classifier_finds_the_signal_and_survives_storage(classifier, halves, tmp_path):
    scored = score_matrix(classifier, halves[1])
    assert auc_of(scored) > 0.8
    assert scored.columns == [*halves[1].columns, "prob"]
    store.save_model(classifier, str(tmp_path / "m"))
    again = score_matrix(str(tmp_path / "m"), halves[1])
    assert sorted(r["prob"] for r in again.collect()) == sorted(r["prob"] for r in scored.collect())
    counts = metrics.split_count_importance(
        f"{tmp_path}/m/learner", prepare.feature_names(classifier.prep)).collect()
    assert "avg_btn_3" in {r["feature"] for r in counts}


def test_importance_puts_the_signal_first(classifier):
    rows = metrics.feature_importance(classifier.prep, classifier.fitted, 3).collect()
    assert rows[0]["feature"] == "avg_btn_3" and len(rows) == 3


@pytest.mark.parametrize("fit", [
    lambda t: train.train_ranker(t, ["race_id"], iterations=30),
    lambda t: train.train_deep_ranker(t, ["race_id"], trees=8, depth=4, rate=0.3),
])
def test_rankers_beat_a_random_order(fit, halves):
    scored = score_matrix(fit(halves[0]), halves[1]).withColumn("random", F.abs(F.xxhash64("id", F.lit(9))))
    ours = metrics.ndcg(scored, ["race_id"], "target_win", "prob").first()["ndcg"]
    chance = metrics.ndcg(scored, ["race_id"], "target_win", "random").first()["ndcg"]
    assert ours > chance + 0.15


def test_ensemble_members_and_storage(halves, tmp_path):
    small = {"trees": 5, "depth": 4}
    ensemble = train.train_ensemble(halves[0], boosted=small, forest=small, extra=small, wide=small)
    scored = ensemble.score(halves[1])
    names = [f"p_{m}" for m in train.BLEND]
    out = train.ensemble_mean(scored, names)
    for name in [*names, "score"]:
        assert auc_of(out, name) > 0.65, name
    store.save_ensemble(ensemble, str(tmp_path / "e"))
    again = store.load_ensemble(str(tmp_path / "e")).score(halves[1])
    assert again.select(names).exceptAll(scored.select(names)).isEmpty()


def test_codes_are_fitted_on_the_training_part(spark):
    df = spark.createDataFrame(
        [(date(2020, 1, 1), "b"), (date(2020, 1, 1), "c"), (date(2022, 1, 1), "a"), (date(2020, 1, 1), None)],
        "date date, course string")
    def codes(**how):
        out = prepare.encode_categories(df, ["course"], cutoff=CUTOFF, **how)
        return {r["course"]: r["course_code"] for r in out.collect()}
    assert codes() == {"b": 0, "c": 1, "a": -1, None: -1}
    assert codes(fit_on="all") == {"a": 0, "b": 1, "c": 2, None: -1}


def test_codes_of_many_categories(spark):
    df = spark.range(12_000).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="categories"):
        prepare.fit_categories(df, ["c"])
    coded = {r["c"]: r["c_code"] for r in prepare.encode_categories(df, ["c"]).collect()}
    assert coded == {c: i for i, c in enumerate(sorted(coded))}


def test_a_slow_rate_keeps_its_trees(halves):
    model = train.train_classifier(halves[0], trees=24, depth=3, rate=0.01)
    assert model.fitted.stages[-1].getNumTrees > 12


def test_depth_is_passed_on(halves):
    prep = prepare.fit_preparation(halves[0], ["avg_btn_3", "draw"])
    model = train.train_gbm_wide(prep.transform(halves[0]), PipelineModel([]), trees=1, depth=9)
    assert model.stages[-1].getMaxDepth() == 9


def test_holdout_of_whole_days(spark):
    def marked(days, share):
        df = spark.createDataFrame([(date(2020, 1, d),) for d in days], "date date")
        return sorted((r["date"].day, r["_valid"]) for r in train._holdout(df, share).collect())

    assert marked([1] * 6 + [2] * 4, 0.1) == [(1, False)] * 6 + [(2, True)] * 4
    assert marked([1] * 9 + [2], 0.5) == [(1, False)] * 9 + [(2, True)]
    assert marked([1] * 3, 0.2) == [(1, False)] * 3 == marked([1] * 3, 0)
    assert marked(range(1, 11), 0.2)[-3:] == [(8, True), (9, True), (10, True)]


def test_no_holdout_trains_on_all(halves):
    assert train.train_classifier(halves[0], trees=3, depth=2, holdout=0).fitted.stages[-1].getNumTrees == 3


def test_best_count_is_patient():
    losses = [5.0, 4.0, 4.5, 4.4, 3.9, 4.1, 4.2, 4.3, 1.0]
    assert [train.best_count(losses, n) for n in (1, 3, 4, 9)] == [2, 5, 9, 9]


def test_deep_ranker_uses_the_race(spark, halves):
    model = train.train_deep_ranker(halves[0], group=["race_id"], trees=6, depth=4, rate=0.3)
    scored = model.score(halves[1])
    assert scored.columns == [*halves[1].columns, "prob"] and auc_of(scored) > 0.75
    inputs = model.prepare(halves[1]).select("features").first()["features"].size
    assert inputs == 2 * len(schema.ALL_FEATURES) + len(schema.CATEGORIES)


def test_scaling_of_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    rows = sorted(prepare.standardize(df, ["a", "b", "c"]).collect())
    assert [tuple(r) for r in rows] == [(-1.0, 0.0, None), (1.0, 0.0, None)]
    assert prepare.fill_missing(df, ["c"]).first()["c"] == -10.0


def test_auc_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, None)], "y int, s double")
    assert metrics.auc(df, "y", ["s"]).first()["auc"] == 0.875


def test_leak_check_sees_a_feature_that_knows_the_result(planted):
    leaky = planted.withColumn("log_prize", F.col("target_win") * 5.0)
    rows = {(r["check"], r["name"]): r["value"] for r in metrics.leak_check(leaky).collect()}
    assert rows["auc", "log_prize"] == 1.0 and rows["uneven_races", "log_prize"] == 500.0
