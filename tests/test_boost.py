from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from formlake.ml import boost, metrics, train
from formlake.ml.boost import Params
from formlake.operators.cleaning import temporal_split

GROUP = ["race"]


@pytest.fixture(scope="module")
def races(spark):
    """Races of six. Who is nearest to 0.5 by `b` wins, but `a` is moved by the race and says nothing."""
    df = spark.range(4200).withColumn("race", (F.col("id") / 6).cast("long"))

    def noise(k):
        return F.abs(F.xxhash64("id", F.lit(k))) % 1000 / 1000

    df = df.withColumns({
        "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("race").cast("int")),
        "shift": (F.abs(F.xxhash64("race")) % 100).cast("double"),
        "a": noise(1) + (F.abs(F.xxhash64("race")) % 100), "b": noise(2),
        "m": F.when(F.abs(F.xxhash64("id", F.lit(3))) % 4 > 0, noise(4) * 20 - 10),
        "c": F.concat(F.lit("C"), F.abs(F.xxhash64("id", F.lit(5))) % 7),
    })
    best = df.groupBy("race").agg(F.min_by("id", F.abs(F.col("b") - 0.5)).alias("best"))
    df = df.join(best, "race").withColumn("target_win", (F.col("id") == F.col("best")).cast("int"))
    return df.withColumns({
        "gone": F.col("m").isNull().cast("int"), "y": ((F.col("b") > 0.6) | (F.col("c") == "C3")).cast("int"),
    }).drop("best").persist()


def auc_of(scored, label="target_win"):
    return metrics.auc(scored, label, ["prob"]).first()["auc"]


def ndcg_of(scored):
    return metrics.ndcg(scored, GROUP, "target_win", "prob").first()["ndcg"]


def test_ranker_beats_the_linear_one_where_only_the_order_counts(races):
    old, new = temporal_split(races, date(2021, 6, 1))
    features = ["a", "shift", "b", "m"]
    model = boost.train_listwise_ranker(
        old, GROUP, features, ["c"], params=Params(trees=30, rate=0.5, depth=3, patience=6))
    linear = train.train_ranker(old, GROUP, features)
    listwise = ndcg_of(model.score(new))
    assert listwise > 0.9 and listwise > ndcg_of(linear.score(new)) + 0.2
    assert model.losses[len(model.trees)] == min(model.losses) < model.losses[0]


def test_leaf_values_and_sums_equal_sql(races, spark):
    p = Params(trees=1, rate=1.0, depth=1, l2=3.0, min_child=2.0)
    model = boost.train_boosted_trees(races, ["b", "m"], [], "y", p, holdout=0)
    root, *leaves = model.nodes(spark).orderBy("node").collect()
    share = races.agg(F.avg("y")).first()[0]
    side = F.expr(f"coalesce({root.feature} <= {root.threshold!r}, {str(root.missing_left).lower()})")
    g, h = F.sum(F.lit(share) - F.col("y")), F.count(F.lit(1)) * share * (1 - share)
    want = {r.side: r for r in races.groupBy(side.alias("side")).agg((-g / (h + 3.0)).alias("v"), g.alias("g"), h.alias("h")).collect()}
    for leaf, goes_left in zip(leaves, (True, False), strict=True):
        assert leaf.value == pytest.approx(want[goes_left].v) and leaf.hessian == pytest.approx(want[goes_left].h)
    assert root.gain == pytest.approx(sum(w.g ** 2 / (w.h + 3) for w in want.values()) - sum(w.g for w in want.values()) ** 2 / (
        sum(w.h for w in want.values()) + 3))
    light = boost.train_boosted_trees(races, ["b", "m"], ["c"], "y", Params(trees=1, rate=1.0, depth=6, min_child=200.0), holdout=0)
    assert light.nodes(spark).agg(F.min("hessian")).first()[0] >= 200


def test_growth_stops_at_best_plus_patience(races, spark):
    tracker = spark.sparkContext
    tracker.setJobGroup("boost", "boost")
    p = Params(trees=500, rate=1.0, depth=3, patience=3)
    noisy = races.withColumn("y", F.when(F.abs(F.xxhash64("id", F.lit(9))) % 3 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    model = boost.train_boosted_trees(noisy, ["a", "b", "m"], ["c"], "y", p)
    jobs = len(tracker.statusTracker().getJobIdsForGroup("boost"))
    tracker.setLocalProperty("spark.jobGroup.id", None)
    grown = len(model.losses)
    assert grown == len(model.trees) + 4 < 60
    assert model.losses.index(min(model.losses)) == len(model.trees)
    assert jobs < 10 * grown + 60  # nothing is grown up to 500 and nothing fitted again


def test_missing_values_have_their_own_direction(races, spark):
    model = boost.train_boosted_trees(races, ["m", "b"], [], "gone", Params(trees=1, rate=1.0, depth=1, l2=0.0), holdout=0)
    scored = model.score(races.withColumn("m", F.col("m")))
    assert auc_of(scored, "gone") == 1.0
    # No number is taken for missing, however small.
    far = races.withColumn("m", F.when(F.col("m").isNull(), -1e9).otherwise(F.col("m")))
    low = model.score(far).agg(F.max("prob")).first()[0]
    assert low < scored.where("m is null").agg(F.min("prob")).first()[0]
    nan = model.score(races.withColumn("m", F.when(F.col("m").isNull(), float("nan")).otherwise(F.col("m"))))
    assert auc_of(nan, "gone") == 1.0


def test_best_leaf_first_has_uneven_depth_and_less_loss(races, spark):
    def loss(model, rows):
        m = boost.logistic_gradients(model.margin(rows, "_margin").withColumns({"_y": F.col("y").cast("double")}))
        return m.agg(F.avg("_loss")).first()[0]

    rows = races.withColumn("y", ((F.col("b") > 0.97) | (F.col("b") < 0.01) | ((F.col("b") > 0.9) & (F.col("a") % 1 > 0.5))).cast("int"))
    rows = rows.withColumn("frac", F.col("a") % 1)
    leaf = boost.train_boosted_trees(
        rows, ["b", "frac"], [], "y", Params(trees=1, rate=1.0, depth=9, leaves=8, min_child=0.1), holdout=0)
    level = boost.train_boosted_trees(rows, ["b", "frac"], [], "y", Params(trees=1, rate=1.0, depth=3, min_child=0.1), holdout=0)
    leaves = [sum(x < 0 for x in m.trees[0].left) for m in (leaf, level)]
    assert leaves[0] <= 8 and leaves[1] <= 8 and leaf.trees[0].depth > 3
    assert loss(leaf, rows) < loss(level, rows)


def test_categories_unseen_and_overflowing(races, spark):
    model = boost.train_boosted_trees(races, ["b"], ["c"], "y", Params(trees=8, rate=0.5, depth=3), holdout=0)
    assert auc_of(model.score(races), "y") > 0.99
    few = boost.train_boosted_trees(races, ["b"], ["c"], "y", Params(trees=2, depth=3, categories=2), holdout=0)
    assert len(few.bins.labels["c"]) == 2 and few.bins.overflow["c"]
    odd = races.limit(5).withColumn("c", F.when(F.col("id") % 2 == 0, "new"))
    assert few.score(odd).where("prob is null").count() == model.score(odd).where("prob is null").count() == 0
    wide = races.withColumn("c", F.concat(F.lit("x"), F.col("id")))
    assert boost.train_boosted_trees(wide, ["b"], ["c"], "y", Params(trees=2, depth=3), holdout=0).trees


def test_storage_and_split_groups(races, spark, tmp_path, split_rows):
    p = Params(trees=3, rate=0.3, depth=3, rows=0.8, columns=0.7)
    model = boost.train_listwise_ranker(races, GROUP, ["a", "b", "shift"], ["c"], params=p, holdout=0)
    model.save(spark, str(tmp_path / "m"))
    again = boost.Boosted.load(spark, str(tmp_path / "m"))
    assert again == model and model.importance(spark, 3).count() == 3
    one = races.withColumn("race", F.lit(1))
    plain = boost.train_listwise_ranker(one, GROUP, ["a", "b"], [], params=p, holdout=0)
    split_rows(500)
    cut = boost.train_listwise_ranker(one, GROUP, ["a", "b"], [], params=p, holdout=0)
    assert [t.feature for t in cut.trees] == [t.feature for t in plain.trees]
    assert np.allclose([v for t in cut.trees for v in t.value], [v for t in plain.trees for v in t.value])


def test_a_pass_over_a_tree_is_one_job_without_a_shuffle(races, spark):
    """Before, every pass made a row for each input of a row and shuffled sums, two jobs and more."""
    def jobs(trees):
        spark.sparkContext.setJobGroup(f"passes {trees}", "passes")
        boost.train_boosted_trees(races, ["a", "b", "m"], ["c"], "y", Params(trees=trees, rate=0.3, depth=3), holdout=0)
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(f"passes {trees}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(found)

    assert jobs(5) - jobs(2) < 3 * 6  # four passes a tree: the root and the three levels below


@pytest.mark.parametrize("ranking", [False, True])
def test_sums_of_blocks_equal_those_of_a_table(races, spark, split_rows, ranking):
    p = Params(trees=2, rate=0.5, depth=3, rows=0.7, columns=0.8)
    seen = []
    take = boost._boost
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(boost, "_boost", lambda rows, *rest: seen.append(rows) or take(rows, *rest))
        if ranking:
            some = races.where("id < 1200")
            blocks = boost.train_listwise_ranker(some, GROUP, ["b", "m"], ["c"], params=p)
            split_rows(5)
            table = boost.train_listwise_ranker(some, GROUP, ["b", "m"], ["c"], params=p)
            assert [type(x) for x in seen] == [boost._Blocks, boost._Rows]
            assert np.allclose(blocks.losses, table.losses)
        else:
            blocks = table = boost.train_boosted_trees(races, ["b", "m"], ["c"], "y", p)
    assert [t.feature for t in blocks.trees] == [t.feature for t in table.trees]
    assert np.allclose([v for t in blocks.trees for v in t.value], [v for t in table.trees for v in t.value])
    # What the trees say to a row is the same by bins and by thresholds.
    odd = F.when(F.col("id") % 5 == 0, float("-inf")).when(F.col("id") % 5 == 1, float("nan")).otherwise(F.col("m"))
    rows = races.where("id < 500").withColumn("m", odd).withColumn("c", F.when(F.col("id") % 7 > 0, F.col("c")))
    binned = rows.select("id", F.struct(*blocks.bins.inputs()).alias("x")).select("id", "x.*")
    n = len(blocks.bins.edges)
    bins = F.array(*[blocks.bins._number(c, f"_x{i}") for i, c in enumerate(blocks.bins.edges)], *[f"_x{i}" for i in range(n, len(blocks.bins.names))])
    sql = binned.withColumn("_bins", bins).select("id", F.expr(boost.walk(blocks.trees, "value")).alias("m"))
    want = {r.id: r.m + blocks.base for r in sql.collect()}
    got = {r.id: r.m for r in blocks.margin(rows, "m").select("id", "m").collect()}
    assert got == pytest.approx(want)


def test_models_with_equal_bins_share_their_blocks(spark, monkeypatch):
    """the boosted members of an ensemble are binned and cut into blocks once, and are those fitted alone."""
    rows = spark.range(400).selectExpr(
        "cast(id % 37 as double) AS a", "cast(id % 11 as double) AS b", "concat('c', id % 3) AS k",
        "cast(id % 37 > 20 as int) AS target_win", "date_add(date'2000-01-01', cast(id % 50 as int)) AS date")
    made = []
    for name in ("fit_bins", "to_blocks"):
        plain = getattr(boost, name)
        monkeypatch.setattr(boost, name, lambda *a, plain=plain, name=name, **k: made.append(name) or plain(*a, **k))
    small = {"trees": 2, "depth": 2}
    found = train.train_ensemble(
        rows, ["a", "b"], ["k"], boosted=small, forest=small, extra=small, wide={"trees": 2, "depth": 3})
    assert sorted(made) == ["fit_bins", "to_blocks"]
    alone = boost.train_boosted_trees(rows, ["a", "b"], ["k"], params=boost.Params(leaves=256, trees=2, depth=3), holdout=0)
    assert found.members["wide"].trees == alone.trees and list(found.members) == ["boosted", "forest", "extra", "wide"]
    other = boost.train_boosted_models(
        rows, [boost.Params(trees=1, depth=1, bins=4), boost.Params(trees=1, depth=1)], ["a"], [], holdout=0)
    assert [len(m.bins.edges["a"]) for m in other] == [3, 37]
