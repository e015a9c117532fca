"""Models of full size, and the two ways to grow them: a job for each pass, and one task with all rows."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from formlake import catalog, schema
from formlake.ml import boost, random_trees, train
from formlake.ml.boost import Params


class Seen(Exception):
    pass


@pytest.fixture
def rows(spark, monkeypatch):
    """A matrix of a few rows, whatever columns are asked for."""
    columns = [*schema.MATRIX_COLUMNS]
    rows = spark.range(60).select(
        *[F.date_add(F.lit("1999-12-01").cast("date"), F.col("id").cast("int")).alias(c) if c == "date"
          else F.concat(F.lit(c), F.col("id") % 3).alias(c) if c in schema.CATEGORIES
          else (F.col("id") % 7).cast("int").alias(c) for c in columns])
    monkeypatch.setattr(catalog, "matrix", lambda spark, sf, *some: rows.select(*some) if some else rows)
    monkeypatch.setattr(catalog, "ordered", lambda spark, sf, *some: rows)
    return rows


def _arguments(monkeypatch, module, name, call):
    """What a query calls the trainer with."""
    seen = {}

    def stop(*args, **kwargs):
        seen.update(args=args, kwargs=kwargs)
        raise Seen

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Seen):
        call()
    return seen


@pytest.mark.parametrize("name", ["train_boosted", "train_forest", "train_extra_trees", "train_gbm_wide"])
def test_ensemble_members_have_their_full_size(spark, rows, monkeypatch, tmp_path, name):
    """F15, F18, F19, F20. Before, members had 5, 10, 10 and 4 trees of 1000, 600, 600 and 1000."""
    seen = _arguments(monkeypatch, train, "train_ensemble", lambda: catalog.QUERIES[name](spark, str(tmp_path)))
    assert seen["kwargs"] == {} and len(seen["args"]) == 1
    assert set(schema.ALL_FEATURES) | set(schema.CATEGORIES) <= set(seen["args"][0].columns)
    default = Params()
    assert (default.trees, default.depth, default.rate) == (1000, 6, 0.05)


def test_classifier_and_deep_ranker_have_their_full_size(spark, rows, monkeypatch, tmp_path):
    """F16, F17. Before, they grew at a rate of 0.5 and gave up after 4 trees that were no better."""
    seen = _arguments(monkeypatch, boost, "train_boosted_trees", lambda: catalog.train_classifier(spark, str(tmp_path)))
    assert seen["kwargs"].get("params", Params()) == Params(trees=1000, depth=6, rate=0.05, patience=50)
    seen = _arguments(monkeypatch, boost, "train_listwise_ranker", lambda: catalog.train_deep_ranker(spark, str(tmp_path)))
    p = seen["kwargs"]["params"]
    assert (p.trees, p.depth, p.rate, p.patience, p.min_child, p.rows, p.columns) == (2000, 8, 0.01, 100, 5, 0.8, 0.8)


@pytest.fixture(scope="module")
def races(spark):
    df = spark.range(1800)
    noise = [F.abs(F.xxhash64("id", F.lit(k))) % 1000 / 1000 for k in range(4)]
    return df.withColumns({
        "race": (F.col("id") / 6).cast("long"), "date": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 60).cast("int")),
        "a": noise[0], "b": F.when(noise[1] > 0.2, noise[2] * 9), "c": F.concat(F.lit("C"), F.abs(F.xxhash64("id")) % 5),
        "target_win": ((noise[0] > 0.6) & (noise[3] > 0.2)).cast("int"),
    }).persist()


def test_one_task_grows_the_trees_of_the_passes(races, monkeypatch):
    """Before, every pass over a tree was a job, however few the rows."""
    p = Params(trees=6, depth=4, rate=0.3, rows=0.8, columns=0.7)
    wide = dataclasses.replace(p, leaves=9)

    def grown():
        return [*boost.train_boosted_models(races, [p, wide], ["a", "b"], ["c"]),
                boost.train_listwise_ranker(races, ["race"], ["a", "b"], ["c"], params=p)]

    held = grown()
    monkeypatch.setattr(boost, "HELD_ROWS", -1)
    for one, passes in zip(held, grown(), strict=True):
        assert [t.feature for t in one.trees] == [t.feature for t in passes.trees] and len(one.trees) > 0
        assert [t.mask for t in one.trees] == [t.mask for t in passes.trees]
        assert np.allclose([v for t in one.trees for v in t.value], [v for t in passes.trees for v in t.value])
        assert np.allclose(one.losses, passes.losses)


def test_random_trees_are_the_same_in_one_task(races, monkeypatch):
    held = random_trees.train_random_trees(races, ["a", "b"], ["c"], trees=5, depth=5, batch=2)
    monkeypatch.setattr(random_trees, "HELD_ROWS", -1)
    assert random_trees.train_random_trees(races, ["a", "b"], ["c"], trees=5, depth=5, batch=2) == held


def test_checkpoints_that_nothing_reads_are_deleted(spark, races, monkeypatch):
    """Before, all blocks of every twentieth tree stayed in the scratch folder."""
    monkeypatch.setattr(boost, "HELD_ROWS", -1)
    monkeypatch.setattr(boost, "BLOCKS_CHECKPOINT_EVERY", 2)
    written = []
    drop = boost._Blocks._drop_old

    def seen(self):
        drop(self)
        if self.kept and self.kept not in written:
            written.append(self.kept)

    monkeypatch.setattr(boost._Blocks, "_drop_old", seen)
    model = boost.train_boosted_trees(races, ["a", "b"], ["c"], params=Params(trees=9, depth=2, rate=0.1), holdout=0)
    assert len(model.trees) == 9 and len(written) >= 3

    def there(path):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    assert [there(x) for x in written] == [False] * (len(written) - 1) + [True]


def test_compiled_trees_walk_like_arrays(spark):
    """Nodes of every kind, on missing, infinite and plain numbers. Before, trees were SQL text, of megabytes at full size."""
    bins = boost.Bins({"x": [1.0, 2.0]}, {"c": ["p", "q"]}, {"c": False})
    tree = boost.Tree()
    #: missing left and none else; numbers left and none else; up to 1.0; a set of categories.
    for feature, left, mask, value in ((0, 1, "1000", 0.0), (0, -1, "", 1.0), (0, 3, "0100", 0.0), (1, 5, "1010", 0.0),
                                       (0, 7, "0111", 0.0), (0, -1, "", 2.0), (0, -1, "", 3.0), (0, -1, "", 4.0), (0, -1, "", 5.0)):
        tree.feature.append(feature), tree.left.append(left), tree.mask.append(mask), tree.value.append(value)
    tree.depth = 3
    rows = [(x, c) for x in (None, float("nan"), float("-inf"), 0.5, 1.0, 1.5, 9.0, float("inf")) for c in ("p", "q", None, "new")]
    df = spark.createDataFrame(rows, "x double, c string")
    model = boost.Boosted(bins, (tree, tree), 10.0, "logistic")
    arrays = df.select(*bins.inputs()).toPandas()
    numbers = bins.matrix([arrays["_x0"].to_numpy(float), arrays["_x1"].to_numpy()])
    want = 10 + boost.Walk([tree, tree], bins.width).value(numbers)
    assert [r.m for r in model.margin(df, "m").select("m").collect()] == want.tolist()
    assert set(want) == {12.0, 14.0, 16.0, 18.0}


def test_blocks_hold_what_growing_reads(races, monkeypatch):
    """F7, F8, F12. Before, rows that are all used kept two lots each, and the first margin, the same for all, was stored."""
    stored, grown = [], []
    take = boost.to_blocks
    monkeypatch.setattr(boost, "to_blocks", lambda *a: stored.append(take(*a)) or stored[-1])
    for rows in (1.0, 0.8):
        grown.append(boost.train_boosted_trees(races, ["a", "b"], ["c"], params=Params(trees=2, depth=2, rows=rows), holdout=0))
    held = [set(x.first()) for x in stored]
    assert held == [{"bins", "y", "valid"}, {"bins", "y", "valid", "lot", "step"}] and all(m.trees for m in grown)


def test_the_ranker_on_base_inputs_reads_no_others(spark, rows, monkeypatch, tmp_path):
    """F9. Before, its rows had all inputs, which took a shuffle more."""
    asked = []
    monkeypatch.setattr(catalog, "ordered", lambda spark, sf, *some: asked.append(some) or rows)
    _arguments(monkeypatch, boost, "train_listwise_ranker", lambda: catalog.train_ranker(spark, str(tmp_path)))
    assert asked == [tuple(catalog.BASE_COLUMNS)]
