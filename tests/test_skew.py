"""The split-safe building blocks against plain windows, with a third of the rows on one key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from formlake.ml import metrics
from formlake.operators import ranking
from formlake.operators.skew import (
    KeyScan,
    SplitPolicy,
    lookup,
    ordered_chunks,
    positions,
    running_totals,
    with_group_values,
)
from formlake.sources.tables import dedupe_append


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit("hot"))
    df = spark.range(9000).select(
        "id", F.coalesce(key, F.when(F.col("id") % 3 == 2, F.concat(F.lit("k"), F.col("id") % 50))).alias("k"),
        (F.xxhash64("id") % 100).alias("v"), (F.abs(F.xxhash64("id", F.lit(1))) % 7).alias("s"),
    )
    return df.persist()


def same(a, b):
    columns = sorted(a.columns)
    assert a.count() == b.count()
    assert a.select(columns).exceptAll(b.select(columns)).isEmpty()


def test_over_full_keys_are_found_and_bounded(rows):
    hot = KeyScan(rows, SplitPolicy(1000, 10)).hot(["k"])
    assert hot.n_keys == 2 and hot.n_rows == 6000  # NULL is a key too
    more = KeyScan(rows, SplitPolicy(1000, 1)).hot(["k"])  # too many to broadcast, but all are split
    assert more.n_keys == 2 and more.n_rows == 6000
    assert KeyScan(rows, SplitPolicy(10_000, 10)).hot(["k"]) is None


def test_more_keys_than_are_broadcast(rows):
    order, totals = [F.col("v"), F.col("id")], {"t": F.col("s")}
    plain = running_totals(rows, ["k"], order, totals, KeyScan(rows, SplitPolicy(10**6)))
    same(running_totals(rows, ["k"], order, totals, KeyScan(rows, SplitPolicy(100, 1, 1))), plain)


def test_finer_keys_need_no_scan_when_the_coarse_key_is_fine(rows):
    scan = KeyScan(rows, SplitPolicy(4000, 10))
    assert scan.hot(["k"]) is None and scan.hot(["k", "s"]) is None


def test_chunks_are_contiguous_and_balanced(rows):
    parts = ordered_chunks(rows, ["k"], [F.col("v"), F.col("id")], 9000, SplitPolicy(500, 10))
    sizes = [r["count"] for r in parts.groupBy("_chunk").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 1500
    spans = parts.groupBy("k", "_chunk").agg(
        F.min(F.struct("v", "id")).alias("lo"), F.max(F.struct("v", "id")).alias("hi")
    )
    before = F.lag("hi").over(Window.partitionBy("k").orderBy("_chunk"))
    assert spans.withColumn("before", before).where("before >= lo").isEmpty()


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_totals(rows, split_rows, keys):
    w = Window.partitionBy(*keys).orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
    expected = rows.withColumn("t", F.coalesce(F.sum("s").over(w), F.lit(0)))
    split_rows(700)
    same(running_totals(rows, keys, [F.col("v"), F.col("id")], {"t": F.col("s")}), expected)


def test_positions_descending(rows, split_rows):
    order = [F.desc("v"), F.asc("id")]
    expected = rows.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    split_rows(700)
    same(positions(rows, ["k"], order, "p"), expected)


def test_group_values_and_lookup(rows, split_rows):
    expected = rows.withColumn("m", F.max("v").over(Window.partitionBy("k")))
    split_rows(700)
    same(with_group_values(rows, ["k"], {"m": F.max("v")}), expected)
    per_key = rows.groupBy("k").agg(F.max("v").alias("m"))
    same(lookup(rows, per_key, ["k"]), expected)
    assert lookup(rows, per_key.where("k = 'hot'"), ["k"], "left_anti").where("k = 'hot'").isEmpty()


def test_dedupe_append_is_idempotent(rows, split_rows):
    split_rows(700)
    rows = rows.where("k is not null")  # a NULL is no key
    old = rows.where("v < 50")
    once = dedupe_append(rows, old, ("k", "id"))
    same(once, rows)
    same(dedupe_append(rows, once, ("k", "id")), rows)


def test_metrics_with_a_large_group(rows, split_rows):
    df = rows.withColumn("label", (F.col("s") == 0).cast("int")).withColumn("score", F.col("v") / 100)
    plain_auc = metrics.auc(df, "label", ["score", "id"]).collect()
    plain_ndcg = metrics.ndcg(df, ["k"], "label", "score").first()
    split_rows(60)
    assert metrics.auc(df, "label", ["score", "id"]).orderBy("name").collect() == sorted(plain_auc)
    split = metrics.ndcg(df, ["k"], "label", "score").first()
    assert split["groups"] == plain_ndcg["groups"] and abs(split["ndcg"] - plain_ndcg["ndcg"]) < 1e-12


def test_group_index_is_dense(rows, split_rows):
    split_rows(9)
    out = ranking.group_index(rows, ["k", "s"])
    expected = rows.select("k", "s").dropna().distinct().orderBy("k", "s").collect()
    want = {(r["k"], r["s"]): i for i, r in enumerate(expected)}
    for r in out.collect():
        assert r["group_id"] == want.get((r["k"], r["s"]), -1)


def test_asof_lookup_with_a_large_horse(spark, split_rows):
    from formlake.operators.context import asof_context

    days = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 211).cast("int"))
    horse = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id") % 20))
    past = spark.range(3000).select("id", days.alias("date"), horse.alias("horse"), (F.col("id") * 2).alias("x"))
    cards = spark.range(600).select(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 230).cast("int")).alias("card_date"),
        F.lit("GB").alias("region"), F.lit("York").alias("course"), F.col("id").cast("string").alias("off"),
        F.lit(1).alias("number"), F.when(F.col("id") % 2 == 0, "hot").otherwise(
            F.concat(F.lit("h"), F.col("id") % 20)).alias("horse"),
    )
    plain = asof_context(cards, past, payload=["x"]).collect()
    split_rows(40)
    split = asof_context(cards, past, payload=["x"]).collect()
    assert len(plain) == 600 and sorted(plain, key=str) == sorted(split, key=str)
    assert any(r["ctx_x"] is not None for r in plain)


def test_results_view_with_split_orders(spark, split_rows):
    from conftest import SF

    from formlake import fixtures

    fixtures.register_tables(spark, SF)
    plain = spark.sql(fixtures.RESULTS_SQL)
    split_rows(10)
    split = fixtures.results_view(spark, SF)
    assert split.dtypes == plain.dtypes
    same(split, plain)


def test_results_are_numbered_without_storing_or_ordering_whole_rows(spark, split_rows, monkeypatch):
    """Only races are cut into chunks; the rows themselves are dealt by race, once."""
    from conftest import SF

    from formlake import fixtures
    from formlake.operators import skew

    stored, cut = [], skew.cut_lineage
    monkeypatch.setattr(skew, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    split_rows(1000)  # no race is over-full, but there are more races than one chunk holds
    view = fixtures.results_view(spark, SF)
    assert stored and all("horse" not in columns for columns in stored)
    place = F.row_number().over(Window.orderBy("race_id", "seq"))
    assert view.withColumn("_place", place).where("id <> _place or id is null").count() == 0
    assert view.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
