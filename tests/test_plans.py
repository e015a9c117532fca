"""What the plans look like: shuffles, pruning, and no Python in them."""

from datetime import date

import pytest
from conftest import SF
from pyspark.sql import functions as F

from formlake import catalog, fixtures, schema
from formlake.operators import cleaning, history, ranking
from formlake.operators.context import CONTEXT_COLUMNS, latest_context, pair_context
from formlake.plans.features import build_features, build_matrix


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def results(spark):
    return fixtures.results(spark, SF)


def test_fused_pass_has_three_shuffles_and_four_sorts(results):
    text = plan(build_matrix(results))
    assert text.count("Exchange hashpartitioning") == text.count("Exchange") == 3
    for key in ("(horse#", "(trainer#", "(race_id#"):
        assert text.count(f"Exchange hashpartitioning{key}") == 1
    assert text.count("Sort [") == 4
    assert "Join" not in text and "SinglePartition" not in text


def test_trailing_window_adds_every_row_once(results):
    text = plan(history.pair_trailing_stats(results))
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1
    assert "RangeFrame, unboundedpreceding$(), -366" in text and "-365" not in text


def test_columns_are_pruned_at_the_scan(results):
    text = plan(history.recent_form(results))
    read = text.split("ReadSchema: ")[1]
    assert "comment" not in read and "prize" not in read and "btn" in read


def test_filters_reach_the_scan(results, spark, tmp_path):
    before, after = cleaning.temporal_split(results, date(2000, 1, 1))
    assert "LessThan(date,2000-01-01)" in plan(before)
    results.withColumn("year", F.year("date")).write.partitionBy("year").parquet(str(tmp_path / "r"))
    _, late = cleaning.temporal_split(spark.read.parquet(str(tmp_path / "r")), date(2000, 1, 1))
    assert "(year" in plan(late).split("PartitionFilters: ")[1].split("]")[0]
    assert after.count() == late.count()


def test_ranking_keeps_n_per_group_before_the_shuffle(results):
    text = plan(ranking.rank_runners(results, ["race_id"], "btn", 5))
    assert text.count("WindowGroupLimit") == 2
    text = plan(ranking.top_pick(results, schema.RACE_KEY, "btn"))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1 and "SortAggregate" not in text


def test_context_aggregates_before_it_shuffles(results):
    featured = build_features(results)
    cards = results.select("horse").distinct()
    text = plan(latest_context(cards, featured.select("horse", "date", "id", *CONTEXT_COLUMNS)))
    # The history is by horse already, so there is no second step.
    assert text.count("WindowGroupLimit") == 1 and "LeftSemi" in text and "SortAggregate" not in text
    runs = results.select("id", "date", "trainer", "jockey")
    synergy = results.select(F.col("id").alias("res_id"), F.lit(1).alias("combo_runs"), F.lit(1.0).alias("combo_win_pc"))
    text = plan(pair_context(results.select("trainer", "jockey"), runs, synergy))
    assert text.count("WindowGroupLimit") == 2 and "SortAggregate" not in text


NO_PYTHON = ["build_features", "data_audit", "score_cards", "ndcg", "auc", "card_history", "recent_form_split"]


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_in_the_plan(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in text
