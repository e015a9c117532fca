import pytest
from pyspark.sql import functions as F

from formlake import fixtures
from formlake.operators import history, skew
from formlake.plans import features


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _runs(spark, n=600):
    return spark.range(n).select(
        "id", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("date"),
        (F.col("id") % 97).alias("race_id"), F.concat(F.lit("H"), F.col("id") % 41).alias("horse"),
        F.concat(F.lit("C"), F.col("id") % 5).alias("course"), F.concat(F.lit("T"), F.col("id") % 13).alias("trainer"),
        F.concat(F.lit("J"), F.col("id") % 7).alias("jockey"), F.lit("Class 3").alias("class"), F.lit("b").alias("hg"),
        (F.col("id") % 9).cast("string").alias("pos"), (F.col("id") % 4).cast("double").alias("btn"),
        (F.col("id") % 60).cast("int").alias("official_rating"), F.lit("9-1").alias("wgt"), F.lit("£100").alias("prize"),
        F.lit(0).alias("jockey_allowance"))


def _tasks(df):
    """Partitions of each exchange of the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_windows_are_dealt_to_more_tasks_than_partitions_where_rows_are_many(spark, few_partitions, monkeypatch):
    """Before, the rows of a large table went to as few tasks as there were shuffle partitions, and sorts spilled."""
    runs = _runs(spark)
    before = {name: sorted(make(runs).collect()) for name, make in FAMILIES.items()}
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    for name, make in FAMILIES.items():
        out = make(runs)
        found = _tasks(out)
        assert found and all(", 12), REPARTITION_BY_NUM" in line for line in found), (name, found)
        assert len(found) == (3 if name == "all" else 2 if name == "micro" else 1)
        assert sorted(out.collect()) == before[name]


FAMILIES = {
    "form": history.recent_form, "class": history.class_moves, "course": history.entity_place_stats,
    "pair": history.pair_trailing_stats, "micro": history.micro_features, "all": features.build_features,
}


def test_csv_files_are_packed_and_read_back(spark, tmp_path):
    """Before, the raw CSV lay on disk as plain text."""
    text = spark.createDataFrame([("a,b", 'say "x"', None)], "a string, b string, c string")
    for _ in range(2):
        fixtures.write_csv(text, str(tmp_path / "csv"))
    assert {p.suffix for p in (tmp_path / "csv").glob("part-*")} == {".gz"}
    rows = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()
    assert [tuple(r) for r in rows] == [("a,b", 'say "x"', None)] * 2
