from datetime import date

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Observation
from pyspark.sql import functions as F

from formlake.ml import train
from formlake.operators import context
from formlake.sources import tables, versions
from formlake.streaming.files import deduplicating_ingest
from formlake.streaming.state import LatestRows, follow_results

HEADER = "date,course,race_id,off,horse,pos,draw,wgt,[or],btn,prize\n"


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(100).withColumnRenamed("id", "res_id")
    assert tables.read_features(spark, path) is None
    tables.write_features(df, path)
    broken = df.withColumn("x", F.when(F.col("res_id") == 70, F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        tables.write_features(broken, path)
    assert tables.read_features(spark, path).count() == 100
    tables.write_features(tables.read_features(spark, path).where("res_id < 10"), path)  # reads what it replaces
    assert tables.read_features(spark, path).count() == 10
    assert versions.drop_old(spark, path) >= 2 and tables.read_features(spark, path).count() == 10


def test_snapshot_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    results = spark.createDataFrame([(1, date(2020, 1, 1)), (2, date(2020, 9, 1))], "id long, date date")
    every = {"results": results, "features_x": spark.range(5).withColumnRenamed("id", "res_id"), "other": spark.range(7)}
    context.write_snapshot(context.recent_snapshot(every, 6, date(2020, 10, 1)), path)
    bad = {"results": results, "other": spark.range(1).select(F.raise_error(F.lit("lost")).alias("id"))}
    with pytest.raises(Exception, match="lost"):
        context.write_snapshot(bad, path)
    assert {n: t.count() for n, t in context.read_snapshot(spark, path).items()} == {"results": 1, "features_x": 1, "other": 7}


def test_latest_rows_do_not_grow_with_history(spark, tmp_path):
    state = LatestRows(str(tmp_path / "state"), payload=("x",), buckets=4)
    assert state.rows(spark) is None
    rows = spark.range(4000).select(
        (F.col("id") % 20).cast("string").alias("horse"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 40).cast("int")).alias("date"),
        "id", (F.col("id") * 2).alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(None, date(2030, 1, 1), 1, 1)], rows.schema))
    landed = str(tmp_path / "landed")
    for part in (rows.where("id >= 2000"), rows.where("id < 2000"), rows.where("id % 7 = 0")):
        part.coalesce(1).write.mode("append").parquet(landed)
        follow_results(spark, landed, rows.schema, state, str(tmp_path / "checkpoint"))
    got = {r.horse: (r.id, r.x) for r in state.rows(spark).collect()}
    assert got == {str(i): (3980 + i, 2 * (3980 + i)) for i in range(20)}
    one = spark.createDataFrame([("3",), (None,)], "horse string")
    read = state.of(one)
    assert [r.id for r in read.collect()] == [3983] and len(read.inputFiles()) == 1
    assert state.of(spark.createDataFrame([(None,)], "horse string")) is None


def test_the_same_file_under_two_names_adds_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    text = HEADER + "2022-01-01,Bath,15,2:00,Flo,1,2,9-0,70,,\n2022-01-01,Bath,15,2:00,Ann,2,3,9-0,70,1,\n2022-01-01,Bath,15,2:00,,3,4,9-0,70,2,\n"
    args = (str(folder), str(tmp_path / "out"), str(tmp_path / "state"), HEADER.strip().split(","))
    (folder / "a.csv").write_text(text)
    assert deduplicating_ingest(spark, *args).count() == 3
    (folder / "b.csv").write_text(text.replace("2022", "1999"))  # an old date isn't late
    (folder / "c.csv").write_text(HEADER + "1980-01-01,Bath,16,2:00,Flo,1,2,9-0,70,,\n")
    rows = deduplicating_ingest(spark, *args).collect()
    assert sorted((r.race_id, r.horse or "") for r in rows) == [(15, ""), (15, ""), (15, "Ann"), (15, "Flo"), (16, "Flo")]


def test_copartitioned_matrix_has_no_exchange(spark):
    from formlake import catalog

    plan = catalog.QUERIES["assemble_matrix_copartitioned"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 5 and "Exchange" not in plan


def test_models_score_after_something_was_observed(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("int").alias(train.LABEL))
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    model = train.train_forest(rows, trees=2, depth=2)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 200
    assert train.add_probability(rows, model, "p").where("p between 0 and 1").count() == 200
