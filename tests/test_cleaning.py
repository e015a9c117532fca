from datetime import date

import pytest
from pyspark.sql import functions as F

from formlake import courses, schema
from formlake.functions import parsing
from formlake.operators import audit, cleaning
from formlake.plans.ingest import clean_results, ingest
from formlake.sources import tables
from formlake.streaming.files import incremental_ingest


def values(spark, expression, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(expression("t").alias("v"), "i").orderBy("i").select("v").collect()]


def test_weights(spark):
    texts = ["9-7", "10-0", "133", " 9 - 7 ", "9-x", "", None, "9-7-1", "133.5"]
    assert values(spark, parsing.parse_weight, texts) == [133, 140, 133, 133, None, None, None, None, None]


def test_prizes(spark):
    texts = ["£1,234.50", "n/a", "", None, "1.2.3", "5000"]
    assert values(spark, parsing.parse_prize, texts) == [1234.5, 0.0, 0.0, 0.0, 0.0, 5000.0]
    assert values(spark, parsing.parse_card_prize, ["€4,000", "", None, "12x"]) == [4000.0, 0.0, 0.0, 0.0]


def test_classes(spark):
    assert values(spark, parsing.extract_class, ["Class 4", "Open", None, "4", "G12 b3"]) == [4, 0, 0, 4, 12]


def test_numbers_are_not_java_literals(spark):
    assert values(spark, parsing.to_number, ["1d", "1f", " 12 ", "1e2", ".5", "5.", "-3", "PU", "", None]) == [
        None, None, 12.0, 100.0, 0.5, 5.0, -3.0, None, None, None]


def test_dates(spark):
    texts = ["2020-01-05", "2020-01-05 00:00:00", " 2020-01-05 ", "2020-13-05", "soon", None]
    day = date(2020, 1, 5)
    assert values(spark, parsing.to_date_or_null, texts) == [day, day, day, None, None, None]


def test_missing_tokens(spark):
    assert values(spark, parsing.na_to_null, ["NA", "nan", "", "None", "PU", "0"]) == [
        None, None, None, None, "PU", "0"]


def test_margins_of_beaten_runners(spark):
    rows = [(1, "2", 0.0), (2, "4", 0.0), (3, "PU", 0.0), (4, "1", 0.0), (5, "3", 1.5), (6, None, 0.0),
            (7, "2", None)]
    fixed, counts = cleaning.fix_margins(spark.createDataFrame(rows, "id int, pos string, btn double"))
    assert {r["id"]: r["btn"] for r in fixed.collect()} == {
        1: 0.01, 2: 20.0, 3: 20.0, 4: 0.0, 5: 1.5, 6: 0.0, 7: None}
    assert tuple(counts.first()) == (1, 2)


def test_conform_adds_casts_and_orders(spark):
    raw = spark.createDataFrame(
        [("7.0", "9007199254740993", "x", "61", "extra")], "draw string, race_id string, ran string, "
        "`[or]` string, other string")
    out = cleaning.conform_schema(raw)
    assert out.columns == schema.RESULTS_SCHEMA.fieldNames()
    row = out.first()
    assert (row["draw"], row["race_id"], row["ran"], row["official_rating"]) == (7, 9007199254740993, None, 61)
    assert row["jockey_allowance"] is None


def test_allowlist():
    assert len(courses.ALLOWED_COURSES) == len(set(courses.ALLOWED_COURSES)) == 90


def test_type_filter_ignores_case(spark):
    df = spark.createDataFrame([("NH flat", 1.0), ("awt", 1.0), ("Hurdle", 1.0), ("Flat", None)],
                               "type string, avg_btn_3 double")
    assert sorted(r["type"] for r in cleaning.type_filter(df).collect()) == ["NH flat", "awt"]


def test_audit_of_an_empty_table(spark):
    df = spark.createDataFrame([], "race_id long, date date, pos string, btn double, wgt string")
    assert {r["metric"]: r["value"] for r in audit.data_audit(df).collect()} == dict.fromkeys(
        ["total_rows", "unique_races", "no_winner", "multi_winner", "null_pos", "null_btn", "null_wgt",
         "logical_errors"], 0)


HEADER = "date,course,race_id,off,horse,num,pos,wgt,[or],prize,comment\n"
FIRST = (HEADER + '2024-05-01, Ascot ,11,1:30,"Big ""Ben""",1,1,9-7,80,"£1,000","led, held on"\n'
         + "2024-05-01,Ascot,11,1:30,Ann,2,PU,9-x,,nan,\n" + "2024-05-02,Paris,12,2:00,Cy,1,1,9-0,70,,\n")
SECOND = HEADER + "soon,York,13,2:00,Dee,1,1,9-0,70,,\n" + "2023-05-02,York,14,2:00,Eve,1,2,9-0,70,,\n"


@pytest.fixture
def csv_dir(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(FIRST, encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text(SECOND, encoding="utf-8")
    return tmp_path


@pytest.mark.parametrize("limit", [10**6, 1])
def test_ingest(spark, csv_dir, split_rows, limit):
    split_rows(limit)
    out = str(csv_dir / "results")
    rows = ingest(spark, str(csv_dir / "in"), out).orderBy("id").collect()
    assert [(r["id"], r["horse"], r["year"]) for r in rows] == [
        (1, "Eve", 2023), (2, 'Big "Ben"', 2024), (3, "Ann", 2024)]
    ben, ann = rows[1], rows[2]
    assert (ben["course"], ben["wgt_lbs"], ben["official_rating"], ben["comment"]) == (
        "Ascot", 133, 80, "led, held on")
    assert (ann["pos"], ann["wgt_lbs"], ann["prize"]) == ("PU", None, None)
    assert [r["horse"] for r in spark.read.parquet(f"{out}_quarantine").collect()] == ["Dee"]
    again = ingest(spark, str(csv_dir / "in"), out)  # nothing new
    assert sorted(r["id"] for r in again.select("id").collect()) == [1, 2, 3]
    (csv_dir / "in" / "c.csv").write_text(HEADER + "2022-01-01,Bath,15,2:00,Flo,1,2,9-0,70,,\n")
    more = ingest(spark, str(csv_dir / "in"), out)  # appending continues the ids
    assert sorted((r["id"], r["horse"]) for r in more.select("id", "horse").collect())[3:] == [(4, "Flo")]


def test_dirty_values_become_null(spark):
    df = spark.createDataFrame([(t,) for t in (
        "999999999-1", "99999999999-99999999999", "99999999999", "9-7", "133", "x")], "t string")
    assert [r[0] for r in df.select(parsing.parse_weight("t")).collect()] == [None, None, None, 133, 133, None]
    days = ["2024-12-31T00:00:00", "2024-12-31 14:30:00.000", "2024/12/31", "20241231", "31/12/2024", "31-12-2024",
            "2024-12-31 14:30", "2024-12-31"]
    df = spark.createDataFrame([(t,) for t in days], "date string")
    assert {r["date"] for r in cleaning.coerce_date(df).collect()} == {date(2024, 12, 31)}


def test_keys_with_nulls_are_never_known(spark):
    old = spark.createDataFrame([(None, None), (7, None), (7, "a")], "race_id long, horse string")
    new = spark.createDataFrame([(None, None), (7, None), (7, "a"), (8, "b"), (8, "b")], old.schema)
    got = sorted(map(str, tables.dedupe_append(new, old).select("race_id", "horse").collect()))
    assert got == sorted(map(str, [*old.collect(), *new.collect()[:2], new.collect()[3]]))


def test_a_long_list_filters_a_stream(spark, tmp_path):
    spark.createDataFrame([("c7",), (" c8 ",), ("no",)], "course string").write.parquet(str(tmp_path / "in"))
    listed = spark.range(12_000).select(F.concat(F.lit("c"), "id").alias("name"))
    stream = spark.readStream.schema("course string").parquet(str(tmp_path / "in"))
    query = cleaning.allowlist_filter(stream, "course", listed).writeStream.format("memory").queryName(
        "listed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["course"] for r in spark.table("listed").collect()} == {"c7", "c8"}


def test_light_profile_and_row_cap(spark, csv_dir):
    rows = ingest(spark, str(csv_dir / "in" / "a.csv"), profile="light").collect()
    assert {r["horse"] for r in rows} == {'Big "Ben"', "Ann"}
    assert [r["pos"] for r in rows if r["horse"] == "Ann"] == [None]
    assert tables.read_results_csv(spark, str(csv_dir / "in" / "a.csv"), nrows=2).count() == 2


def test_incremental_ingest_reads_each_file_once(spark, csv_dir):
    names = HEADER.strip().split(",")
    args = (str(csv_dir / "in"), str(csv_dir / "out"), str(csv_dir / "state"), names)
    assert incremental_ingest(spark, *args).count() == 4
    (csv_dir / "in" / "c.csv").write_text(HEADER + "2022-01-01,Bath,15,2:00,Flo,1,2,9-0,70,,\n")
    streamed = incremental_ingest(spark, *args)
    batch = clean_results(tables.read_results_csv(spark, args[0]))
    assert streamed.count() == 5 and streamed.exceptAll(batch).isEmpty()


def test_bucketed_features_join_without_a_shuffle(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("res_id"), F.lit(1).alias("x"))
    a = tables.write_features(df, str(tmp_path / "a"), buckets=4, table="bucketed_a")
    b = tables.write_features(df, str(tmp_path / "b"), buckets=4, table="bucketed_b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.join(b, "res_id")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_a")
        spark.sql("DROP TABLE bucketed_b")


def test_matrix_as_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, date(2020, 1, 1), 2.5), (2, None, None)], "id long, date date, x double")
    assert sorted(tables.write_matrix(df, str(tmp_path / "m"), "csv").collect()) == sorted(df.collect())
