"""History features: golden case, comparison with a plain-Python model, no look-ahead."""

from datetime import date

import model
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formlake.operators import history
from formlake.plans.features import assemble_matrix, build_features, build_matrix

SLOW = settings(
    max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
SEEDS = st.integers(min_value=0, max_value=10**6)

GOLDEN = [
    # id, date, course, pos, btn, class, hg, rating
    (1, "2020-01-01", "York", "1", 0.0, "Class 4", None, 60),
    (2, "2020-01-11", "York", "3", 2.5, "Class 3", "b", 62),
    (3, "2020-01-11", "Ayr", "PU", None, "Open", "b", None),
    (4, "2020-02-01", "York", "2", 1.0, "Class 5", None, 61),
    (5, "2020-12-31", "York", "4", 7.0, "Class 2", "t", 64),
    (6, "2021-01-01", "Ayr", "1", 0.0, "Class 2", "t", 63),
]
# id: avg 3, avg 5, days, last pos, class diff, class mean, gear, rating change, course, pair
EXPECTED = {
    1: (None, None, None, None, 0, 0.0, 0, 0, (0, 0), (0, 0)),
    2: (0.0, 0.0, 10, 1, -1, 4.0, 1, 2, (1, 1), (1, 1)),
    3: (1.25, 1.25, 0, 3, 0, 0.0, 0, 0, (0, 0), (2, 1)),
    4: (7.5, 7.5, 21, 20, 0, 0.0, 0, 0, (2, 1), (3, 1)),
    5: (7.83, 5.88, 334, 2, -3, 5.0, 1, 3, (3, 1), (4, 1)),
    6: (9.33, 6.1, 1, 4, 0, 3.5, 0, -1, (1, 0), (4, 0)),
}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], model.SCHEMA)


@pytest.fixture(scope="module")
def golden(spark):
    rows = [
        {
            "id": i, "date": date.fromisoformat(d), "race_id": i, "course": course, "type": "Flat", "class": c,
            "dist": "5f", "going": "Good", "draw": 1, "pos": pos, "btn": btn, "horse": "A", "wgt": "9-7",
            "hg": hg, "jockey": "J", "trainer": "T", "prize": "£1,000", "official_rating": rating,
            "jockey_allowance": None,
        }
        for i, d, course, pos, btn, c, hg, rating in GOLDEN
    ]
    return frame(spark, rows)


def _check_golden(df):
    for row in build_features(df).collect():
        want = EXPECTED[row["id"]]
        have = (
            row["avg_btn_3"], row["avg_btn_5"], row["days_since_last"], row["last_pos"], row["class_diff"],
            row["avg_class_3"], row["gear_change"], row["or_change"],
            (row["h_course_runs"], row["h_course_wins"]), (row["combo_runs"], row["combo_wins"]),
        )
        assert have == want, row["id"]
        assert round(row["log_prize"], 6) == 6.908755


def test_golden_case(golden):
    _check_golden(golden)


def test_golden_case_when_the_horse_is_split(golden, split_rows):
    split_rows(1)
    _check_golden(golden)


@SLOW
@given(SEEDS)
def test_model_and_spark_agree(spark, seed):
    rows = model.random_rows(seed)
    model.assert_same(build_features(frame(spark, rows)), model.history(rows))


@SLOW
@given(SEEDS, st.sampled_from([24, 90]))
def test_split_keys_agree_with_the_model(spark, split_rows, seed, limit):
    rows = model.random_rows(seed, hot=True)
    split_rows(limit)
    model.assert_same(build_features(frame(spark, rows)), model.history(rows))


@pytest.mark.parametrize("limit", [10**6, 25])
def test_same_day_excluded(spark, split_rows, limit):
    rows = model.random_rows(5, hot=True)
    for row in rows[::3]:
        row["date"] = date(2020, 5, 1)
    split_rows(limit)
    out = history.pair_trailing_stats(frame(spark, rows), same_day="exclude")
    wanted = ["combo_runs", "combo_wins", "combo_win_pc", "combo_place_pc"]
    expected = {
        k: {n: v[n] for n in wanted} for k, v in model.history(rows, same_day="exclude").items()
    }
    model.assert_same(out.withColumnRenamed("res_id", "id"), expected)


def test_one_day_holds_most_rows(spark, split_rows):
    """Chunks cut inside a day too, by id."""
    rows = model.random_rows(9, hot=True)
    for row in rows:
        row["date"] = date(2020, 5, 1)
    split_rows(40)
    model.assert_same(build_features(frame(spark, rows)), model.history(rows))


def test_input_order_does_not_matter(spark):
    rows = model.random_rows(3)
    mixed = frame(spark, rows[::-1]).repartition(5, "draw")
    model.assert_same(build_features(mixed), model.history(rows))


def test_later_rows_change_nothing(spark):
    rows = model.random_rows(4)
    cut = sorted(r["date"] for r in rows)[200]
    early = [r for r in rows if r["date"] < cut]
    full = build_features(frame(spark, rows)).where(F.col("date") < F.lit(cut)).drop("log_prize")
    expected = {k: {n: v for n, v in f.items() if n != "log_prize"} for k, f in model.history(early).items()}
    model.assert_same(full, expected)


def test_rows_without_a_key_can_have_no_history(spark):
    rows = model.random_rows(6)
    form = history.recent_form(frame(spark, rows), null_keys="no_history").collect()
    nameless = {r["id"] for r in rows if r["horse"] is None}
    assert nameless
    assert all(r["avg_btn_3"] is None for r in form if r["res_id"] in nameless)
    assert any(r["avg_btn_3"] is not None for r in form if r["res_id"] not in nameless)


def test_fused_and_joined_matrix_are_equal(spark):
    df = frame(spark, model.random_rows(8, n=500))
    from formlake.functions.parsing import parse_weight, position_number

    df = df.withColumn("wgt_lbs", parse_weight("wgt")).withColumn("pos_num", position_number("pos"))
    joined = assemble_matrix(
        df, history.pair_trailing_stats(df), history.entity_place_stats(df), history.recent_form(df),
        history.class_moves(df), history.micro_features(df),
    )
    key = lambda row: row["id"]
    assert sorted(build_matrix(df).collect(), key=key) == sorted(joined.collect(), key=key)
