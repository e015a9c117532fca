import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from formlake import fixtures
from formlake.operators import cards, context
from formlake.operators.ranking import top_by_rating
from formlake.sources import racecards
from formlake.streaming.files import score_cards_stream

CARD = {
    "GB": {"York": {
        "2:00": {"race_name": "R" * 70, "prize": "£4,000", "race_class": 3, "distance": "1m", "course_id": 5,
                 "distance_f": 8.0, "runners": [
                     {"name": "O'Hara", "number": 1, "lbs": 130, "draw": 2, "headgear": "b", "ofr": 70, "rpr": 81,
                      "jockey_allowance": 3, "trainer_id": "T", "jockey_id": "J"},
                     {"name": "New", "number": 2, "lbs": "x", "headgear": "t", "rpr": None},
                     {"name": "Out", "number": 3, "lbs": 120, "non_runner": True}]},
        "1:30": {"race_name": "Early", "prize": "", "runners": []}}},
    "IRE": {"Cork": {"3:00": {"prize": "€1", "race_class": 0, "runners": [
        {"name": "Known", "number": 1, "lbs": 120, "last_run": 12, "ofr": 60}]}}},
}


@pytest.fixture(scope="module")
def card_dir(tmp_path_factory):
    path = tmp_path_factory.mktemp("cards")
    old = {"GB": {"Ayr": {"1:00": {"runners": [{"name": "Past", "number": 1}]}}}}
    (path / "2025-03-01.json").write_text(json.dumps(old))
    (path / "2025-03-02.json").write_text(json.dumps(CARD, indent=1), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def newest(spark, card_dir):
    return racecards.read_racecards(spark, card_dir)


def test_newest_named_and_all_files(spark, card_dir, newest):
    assert {r["horse"] for r in newest.collect()} == {"O'Hara", "New", "Out", "Known", None}
    named = racecards.read_racecards(spark, card_dir, date="2025-03-01").collect()
    assert [(r["horse"], r["card_date"]) for r in named] == [("Past", date(2025, 3, 1))]
    assert racecards.read_racecards(spark, card_dir, latest=False).count() == 6
    with pytest.raises(FileNotFoundError):
        racecards.read_racecards(spark, card_dir, date="2020-01-01")


def test_quoted_numbers_and_broken_files(spark):
    runner = {"name": "A", "number": "4", "ofr": "61", "rpr": 7, "non_runner": "false", "draw": "99999999999"}
    whole = json.dumps({"GB": {"York": {"1:00": {"race_class": "3", "distance_f": "8.5", "course_id": 12,
                                                 "runners": [runner]}}}})
    docs = spark.createDataFrame([(date(2025, 1, 1), whole), (date(2025, 1, 1), whole[:40]), (date(2025, 1, 2), "")],
                                 "card_date date, value string")
    (row,) = racecards.explode_runners(racecards.parse_races(docs)).collect()
    assert (row["number"], row["ofr"], row["rpr"], row["race_class"], row["distance_f"], row["course_id"]) == (
        4, 61, 7, 3, 8.5, 12)
    assert row["non_runner"] is False and row["draw"] is None
    broken = {r["card_date"].day: r["broken"] for r in racecards.broken_documents(docs).collect()}
    assert broken == {1: 1, 2: 1}


def test_long_numbers_do_not_stop_scoring(spark):
    card = spark.createDataFrame([("99999999999", "99999999999")], "lbs string, last_run string")
    assert card.select(cards._pounds().alias("p")).first()["p"] == 0


def test_meeting_index_follows_the_document(spark, card_dir):
    races = racecards.parse_races(racecards.read_documents(spark, card_dir))
    rows = cards.meeting_index(races).orderBy(F.substring("code", 2, 2)).collect()
    assert [(r["code"], r["off"], r["runners"]) for r in rows] == [("G1", "1:30", 0), ("G2", "2:00", 3),
                                                                  ("H3", "3:00", 1)]
    assert len(rows[1]["race_name"]) == 60 and len(rows[1]["short_name"]) == 45 and rows[0]["distance"] == "?"


def test_top_by_rating_counts_missing_as_zero(newest):
    rows = top_by_rating(newest, n=2).where("off = '2:00'").orderBy("rank").collect()
    assert [r["horse"] for r in rows] == ["O'Hara", "New"]


@pytest.fixture(scope="module")
def known(spark, newest):
    columns = context.CONTEXT_COLUMNS
    base = {c: None for c in columns} | {"hg": "b", "official_rating": 66, "combo_runs": 4, "avg_btn_3": 1.5}
    rows = [
        {**base, "horse": "O'Hara", "date": date(2025, 2, 1), "id": 1, "hg": "t"},
        {**base, "horse": "O'Hara", "date": date(2025, 3, 1), "id": 2},
        {**base, "horse": "O'Hara", "date": date(2025, 3, 9), "id": 3, "combo_runs": 9},
        {**base, "horse": "Known", "date": date(2025, 1, 1), "id": 4},
    ]
    kinds = {"hg": "string", "horse": "string", "date": "date", "id": "long", "avg_btn_3": "double",
             "avg_btn_5": "double", "last_pos": "double", "combo_win_pc": "double", "avg_class_3": "double",
             "log_prize": "double"}
    names = ["horse", "date", "id", *columns]
    layout = ", ".join(f"{n} {kinds.get(n, 'int')}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], layout)


def test_latest_and_asof_context(newest, known):
    running = cards.drop_non_runners(newest)
    latest = {r["horse"]: r for r in context.latest_context(running, known).collect()}
    assert set(latest) == {"O'Hara", "New", "Known"}
    assert latest["O'Hara"]["ctx_combo_runs"] == 9 and not latest["New"]["found"]
    before = {r["horse"]: r for r in context.asof_context(running, known).collect()}
    assert before["O'Hara"]["ctx_combo_runs"] == 4 and not before["New"]["found"]


def test_defaults_only_for_unknown_horses(newest, known):
    running = context.asof_context(cards.drop_non_runners(newest), known)
    rows = {r["horse"]: r for r in cards.card_defaults(running).collect()}
    assert (rows["New"]["avg_btn_3"], rows["New"]["last_pos"], rows["New"]["avg_class_3"]) == (6.0, 5.0, 4.0)
    assert rows["New"]["wgt_lbs"] == 0 and rows["New"]["days_since_last"] == 30
    assert rows["O'Hara"]["avg_btn_3"] == 1.5 and rows["O'Hara"]["avg_btn_5"] is None
    assert (rows["Known"]["race_class"], rows["Known"]["days_since_last"]) == (4, 12)
    mean = {r["horse"]: r for r in cards.card_defaults(running, "mean").collect()}
    assert mean["New"]["avg_btn_3"] == 5.0 and mean["Known"]["race_class"] == 0


def test_card_features(newest, known):
    running = context.asof_context(cards.drop_non_runners(newest), known)
    rows = {r["horse"]: r for r in cards.card_features(running).collect()}
    assert [rows[h]["gear_change"] for h in ("O'Hara", "New", "Known")] == [0, 1, 0]
    assert [rows[h]["or_change"] for h in ("O'Hara", "New", "Known")] == [4, 0, -6]
    assert rows["O'Hara"]["true_wgt"] == 127 and round(rows["O'Hara"]["log_prize"], 6) == 8.2943
    legacy = {r["horse"]: r["gear_change"] for r in cards.card_features(running, legacy_gear=True).collect()}
    assert legacy == {"O'Hara": 0, "New": 0, "Known": 1}  # headgear taken off counts


def test_stream_scores_each_file_once(spark, card_dir, tmp_path):
    def score(batch):
        return batch.select("card_date", "horse")

    args = (spark, card_dir, str(tmp_path / "out"), str(tmp_path / "state"), score)
    assert score_cards_stream(*args).count() == 6
    assert score_cards_stream(*args).count() == 6


def test_a_day_in_several_documents_of_one_file(spark, tmp_path):
    folder = tmp_path / "card_date=2025-03-01"
    folder.mkdir()
    meetings = [("IRE", "Cork"), ("GB", "York"), ("GB", "Ascot")]
    (folder / "a.txt").write_text("\n".join(
        json.dumps({region: {course: {off: {"race_name": course, "runners": [{"name": off}]} for off in ("13:00", "12:00")}}})
        for region, course in meetings))
    documents = racecards.read_documents(spark, str(tmp_path), lines=True)
    races = racecards.parse_races(documents)
    codes = {(r.course, r.off): r.code for r in cards.meeting_index(races).collect()}
    assert codes == {("Ascot", "12:00"): "G1", ("Ascot", "13:00"): "G2", ("York", "12:00"): "G3", ("York", "13:00"): "G4",
                     ("Cork", "12:00"): "H5", ("Cork", "13:00"): "H6"}
    assert racecards.read_racecards(spark, str(tmp_path), lines=True).count() == 6


def test_rows_of_documents_are_shuffled_once(spark):
    """neither races nor their texts are shuffled after the rows, and lines of a race may differ in all but its id."""
    day = date(2001, 1, 1)
    rows = [
        (day, "York", 2, "£5", "6f", "Class 3", "A", 1, 130, 1, None, 60, None, "T1", "J1", "1"),
        (day, "York", 2, "£9", "6f", "Class 2", "B", 2, 131, 2, "b", 70, 3, "T2", "J2", "PU"),
        (day, "York", 3, "£5", "7f", "Open", "C", 1, 120, 1, None, None, None, "T1", "J1", "1"),
        (day, "Ayr", 2, "£5", "6f", "Class 1", "D", 1, 125, 1, None, 50, None, "T3", "J1", "1"),
    ]
    results = spark.createDataFrame(rows, (
        "date date, course string, race_id long, prize string, dist string, class string, horse string, seq int, wgt_lbs int, "
        "draw int, hg string, official_rating int, jockey_allowance int, trainer string, jockey string, pos string"))
    documents = fixtures.card_documents(results)
    plan = documents._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") == 1
    found = racecards.explode_runners(racecards.parse_races(documents)).collect()
    assert sorted((r.region, r.course, r.off, r.horse, r.prize, r.race_class, r.lbs, r.rpr, r.non_runner) for r in found) == [
        ("GB", "Ayr", "2", "D", "£5", 1, "125", 51, False), ("GB", "York", "2", "A", "£9", 3, "130", 61, False),
        ("GB", "York", "2", "B", "£9", 3, "131", 72, True), ("IRE", "York", "3", "C", "£5", 0, "120", None, False)]


def test_a_batch_of_cards_is_parsed_once(spark, card_dir, tmp_path):
    """a score that reads the runners several times finds them kept while the batch runs."""
    kept = []

    def score(runners):
        kept.append(runners)
        assert runners.is_cached and runners.storageLevel.useDisk
        return runners.select("horse", "number")

    out = score_cards_stream(spark, card_dir, str(tmp_path / "out"), str(tmp_path / "checkpoint"), score)
    assert out.count() == 6 and not kept[0].is_cached
