"""Queries store and shuffle only what they read."""

import pytest
from pyspark.sql import functions as F
from test_dealing import _runs

from formlake import catalog, schema


@pytest.fixture
def own_results(spark, monkeypatch):
    """The catalog's tables come from made-up runs, of which every fifth has no rating and some have no margin."""
    rating = F.when(F.col("id") % 5 > 0, (F.col("id") % 60).cast("int"))
    runs = _runs(spark).withColumns({
        "official_rating": rating, "btn": F.when(F.col("id") % 7 > 0, F.col("btn")), "type": F.lit("Flat"),
        "dist": F.lit("5f"), "going": F.lit("soft"), "draw": (F.col("id") % 6).cast("int"), "wgt_lbs": F.lit(126),
        "pos_num": F.col("pos").cast("int"),
    })
    monkeypatch.setattr(catalog, "results", lambda spark, sf: runs)
    return runs


def _rows(df):
    return sorted(map(str, df.collect()))


def test_stored_tables_hold_only_the_columns_asked_for(spark, own_results, tmp_path):
    """Before, all columns of all families were shuffled three times and stored, whatever a query read."""
    for make, columns in (
        (catalog.featured, catalog.SCORED_COLUMNS), (catalog.featured, ["id", "btn", "avg_btn_3"]),
        (catalog.matrix, catalog.RACE_COLUMNS), (catalog.matrix, catalog.FEW_NUMBERS),
    ):
        some = make(spark, str(tmp_path), *columns)
        assert some.columns == columns
        assert _rows(some) == _rows(make(spark, str(tmp_path)).select(*columns)) != []
    assert "prize" not in catalog.scored(spark, str(tmp_path)).columns


def test_families_that_are_not_read_are_not_shuffled(own_results, spark):
    for columns, shuffles in ((["id", "btn", "avg_btn_3"], 1), (catalog.SCORED_COLUMNS, 2)):
        plan = catalog.features.build_features(own_results).select(*columns)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles


def test_ordered_rows_are_stored(spark, own_results, tmp_path):
    """Before, each pass over them joined every race with its winner again."""
    rows = catalog.ordered(spark, str(tmp_path))
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    races = rows.groupBy(*schema.RACE_KEY).agg(F.sum("target_win").alias("n")).collect()
    assert races and {r["n"] for r in races} == {1}


def test_learners_on_base_inputs_need_no_race_shuffle(own_results, spark, monkeypatch, tmp_path):
    """Before, the matrix of all inputs was made for them."""
    text = catalog.features.build_matrix(own_results).select(*catalog.BASE_COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2
    seen = {}
    monkeypatch.setattr(catalog, "CUTOFF", catalog.date(2020, 1, 30))
    catalog._fitted(spark, str(tmp_path), "seen", lambda rows: seen.setdefault("rows", rows))
    assert seen["rows"].columns == catalog.BASE_COLUMNS
    whole = catalog.cleaning.temporal_split(catalog.planted(spark, str(tmp_path)), catalog.CUTOFF)[0]
    assert _rows(seen["rows"]) == _rows(whole.select(*catalog.BASE_COLUMNS)) != []


@pytest.mark.parametrize(("name", "shuffles"), [("card_defaults", 2), ("card_features", 0), ("standardize", 2), ("group_deviations", 1)])
def test_queries_store_the_columns_they_read(spark, own_results, monkeypatch, tmp_path, name, shuffles):
    """F5, F6, F11, F14. Before, each stored all features of all families, made in three shuffles of whole rows."""
    made = {}

    def stored(spark, label, sf, make):
        made[label.split("-")[0]] = make()
        return made[label.split("-")[0]]

    monkeypatch.setattr(catalog.fixtures, "stored", stored)
    monkeypatch.setattr(catalog, "runners", lambda spark, sf: catalog.racecards.explode_runners(catalog.racecards.parse_races(
        spark.createDataFrame([], "card_date date, value string"))))
    catalog.QUERIES[name](spark, str(tmp_path))
    (table,) = made.values()
    assert len(table.columns) < 14
    assert table._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == shuffles


def test_pair_context_makes_one_family(spark, own_results, monkeypatch, tmp_path):
    """F13. Before, all five feature tables were computed and stored for the one that is read."""
    made = []
    monkeypatch.setattr(catalog.fixtures, "stored", lambda spark, label, sf, make: made.append(label) or make())
    monkeypatch.setattr(catalog, "runners", lambda spark, sf: own_results.select(
        F.col("race_id").cast("string").alias("off"), F.col("id").alias("number"), "trainer", "jockey"))
    catalog.pair_context(spark, str(tmp_path))
    assert made == ["features_synergy"]


def test_pairs_meet_the_statistics_of_their_newest_result(spark):
    """Also where the table repeats an id: a card row stays one row. Before, all results were joined to the table."""
    results = spark.createDataFrame(
        [(1, "2020-01-01", "T", "J"), (2, "2020-01-02", "T", "J"), (3, "2020-01-02", "T", None)], "id long, date string, trainer string, jockey string")
    synergy = spark.createDataFrame([(1, 0, 0.0), (2, 1, 0.5), (2, 1, 0.5)], "res_id long, combo_runs long, combo_win_pc double")
    cards = spark.createDataFrame([(1, "T", "J"), (2, "T", None), (3, "U", "J")], "number int, trainer string, jockey string")
    out = catalog.context.pair_context(cards, results, synergy)
    rows = {(r.number, r.pair_found, r.pair_combo_runs, r.pair_combo_win_pc) for r in out.collect()}
    assert out.count() == 3 and rows == {(1, True, 1, 0.5), (2, True, None, None), (3, False, None, None)}
    used = catalog.context.pair_context(cards, results, synergy)._jdf.queryExecution().optimizedPlan().toString()
    assert used.index("Join LeftOuter, (id#") < used.index("row_number(")


def test_scoring_takes_the_matrix_from_the_rows_of_the_cards(spark, own_results, monkeypatch, tmp_path):
    """F1-F4. Before, all features of the history were made twice, once for the cards and once for the model."""
    made, seen = [], {}
    monkeypatch.setattr(catalog.fixtures, "stored", lambda spark, label, sf, make: made.append(label) or make())
    monkeypatch.setattr(catalog, "CUTOFF", catalog.date(2020, 1, 30))
    monkeypatch.setattr(catalog.train, "train_ensemble", lambda rows, **sizes: seen.setdefault("rows", rows))
    known, _ = catalog._scoring(spark, str(tmp_path))
    assert [label.split("-")[0] for label in made] == ["featured"] and known.columns == catalog.SCORING_COLUMNS
    whole = catalog.cleaning.temporal_split(catalog.planted(spark, str(tmp_path)), catalog.CUTOFF)[0]
    assert _rows(seen["rows"]) == _rows(whole.select(*seen["rows"].columns)) != []


def test_tables_of_many_columns_can_be_stored(spark, own_results, tmp_path):
    """Their names, which list the columns, may be longer than a folder's can be."""
    rows = catalog.featured(spark, str(tmp_path), *catalog.SCORING_COLUMNS, "trainer", "jockey")
    assert rows.columns == [*catalog.SCORING_COLUMNS, "trainer", "jockey"] and rows.count() == own_results.count()
