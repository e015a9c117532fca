"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from formlake import schema
from formlake.fixtures import LINE_CTE, RESULTS_SELECT

GIVEN_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
CUTOFF = "2000-01-01"
AS_OF = "2001-08-01"

_PREFIX = f"""WITH {LINE_CTE}, results AS ({RESULTS_SELECT}),
r AS (
  SELECT *, TRY_CAST(pos AS INT) AS pos_num,
    CAST(split_part(wgt, '-', 1) AS INT) * 14 + CAST(split_part(wgt, '-', 2) AS INT) AS wgt_lbs
  FROM results
)"""

_FLAGS = """,
s AS (
  SELECT *, coalesce(btn, 20.0) AS b, coalesce(CAST(pos_num AS DOUBLE), 20.0) AS p,
    coalesce(TRY_CAST(nullif(regexp_extract(class, '(\\d+)', 1), '') AS DOUBLE), 0.0) AS cls,
    CASE WHEN pos_num = 1 THEN 1 ELSE 0 END AS w, CASE WHEN pos_num <= 3 THEN 1 ELSE 0 END AS pl,
    coalesce(TRY_CAST(regexp_replace(prize, '[^0-9.]', '', 'g') AS DOUBLE), 0.0) AS cash
  FROM r
)"""


def _form(key: str = "horse") -> str:
    runs = f"PARTITION BY {key} ORDER BY date, id"
    return f"""
  SELECT id,
    round(avg(b) OVER ({runs} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 2) AS avg_btn_3,
    round(avg(b) OVER ({runs} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 2) AS avg_btn_5,
    CAST(date - lag(date) OVER ({runs}) AS INT) AS days_since_last,
    lag(p) OVER ({runs}) AS last_pos
  FROM s"""


def _class(key: str = "horse") -> str:
    runs = f"PARTITION BY {key}, seg ORDER BY date, id"
    return f"""
  SELECT id,
    CASE WHEN cls = 0 THEN 0 ELSE coalesce(CAST(cls - lag(nullif(cls, 0)) OVER ({runs}) AS INT), 0) END
      AS class_diff,
    CASE WHEN cls = 0 THEN 0.0 ELSE coalesce(round(avg(nullif(cls, 0)) OVER
      ({runs} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 2), 0.0) END AS avg_class_3
  FROM (SELECT *, sum(CASE WHEN cls = 0 THEN 1 ELSE 0 END) OVER
      (PARTITION BY {key} ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg
    FROM s) t"""


#: Classes beyond an int: a difference that is too large counts as none.
_DIRTY_CLASS = _class().replace("FROM s)", "FROM (SELECT * REPLACE (CASE WHEN draw = 3 THEN 99999999999.0 ELSE cls END AS cls) FROM s) s)").replace(
    "CAST(cls - lag", "TRY_CAST(cls - lag")


def _course(keys: str = "horse, course") -> str:
    runs = f"(PARTITION BY {keys} ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
  SELECT id, n AS h_course_runs, wins AS h_course_wins,
    CASE WHEN n = 0 THEN 0.0 ELSE round(places / n, 3) END AS h_course_place_pc
  FROM (SELECT id, count(*) OVER {runs} AS n,
      CAST(coalesce(sum(w) OVER {runs}, 0) AS BIGINT) AS wins,
      CAST(coalesce(sum(pl) OVER {runs}, 0) AS BIGINT) AS places FROM s) t"""


def _synergy(keys: str = "trainer, jockey", same_day: bool = True) -> str:
    trailing = (f"(PARTITION BY {keys} ORDER BY date "
                "RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)")
    today = f"(PARTITION BY {keys}, date ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def both(agg: str) -> str:
        tail = f" + coalesce({agg} OVER {today}, 0)" if same_day else ""
        return f"CAST(coalesce({agg} OVER {trailing}, 0){tail} AS BIGINT)"

    return f"""
  SELECT id, n AS combo_runs, wins AS combo_wins,
    CASE WHEN n = 0 THEN 0.0 ELSE round(wins / n, 3) END AS combo_win_pc,
    CASE WHEN n = 0 THEN 0.0 ELSE round(places / n, 3) END AS combo_place_pc
  FROM (SELECT id, {both("count(*)")} AS n, {both("sum(w)")} AS wins, {both("sum(pl)")} AS places
    FROM s) t"""


_MICRO = """
  SELECT id,
    CASE WHEN coalesce(hg, '') <> '' AND hg <> coalesce(lag(hg) OVER (PARTITION BY horse ORDER BY date, id), '')
      THEN 1 ELSE 0 END AS gear_change,
    coalesce(official_rating - lag(official_rating) OVER (PARTITION BY horse ORDER BY date, id), 0)
      AS or_change,
    wgt_lbs - coalesce(jockey_allowance, 0) AS true_wgt,
    max(cash) OVER (PARTITION BY race_id) AS race_value,
    round(ln(1 + max(cash) OVER (PARTITION BY race_id)), 9) AS log_prize
  FROM s"""

_FAMILIES = f""",
form AS ({_form()}),
cls AS ({_class()}),
crs AS ({_course()}),
syn AS ({_synergy()}),
mic AS ({_MICRO})"""

_FEATURES = f"""{_FAMILIES},
feats AS (
  SELECT s.*, avg_btn_3, avg_btn_5, days_since_last, last_pos, class_diff, avg_class_3, h_course_runs,
    h_course_wins, h_course_place_pc, combo_runs, combo_wins, combo_win_pc, combo_place_pc,
    gear_change, or_change, true_wgt, log_prize
  FROM s JOIN form USING (id) JOIN cls USING (id) JOIN crs USING (id) JOIN syn USING (id)
  JOIN mic USING (id)
)"""

_MATRIX = f"""{_FEATURES},
matrix AS (
  SELECT id, race_id, date, course, dist, going, class, wgt_lbs, draw, btn, combo_runs, combo_win_pc,
    combo_place_pc, h_course_runs, h_course_wins, h_course_place_pc, avg_btn_3, avg_btn_5,
    days_since_last, last_pos, class_diff, avg_class_3, gear_change, or_change, true_wgt, log_prize,
    w AS target_win
  FROM feats WHERE avg_btn_3 IS NOT NULL AND (lower(type) LIKE '%flat%' OR lower(type) LIKE '%awt%')
),
scored AS (
  SELECT *, round(coalesce(official_rating, 0) * 0.01 - coalesce(avg_btn_3, 0) * 0.02
    + coalesce(combo_win_pc, 0), 6) AS prob, w AS target_win FROM feats
)"""

_CARDS = """,
races AS (
  SELECT race_id, date AS card_date, CASE WHEN race_id % 2 = 0 THEN 'GB' ELSE 'IRE' END AS region,
    course, CAST(race_id AS VARCHAR) AS off, concat(course, ' Stakes ', CAST(race_id AS VARCHAR)) AS race_name,
    max(prize) AS prize, max(dist) AS distance,
    CAST(max(cls) AS INT) AS race_class, count(*) AS runners
  FROM s GROUP BY race_id, date, course
),
cards AS (
  SELECT c.race_id, card_date, region, c.course, off, race_name, c.prize, distance, race_class, s.horse,
    s.trainer, s.jockey, s.seq AS number, CAST(s.wgt_lbs AS VARCHAR) AS lbs,
    s.draw, s.hg AS headgear, s.official_rating AS ofr, s.official_rating + s.draw AS rpr,
    s.jockey_allowance, s.pos = 'PU' AS non_runner
  FROM races c JOIN s USING (race_id)
)"""


def _sql(body: str, *ctes: str) -> str:
    return _PREFIX + "".join(ctes) + body


def _s(body: str) -> str:
    return _sql(body, _FLAGS)


def _m(body: str) -> str:
    return _sql(body, _FLAGS, _MATRIX)


def _c(body: str) -> str:
    return _sql(body, _FLAGS, _CARDS)


def _cf(body: str) -> str:
    return _sql(body, _FLAGS, _FEATURES, _CARDS)


_TEXT_COLUMNS = """CAST(date AS VARCHAR) AS date, course, CAST(race_id AS VARCHAR) AS race_id, type, class,
  dist, going, CAST(ran AS VARCHAR) AS ran, CAST(draw AS VARCHAR) AS draw, pos, CAST(btn AS VARCHAR) AS btn,
  horse, wgt, hg, jockey, trainer, prize, CAST(official_rating AS VARCHAR) AS official_rating,
  CAST(jockey_allowance AS VARCHAR) AS jockey_allowance"""

_CLEAN_COLUMNS = """date, course, race_id, type, class, dist, going, ran, draw, pos, btn, horse, wgt_lbs, hg,
  jockey, trainer, prize, official_rating, jockey_allowance"""

_LISTED = "course IN (SELECT n_name FROM nation WHERE n_regionkey IN (0, 3))"

_BEYOND = "({n} < coalesce(pos_num, 99) AND pos IS NOT NULL)"

_ROW_ORDER = ", ".join(f"{c} NULLS FIRST" for c in [
    "date", "race_id", "horse", "course", "type", "class", "dist", "going", "ran", "draw", "pos", "btn",
    "wgt", "hg", "jockey", "trainer", "prize", "official_rating", "jockey_allowance",
])

_CONTEXT = """avg_btn_3, avg_btn_5, last_pos, combo_runs, combo_win_pc, h_course_runs, h_course_wins,
  class_diff, avg_class_3, gear_change, or_change, true_wgt, log_prize, hg, official_rating"""
_CTX_SELECT = ", ".join(f"f.{c.strip()} AS ctx_{c.strip()}" for c in _CONTEXT.split(","))
_LATEST = """
  SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY horse ORDER BY date DESC, id DESC) = 1"""

_DEFAULTS = {
    "combo_runs": "0", "combo_win_pc": "0.0", "h_course_runs": "0", "h_course_wins": "0",
    "avg_btn_3": "6.0", "avg_btn_5": "6.0", "last_pos": "5.0", "class_diff": "0", "avg_class_3": "4.0",
}

# What was known of each row's horse, pair and course strictly before its day.
_CARD_HISTORY = """,
back AS (
  SELECT c.id AS card, c.date AS day, c.cls AS now, h.date, h.b, h.p, h.cls, h.hg, h.official_rating,
    row_number() OVER (PARTITION BY c.id ORDER BY h.date DESC, h.id DESC) AS k
  FROM s c JOIN s h ON c.horse = h.horse AND h.date < c.date
),
seg AS (SELECT *, sum(CASE WHEN cls = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY card ORDER BY k) AS z FROM back),
form AS (
  SELECT card AS id, round(avg(CASE WHEN k <= 3 THEN b END), 2) AS avg_btn_3,
    round(avg(CASE WHEN k <= 5 THEN b END), 2) AS avg_btn_5,
    CAST(max(CASE WHEN k = 1 THEN day - date END) AS INT) AS days_since_last,
    max(CASE WHEN k = 1 THEN p END) AS last_pos,
    CAST(max(CASE WHEN k = 1 AND z = 0 AND now > 0 THEN now - cls END) AS INT) AS class_diff,
    round(avg(CASE WHEN k <= 3 AND z = 0 AND now > 0 THEN cls END), 2) AS avg_class_3,
    max(CASE WHEN k = 1 THEN hg END) AS last_hg,
    max(CASE WHEN k = 1 THEN official_rating END) AS last_or
  FROM seg WHERE k <= 5 GROUP BY card
),
crs AS (
  SELECT c.id, count(*) AS n, CAST(sum(h.w) AS BIGINT) AS wins, sum(h.pl) / count(*) AS pc
  FROM s c JOIN s h ON c.horse = h.horse AND c.course = h.course AND h.date < c.date GROUP BY c.id
),
syn AS (
  SELECT c.id, count(*) AS n, CAST(sum(h.w) AS BIGINT) AS wins, sum(h.w) / count(*) AS win_pc,
    sum(h.pl) / count(*) AS pc
  FROM s c JOIN s h ON c.trainer = h.trainer AND c.jockey = h.jockey AND h.date < c.date
    AND h.date >= c.date - INTERVAL 365 DAYS
  GROUP BY c.id
)
SELECT s.id, s.date, s.horse, s.race_id, avg_btn_3, avg_btn_5, days_since_last, last_pos,
  coalesce(class_diff, 0) AS class_diff, coalesce(avg_class_3, 0.0) AS avg_class_3,
  coalesce(crs.n, 0) AS h_course_runs, coalesce(crs.wins, 0) AS h_course_wins,
  coalesce(round(crs.pc, 3), 0.0) AS h_course_place_pc,
  coalesce(syn.n, 0) AS combo_runs, coalesce(syn.wins, 0) AS combo_wins,
  coalesce(round(syn.win_pc, 3), 0.0) AS combo_win_pc, coalesce(round(syn.pc, 3), 0.0) AS combo_place_pc,
  CASE WHEN coalesce(s.hg, '') <> '' AND s.hg <> coalesce(last_hg, '') THEN 1 ELSE 0 END AS gear_change,
  coalesce(s.official_rating - last_or, 0) AS or_change, s.wgt_lbs - coalesce(s.jockey_allowance, 0) AS true_wgt,
  round(ln(1 + max(s.cash) OVER (PARTITION BY s.race_id)), 9) AS log_prize
FROM s LEFT JOIN form USING (id) LEFT JOIN crs USING (id) LEFT JOIN syn USING (id)"""

_WEIGHTED_INPUTS = (
    ", ".join(f"CASE WHEN f.id IS NOT NULL THEN f.{c} ELSE {d} END AS {c}" for c, d in _DEFAULTS.items())
    + """, CAST(c.lbs AS INT) AS wgt_lbs, c.draw, 30 AS days_since_last,
    CASE WHEN coalesce(c.race_class, 0) = 0 THEN 4 ELSE c.race_class END AS race_class"""
)

_FORM_COLUMNS = "id AS res_id, avg_btn_3, avg_btn_5, days_since_last, last_pos"

_ENCODED = ", ".join(
    f"CASE WHEN {c} IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INT) END AS {c}_code"
    for c in schema.CATEGORIES
)
_Z = ["wgt_lbs", "combo_win_pc", "avg_btn_3", "days_since_last", "or_change"]
_STANDARD = ", ".join(
    f"round(({c} - avg({c}) FILTER (date < DATE '{CUTOFF}') OVER ()) / "
    f"stddev_pop({c}) FILTER (date < DATE '{CUTOFF}') OVER (), 6) AS {c}" for c in _Z
)


def _auc(score: str, source: str, label: str = "target_win") -> str:
    return f"""(SELECT round((sum(CASE WHEN {label} = 1 THEN rk ELSE 0 END) -
      count(*) FILTER ({label} = 1) * (count(*) FILTER ({label} = 1) + 1) / 2.0) /
      (CAST(count(*) FILTER ({label} = 1) AS DOUBLE) * count(*) FILTER ({label} <> 1)), 9)
    FROM (SELECT {label}, rank() OVER (ORDER BY {score}) +
      (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk FROM {source} WHERE {score} IS NOT NULL) t)"""


def _picks(condition: str = "TRUE") -> str:
    return f"""SELECT * FROM scored WHERE {condition} QUALIFY row_number() OVER
      (PARTITION BY date, course, dist ORDER BY prob DESC, id) = 1"""


_EVENT_ROWS = """WITH s AS (
  SELECT event_id AS id, CAST(ts AS DATE) AS date, user_id AS horse, event_type AS course,
    CASE WHEN value > 50 THEN 1 ELSE 0 END AS w, CASE WHEN value > 20 THEN 1 ELSE 0 END AS pl FROM events)"""

_AUDIT = f"""
SELECT 'total_rows' AS metric, CAST(NULL AS INT) AS period, count(*) AS value FROM r
UNION ALL SELECT 'unique_races', NULL, count(DISTINCT race_id) FROM r
UNION ALL SELECT 'no_winner', NULL, count(*) FROM (SELECT race_id FROM s GROUP BY race_id HAVING sum(w) = 0) t
UNION ALL SELECT 'multi_winner', NULL, count(*) FROM (SELECT race_id FROM s GROUP BY race_id HAVING sum(w) > 1) t
UNION ALL SELECT 'null_pos', NULL, count(*) FROM r WHERE pos IS NULL
UNION ALL SELECT 'null_btn', NULL, count(*) FROM r WHERE btn IS NULL AND {_BEYOND.format(n=1)}
UNION ALL SELECT 'null_wgt', NULL, count(*) FROM r WHERE wgt_lbs IS NULL
UNION ALL SELECT 'logical_errors', NULL, count(*) FROM r WHERE btn = 0 AND {_BEYOND.format(n=1)}
UNION ALL SELECT 'races_in_year', CAST(year(date) AS INT), count(DISTINCT race_id) FROM r GROUP BY year(date)"""

_FIXED = f"""CASE WHEN btn = 0 AND pos_num IN (2, 3) THEN 0.01
  WHEN btn = 0 AND {_BEYOND.format(n=3)} THEN 20.0 ELSE btn END AS btn"""


def _model_sql() -> dict[str, str]:
    """What holds for every fitted model: it scores the test rows and finds the planted label."""
    test = f" FROM matrix WHERE date >= DATE '{CUTOFF}'"
    verdict = _m(" SELECT count(*) AS scored_rows, CAST(0 AS BIGINT) AS out_of_range, true AS finds_label" + test)
    places = _c(
        " SELECT card_date, region, course, off, row_number() OVER (PARTITION BY card_date, region, course, off"
        " ORDER BY number) AS rank, true AS good FROM cards WHERE NOT non_runner QUALIFY rank <= 5")
    names = ", ".join(f"('p_{m}', true)" for m in ("boosted", "forest", "extra", "wide", "ensemble"))
    return {
        **dict.fromkeys(("train_classifier", "train_linear_ranker", "train_boosted", "train_forest",
                         "train_extra_trees", "train_gbm_wide"), verdict),
        **dict.fromkeys(("train_ranker", "train_deep_ranker"), _m(
            " SELECT count(DISTINCT (date, course, dist)) AS groups, true AS beats_linear, true AS finds_order" + test)),
        "early_stopping": "SELECT 4 AS trees_after_best, true AS keeps_best, true AS stopped_early",
        "boosted_leaf_values": _m(
            " SELECT CASE WHEN y = 1 THEN 1 ELSE 2 END AS node, round(sum(p - y), 6) AS gradient,"
            " round(sum(p * (1 - p)), 6) AS hessian, round(-sum(p - y) / (sum(p * (1 - p)) + 2.0), 9) AS value"
            " FROM (SELECT y, avg(y) OVER () AS p FROM (SELECT CAST(coalesce(draw <= 3, false) AS INT) AS y FROM matrix))"
            " GROUP BY y"),
        "missing_direction": _m(
            " SELECT count(*) FILTER (avg_btn_3 IS NULL) AS missing_found, CAST(0 AS BIGINT) AS wrong FROM matrix"),
        "leafwise_growth": "SELECT true AS within_leaves, true AS uneven, true AS less_loss",
        **dict.fromkeys(("score_cards", "score_cards_mean", "score_cards_stream", "score_cards_state"), places),
        "score_matrix": _m(" SELECT id, race_id, true AS in_range" + test),
        "model_io": _m(" SELECT count(*) AS total_rows, CAST(0 AS DOUBLE) AS largest_difference" + test),
        "ensemble_auc": f"SELECT * FROM (VALUES {names}) t(name, finds_label)",
        "feature_importance": "SELECT CAST(i AS INT) AS place, CASE WHEN i = 1 THEN 'avg_btn_3' END AS first,"
                              " true AS has_gain FROM range(1, 11) t(i)",
        "split_count_importance": "SELECT true AS uses_planted_feature, CAST(0 AS BIGINT) AS wrong_rows",
    }


def oracle_sql() -> dict[str, str]:
    sql = {
        # sources and sinks
        "read_results_csv": _sql(f" SELECT {_TEXT_COLUMNS} FROM results"),
        "write_results": _sql(
            f" SELECT row_number() OVER (ORDER BY {_ROW_ORDER}) AS id, date, race_id, horse, pos,"
            " CAST(year(date) AS INT) AS year FROM results"),
        "dedupe_append": _sql(
            f" SELECT race_id, horse FROM results WHERE date < DATE '{CUTOFF}' UNION ALL"
            f" SELECT DISTINCT race_id, horse FROM results WHERE date >= DATE '{CUTOFF}'"),
        "dedupe_append_nulls": _sql(
            f" SELECT race_id, CASE WHEN date < DATE '{CUTOFF}' THEN count(*) + count(*) FILTER (draw = 2)"
            " ELSE count(DISTINCT horse) FILTER (draw <> 2) + 2 * count(*) FILTER (draw = 2) END AS n"
            " FROM results GROUP BY race_id, date"),
        "write_features": _sql(f" SELECT {_FORM_COLUMNS} FROM form", _FLAGS, _FAMILIES),
        "write_features_failed": _sql(f" SELECT {_FORM_COLUMNS} FROM form", _FLAGS, _FAMILIES),
        "deduplicating_ingest": _sql(f" SELECT DISTINCT race_id, horse FROM r WHERE {_LISTED}"),
        "latest_rows": _sql(" SELECT horse, id, date, course FROM results QUALIFY row_number() OVER"
                            " (PARTITION BY horse ORDER BY date DESC, id DESC) = 1"),
        "scan_history": _sql(" SELECT id, date, horse, pos, btn FROM results"),
        "scan_history_synergy": _sql(" SELECT id, date, trainer, jockey, pos FROM results"),
        "scan_history_course": _sql(" SELECT id, date, horse, course, pos FROM results"),
        "scan_history_class": _sql(" SELECT id, date, horse, class FROM results"),
        "scan_history_micro": _sql(" SELECT id, race_id, horse, date, hg, official_rating, jockey_allowance,"
                                   " wgt_lbs, prize FROM r"),
        "matrix_io": _m(" SELECT * FROM matrix"),
        "read_racecards": _c(" SELECT card_date, region, course, off, race_name, prize, distance, race_class,"
                             " horse, trainer, jockey, number, lbs, draw, headgear, ofr, rpr,"
                             " jockey_allowance, non_runner FROM cards"),
        "table_profile": "SELECT DISTINCT t.table_name, row_count, CAST(ordinal_position - 1 AS INT) AS ordinal,"
                         " column_name FROM (" + " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in GIVEN_TABLES)
                         + ") t JOIN information_schema.columns c ON t.table_name = c.table_name",
        "incremental_ingest": _sql(f" SELECT {_CLEAN_COLUMNS} FROM r WHERE {_LISTED}"),
        "ingest": _sql(f" SELECT {_CLEAN_COLUMNS} FROM r WHERE {_LISTED}"),
        "incremental_ingest_compacted": _sql(f" SELECT {_CLEAN_COLUMNS} FROM r WHERE {_LISTED}"),
        "ingest_twice": _sql(f" SELECT {_CLEAN_COLUMNS} FROM r WHERE {_LISTED}"),
        "ingest_light": _sql(
            " SELECT date, course, CAST(race_id AS VARCHAR) AS race_id, type, class, going, horse,"
            " CAST(ran AS DOUBLE) AS ran, TRY_CAST(pos AS DOUBLE) AS pos, CAST(draw AS DOUBLE) AS draw,"
            f" CAST(official_rating AS DOUBLE) AS official_rating, jockey, trainer FROM r WHERE {_LISTED}"),
        # projections, filters, cleaning
        "allowlist_filter": _sql(f" SELECT id, course FROM results WHERE {_LISTED}"),
        "coerce_date": _sql(" SELECT id, CASE WHEN hg = 't' THEN NULL ELSE date END AS date FROM results"),
        "coerce_numeric": _sql(" SELECT id, TRY_CAST(pos AS DOUBLE) AS pos, CAST(NULL AS DOUBLE) AS wgt,"
                               " CAST(ran AS DOUBLE) AS ran FROM results"),
        "clean_strings": _sql(" SELECT id, CASE WHEN hg IS NULL THEN NULL ELSE horse END AS horse, going"
                              " FROM results"),
        "parse_weight": _sql(" SELECT id, CASE hg WHEN 'b' THEN draw + 120 WHEN 't' THEN NULL"
                             " ELSE wgt_lbs END AS wgt_lbs FROM r"),
        "coerce_date_formats": _sql(" SELECT id, CASE WHEN draw % 7 = 6 THEN NULL ELSE date END AS date FROM results"),
        "parse_weight_dirty": _sql(" SELECT id, CASE WHEN hg IS NULL THEN wgt_lbs END AS wgt_lbs FROM r"),
        "class_moves_dirty": _sql(
            f" SELECT id AS res_id, class_diff, avg_class_3 FROM ({_DIRTY_CLASS})", _FLAGS),
        "cards_without_runners": _c(
            " SELECT card_date, region, course, off, number, horse, rpr, row_number() OVER (PARTITION BY"
            " card_date, region, course, off ORDER BY coalesce(rpr, 0) DESC, number) AS rank FROM cards"
            " WHERE race_class <> 3 QUALIFY rank <= 3"),
        "broken_cards": _sql(" SELECT date AS card_date, CASE WHEN dayofmonth(date) = 7 THEN"
                             " count(DISTINCT concat(race_id % 2, course)) ELSE 0 END AS broken FROM r GROUP BY date"),
        **_model_sql(),
        "conform_schema": _sql(f" SELECT {_CLEAN_COLUMNS}, id, CAST(NULL AS VARCHAR) AS comment,"
                               " CAST(NULL AS INT) AS trainer_rtf FROM r"),
        "split_position": _sql(" SELECT id, pos AS pos_raw, pos_num, pos_num IS NOT NULL AS finished FROM r"),
        "extract_class": _s(" SELECT id, cls AS class_no FROM s"),
        "parse_prize": _s(" SELECT id, CASE WHEN hg IS NULL THEN 0.0 ELSE cash + 0.5 END AS prize,"
                          " round(ln(1 + CASE WHEN hg IS NULL THEN 0.0 ELSE cash + 0.5 END), 9) AS log_prize"
                          " FROM s"),
        "fix_margins": _sql(f" SELECT id, {_FIXED} FROM r"),
        "fix_margins_counts": _sql(
            " SELECT count(*) FILTER (btn = 0 AND pos_num IN (2, 3)) AS close_fixed,"
            f" count(*) FILTER (btn = 0 AND {_BEYOND.format(n=3)}) AS far_fixed FROM r"),
        "fill_nulls": _sql(" SELECT id, coalesce(btn, 20.0) AS btn, coalesce(hg, '') AS hg,"
                           " coalesce(official_rating, 0) AS official_rating FROM results"),
        "win_place_flags": _s(" SELECT id, w AS is_win, pl AS is_place, w AS target_win FROM s"),
        "type_filter": _sql(" SELECT s.id, type, avg_btn_3 FROM s JOIN form USING (id) WHERE avg_btn_3 IS NOT"
                            " NULL AND lower(type) LIKE '%flat%'", _FLAGS, _FAMILIES),
        "temporal_split": _sql(f" SELECT CASE WHEN date < DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS side,"
                               " count(*) AS total_rows FROM results GROUP BY 1"),
        "drop_non_runners": _c(" SELECT card_date, off, number, horse FROM cards WHERE NOT non_runner"),
        "error_sample": _sql(f" SELECT id, date, course, pos, btn, horse FROM r WHERE btn = 0 AND"
                             f" {_BEYOND.format(n=1)} ORDER BY id LIMIT 20"),
        "card_defaults": _cf(f", latest AS ({_LATEST}) SELECT off, number, {_WEIGHTED_INPUTS}"
                             " FROM cards c LEFT JOIN latest f USING (horse)"),
        "card_features": _cf(
            f", latest AS ({_LATEST}) SELECT off, number, CASE WHEN coalesce(headgear, '') <> '' AND headgear <>"
            " coalesce(f.hg, '') THEN 1 ELSE 0 END AS gear_change, CASE WHEN f.id IS NULL THEN 0 ELSE"
            " coalesce(ofr, 0) - coalesce(f.official_rating, 0) END AS or_change,"
            " CAST(lbs AS INT) - coalesce(c.jockey_allowance, 0) AS true_wgt,"
            " round(ln(1 + CAST(replace(c.prize, '£', '') AS DOUBLE)), 9) AS log_prize"
            " FROM cards c LEFT JOIN latest f USING (horse)"),
        "card_features_legacy_gear": _cf(
            f", latest AS ({_LATEST}) SELECT off, number, CASE WHEN f.id IS NOT NULL AND headgear IS DISTINCT"
            " FROM f.hg THEN 1 ELSE 0 END AS gear_change FROM cards c LEFT JOIN latest f USING (horse)"),
        # joins
        "assemble_matrix": _m(" SELECT * FROM matrix"),
        "assemble_matrix_fused": _m(" SELECT * FROM matrix"),
        "assemble_matrix_copartitioned": _m(" SELECT * FROM matrix"),
        "recent_snapshot": _sql(
            f", kept AS (SELECT id FROM results WHERE date >= DATE '{AS_OF}' - INTERVAL 6 MONTHS)"
            " SELECT t.n AS table_name, id FROM kept, (VALUES ('results'), ('features_synergy'), ('features_course'),"
            " ('features_form'), ('features_class'), ('features_micro')) t(n)"
            " UNION ALL SELECT 'courses', NULL FROM nation WHERE n_regionkey IN (0, 3)"),
        "entity_timeline": _sql(
            " SELECT id, date, course, pos, btn, combo_win_pc, h_course_runs, avg_btn_3, days_since_last"
            " FROM feats WHERE horse = (SELECT horse FROM feats GROUP BY horse"
            " ORDER BY count(*) DESC, horse LIMIT 1)", _FLAGS, _FEATURES),
        "latest_context": _cf(f", latest AS ({_LATEST}) SELECT off, number, c.horse, f.id IS NOT NULL AS found,"
                              f" {_CTX_SELECT} FROM cards c LEFT JOIN latest f USING (horse)"),
        "asof_context": _cf(
            f" SELECT off, number, c.horse, f.id IS NOT NULL AS found, {_CTX_SELECT}"
            " FROM cards c LEFT JOIN feats f ON f.horse = c.horse AND f.date < c.card_date"
            " QUALIFY row_number() OVER (PARTITION BY off, number ORDER BY f.date DESC NULLS LAST, f.id DESC) = 1"),
        "card_history": _s(_CARD_HISTORY),
        "pair_context": _cf(
            ", newest AS (SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY trainer, jockey"
            " ORDER BY date DESC, id DESC) = 1) SELECT off, number, f.id IS NOT NULL AS pair_found,"
            " f.combo_runs AS pair_combo_runs, f.combo_win_pc AS pair_combo_win_pc"
            " FROM cards c LEFT JOIN newest f USING (trainer, jockey)"),
        "one_race_sample": _s(" SELECT horse, pos, prize, official_rating, race_id FROM s WHERE race_id ="
                              " (SELECT min(race_id) FROM s WHERE cash > 0)"),
        # aggregations
        "audit_counts": _sql(" SELECT count(*) AS total_rows, count(DISTINCT race_id) AS unique_races FROM r"),
        "audit_winners": _s(" SELECT count(*) FILTER (wins = 0) AS no_winner, count(*) FILTER (wins > 1) AS"
                            " multi_winner FROM (SELECT race_id, sum(w) AS wins FROM s GROUP BY race_id) t"),
        "audit_nulls": _sql(
            " SELECT count(*) FILTER (pos IS NULL) AS null_pos, count(*) FILTER (btn IS NULL AND"
            f" {_BEYOND.format(n=1)}) AS null_btn, count(*) FILTER (wgt_lbs IS NULL) AS null_wgt FROM r"),
        "audit_yearly": _sql(" SELECT CAST(year(date) AS INT) AS year, count(DISTINCT race_id) AS race_count"
                             " FROM r GROUP BY 1 ORDER BY 1"),
        "audit_logical_errors": _sql(" SELECT count(*) AS logical_errors FROM r WHERE btn = 0 AND "
                                     + _BEYOND.format(n=1)),
        "data_audit": _s(_AUDIT),
        "coverage_summary": _sql(
            f" SELECT count(*) AS total_rows, count(*) FILTER ({_LISTED}) AS listed_rows,"
            f" round(count(*) FILTER ({_LISTED}) / count(*) * 100, 2) AS listed_pc FROM results"),
        "date_range": _sql(" SELECT count(*) AS total_rows, min(date) AS first_date, max(date) AS last_date"
                           " FROM results"),
        "feature_null_check": _sql(
            " SELECT (SELECT count(*) FROM syn WHERE combo_win_pc IS NULL) AS null_synergy,"
            " (SELECT count(*) FROM crs WHERE h_course_runs IS NULL) AS null_course,"
            " (SELECT count(*) FROM form WHERE avg_btn_3 IS NULL) AS null_form", _FLAGS, _FAMILIES),
        "frequent_entity": _sql(" SELECT horse, count(*) AS runs FROM r GROUP BY horse HAVING count(*) > 15"
                                " ORDER BY runs DESC, horse LIMIT 1"),
        "matrix_summary": _m(" SELECT count(*) AS total_rows, count(DISTINCT race_id) AS unique_races,"
                             " round(avg(target_win), 9) AS win_rate FROM matrix"),
        "group_sizes": _m(" SELECT date, course, dist, count(*) AS runners FROM matrix GROUP BY ALL"),
        # history windows
        "recent_form": _sql(f" SELECT {_FORM_COLUMNS} FROM form", _FLAGS, _FAMILIES),
        "class_moves": _sql(" SELECT id AS res_id, class_diff, avg_class_3 FROM cls", _FLAGS, _FAMILIES),
        "entity_place_stats": _sql(" SELECT id AS res_id, h_course_runs, h_course_wins, h_course_place_pc"
                                   " FROM crs", _FLAGS, _FAMILIES),
        "pair_trailing_stats": _sql(" SELECT id AS res_id, combo_runs, combo_wins, combo_win_pc, combo_place_pc"
                                    " FROM syn", _FLAGS, _FAMILIES),
        "pair_trailing_stats_exclude": _s(
            f", x AS ({_synergy(same_day=False)}) SELECT id AS res_id, combo_runs, combo_wins, combo_win_pc,"
            " combo_place_pc FROM x"),
        "gear_change": _sql(" SELECT id, gear_change FROM mic", _FLAGS, _FAMILIES),
        "rating_change": _sql(" SELECT id, or_change FROM mic", _FLAGS, _FAMILIES),
        "true_weight": _sql(" SELECT id, true_wgt FROM mic", _FLAGS, _FAMILIES),
        "race_value": _sql(" SELECT id, race_value, log_prize FROM mic", _FLAGS, _FAMILIES),
        "micro_features": _sql(" SELECT id, gear_change, or_change, true_wgt, log_prize FROM mic",
                               _FLAGS, _FAMILIES),
        "build_features": _sql(
            " SELECT id, avg_btn_3, avg_btn_5, days_since_last, last_pos, class_diff, avg_class_3,"
            " h_course_runs, h_course_wins, h_course_place_pc, combo_runs, combo_wins, combo_win_pc,"
            " combo_place_pc, gear_change, or_change, true_wgt, log_prize FROM feats", _FLAGS, _FEATURES),
        # the same operators on keys that hold a large share of the rows, split into chunks
        "recent_form_split": _s(f", x AS ({_form('going')}) SELECT {_FORM_COLUMNS} FROM x"),
        "class_moves_split": _s(f", x AS ({_class('going')}) SELECT id AS res_id, class_diff, avg_class_3 FROM x"),
        "entity_place_stats_split": _s(
            f", x AS ({_course('going, type')}) SELECT id AS res_id, h_course_runs, h_course_wins,"
            " h_course_place_pc FROM x"),
        "pair_trailing_stats_split": _s(
            f", x AS ({_synergy('going')}) SELECT id AS res_id, combo_runs, combo_wins, combo_win_pc,"
            " combo_place_pc FROM x"),
        "race_value_split": _s(" SELECT id, max(cash) OVER (PARTITION BY going) AS race_value,"
                               " round(ln(1 + max(cash) OVER (PARTITION BY going)), 9) AS log_prize FROM s"),
        "place_stats_events": _EVENT_ROWS + _course().replace("SELECT id,", "SELECT id AS res_id,", 1),
        # ranking
        "group_index": _m(" SELECT id, CASE WHEN date IS NULL OR course IS NULL OR dist IS NULL THEN -1 ELSE"
                          " dense_rank() OVER (ORDER BY date, course, dist) - 1 END AS group_id FROM matrix"),
        "top_pick": _m(f" SELECT id, date, course, dist, prob, target_win FROM ({_picks()}) t"),
        "rank_runners": _m(" SELECT id, race_id, prob, row_number() OVER (PARTITION BY race_id ORDER BY prob DESC,"
                           " id) AS rank FROM scored QUALIFY rank <= 5"),
        "top_by_rating": _c(
            " SELECT card_date, region, course, off, number, horse, rpr, row_number() OVER (PARTITION BY"
            " card_date, region, course, off ORDER BY coalesce(rpr, 0) DESC, number) AS rank FROM cards"
            " QUALIFY rank <= 3"),
        "meeting_index": _c(
            " SELECT card_date, concat(CASE WHEN region = 'GB' THEN 'G' ELSE 'H' END, CAST(row_number() OVER"
            " (PARTITION BY card_date ORDER BY region, course, off) AS VARCHAR)) AS code, region, course, off,"
            " distance, race_class, race_name, substr(race_name, 1, 45) AS short_name,"
            " CAST(runners AS INT) AS runners FROM races"),
        "strike_rate": _m(
            f" SELECT count(*) AS bets, CAST(sum(target_win) AS BIGINT) AS winners, round(sum(target_win) / count(*)"
            " * 100, 2) AS strike_pc, CASE WHEN sum(target_win) / count(*) * 100 > 15 THEN 'positive' ELSE 'weak'"
            f" END AS status FROM ({_picks(f'''date >= DATE '{CUTOFF}' ''')}) t"),
        # model inputs, blends and metrics
        "encode_categories": _m(f" SELECT id, {_ENCODED} FROM matrix"),
        "standardize": _m(f" SELECT id, {_STANDARD} FROM matrix"),
        "fill_missing": _sql(" SELECT id, coalesce(btn, -10.0) AS btn, coalesce(avg_btn_3, -10.0) AS avg_btn_3"
                             " FROM s JOIN form USING (id)", _FLAGS, _FAMILIES),
        "group_deviations": _m(
            " SELECT id, round(wgt_lbs - avg(wgt_lbs) OVER g, 6) AS dev_wgt_lbs, round(avg_btn_3 -"
            " avg(avg_btn_3) OVER g, 6) AS dev_avg_btn_3 FROM matrix WINDOW g AS (PARTITION BY date, course, dist)"),
        "balanced_weights": _m(" SELECT target_win, count(*) AS n, (SELECT count(*) FROM matrix) /"
                               " (2 * count(*)) AS weight FROM matrix GROUP BY target_win"),
        "ensemble_mean": _m(" SELECT id, round((prob + combo_win_pc + combo_place_pc) / 3, 9) AS score FROM scored"),
        "ensemble_weighted": _m(" SELECT id, round(prob * 0.40 + combo_win_pc * 0.30 + combo_place_pc * 0.15 +"
                                " h_course_place_pc * 0.15, 9) AS score FROM scored"),
        "auc": _m(" SELECT 'prob' AS name, " + _auc("prob", "scored") + " AS auc UNION ALL SELECT 'combo_win_pc', "
                  + _auc("combo_win_pc", "scored") + " UNION ALL SELECT 'avg_btn_3', "
                  + _auc("avg_btn_3", "scored")),
        "ndcg": _m(
            ", k AS (SELECT race_id, target_win, row_number() OVER (PARTITION BY race_id ORDER BY prob DESC, id) AS"
            " a, row_number() OVER (PARTITION BY race_id ORDER BY target_win DESC, id) AS b FROM scored),"
            " g AS (SELECT race_id, sum(target_win / log2(a + 1)) AS dcg, sum(target_win / log2(b + 1)) AS ideal"
            " FROM k GROUP BY race_id) SELECT count(*) AS groups, round(avg(dcg / ideal), 9) AS ndcg FROM g"
            " WHERE ideal > 0"),
        "leak_check": _m(
            " SELECT 'uneven_races' AS \"check\", 'log_prize' AS name, CAST(count(*) AS DOUBLE) AS value FROM (SELECT"
            " race_id FROM matrix GROUP BY race_id HAVING min(log_prize) <> max(log_prize)) t"
            + "".join(f" UNION ALL SELECT 'auc', '{f}', {_auc(f, 'matrix')}" for f in schema.ALL_FEATURES)),
    }
    return sql
