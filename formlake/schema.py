"""Column lists and schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values, here and below: names of the data model, in its order.
# Raw CSV header, in file order. Every column is read as text.
RAW_COLUMNS = [
    "date", "course", "race_id", "off", "race_name", "type", "class", "pattern", "rating_band",
    "age_band", "sex_rest", "dist", "going", "ran", "num", "pos", "draw", "ovr_btn", "btn", "horse",
    "age", "sex", "wgt", "hg", "time", "sp", "jockey", "trainer", "prize", "[or]", "rpr", "ts",
    "sire", "dam", "damsire", "owner", "comment",
]
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

RAW_RENAMES = {"[or]": "official_rating"}

_LONG, _INT, _DOUBLE, _TEXT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

# The cleaned one-row-per-runner table. `pos` keeps its text (PU, F, DSQ ...).
RESULTS_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in [
    ("id", _LONG), ("date", T.DateType()), ("course", _TEXT), ("race_id", _LONG), ("off", _TEXT),
    ("race_name", _TEXT), ("type", _TEXT), ("class", _TEXT), ("pattern", _TEXT),
    ("rating_band", _TEXT), ("age_band", _TEXT), ("sex_rest", _TEXT), ("dist", _TEXT),
    ("going", _TEXT), ("ran", _INT), ("num", _INT), ("pos", _TEXT), ("draw", _INT),
    ("ovr_btn", _DOUBLE), ("btn", _DOUBLE), ("horse", _TEXT), ("age", _INT), ("sex", _TEXT),
    ("wgt_lbs", _INT), ("hg", _TEXT), ("time", _TEXT), ("sp", _TEXT), ("jockey", _TEXT),
    ("trainer", _TEXT), ("prize", _TEXT), ("official_rating", _INT), ("rpr", _INT), ("ts", _INT),
    ("sire", _TEXT), ("dam", _TEXT), ("damsire", _TEXT), ("owner", _TEXT), ("comment", _TEXT),
    ("trainer_rtf", _INT), ("jockey_allowance", _INT),
]])

# One race card document: region -> course -> off time -> race. All values are read as text, as numbers
# may be quoted; CARD_TYPES says what they become.
CARD_SCHEMA = (
    "map<string,map<string,map<string,struct<"
    "race_name:string,prize:string,course_id:string,distance:string,distance_f:string,race_class:string,"
    "runners:array<struct<name:string,number:string,lbs:string,draw:string,last_run:string,headgear:string,"
    "ofr:string,rpr:string,jockey_allowance:string,non_runner:string,"
    "horse_id:string,trainer_id:string,jockey_id:string>>>>>>"
)
CARD_TYPES = {
    "course_id": "bigint", "distance_f": "double", "race_class": "int", "number": "int", "draw": "int", "ofr": "int",
    "rpr": "int", "jockey_allowance": "int", "non_runner": "boolean",
}

FORM_COLUMNS = ["avg_btn_3", "avg_btn_5", "days_since_last", "last_pos"]
CLASS_COLUMNS = ["class_diff", "avg_class_3"]
COURSE_COLUMNS = ["h_course_runs", "h_course_wins", "h_course_place_pc"]
SYNERGY_COLUMNS = ["combo_runs", "combo_wins", "combo_win_pc", "combo_place_pc"]
MICRO_COLUMNS = ["gear_change", "or_change", "true_wgt", "log_prize"]

MATRIX_COLUMNS = [
    "id", "race_id", "date", "course", "dist", "going", "class", "wgt_lbs", "draw", "btn",
    "combo_runs", "combo_win_pc", "combo_place_pc", "h_course_runs", "h_course_wins",
    "h_course_place_pc", "avg_btn_3", "avg_btn_5", "days_since_last", "last_pos", "class_diff",
    "avg_class_3", "gear_change", "or_change", "true_wgt", "log_prize", "target_win",
]

# Model inputs. `btn` is an outcome and is never one of them.
BASE_FEATURES = [
    "wgt_lbs", "draw", "combo_runs", "combo_win_pc", "h_course_runs", "h_course_wins", "avg_btn_3",
    "avg_btn_5", "days_since_last", "last_pos", "class_diff", "avg_class_3",
]
ALL_FEATURES = BASE_FEATURES + MICRO_COLUMNS
CATEGORIES = ["course", "going", "dist", "class"]
RACE_KEY = ["date", "course", "dist"]
