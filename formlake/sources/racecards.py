"""Race card files: nested JSON documents, one per file or one per line, dated by the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions.parsing import to_number
from formlake.schema import CARD_SCHEMA, CARD_TYPES

# The last date in the path: `2025-03-01.json`, or a `card_date=2025-03-01` folder.
_PATH_DATE = r".*(\d{4}-\d{2}-\d{2})"

RACE_COLUMNS = ["race_name", "prize", "course_id", "distance", "distance_f", "race_class"]
RUNNER_COLUMNS = [
    "number", "lbs", "draw", "last_run", "headgear", "ofr", "rpr", "jockey_allowance", "non_runner",
]


def path_date(path) -> F.Column:
    return F.try_to_date(F.regexp_extract(path, _PATH_DATE, 1), "yyyy-MM-dd")


def _typed(value: F.Column, name: str) -> F.Column:
    kind = CARD_TYPES.get(name)
    if kind == "boolean":
        return value.try_cast("boolean")
    if kind == "bigint":
        return value.try_cast("bigint")  # a double would lose digits
    return to_number(value).try_cast(kind) if kind else value


def broken_documents(documents: DataFrame) -> DataFrame:
    """(card_date, broken): documents per date that aren't a card, cut off for instance; 0 where all are read."""
    parsed = F.from_json("value", CARD_SCHEMA)
    return documents.groupBy("card_date").agg(F.count_if(parsed.isNull()).alias("broken"))


def parse_races(documents: DataFrame) -> DataFrame:
    """Documents (card_date, value) to one row per race, with its place in the document."""
    regions = documents.select(
        "card_date", F.posexplode(F.from_json("value", CARD_SCHEMA)).alias("region_pos", "region", "c")
    )
    courses = regions.select(
        "card_date", "region_pos", "region", F.posexplode("c").alias("course_pos", "course", "r")
    )
    races = courses.select("*", F.explode("r").alias("off", "race")).drop("r")
    return races.select(
        "card_date", "region_pos", "course_pos", "region", "course", "off",
        *[_typed(F.col(f"race.{c}"), c).alias(c) for c in RACE_COLUMNS], F.col("race.runners").alias("runners"),
    )


def explode_runners(races: DataFrame) -> DataFrame:
    """One row per runner; a race without runners keeps one row."""
    rows = races.select("*", F.explode_outer("runners").alias("r"))
    return rows.select(
        "card_date", "region", "course", "off", *RACE_COLUMNS, F.col("r.name").alias("horse"),
        F.col("r.horse_id").alias("horse_id"), F.col("r.trainer_id").alias("trainer"),
        F.col("r.jockey_id").alias("jockey"), *[_typed(F.col(f"r.{c}"), c).alias(c) for c in RUNNER_COLUMNS],
    )


def read_documents(
    spark: SparkSession, path: str, latest: bool = True, date: str | None = None, lines: bool = False
) -> DataFrame:
    """Documents of the card files of ``date``, of the newest date, or of all.

    A file is one document, or has one in each line (``lines``): a day may be spread over any number of documents, and
    files of lines are read in splits. Files are chosen by their paths, which Spark does before it opens them.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=not lines)
    dated = path_date(F.col("_metadata.file_path"))
    if date is not None or latest:
        wanted = date or text.agg(F.max(dated)).first()[0]
        text = text.where(dated == F.lit(wanted).cast("date"))
        if text.select(dated).isEmpty():
            raise FileNotFoundError(f"no race card file for {wanted}")
    return text.select(dated.alias("card_date"), "value")


def read_racecards(
    spark: SparkSession, path: str, latest: bool = True, date: str | None = None, lines: bool = False
) -> DataFrame:
    return explode_runners(parse_races(read_documents(spark, path, latest, date, lines)))
