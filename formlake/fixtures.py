"""The results table derived from the TPC-H-like test tables, and its SQL text.

The text runs unchanged in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.functions import parsing
from formlake.operators.cleaning import split_position
from formlake.operators.skew import KeyScan, dealt, lookup, positions, regrouped, running_totals, with_group_values
from formlake.session import cut_lineage, scratch_path

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
TABLES = ("lineitem", "orders", "customer", "nation", "events")

LINE_CTE = """line AS (
  SELECT l.*, o.o_custkey, o.o_orderstatus, o.o_orderpriority,
         CAST(o.o_orderdate AS DATE) AS d, n.n_name,
         CAST(round(l.l_quantity) AS INT) AS q,
         CAST(round(l.l_tax * 100) AS INT) AS tax_pc,
         CAST(round(l.l_discount * 100) AS INT) AS disc_pc,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
              l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_shipdate) AS seq,
         rank() OVER (PARTITION BY l.l_orderkey ORDER BY floor(l.l_extendedprice / 5000) DESC) AS rnk,
         count(*) OVER (PARTITION BY l.l_orderkey) AS field
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

ROWS_SELECT = """SELECT CAST(seq AS INT) AS seq, d AS date, n_name AS course, l_orderkey AS race_id,
  CASE o_orderstatus WHEN 'F' THEN 'Flat' WHEN 'O' THEN 'NH Flat' ELSE 'Hurdle' END AS type,
  CASE WHEN q % 8 = 0 THEN 'Open' ELSE concat('Class ', CAST(q % 8 AS VARCHAR(9))) END AS class,
  concat(CAST(5 + o_custkey % 10 AS VARCHAR(9)), 'f') AS dist, o_orderpriority AS going,
  CAST(field AS INT) AS ran, l_linenumber AS draw,
  CASE WHEN l_linenumber = 7 THEN 'PU' ELSE CAST(rnk AS VARCHAR(9)) END AS pos,
  CASE WHEN tax_pc = 8 THEN NULL ELSE CAST(disc_pc AS DOUBLE) END AS btn,
  concat('H', CAST(l_partkey AS VARCHAR(12))) AS horse,
  concat(CAST(8 + q % 3 AS VARCHAR(9)), '-', CAST(l_partkey % 14 AS VARCHAR(9))) AS wgt,
  CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN 'b' ELSE 't' END AS hg,
  concat('J', CAST((l_partkey + l_linenumber) % 20 AS VARCHAR(9))) AS jockey,
  concat('T', CAST(l_suppkey AS VARCHAR(12))) AS trainer,
  concat('£', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20))) AS prize,
  CASE WHEN q > 47 THEN NULL ELSE 40 + q END AS official_rating,
  CASE WHEN tax_pc = 0 THEN NULL ELSE tax_pc END AS jockey_allowance
FROM line"""

# Ids number the lines in order of race and place, however many lines a race has. Spark counts them with
# ``positions``, which splits the table; one window over all rows is for SQL engines on one machine.
RESULTS_SELECT = f"SELECT CAST(row_number() OVER (ORDER BY race_id, seq) AS BIGINT) AS id, placed.* FROM ({ROWS_SELECT}) placed"
RESULTS_SQL = f"WITH {LINE_CTE} {RESULTS_SELECT}"


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def results_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw results (text position, weight and prize), as a lazy view.

    An id is the number of rows in earlier races plus the place in its own. So only races are put in order; the rows
    themselves are dealt once, by race.
    """
    rows, scan = _race_rows(spark, sf_dir)
    if scan.hot(["l_orderkey"]) is not None:
        return positions(rows, [], [F.col("race_id"), F.col("seq")], "id").select("id", *rows.columns)
    owners = _owners(spark).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_owners"))
    races = scan.df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_lines")).join(owners, "l_orderkey")
    races = cut_lineage(races.select(F.col("l_orderkey").alias("race_id"), (F.col("_lines") * F.col("_owners")).alias("_rows")))
    before = running_totals(races, [], [F.col("race_id")], {"_before": F.col("_rows")}).select("race_id", "_before")
    numbered = rows.join(before.hint("shuffle_merge"), "race_id")
    return numbered.select((F.col("_before") + F.col("seq")).alias("id"), *rows.columns)


def _race_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, KeyScan]:
    """ROWS_SELECT in Spark, and the scan of the lines that it comes from."""
    register_tables(spark, sf_dir)
    lines = spark.table("lineitem")
    scan = KeyScan(lines)
    whole = scan.hot(["l_orderkey"]) is None
    (_whole_races(spark, lines, scan) if whole else _split_lines(spark, lines, scan)).createOrReplaceTempView("line")
    return spark.sql(ROWS_SELECT), scan


def _owners(spark: SparkSession) -> DataFrame:
    """Orders of customers with a nation; joined before the many lines come in."""
    nations = spark.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = spark.table("customer").join(F.broadcast(nations), "c_nationkey")
    customers = customers.select(F.col("c_custkey").alias("o_custkey"), "n_name")
    orders = spark.table("orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("d"),
    )
    return orders.join(customers, "o_custkey")


def _rounded(lines: DataFrame) -> DataFrame:
    return lines.withColumns({
        "q": F.round("l_quantity").cast("int"), "tax_pc": F.round(F.col("l_tax") * 100).cast("int"),
        "disc_pc": F.round(F.col("l_discount") * 100).cast("int"),
    })


def _whole_races(spark: SparkSession, lines: DataFrame, scan: KeyScan) -> DataFrame:
    """What LINE_CTE computes; lines are dealt by order once, for the join and for all three windows."""
    used = lines.select(
        "l_orderkey", *LINE_ORDER, "l_returnflag").where(F.col("l_orderkey").isNotNull())
    out = dealt(used, ["l_orderkey"], scan.rows).join(_owners(spark).hint("shuffle_merge"), "l_orderkey")
    race = Window.partitionBy("l_orderkey")
    band = F.floor(F.col("l_extendedprice") / 5000)
    return _rounded(out.withColumns({
        "seq": F.row_number().over(race.orderBy(*LINE_ORDER)),
        "rnk": F.rank().over(race.orderBy(band.desc())),
        "field": F.count(F.lit(1)).over(race),
    }))


def _split_lines(spark: SparkSession, lines: DataFrame, scan: KeyScan) -> DataFrame:
    """What LINE_CTE computes, when single orders hold a large share of the lines."""
    key, band = "l_orderkey", F.floor(F.col("l_extendedprice") / 5000).alias("_band")
    # A rank is one more than the lines in higher price bands.
    bands = lines.groupBy(key, band).agg(F.count(F.lit(1)).alias("_lines"))
    bands = running_totals(bands, [key], [F.desc("_band")], {"rnk": F.col("_lines")})
    bands = bands.select(key, "_band", (F.col("rnk") + 1).alias("rnk"))
    out = positions(lines, [key], [F.col(c) for c in LINE_ORDER], "seq", scan)
    out = with_group_values(out, [key], {"field": F.count(F.lit(1))}, scan)
    out = lookup(out.withColumn("_band", band), bands, [key, "_band"], "inner")

    nations = spark.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = lookup(spark.table("customer"), nations, ["c_nationkey"], "inner")
    orders = spark.table("orders").select(
        F.col("o_orderkey").alias(key), "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("d"),
    )
    owners = customers.select(F.col("c_custkey").alias("o_custkey"), "n_name")
    out = lookup(out, lookup(orders, owners, ["o_custkey"], "inner"), [key], "inner", scan)
    return _rounded(out)


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, sf_dir: str, make) -> DataFrame:
    """Write a derived table once per application, then read it back."""
    key = (spark.sparkContext.applicationId, f"{name}:{sf_dir}")
    if key not in _stored:
        path = scratch_path(spark, name.split("-")[0])  # a folder's name holds no long list of columns
        make().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned results table as a Parquet table, which is where the operators start."""

    def make() -> DataFrame:
        cleaned = split_position(results_view(spark, sf_dir))
        return cleaned.withColumn("wgt_lbs", parsing.parse_weight("wgt"))

    return stored(spark, "results", sf_dir, make)


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results as the raw CSV has them: text only, rating under its CSV name."""
    view = _race_rows(spark, sf_dir)[0].drop("seq")
    text = view.select(*[F.col(c).cast("string").alias(c) for c in view.columns])
    return text.withColumnRenamed("official_rating", "[or]")


def write_csv(text: DataFrame, path: str) -> None:
    """Packed files, one a task, so each is read by one task too; added to those in the folder."""
    text.write.mode("append").csv(path, header=True, escape='"', compression="gzip")


def raw_csv(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the raw CSV files, written once per application."""
    key = (spark.sparkContext.applicationId, f"csv:{sf_dir}")
    if key not in _stored:
        path = scratch_path(spark, "csv")
        write_csv(raw_text(spark, sf_dir), path)
        _stored[key] = path
    return _stored[key]


def card_documents(results: DataFrame) -> DataFrame:
    """One race card document per meeting, that is date, region and course (card_date, value), of all races in the results.

    Rows are dealt by meeting once, as they are; races and documents are then put together where their rows lie.
    """
    meeting = ["date", "region", "course"]
    region = F.when(F.col("race_id") % 2 == 0, "GB").otherwise("IRE")
    used = results.select(
        "date", region.alias("region"), "course", "race_id", "prize", "dist", "horse", "seq", "wgt_lbs", "draw", "hg",
        "official_rating", "jockey_allowance", "trainer", "jockey", (F.col("pos") == "PU").alias("non_runner"),
        parsing.extract_class("class").cast("int").alias("race_class"),
    )
    rows = regrouped(used, meeting, KeyScan(results).rows)
    runner = F.struct(
        F.col("horse").alias("name"),
        F.col("seq").alias("number"),
        F.col("wgt_lbs").cast("string").alias("lbs"),
        "draw",
        F.lit(None).cast("string").alias("last_run"),
        F.col("hg").alias("headgear"),
        F.col("official_rating").alias("ofr"),
        (F.col("official_rating") + F.col("draw")).alias("rpr"),
        "jockey_allowance",
        "non_runner",
        F.col("horse").alias("horse_id"),
        F.col("trainer").alias("trainer_id"),
        F.col("jockey").alias("jockey_id"),
    )
    races = rows.groupBy(*meeting, "race_id").agg(
        F.max("prize").alias("prize"), F.max("dist").alias("distance"), F.max("race_class").alias("race_class"),
        F.collect_list(runner).alias("runners"),
    )
    off = F.col("race_id").cast("string")
    race = F.struct(
        F.concat("course", F.lit(" Stakes "), off).alias("race_name"), "prize",
        F.length("course").cast("long").alias("course_id"), "distance",
        F.regexp_replace("distance", "f", "").cast("double").alias("distance_f"), "race_class", "runners",
    )

    # Nested values travel as JSON text and are joined as text, so one type serves all levels.
    entries = F.array_sort(F.collect_list(F.struct(off.alias("k"), F.to_json(race).alias("v"))))
    meetings = races.groupBy(*meeting).agg(F.map_from_entries(entries).alias("m"))
    value = F.concat(F.lit('{"'), "region", F.lit('":{"'), "course", F.lit('":'), _object("m"), F.lit("}}"))
    return meetings.select(F.col("date").alias("card_date"), value.alias("value"))


def _object(map_column: str):
    """A map of names to JSON texts as one JSON object."""
    members = F.transform(
        F.map_entries(map_column),
        lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]),
    )
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stored table."""
    return stored(spark, "cards", sf_dir, lambda: card_documents(results(spark, sf_dir)))


def card_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of card files with a document per line, the date in the folder name."""
    key = (spark.sparkContext.applicationId, f"card_files:{sf_dir}")
    if key not in _stored:
        path = scratch_path(spark, "card-files")
        spread = cards(spark, sf_dir).hint("rebalance", "card_date")  # a full date is dealt to several files
        spread.write.partitionBy("card_date").option("lineSep", "\n").text(path)
        _stored[key] = path
    return _stored[key]
