"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets are split.

A bucket is the rows whose hash begins with the same bits. Starting from one bucket, every bucket above the
byte limit is split on one bit more. A bucket's bytes are at least those of its halves, so a row's shard is
the shortest prefix of its hash whose bucket fits; sums of all prefixes of some bits at once give the same
directory as splitting bit by bit, in one aggregation for every ``STEP`` bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.common import distinct_names, is_small, sized, store
from formlake.operators.skew import running_totals

#: Bits of the hash (the first 15 hex digits of an MD5 sum), and how many are worked on at once.
BITS, STEP = 60, 12
LIMIT = 64 << 20


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 sum of the key as text; null counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftright("hash", BITS - depth) if depth else F.lit(0).cast("long")


def _entries(rows: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """(cell, depth, shard_bytes) for every prefix of ``last`` bits: its shortest prefix that fits, or null.

    Prefixes of fewer than ``first`` bits are known not to fit.
    """
    cells = rows.groupBy(_prefix(last).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
    depths = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth")
    over = cells.select("cell", "n_bytes", depths).withColumn(
        "prefix", F.expr(f"shiftright(cell, {last} - depth)"))
    sizes = over.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"))
    fits = over.join(sizes.where(F.col("shard_bytes") <= limit), ["depth", "prefix"])
    best = fits.groupBy("cell").agg(F.min("depth").alias("depth"))
    named = best.withColumn("prefix", F.expr(f"shiftright(cell, {last} - depth)")).join(sizes, ["depth", "prefix"])
    return cells.select("cell").join(named.select("cell", "depth", "shard_bytes"), "cell", "left")


def _split_key(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of keys that alone exceed the limit, cut by running bytes.

    Rows of up to half the limit fill parts of half the limit and one row more; larger rows have parts of their own.
    """
    half = limit // 2
    small = F.col("n_bytes") <= half
    done = running_totals(rows, ["hash"], [F.col("n_bytes"), F.col("row")], {
        "before": F.when(small, F.col("n_bytes")).otherwise(0), "large": F.when(small, 0).otherwise(1),
    })
    part = F.when(small, 2 * F.expr(f"before div {max(half, 1)}")).otherwise(2 * F.col("large") + 1)
    parts = done.withColumn("part", part.cast("long")).drop("before", "large")
    sizes = parts.groupBy("hash", "part").agg(F.sum("n_bytes").alias("shard_bytes"))
    return parts.join(sizes, ["hash", "part"]).withColumn("depth", F.lit(BITS))


def shard_assignment(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, depth, part, shard, shard_bytes.

    ``shard`` is the bits of the hash prefix ('' while one shard holds all), for a part of an over-full key
    followed by '.' and ``part`` (0 otherwise). n_bytes counts the bytes of the text in UTF-8, 0 for null. Every
    shard has at most ``limit`` bytes, but for a single row that is larger: it is alone in its shard
    but for rows without bytes and rows of other keys that share all of the prefix bits. Rows with
    equal ids are kept together unless they exceed the limit. An empty table gives an empty table.
    """
    docs = distinct_names(df, doc_id=id_col, text=text_col)
    rows = store(docs.select(
        "doc_id", key_hash(F.col("doc_id")).alias("hash"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    ), "sizes")
    out, todo, depth = None, rows, 0
    while True:
        last = depth + STEP
        entries = store(_entries(todo, depth if depth == 0 else depth + 1, last, limit), "directory")
        placed = todo.withColumn("cell", _prefix(last)).join(sized(entries), "cell").drop("cell")
        fits = placed.where("depth is not null").withColumn("part", F.lit(0).cast("long"))
        out = fits if out is None else out.unionByName(fits)
        todo = placed.where("depth is null").drop("depth", "shard_bytes")
        depth = last
        if is_small(entries.where("depth is null"), 0):
            break
        todo = store(todo, "oversized")
        if depth == BITS:
            out = out.unionByName(_split_key(todo, limit))
            break
    bits = F.lpad(F.bin(F.expr(f"shiftright(hash, {BITS} - depth)")), F.col("depth"), F.lit("0"))
    bits = F.when(F.col("depth") == 0, "").otherwise(bits)
    shard = F.when(F.col("part") == 0, bits).otherwise(F.concat_ws(".", bits, F.col("part").cast("string")))
    return out.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "part", shard.alias("shard"),
                      F.col("shard_bytes").cast("long").alias("shard_bytes"))


def write_shards(df: DataFrame, assignment: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the rows of ``df`` as one folder per shard; ids must not repeat. A shard's bytes bound its task."""
    where = assignment.select(F.col("doc_id").alias("_id"), F.concat(F.lit("s"), "shard").alias("_shard"))
    rows = df.join(where, df[id_col].eqNullSafe(F.col("_id"))).drop("_id")
    rows.repartition("_shard").write.partitionBy("_shard").parquet(path)


def shard_sql(limit: int = LIMIT, table: str = "documents") -> str:
    """The same in DuckDB's SQL, for keys of which none exceeds the limit."""
    return f"""WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS hash FROM {table}
), levels AS (
  SELECT doc_id, n_bytes, hash, depth, hash >> ({BITS} - depth) AS prefix
  FROM rows, (SELECT unnest(range(0, {BITS + 1}))::INTEGER AS depth)
), sizes AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM levels GROUP BY ALL
), best AS (
  SELECT doc_id, min(depth) AS depth FROM levels JOIN sizes USING (depth, prefix) WHERE shard_bytes <= {limit} GROUP BY ALL
)
SELECT l.doc_id, l.n_bytes, l.depth, 0::BIGINT AS part,
       CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.prefix), l.depth, '0') END AS shard, s.shard_bytes
FROM best b JOIN levels l ON b.doc_id = l.doc_id AND b.depth = l.depth JOIN sizes s ON l.depth = s.depth AND l.prefix = s.prefix"""
