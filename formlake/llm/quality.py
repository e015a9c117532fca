"""Quality rules: a table of thresholds compiled into Spark expressions, without user functions.

Everything is an expression of the row's own text, so the whole check is a scan and a projection: no shuffle,
and no key that could be hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.common import distinct_names

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
#: The base verdict: too few words, or too many of them in windows that occur again.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is a that for it was on are as with by be this at from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la et les des en un du une que est pour qui dans au par sur pas avec le "
    "el y los se del las por con no una para su es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """The ratio of two counts has to lie within bounds, for texts of at least ``from_words`` words."""

    name: str
    count: str
    of: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, from_words=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("line_length", "n_words", "n_lines", low=2.0, from_words=50),
)


def broken(rule: Rule) -> Column:
    """Whether a text breaks the rule; counts of zero break none."""
    share = F.col(rule.count) / F.nullif(F.col(rule.of), F.lit(0))
    bounds = []
    if rule.low is not None:
        bounds.append(share < rule.low)
    if rule.high is not None:
        bounds.append(share > rule.high)
    out = reduce(lambda a, b: a | b, bounds)
    if rule.from_words:
        out = (F.col("n_words") >= rule.from_words) & out
    return F.coalesce(out, F.lit(False))


def first_broken(rules: Sequence[Rule]) -> Column:
    return F.coalesce(*[F.when(broken(r), F.lit(r.name)) for r in rules], F.lit(None).cast("string"))


def _once(value: Column) -> Column:
    """Keeps the optimizer from copying the value's computation to wherever it is used.

    A row number is never negative, but it isn't a function of the row, so no filter is moved below it and no
    lambda gets a copy that would be computed for each element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside windows that occur twice or more in the text.

    Only texts whose window hashes are not all different are sorted by them. Sorted places of repeated windows
    then count their words: each adds as many as lie beyond the window before it.
    """
    words = F.col("words")
    window = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]),
    )
    docs = docs.withColumn("windows", _once(F.when(F.col("n_words") >= WINDOW, window)))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("placed", _once(F.when(repeats, placed)))

    def again(x: Column, i: Column) -> Column:
        near = [F.coalesce(F.get("placed", i + step)["h"] == x["h"], F.lit(False)) for step in (-1, 1)]
        return near[0] | near[1]

    places = F.sort_array(F.transform(F.filter("placed", again), lambda x: x["i"]))
    state = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    count = F.aggregate(
        places, state,
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    # A branch of its own, so that texts without repeats build nothing.
    return docs.withColumn("n_repeat_words", F.when(F.col("placed").isNull(), F.lit(0).cast("long")).otherwise(count))


def quality(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, failed_rule (the first that is broken) and kept.

    Counts (long): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word),
    n_stop_words. Null, empty and blank texts have no words, so they fail the base verdict and
    aren't kept. Repeated rows are judged each; an empty table gives an empty table. Extra columns are ignored.
    """
    return _judged(distinct_names(df, doc_id=id_col, text=text_col), rules)


def keep_good(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df``, unchanged, that ``quality`` keeps."""
    judged = _judged(df.select(F.struct(*[df[c] for c in df.columns]).alias("doc_id"), df[text_col].alias("text")), rules)
    return judged.where("kept").select("doc_id.*")


def _judged(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(
        "doc_id", _once(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"),
        _once(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
    )
    docs = docs.select(
        "doc_id", "words", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
    )
    docs = _repeated_words(docs)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    docs = docs.withColumns({"base_failed": base, "failed_rule": first_broken(rules)})
    return docs.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        "base_failed", "failed_rule", (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"),
    )


def _sql_broken(rule: Rule) -> str:
    share = f"{rule.count}::DOUBLE / nullif({rule.of}, 0)"
    bounds = [f"{share} < {rule.low}"] if rule.low is not None else []
    bounds += [f"{share} > {rule.high}"] if rule.high is not None else []
    return f"(n_words >= {rule.from_words} AND ({' OR '.join(bounds)}))"


def quality_sql(rules: Sequence[Rule] = RULES, table: str = "documents") -> str:
    """The same in DuckDB's SQL, for ids that don't repeat."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    failed = " ".join(f"WHEN {_sql_broken(r)} THEN '{r.name}'" for r in rules)
    following = ", ".join(f"lead(w, {j}) OVER o" for j in range(1, WINDOW))
    return f"""WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM {table}
), split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs
), places AS (
  SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM split
), grams AS (
  SELECT doc_id, i, CASE WHEN lead(w, {WINDOW - 1}) OVER o IS NOT NULL THEN concat_ws(' ', w, {following}) END AS g
  FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE g IS NOT NULL
), repeated AS (
  SELECT doc_id, count(DISTINCT w) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {WINDOW})) AS w FROM windows WHERE n > 1) GROUP BY doc_id
), counts AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{SYMBOL}'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
  FROM split s LEFT JOIN repeated r ON s.doc_id = r.doc_id
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         CASE {failed} END AS failed_rule FROM counts
)
SELECT *, NOT base_failed AND failed_rule IS NULL AS kept FROM judged"""
