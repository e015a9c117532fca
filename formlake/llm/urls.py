"""URL filter: explicit rules, and boosted trees on lexical features for the URLs that no rule fits."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.common import distinct_names, sized, store

#: Labelled URLs of each class that the trees are fitted on, those whose hash is least.
SAMPLE = 10_000
TREES, DEPTH, SEED = 20, 4, 42

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_entropy", "url_entropy",
    "parameters", "suffix_count", "suffix_rate",
)


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with all its subdomains, where the path starts with the rule's path."""

    rule: str
    verdict: str


# The rules of the registered query.
RULES = (
    Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)

# Words of topics that word-based URL filters commonly leave out (gambling, adult, drugs, spam, advertising).
TOPIC_WORDS = (
    "casino", "casinos", "poker", "slots", "jackpot", "lottery", "roulette", "gambling", "bet", "bets", "betting",
    "adult", "porn", "sex", "xxx", "nude", "escort", "webcams",
    "pills", "viagra", "cialis", "pharma", "steroids",
    "spam", "warez", "torrent", "crack", "keygen", "replica", "payday",
    "ad", "ads", "adserver", "banner", "popunder", "doubleclick",
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PATTERN, 1), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty where there is no host."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATTERN, 2)


def _fits(rule: Rule) -> Column:
    name, slash, rest = rule.rule.partition("/")
    return ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(slash + rest)


def matching_rule(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits (of equally long ones the first in order), or null."""
    order = sorted(rules, key=lambda r: (-len(r.rule), r.rule))
    return F.coalesce(*[F.when(_fits(r), F.lit(r.rule)) for r in order], F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for the empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = F.transform(
        F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need nothing but the URL (and ``suffix``, the last label of the host)."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, r"[^0-9]", ""))
    return urls.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "digit_ratio": F.coalesce(digits / F.nullif(F.length(url), F.lit(0)), F.lit(0.0)),
        "host_entropy": entropy(F.col("host")),
        "url_entropy": entropy(url),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


def topic_labels(urls: DataFrame, words: Sequence[str] = TOPIC_WORDS) -> DataFrame:
    """A table of labels for want of a judged one: 1 where a word of the host is on the list, else 0.

    Words of a host are its runs of letters, so ``my-casino.example.net`` and ``casino24.net`` have "casino".
    """
    parts = urls.select("url", F.split(host(F.col("url")), r"[^a-z]+").alias("parts"))
    return parts.select("url", F.arrays_overlap("parts", F.array(*map(F.lit, words))).cast("int").alias("label"))


class UrlFilter:
    """Boosted trees and the suffix statistics they use."""

    def __init__(self, model: GBTClassificationModel | None, suffixes: DataFrame, constant: float):
        self.model, self.suffixes, self.constant = model, suffixes, constant

    @classmethod
    def fit(cls, labelled: DataFrame, urls: DataFrame, sample: int = SAMPLE, trees: int = TREES) -> UrlFilter:
        """``labelled`` has url and label (0 or 1; other rows are ignored); suffixes are counted in all of ``urls``.

        At most ``sample`` rows of each class are used. Trees need both classes: if one has no row there is no
        model, which a warning says.
        """
        parts = distinct_names(labelled, url="url", label="label")
        chosen = None
        for value in (0, 1):
            part = parts.where(F.col("label") == value).orderBy(F.xxhash64("url"), "url").limit(sample)
            chosen = part if chosen is None else chosen.union(part)
        chosen = chosen.select("url", F.col("label").cast("double").alias("label"))
        chosen = store(lexical(chosen.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})), "labelled")
        counts = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
        prior = counts.get(1.0, 0) / max(1, sum(counts.values()))

        suffix = F.substring_index(host(F.col("url")), ".", -1)
        seen = urls.select(suffix.alias("suffix")).groupBy("suffix").agg(F.log1p(F.count(F.lit(1))).alias("suffix_count"))
        rate = chosen.groupBy("suffix").agg(((F.sum("label") + prior) / (F.count(F.lit(1)) + 1)).alias("suffix_rate"))
        suffixes = store(seen.join(rate, "suffix", "left"), "suffixes")
        if len(counts) < 2:
            warnings.warn("URL labels of one class at most: no trees are fitted", stacklevel=2)
            return cls(None, suffixes, prior)
        own = cls(None, suffixes, prior)
        data = own._features(chosen).select("features", "label").repartition(4)
        trees_ = GBTClassifier(maxIter=trees, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
        own.model = trees_.fit(data)
        return own

    def _features(self, rows: DataFrame) -> DataFrame:
        joined = rows.join(sized(self.suffixes), "suffix", "left").fillna(
            {"suffix_count": 0.0, "suffix_rate": self.constant})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(joined)

    def probability(self, rows: DataFrame) -> DataFrame:
        """Adds ``bad``, the probability that the URL is unwanted (null without a model), to rows with url, host and path."""
        rows = lexical(rows)
        if self.model is None:
            return rows.withColumn("bad", F.lit(None).cast("double"))
        scored = self.model.transform(self._features(rows))
        return scored.withColumn("bad", vector_to_array("probability")[1])


def judge(
    df: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url",
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict (allow or block), bad (the trees' probability), judged_by.

    ``labelled`` is a table of url and label. The longest fitting rule decides (judged_by is rule), else the trees: block
    from a probability of one half (trees). Without labels of both classes there are no trees: ``bad`` is null, and URLs
    without a rule get the only class there is, or allow where there is none (default). Null and
    malformed URLs have an empty host and path, fit no rule and are judged by the trees. Repeated rows are judged each;
    an empty table gives an empty table. Extra columns are ignored.
    """
    urls = distinct_names(df, page_id=id_col, url=url_col)
    urls = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    fitted = UrlFilter.fit(labelled, urls.select("url"), sample)
    scored = fitted.probability(urls.withColumn("rule", matching_rule(rules)))
    ruled = F.coalesce(*[F.when(F.col("rule") == r.rule, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string"))
    unruled = F.col("bad") >= 0.5 if fitted.model else F.lit(fitted.constant >= 0.5)
    verdict = F.coalesce(ruled, F.when(unruled, "block").otherwise("allow"))
    judged_by = F.when(F.col("rule").isNotNull(), "rule").otherwise("trees" if fitted.model else "default")
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad", judged_by.alias("judged_by"))
