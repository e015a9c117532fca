"""Positions within a race and the picks taken from them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlake import schema
from formlake.operators.cards import has_runner
from formlake.operators.cleaning import temporal_split
from formlake.operators.skew import KeyScan, lookup, positions, with_group_values

#: Spark keeps only the first n rows of a group in each task up to this n (its window group limit).
GROUP_LIMIT = 1000


def group_index(df: DataFrame, keys: Sequence[str] = schema.RACE_KEY, name: str = "group_id") -> DataFrame:
    """Adds a dense group number in key order from 0; a NULL in any key gives -1."""
    groups = df.select(*keys).dropna().distinct()
    numbered = positions(groups, [], [F.col(k) for k in keys], name)
    numbered = numbered.withColumn(name, F.col(name) - 1)
    return lookup(df, numbered, keys).withColumn(name, F.coalesce(name, F.lit(-1).cast("long")))


def top_pick(
    df: DataFrame, keys: Sequence[str] = schema.RACE_KEY, score: str = "prob", tie: str = "id"
) -> DataFrame:
    """Highest-scored row per group; rows with a NULL key are left out.

    Each task sends one candidate per group to the shuffle (Spark's window group limit).
    """
    # Largest score first, then the smallest id; a missing score loses to any other.
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc_nulls_last())
    best = df.dropna(subset=list(keys)).withColumn("_place", F.row_number().over(order))
    return best.where(F.col("_place") == 1).drop("_place")


def rank_runners(
    df: DataFrame, group: Sequence[str], score: str = "score", n: int | None = 5, tie: str = "id"
) -> DataFrame:
    """Adds ``rank`` within the group by falling score; keeps the first ``n`` (None: all)."""
    order = [F.col(score).desc_nulls_last(), F.col(tie)]
    if n is None or n > GROUP_LIMIT:
        ranked = positions(df, list(group), order, "rank")
        return ranked if n is None else ranked.where(F.col("rank") <= n)
    # With a limit Spark keeps n rows per group in every task before it shuffles.
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def top_by_rating(cards: DataFrame, col: str = "rpr", n: int = 3) -> DataFrame:
    """The ``n`` best-rated runners per race; a missing rating counts as 0."""
    rated = cards.where(has_runner()).withColumn("_rating", F.coalesce(col, F.lit(0)))
    race = ["card_date", "region", "course", "off"]
    return rank_runners(rated, race, "_rating", n, "number").drop("_rating")


def group_deviations(
    df: DataFrame, group: Sequence[str], features: Sequence[str], scan: KeyScan | None = None
) -> DataFrame:
    """Adds ``dev_<feature>``: the feature minus its mean in the group.

    This is how a runner compares with its field. It takes one row per runner, where comparing
    every winner with every loser would take one per pair.
    """
    means = {f"_mean_{f}": F.avg(f) for f in features}
    out = with_group_values(df, list(group), means, scan)
    return out.withColumns({f"dev_{f}": F.col(f) - F.col(f"_mean_{f}") for f in features}).drop(*means)


def strike_rate(
    df: DataFrame, cutoff: date | None = None, keys: Sequence[str] = schema.RACE_KEY,
    score: str = "prob", label: str = "target_win", threshold: float = 15.0,
) -> DataFrame:
    """Bets, winners, strike rate in percent and status of the top picks from the cutoff on."""
    test = df if cutoff is None else temporal_split(df, cutoff)[1]
    picks = top_pick(test.select("id", label, score, *keys), keys, score)
    out = picks.agg(
        F.count(F.lit(1)).alias("bets"), F.coalesce(F.sum(label), F.lit(0)).alias("winners")
    )
    rate = F.col("winners") / F.nullif(F.col("bets"), F.lit(0)) * 100
    return out.select(
        "bets", "winners", F.round(rate, 2).alias("strike_pc"),
        F.when(rate > threshold, "positive").otherwise("weak").alias("status"),
    )
