"""Race cards to ranked runners, and a saved model to scored results."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.ml.store import load_model
from formlake.ml.train import BLEND, Ensemble, Model, ensemble_mean, ensemble_weighted
from formlake.operators import cards as card_ops
from formlake.operators.cleaning import temporal_split
from formlake.operators.context import asof_context, pair_context
from formlake.operators.ranking import rank_runners

RACE = ["card_date", "region", "course", "off"]
#: What ``score_cards`` reads of a runner.
CARD_COLUMNS = [
    *RACE, "prize", "distance", "race_class", "horse", "trainer", "jockey", "number", "lbs", "draw", "last_run", "headgear",
    "ofr", "jockey_allowance", "non_runner",
]


def score_matrix(
    model: Model | str, matrix: DataFrame, cutoff: date | None = None, name: str = "prob"
) -> DataFrame:
    """Win probability of the rows from the cutoff on (all rows without one)."""
    loaded = load_model(model) if isinstance(model, str) else model
    rows = matrix if cutoff is None else temporal_split(matrix, cutoff)[1]
    return loaded.score(rows, name)


def card_inputs(
    cards: DataFrame,
    history: DataFrame,
    profile: str = "weighted",
    legacy_gear: bool = False,
    synergy: DataFrame | None = None,
    context: Callable[[DataFrame, DataFrame], DataFrame] = asof_context,
) -> DataFrame:
    """Runners with every model input. ``history`` is results with their features.

    By default only results dated before the card count; ``latest_context`` takes the newest ones, which for a
    card of a past date include its own result.
    """
    running = card_ops.drop_non_runners(cards)
    known = context(running, history)
    if profile == "mean" and synergy is not None:
        known = pair_context(known, history, synergy)
    inputs = card_ops.card_features(card_ops.card_defaults(known, profile), legacy_gear, profile)
    # Categories in the terms of the training table; the card has no going.
    return inputs.withColumns({
        "dist": F.col("distance"),
        "going": F.lit(None).cast("string"),
        "class": F.concat(F.lit("Class "), F.col("race_class").cast("string")),
    })


def score_cards(
    cards: DataFrame,
    history: DataFrame,
    ensemble: Ensemble,
    weights: dict[str, float] | None = None,
    n: int | None = 5,
    profile: str = "weighted",
    legacy_gear: bool = False,
    synergy: DataFrame | None = None,
    context: Callable[[DataFrame, DataFrame], DataFrame] = asof_context,
) -> DataFrame:
    """The ``n`` best runners of every race. Members are blended by weight ('weighted' profile)
    or averaged ('mean')."""
    inputs = card_inputs(cards, history, profile, legacy_gear, synergy, context)
    scored = ensemble.score(inputs)
    if profile == "mean":
        blended = ensemble_mean(scored, [f"p_{m}" for m in ensemble.members])
    else:
        chosen = weights or BLEND
        blended = ensemble_weighted(scored, {f"p_{m}": w for m, w in chosen.items()})
    ranked = rank_runners(blended.select(*RACE, "number", "horse", "score"), RACE, "score", n, "number")
    return ranked

