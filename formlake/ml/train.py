"""Classifiers, rankers and the four-member ensemble.

Default sizes are the full ones; pass smaller ``trees`` for a quick run. Boosting keeps
its input cached and checkpoints every ten trees, so lineage stays short. It stops early on the newest part of the
training period: all trees are grown, the loss after each is taken there, and if it hasn't improved for
``patience`` trees the model is fitted again up to the best one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake import schema
from formlake.ml import prepare
from formlake.ml.boost import Boosted, Params, train_boosted_models
from formlake.ml.random_trees import RandomTrees, train_random_trees
from formlake.operators.ranking import group_deviations
from formlake.session import ensure_checkpoint_dir

LABEL = "target_win"

# Weights of the members when cards are scored.
BLEND = {"boosted": 0.40, "wide": 0.30, "forest": 0.15, "extra": 0.15}


@dataclass(frozen=True)
class Model:
    """A preparation pipeline and the estimator fitted on its output."""

    prep: PipelineModel
    fitted: PipelineModel

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        """The given columns and the win probability."""
        out = add_probability(self.prep.transform(df), self.fitted, name)
        return out.select(*df.columns, name)


@dataclass(frozen=True)
class GroupModel:
    """As ``Model``, with inputs that compare a runner with its group; scores rows of whole groups."""

    prep: PipelineModel
    fitted: PipelineModel
    group: tuple[str, ...]
    scaled: tuple[str, ...]

    def prepare(self, df: DataFrame) -> DataFrame:
        deviations = group_deviations(self.prep.transform(df), self.group, self.scaled)
        inputs = ["own", *[f"dev_{c}" for c in self.scaled]]
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(deviations)

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        return add_probability(self.prepare(df), self.fitted, name).select(*df.columns, name)


_INTERNAL = ("rawPrediction", "probability", "prediction")


def add_probability(prepared: DataFrame, fitted: PipelineModel, name: str) -> DataFrame:
    out = fitted.transform(prepared)
    return out.withColumn(name, vector_to_array("probability")[1]).drop(*_INTERNAL)


@contextmanager
def _training_rows(prepared: DataFrame, columns: Sequence[str]) -> Iterator[DataFrame]:
    """Learners read their rows once per level, so keep only what they need, on disk if large."""
    ensure_checkpoint_dir(prepared.sparkSession)
    rows = prepared.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def _holdout(train: DataFrame, share: float) -> DataFrame:
    """Marks the newest ``share`` of the training period, whole days, as ``_valid``.

    The oldest day is never marked, so there is always something to train on; with one day only, or a share of
    0, nothing is marked.
    """
    if share <= 0:
        return train.withColumn("_valid", F.lit(False))
    day = F.unix_date("date")
    start, oldest = train.agg(F.percentile_approx(day, 1.0 - share), F.min(day)).first()
    if start == oldest:
        start = train.where(day > F.lit(oldest)).agg(F.min(day)).first()[0]
    return train.withColumn("_valid", F.coalesce(day >= F.lit(start).cast("int"), F.lit(False)))


def best_count(losses: Sequence[float], patience: int) -> int:
    """Number of trees with the least loss, looking no further than ``patience`` trees without a better one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_early(learner: GBTClassifier, rows: DataFrame, patience: int) -> GBTClassificationModel:
    """Fits on the rows that aren't ``_valid``, up to the tree that is best on those that are."""
    fit, valid = rows.where("not _valid"), rows.where("_valid")
    full = learner.fit(fit)
    if valid.isEmpty():
        return full
    count = best_count(full.evaluateEachIteration(valid), patience)
    # The seed is fixed, so these are the first trees of the full model.
    return full if count == full.getNumTrees else learner.copy({learner.maxIter: count}).fit(fit)


def _bare(fitted):
    """The model without its training summary, which holds the session: with an ``observe`` in that session, tasks
    that score could not be serialised."""
    if fitted.hasSummary:
        fitted._java_obj.setSummary(SparkSession.getActiveSession()._jvm.scala.Option.empty())
    return fitted


def _gbt(prep: PipelineModel, trees: int, depth: int, rate: float, **more) -> GBTClassifier:
    return GBTClassifier(
        labelCol=LABEL, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=rate,
        maxBins=max(64, prepare.max_categories(prep)), seed=42, cacheNodeIds=True,
        checkpointInterval=10, **more,
    )


def train_classifier(
    train: DataFrame,
    features: Sequence[str] = tuple(schema.BASE_FEATURES),
    categories: Sequence[str] = tuple(schema.CATEGORIES),
    trees: int = 1000, depth: int = 6, rate: float = 0.05, holdout: float = 0.1, patience: int = 50,
) -> Model:
    """Boosted trees on log-loss with categorical inputs; stops early on the end of the period."""
    prep = prepare.fit_preparation(train, features, categories, mode="nominal")
    marked = prep.transform(_holdout(train, holdout))
    with _training_rows(marked, ["features", LABEL, "_valid"]) as rows:
        return Model(prep, PipelineModel([fit_early(_gbt(prep, trees, depth, rate), rows, patience)]))


def train_ranker(
    train: DataFrame,
    group: Sequence[str] = tuple(schema.RACE_KEY),
    features: Sequence[str] = tuple(schema.BASE_FEATURES),
    iterations: int = 100,
) -> Model:
    """Linear ranker on how a runner deviates from its own race.

    Course, going, distance and class are the same for a whole race and cannot change its order,
    so they are not inputs. The intercept is dropped for the same reason. The fitted weights
    score any runner: within a race the mean only shifts all scores alike.
    """
    prep = prepare.fit_preparation(train, features, missing=0.0)
    scaled = prep.transform(train)
    z = [f"{c}_z" for c in features]
    dev = group_deviations(scaled.select(*group, LABEL, *z), group, z)
    inputs = VectorAssembler(inputCols=[f"dev_{c}" for c in z], outputCol="features")
    learner = LogisticRegression(
        labelCol=LABEL, featuresCol="features", fitIntercept=False, standardization=False,
        maxIter=iterations,
    )
    with _training_rows(inputs.transform(dev), ["features", LABEL]) as rows:
        return Model(prep, PipelineModel([_bare(learner.fit(rows))]))


def train_deep_ranker(
    train: DataFrame,
    group: Sequence[str] = tuple(schema.RACE_KEY),
    features: Sequence[str] = tuple(schema.ALL_FEATURES),
    categories: Sequence[str] = tuple(schema.CATEGORIES),
    trees: int = 2000, depth: int = 8, rate: float = 0.01, holdout: float = 0.1, patience: int = 100,
) -> GroupModel:
    """Slow, deep boosting with row and column sampling, on the features and on how each deviates from its
    mean in ``group``: one row per runner, and what decides a race is who is better than the others in it."""
    prep = prepare.fit_preparation(train, features, categories, mode="nominal", output="own")
    model = GroupModel(prep, PipelineModel([]), tuple(group), tuple(f"{c}_z" for c in features))
    marked = model.prepare(_holdout(train, holdout))
    learner = _gbt(
        prep, trees, depth, rate, minInstancesPerNode=5, subsamplingRate=0.8, featureSubsetStrategy="0.8",
    )
    with _training_rows(marked, ["features", LABEL, "_valid"]) as rows:
        return replace(model, fitted=PipelineModel([fit_early(learner, rows, patience)]))


def balanced_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows and weight per class: n / (classes * n of the class)."""
    per_class = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # one row per class
    total, classes = F.sum("n").over(every), F.count(F.lit(1)).over(every)
    return per_class.withColumn("weight", total / (classes * F.col("n")))


def _weighted(train: DataFrame) -> DataFrame:
    weights = {row[LABEL]: row["weight"] for row in balanced_weights(train).collect()}
    weight = F.coalesce(*[F.when(F.col(LABEL) == k, F.lit(w)) for k, w in weights.items()])
    return train.withColumn("_weight", weight)


def train_boosted(prepared: DataFrame, prep: PipelineModel, trees: int = 1000, depth: int = 6,
                  rate: float = 0.05) -> PipelineModel:
    return PipelineModel([_gbt(prep, trees, depth, rate).fit(prepared)])


def train_gbm_wide(prepared: DataFrame, prep: PipelineModel, trees: int = 1000, depth: int = 9,
                   rate: float = 0.05) -> PipelineModel:
    """Deeper boosting; leaves are grown level by level here, up to 2^depth of them."""
    return PipelineModel([_gbt(prep, trees, depth, rate).fit(prepared)])


def train_forest(prepared: DataFrame, balanced: bool = True, trees: int = 600,
                 depth: int = 12) -> PipelineModel:
    rows = _weighted(prepared) if balanced else prepared
    learner = RandomForestClassifier(
        labelCol=LABEL, featuresCol="features", numTrees=trees, maxDepth=depth, seed=42,
        maxBins=64, cacheNodeIds=True, checkpointInterval=10,
    )
    if balanced:
        learner = learner.setWeightCol("_weight")
    return PipelineModel([_bare(learner.fit(rows))])


def train_extra_trees(prepared: DataFrame, trees: int = 600, depth: int = 12,
                      bins: int = 8) -> PipelineModel:
    """A Spark ML forest with few candidate thresholds, bootstrap rows and another seed; extremely randomised trees are
    those of ``random_trees``."""
    learner = RandomForestClassifier(
        labelCol=LABEL, featuresCol="features", numTrees=trees, maxDepth=depth, seed=1042,
        maxBins=bins, featureSubsetStrategy="sqrt", cacheNodeIds=True, checkpointInterval=10,
    )
    return PipelineModel([_bare(learner.fit(prepared))])


@dataclass(frozen=True)
class Ensemble:
    prep: PipelineModel
    members: dict[str, PipelineModel | Boosted | RandomTrees]

    def score(self, df: DataFrame) -> DataFrame:
        """The given columns and one ``p_<member>`` per member; the inputs are prepared once."""
        out = self.prep.transform(df)
        for name, fitted in self.members.items():
            own = isinstance(fitted, PipelineModel)
            out = add_probability(out, fitted, f"p_{name}") if own else fitted.score(out, f"p_{name}")
        return out.select(*df.columns, *[f"p_{name}" for name in self.members])


def train_ensemble(
    train: DataFrame,
    features: Sequence[str] = tuple(schema.ALL_FEATURES),
    categories: Sequence[str] = tuple(schema.CATEGORIES),
    boosted: dict | None = None, forest: dict | None = None,
    extra: dict | None = None, wide: dict | None = None,
) -> Ensemble:
    """Four members: second-order boosting level by level, a forest, extremely randomised trees, and boosting that grows
    the best leaf first (up to 256). Only the forest needs coded, scaled and filled inputs; the others know missing values.

    The forest, the random trees and both boosted members are fitted side by side, as the passes of one leave cores idle;
    the boosted members share their bins and blocks."""
    params = [Params(**(boosted or {})), Params(**{"leaves": 256, "depth": 9, **(wide or {})})]
    with _training_rows(train, [*features, *categories, LABEL, "date"]) as rows, ThreadPoolExecutor(2) as side:
        prep = prepare.fit_preparation(rows, features, categories, mode="ordinal")  # a pass over rows, which keeps them
        apart = inheritable_thread_target(train.sparkSession)
        both = side.submit(apart(train_boosted_models), rows, params, features, categories, LABEL, holdout=0)
        random = side.submit(apart(train_random_trees), rows, features, categories, LABEL, **(extra or {}))
        with _training_rows(prep.transform(rows), ["features", LABEL]) as prepared:
            grown = train_forest(prepared, **(forest or {}))
        level, leafwise = both.result()
        members = {"boosted": level, "forest": grown, "extra": random.result(), "wide": leafwise}
    return Ensemble(prep, members)


def ensemble_mean(df: DataFrame, cols: Sequence[str], name: str = "score") -> DataFrame:
    return df.withColumn(name, sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols))


def ensemble_weighted(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    parts = [F.col(c) * F.lit(w) for c, w in weights.items()]
    return df.withColumn(name, sum(parts[1:], parts[0]))
