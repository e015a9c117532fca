"""Category codes, scaling and missing values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake import schema
from formlake.operators.cleaning import temporal_split
from formlake.operators.skew import lookup, positions

MISSING = -10.0
MAX_CATEGORIES = 10_000


def _fit_rows(df: DataFrame, fit_on: str, cutoff: date | None) -> DataFrame:
    if fit_on == "all" or cutoff is None:
        return df
    if fit_on != "train":
        raise ValueError(f"fit_on is 'train' or 'all', not {fit_on!r}")
    return temporal_split(df, cutoff)[0]


def fit_categories(df: DataFrame, cols: Sequence[str], limit: int = MAX_CATEGORIES) -> StringIndexerModel:
    """Alphabetical indexers for learners, which need a bin for every category.

    Labels are kept on the driver and in the model, so a column may have ``limit`` of them at most;
    ``encode_categories`` has no such bound.
    """
    sizes = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols]).first()
    too_many = [c for c in cols if sizes[c] > limit]
    if too_many:
        raise ValueError(f"more than {limit} categories in {too_many}")
    return StringIndexer(
        inputCols=list(cols), outputCols=[f"{c}_index" for c in cols],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    ).fit(df)


def _ordinal(indexer: StringIndexerModel) -> str:
    codes = [
        f"CAST(CASE WHEN `{c}_index` >= {len(labels)} THEN -1 ELSE `{c}_index` END AS INT) AS `{c}_code`"
        for c, labels in zip(indexer.getInputCols(), indexer.labelsArray, strict=True)
    ]
    return f"SELECT *, {', '.join(codes)} FROM __THIS__"


def encode_categories(
    df: DataFrame,
    cols: Sequence[str] = tuple(schema.CATEGORIES),
    mode: str = "ordinal",
    fit_on: str = "train",
    cutoff: date | None = None,
) -> DataFrame:
    """Adds ``<col>_code`` (ordinal: alphabetical, NULL and unseen are -1) or ``<col>_index``
    (nominal: carries the category attribute that tree learners read).

    Ordinal codes number the distinct values where they are, however many there are.
    """
    rows = _fit_rows(df, fit_on, cutoff)
    if mode == "nominal":
        return fit_categories(rows, cols).transform(df)
    for c in cols:
        codes = positions(rows.select(c).dropna().distinct(), [], [F.col(c)], f"{c}_code")
        codes = codes.withColumn(f"{c}_code", (F.col(f"{c}_code") - 1).cast("int"))
        df = lookup(df, codes, [c]).withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return df


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per column; a zero deviation divides by 1."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> Scaler:
        row = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
        ).first()  # one row
        return cls({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in self.stats.items()
        })

    def sql(self, suffix: str, missing: float) -> list[str]:
        return [
            f"coalesce((CAST(`{c}` AS DOUBLE) - {mean!r}D) / {std!r}D, {missing!r}D) AS `{c}{suffix}`"
            for c, (mean, std) in self.stats.items()
        ]


def standardize(
    df: DataFrame, cols: Sequence[str], fit_on: str = "train", cutoff: date | None = None
) -> DataFrame:
    return Scaler.fit(_fit_rows(df, fit_on, cutoff), cols).apply(df)


def fill_missing(df: DataFrame, cols: Sequence[str], value: float = MISSING) -> DataFrame:
    return df.fillna(value, subset=list(cols))


def fit_preparation(
    train: DataFrame,
    numeric: Sequence[str],
    categories: Sequence[str] = (),
    mode: str = "ordinal",
    missing: float = MISSING,
    output: str = "features",
) -> PipelineModel:
    """Indexers, scaling and assembly as one saveable pipeline, fitted in two aggregates.

    Scaled numbers go to ``<col>_z``; a missing number becomes ``missing``, outside the range of
    scaled values, so that trees can split it off.
    """
    stages: list = []
    inputs = [f"{c}_z" for c in numeric]
    if categories:
        indexer = fit_categories(train, categories)
        stages.append(indexer)
        if mode == "ordinal":
            stages.append(SQLTransformer(statement=_ordinal(indexer)))
        inputs += [f"{c}_{'code' if mode == 'ordinal' else 'index'}" for c in categories]
    scaled = ", ".join(Scaler.fit(train, numeric).sql("_z", missing))
    stages.append(SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    return PipelineModel(stages)


def feature_names(prep: PipelineModel) -> list[str]:
    names = prep.stages[-1].getInputCols()
    return [n.rsplit("_", 1)[0] if n.endswith(("_z", "_code", "_index")) else n for n in names]


def max_categories(prep: PipelineModel) -> int:
    """Bins a tree learner needs for the nominal inputs."""
    sizes = [
        len(labels) + 1
        for stage in prep.stages if isinstance(stage, StringIndexerModel)
        for labels in stage.labelsArray
    ]
    return max(sizes, default=2)
