"""Trees as a Spark ML model, which walks them in compiled code however many they are.

A model is written in Spark ML's own format and loaded once. Every number of a row is there four times: with missing values
below all others, with them above, as 1 where there is a number, and as 1 where there is none. So a node sends missing values
to either side by the copy that it looks at.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.session import scratch_path

COPIES = 4
#: Nodes that are handed to Spark at once.
NODES = 200_000

_LISTS = pa.list_(pa.float64())
_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", _LISTS), ("numCategories", pa.int32())])
_NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", _LISTS),
    ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", _SPLIT)])


@dataclass
class Flat:
    """One tree: for each node its left child (-1 at leaves; the right one follows it), the input it looks at, the values that
    go left, the number of categories (-1 for numbers) and its value."""

    left: Sequence[int]
    place: Sequence[int]
    goes_left: Sequence[Sequence[float]]
    categories: Sequence[int]
    value: Sequence[float]


def number_split(number: int, cut: float, missing_left: bool) -> tuple[int, list[float]]:
    """(input, threshold) of a node that sends numbers up to ``cut`` to the left: NaN none of them, infinity all of them."""
    at = number * COPIES
    if math.isnan(cut):
        return at + 2, [0.5 if missing_left else -1.0]
    if cut == math.inf:
        return (at + 2, [2.0]) if missing_left else (at + 3, [0.5])
    return (at if missing_left else at + 1), [cut]


def inputs(numbers: Sequence[Column], categories: Sequence[Column] = ()) -> Column:
    """The vector that the trees look at. Numbers may be NULL or NaN, categories are whole numbers. As elements of an array
    that a lambda goes over, numbers are computed once, not for every copy."""
    def copies(x: Column) -> Column:
        gone = x.isNull() | F.isnan(x)
        return F.array(F.when(gone, F.lit(-math.inf)).otherwise(x), F.when(gone, F.lit(math.inf)).otherwise(x),
                       F.when(gone, 0.0).otherwise(1.0), F.when(gone, 1.0).otherwise(0.0))

    cells = [F.flatten(F.transform(F.array(*some), copies)) for some in [[x.cast("double") for x in numbers]] if some]
    return array_to_vector(F.concat(*cells, *[F.array(*some) for some in [[c.cast("double") for c in categories]] if some]))


class Scorer:
    """The sum of all trees' values as a column. The model is written and loaded when a session first needs it."""

    def __init__(self, trees: Sequence[Flat], n_inputs: int):
        self.trees, self.n_inputs, self.loaded = trees, n_inputs, (None, None)

    def add(self, df: DataFrame, vector: Column, name: str) -> DataFrame:
        if not self.trees:
            return df.withColumn(name, F.lit(0.0))
        spark = df.sparkSession
        application, model = self.loaded
        if application != spark.sparkContext.applicationId:
            model = GBTRegressionModel.load(self._write(spark))
            self.loaded = spark.sparkContext.applicationId, model
        model.setFeaturesCol("_inputs").setPredictionCol("_sum")
        out = model.transform(df.withColumn("_inputs", vector))
        return out.withColumn(name, F.col("_sum")).select(*[c for c in df.columns if c != name], name)

    def _write(self, spark: SparkSession) -> str:
        path, numbered = scratch_path(spark, "trees"), list(enumerate(self.trees))
        names = [_metadata(spark, "DecisionTreeRegressionModel", f"tree_{i}") for i, _ in numbered]
        head = _metadata(spark, "GBTRegressionModel", "trees", numFeatures=self.n_inputs, numTrees=len(names))
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame(
            [(i, text, 1.0) for i, text in enumerate(names)], "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
        held, nodes = [], 0
        for at, (number, tree) in enumerate(numbered):
            held.append(_table(number, tree))
            nodes += len(tree.left)
            if nodes >= NODES or at == len(numbered) - 1:
                spark.createDataFrame(pa.concat_tables(held)).write.mode("append").parquet(f"{path}/data")
                held, nodes = [], 0
        return path


def _metadata(spark: SparkSession, name: str, uid: str, **more) -> str:
    return json.dumps({
        "class": f"org.apache.spark.ml.regression.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
        "uid": uid, "paramMap": {}, "defaultParamMap": {"impurity": "variance"}, **more})


def _table(number: int, t: Flat) -> pa.Table:
    n = len(t.left)
    left = np.array(t.left, np.int32)
    inner = left >= 0
    split = pa.StructArray.from_arrays([
        pa.array(np.where(inner, np.array(t.place, np.int32), -1).astype(np.int32)),
        pa.array([x if i else [] for x, i in zip(t.goes_left, inner, strict=True)], _LISTS),
        pa.array(np.where(inner, np.array(t.categories, np.int32), -1).astype(np.int32))], fields=list(_SPLIT))
    zeros = np.zeros(n)
    stats = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 3), pa.array(np.zeros(n * 3)))
    node = pa.StructArray.from_arrays([
        pa.array(np.arange(n, dtype=np.int32)), pa.array(np.array(t.value, np.float64)), pa.array(zeros), stats,
        pa.array(np.zeros(n, np.int64)), pa.array(np.where(inner, 0.0, -1.0)), pa.array(left),
        pa.array(np.where(inner, left + 1, -1).astype(np.int32)), split], fields=list(_NODE))
    return pa.table({"treeID": pa.array(np.full(n, number, np.int32)), "nodeData": node})
