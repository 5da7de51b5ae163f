"""Boosting in steps: one ``pyspark.ml`` tree at a time on a written residual.

A step fits a regression tree to what the trees before it leave over, so a run can be stopped at any round and cut back to
its leading trees; nothing is ever trained twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curafold.session import materialize

if TYPE_CHECKING:
    from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel

DEFAULTS = dict(maxDepth=4, stepSize=0.1, subsamplingRate=0.75, minInstancesPerNode=2, maxBins=64)
#: Trees whose predictions are computed on the fly before the residual is written again.
WRITE_EVERY = 4
SAMPLE_PARTS = 1 << 20


class Stall:
    """Follows an error curve; ``best`` is the number of rounds to keep."""

    def __init__(self, patience: int):
        self.patience, self.least, self.best, self.seen = patience, float("inf"), 0, 0

    def add(self, error: float) -> bool:
        """Whether ``patience`` rounds have passed without an improvement beyond rounding."""
        self.seen += 1
        if self.seen == 1 or error < self.least - 1e-9 * abs(self.least):
            self.least, self.best = error, self.seen
        return self.seen - self.best >= self.patience


def _advance(rows: DataFrame, tree: "DecisionTreeRegressionModel", weight: float, label: str) -> DataFrame:
    """The rows with the tree added to their prediction ``__f`` and taken off their residual ``__r``."""
    scored = tree.transform(rows).withColumn("__f", F.col("__f") + F.lit(weight) * F.col("__tree"))
    return scored.withColumn("__r", F.col(label) - F.col("__f")).drop("__tree")


def boost(
    train: DataFrame, label: str, max_rounds: int, seed: int, valid: DataFrame | None = None, patience: int = 0, **params
) -> tuple[list["DecisionTreeRegressionModel"], list[float], int]:
    """``(trees, weights, best)``: trees on ``train`` until the squared error on ``valid`` stalls or ``max_rounds`` are reached.

    The first tree counts in full, later ones by ``stepSize``. Each tree sees a hash-drawn share of the rows.
    Rows without features or a label take no part.
    """
    from pyspark.ml.regression import DecisionTreeRegressor

    options = {**DEFAULTS, **params}
    step, rate = options.pop("stepSize"), options.pop("subsamplingRate")
    # Residuals start as the label itself, since no tree has predicted anything yet.
    start = {"__f": F.lit(0.0), "__r": F.col(label).cast("double"), "__k": F.monotonically_increasing_id()}
    complete = F.col("features").isNotNull() & F.col(label).isNotNull()
    rows = materialize(train.where(complete).select("features", label).withColumns(start), "boost-train")
    check = materialize(valid.where(complete).select("features", label).withColumns(start), "boost-valid") if valid is not None else None
    stall = Stall(patience)
    trees: list[DecisionTreeRegressionModel] = []
    weights: list[float] = []
    for m in range(max_rounds):
        drawn = rows
        if rate < 1:
            drawn = rows.where(F.pmod(F.xxhash64("__k", F.lit(seed + m)), F.lit(SAMPLE_PARTS)) < int(rate * SAMPLE_PARTS))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="__r", predictionCol="__tree", seed=seed + m, **options).fit(drawn)
        trees.append(tree)
        weights.append(1.0 if m == 0 else step)
        rows = _advance(rows, tree, weights[-1], label)
        if check is not None:
            check = _advance(check, tree, weights[-1], label)
            error = check.agg(F.avg(F.col("__r") * F.col("__r"))).first()[0]
            if stall.add(float("inf") if error is None else error):
                break
        if len(trees) % WRITE_EVERY == 0 and m + 1 < max_rounds:
            rows = materialize(rows, "boost-train")
            check = materialize(check, "boost-valid") if check is not None else None
    return trees, weights, stall.best if valid is not None else len(trees)


def leading(trees: Sequence["DecisionTreeRegressionModel"], weights: Sequence[float], rounds: int) -> "GBTRegressionModel":
    """The ensemble of the first ``rounds`` trees, as a ``pyspark.ml`` model that predicts into ``pred``."""
    from pyspark.ml.regression import GBTRegressionModel
    from pyspark.sql import SparkSession

    context = SparkSession.active().sparkContext
    package = context._jvm.org.apache.spark.ml.regression
    members = context._gateway.new_array(package.DecisionTreeRegressionModel, rounds)
    shares = context._gateway.new_array(context._jvm.double, rounds)
    for i in range(rounds):
        members[i], shares[i] = trees[i]._java_obj, float(weights[i])
    model = GBTRegressionModel(package.GBTRegressionModel(f"boosted_{uuid.uuid4().hex[:12]}", members, shares))
    return model.setFeaturesCol("features").setPredictionCol("pred")
