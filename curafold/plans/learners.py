"""Least squares from sufficient statistics, and gradient-boosted trees from ``pyspark.ml``.

A linear fit needs only sums of products, which Spark aggregates map-side in one pass
for any number of folds, arms or seeds at once. Leaving a fold out is a subtraction
of its sums, so k-fold prediction costs one aggregation instead of k fits.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curafold.plans.boosting import boost, leading
from curafold.session import join_parameters, materialize

if TYPE_CHECKING:
    from pyspark.ml.regression import GBTRegressionModel

def linear_stats(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """Sums of the normal equations per ``by`` group in long form: ``(by…, pos, s)``.

    Rows become ``z = (1, x - mean, y - mean)`` with the means of the whole table, which keeps the sums
    free of large offsets. A task adds up ``z'z`` in blocks and sends one row per group and position: the
    upper triangle, then ``n * mean`` of each column. Everything is a sum over rows, so leaving
    a part out is a subtraction. Rows with a missing value or label take no part; a group without any other row has
    sums of zero. NULL is a group like any other.
    """
    columns = [*features, label]
    by = list(by)
    wide = df.select(*by, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    names = [f"__x{i}" for i in range(len(columns))]
    shift = [0.0 if m is None else m for m in wide.agg(*[F.avg(c) for c in names]).first()]

    def partial(batches):
        import numpy as np
        import pandas as pd

        upper = np.triu_indices(len(names) + 1)
        mean = np.array(shift)
        sums: dict = {}
        for pdf in batches:
            z = pdf[names].to_numpy(float) - mean
            complete = ~np.isnan(z).any(axis=1)
            z = np.column_stack([np.ones(len(z)), z])
            if by:
                code = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
                firsts = np.unique(code, return_index=True)[1]
                keys = [tuple(pdf[c].iloc[i] for c in by) for i in firsts]
                keys = [tuple(None if pd.isna(x) else x for x in key) for key in keys]
            else:
                code, keys = np.zeros(len(z), int), [()]
            order = np.argsort(code, kind="stable")
            order = order[complete[order]]
            cuts = np.searchsorted(code[order], np.arange(len(keys) + 1))
            for k, key in enumerate(keys):
                part = z[order[cuts[k] : cuts[k + 1]]]
                sums[key] = sums.get(key, 0.0) + part.T @ part
            if len(sums) * len(upper[0]) > 4_000_000:
                yield from rows(sums, upper, mean)
                sums = {}
        yield from rows(sums, upper, mean)

    def rows(sums, upper, mean):
        import numpy as np
        import pandas as pd

        for key, total in sums.items():
            s = np.concatenate([total[upper], total[0, 0] * mean])
            out = pd.DataFrame({"pos": np.arange(len(s)), "s": s})
            for i, name in enumerate(by):
                out.insert(i, name, [key[i]] * len(s))
            yield out

    types = dict(wide.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "pos int", "s double"])
    return wide.mapInPandas(partial, schema).groupBy(*by, "pos").agg(F.sum("s").alias("s"))


def leave_out(stats: DataFrame, by: Sequence[str], part: str) -> DataFrame:
    """Statistics of everything but the part, per ``by`` group."""
    w = Window.partitionBy(*by, "pos")
    return stats.select(*by, part, "pos", (F.sum("s").over(w) - F.col("s")).alias("s"))


def solve_linear(stats: DataFrame, by: Sequence[str], n_features: int) -> DataFrame:
    """``(by…, coef)`` with the intercept first; one solve per group, whose size is that of the model."""
    p = n_features + 1
    by = list(by)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "s")))
    packed = stats.groupBy(*by).agg(F.transform(ordered, lambda x: x["s"]).alias("s"))

    def solve(batches):
        import numpy as np

        upper = np.triu_indices(p + 1)
        for pdf in batches:
            coefs = []
            for row in pdf["s"]:
                row = np.asarray(row, float)
                full = np.zeros((p + 1, p + 1))
                full[upper] = row[: len(upper[0])]
                if not full[0, 0] > 0.5:  # no complete row is left
                    coefs.append(None)
                    continue
                full = full + np.triu(full, 1).T
                xtx, xty = full[:p, :p], full[:p, p]
                scale = np.sqrt(np.where(np.diag(xtx) > 0, np.diag(xtx), 1.0))
                beta = np.linalg.lstsq(xtx / np.outer(scale, scale), xty / scale, rcond=1e-13)[0] / scale
                mean = row[len(upper[0]) :] / full[0, 0]
                beta[0] += mean[-1] - beta[1:] @ mean[:-1]
                coefs.append(beta.tolist())
            out = pdf[by].copy()
            out["coef"] = coefs
            yield out

    types = dict(stats.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "coef array<double>"])
    return packed.mapInPandas(solve, schema)


def linear_prediction(coef: Column, features: Sequence[str]) -> Column:
    values = F.array(*[F.col(f).cast("double") for f in features])
    terms = F.zip_with(F.slice(coef, 2, len(features)), values, lambda c, x: c * x)
    return F.aggregate(terms, coef[0], lambda total, t: total + t)


def fit_linear(
    df: DataFrame, by: Sequence[str], features: Sequence[str], label: str
) -> DataFrame:
    return solve_linear(linear_stats(df, by, features, label), by, len(features))


def predict_linear(
    df: DataFrame, coefs: DataFrame, by: Sequence[str], features: Sequence[str], out: str = "pred"
) -> DataFrame:
    """Score rows with their group's coefficients (one coefficient row per group).

    No row is lost: one whose group has no coefficients, or that misses a feature, is predicted NULL.
    """
    if by:
        joined = join_parameters(df, coefs, list(by), "coefficients", "left")
    else:
        joined = df.withColumn("coef", coefs.select("coef").scalar())
    return joined.withColumn(out, linear_prediction(F.col("coef"), features)).drop("coef")


def oof_predict(
    df: DataFrame,
    fold: str,
    features: Sequence[str],
    label: str,
    by: Sequence[str] = (),
    out: str = "pred",
) -> DataFrame:
    """Predict every row from the rows of the other folds (of its ``by`` group); NULL where they hold no complete row."""
    keys = [*by, fold]
    stats = linear_stats(df, keys, features, label)
    coefs = solve_linear(leave_out(stats, by, fold), keys, len(features))
    return predict_linear(df, coefs, keys, features, out)


# --- gradient-boosted trees ---------------------------------------------------


def fit_early_stop(
    train: DataFrame, valid: DataFrame, label: str, max_rounds: int, patience: int, seed: int, **params
) -> tuple["GBTRegressionModel", int]:
    """Boost on ``train``; keep the rounds chosen by the error curve on ``valid``.

    A tree is fitted at a time until the curve has stalled for ``patience`` rounds or ``max_rounds`` are reached;
    the model has the leading trees up to the best round.
    """
    trees, weights, best = boost(train, label, max_rounds, seed, valid, patience, **params)
    return leading(trees, weights, best), best


def fit_fixed(train: DataFrame, label: str, rounds: int, seed: int, **params) -> "GBTRegressionModel":
    trees, weights, _ = boost(train, label, rounds, seed, **params)
    return leading(trees, weights, rounds)


def select_rounds(
    inner_train: DataFrame, id_col: str, label: str, fraction: float, max_rounds: int,
    patience: int, seed: int, group: str | None = None, **params,
) -> int:
    """Round count from a pilot split inside the training rows only; with ``group`` it keeps groups whole."""
    from curafold.operators.splits import group_holdout, holdout

    if group is None:
        parts = holdout(inner_train, id_col, fraction, seed, out="__pilot")
    else:
        parts = group_holdout(inner_train, group, fraction, seed, out="__pilot")
    parts = materialize(parts, "pilot")
    pilot = parts.where(F.col("__pilot") == "train").drop("__pilot")
    check = parts.where(F.col("__pilot") == "valid").drop("__pilot")
    return fit_early_stop(pilot, check, label, max_rounds, patience, seed, **params)[1]


def oof_predict_trees(
    df: DataFrame, fold: str, k: int, label: str, rounds: int, seed: int, **params
) -> DataFrame:
    """Out-of-fold tree predictions: ``k`` distributed fits, one per fold, on rows written once."""
    rows = materialize(df, "tree-folds")
    out = None
    for f in range(1, k + 1):
        model = fit_fixed(rows.where(F.col(fold) != f), label, rounds, seed + f, **params)
        part = model.transform(rows.where(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out


def ablation_contributions(
    model: "GBTRegressionModel", rows: DataFrame, id_cols: Sequence[str], names: Sequence[str], medians: Sequence[float],
    vector: str = "features",
) -> DataFrame:
    """``(id…, feature, value, contribution)``: what a feature's value changes against its training median.

    Base and ablated rows are scored in one pass, a row per feature that a tree splits on; the others change nothing.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    used = set(model.featureImportances.indices.tolist())
    values = rows.select(*id_cols, vector_to_array(F.col(vector)).alias("__x"))
    variants = [F.struct(F.lit(-1).alias("k"), F.lit(None).cast("double").alias("median"))]
    variants += [F.struct(F.lit(k).alias("k"), F.lit(float(m)).alias("median")) for k, m in enumerate(medians) if k in used]
    wide = values.withColumn("__v", F.explode(F.array(*variants)))
    changed = F.transform("__x", lambda x, i: F.when(i == F.col("__v.k"), F.col("__v.median")).otherwise(x))
    scored = model.transform(wide.withColumn(vector, array_to_vector(changed)))
    keys = F.struct(*id_cols)
    base = F.max(F.when(F.col("__v.k") < 0, F.col("pred")))
    ablated = F.map_from_entries(F.collect_list(F.when(F.col("__v.k") >= 0, F.struct(F.col("__v.k"), "pred"))))
    # The map of a row is at most as long as the model is wide.
    by_row = scored.groupBy(keys.alias("__id")).agg(base.alias("__base"), ablated.alias("__ablated"), F.any_value("__x").alias("__x"))
    named = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(k).alias("k")) for k, n in enumerate(names)])
    long = by_row.select("__id.*", "__base", "__ablated", "__x", F.inline(named))
    change = F.col("__base") - F.coalesce(F.element_at("__ablated", F.col("k")), F.col("__base"))
    return long.select(*id_cols, "feature", F.get("__x", F.col("k")).alias("value"), change.alias("contribution"))
