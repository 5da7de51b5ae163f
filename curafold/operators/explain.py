"""Summaries of per-row feature contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curafold.functions.target import direction_label
from curafold.session import materialize
from curafold.operators.ranking import average_rank, exact_median, join_on


def linear_contributions(
    df: DataFrame,
    id_cols: Sequence[str],
    coefs: DataFrame,
    features: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Exact additive attribution ``coef * (x - mean)`` in long form, and the bias row.

    ``coefs`` is one row with ``coef`` (intercept first); means are those of ``df``.
    """
    means = df.agg(F.array(*[F.avg(f) for f in features]).alias("m"))
    base = df.withColumns(
        {"__c": coefs.select("coef").scalar(), "__m": means.scalar()}
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f).cast("double").alias("value"),
                (F.col("__c")[i + 1] * (F.col(f) - F.col("__m")[i])).alias("contribution"),
            )
            for i, f in enumerate(features)
        ]
    )
    long = base.select(*id_cols, F.inline(rows))
    bias = coefs.select(F.col("coef").alias("__c")).withColumn("__m", means.scalar())
    total = F.col("__c")[0]
    for i in range(len(features)):
        total = total + F.col("__c")[i + 1] * F.col("__m")[i]
    return long, bias.select(total.alias("bias"))


def reconstruction_error(
    long: DataFrame, bias: DataFrame, predictions: DataFrame, id_col: str
) -> DataFrame:
    """Largest difference between bias + contributions and the prediction."""
    sums = long.groupBy(id_col).agg(F.sum("contribution").alias("__s"))
    return predictions.join(sums, id_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs(F.col("__s") + bias.scalar() - F.col("pred"))).alias("max_abs_diff"),
    )


def contribution_importance(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean")
    )


def group_importance(importance: DataFrame, kind: Column) -> DataFrame:
    """Importance summed per feature type with its share of the total."""
    sums = importance.groupBy(kind.alias("feature_group")).agg(F.sum("mean_abs").alias("mean_abs"))
    total = F.sum("mean_abs").over(Window.partitionBy(F.lit(1)))
    return sums.withColumn(
        "relative_percent", F.try_divide(F.col("mean_abs") * 100, F.when(total != 0, total))
    )


def feature_spearman(long: DataFrame) -> DataFrame:
    """Rank correlation of value and contribution per feature; NULL when either is constant.

    Rows collapse to distinct (value, contribution) pairs before the rank lookups, so
    a value shared by very many rows is one weighted row. The pairs are written once: contributions that are worked
    out again may differ in the last bit, as sums in another order do, and would then miss their rank.
    """
    complete = long.where(F.col("value").isNotNull() & F.col("contribution").isNotNull())
    pairs = complete.groupBy("feature", "value", "contribution").agg(F.count(F.lit(1)).alias("w"))
    pairs = materialize(pairs, "rank-pairs")
    ranked = join_on(
        join_on(pairs, average_rank(pairs, ["feature"], "value", "rx", "w").drop("n_ties"), ["feature", "value"]),
        average_rank(pairs, ["feature"], "contribution", "ry", "w").drop("n_ties"),
        ["feature", "contribution"],
    )
    n, w = F.sum("w"), F.col("w")
    mean_rank = (n + 1) / 2
    # Average ranks always have mean (n + 1) / 2, so one pass gives the central sums.
    sxx = F.sum(w * F.col("rx") * F.col("rx")) - n * mean_rank * mean_rank
    syy = F.sum(w * F.col("ry") * F.col("ry")) - n * mean_rank * mean_rank
    sxy = F.sum(w * F.col("rx") * F.col("ry")) - n * mean_rank * mean_rank
    varies = (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    out = ranked.groupBy("feature").agg(
        F.when(varies, F.try_divide(sxy, F.sqrt(sxx * syy))).alias("spearman")
    )
    names = long.select("feature").distinct()
    return names.join(out, "feature", "left")


def importance_table(long: DataFrame, kind: Column) -> DataFrame:
    """Importance, type, rank correlation and direction per feature."""
    rho = feature_spearman(long)
    return (
        contribution_importance(long)
        .join(rho, "feature")
        .withColumns({"feature_type": kind, "direction": direction_label(F.col("spearman"))})
    )


def top_features(importance: DataFrame, n: int, kind: str | None = None) -> DataFrame:
    """The ``n`` most important features, overall or within one type (ties by name)."""
    rows = importance if kind is None else importance.where(F.col("feature_type") == kind)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("mean_abs"), "feature")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def local_top(long: DataFrame, cases: DataFrame, id_col: str, n: int) -> DataFrame:
    """Strongest contributions of each selected row."""
    chosen = long.join(cases.select(id_col, "case_label"), id_col)
    order = Window.partitionBy("case_label", id_col).orderBy(F.desc(F.abs("contribution")), "feature")
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def representative_cases(scored: DataFrame, id_col: str) -> DataFrame:
    """Rows with the largest and smallest prediction, the largest error and the error
    closest to the median; the smallest id wins ties. Plain partial aggregates.

    The two middle errors of an even count are equally far from the median; distances
    are compared at 12 digits so that rounding noise does not break that tie."""
    middle = exact_median(
        scored.withColumn("__one", F.lit(1)), ["__one"], "fold_error", "__m"
    ).select("__m")
    rows = scored.withColumn("__gap", F.round(F.abs(F.col("fold_error") - middle.scalar()), 12))
    row = F.struct(id_col, "y", "pred", "fold_error")

    def first_by(order: Column) -> Column:
        return F.min_by(row, F.struct(order, F.col(id_col)))

    picks = rows.agg(
        first_by(-F.col("pred")).alias("highest_prediction"),
        first_by(F.col("pred")).alias("lowest_prediction"),
        first_by(-F.col("fold_error")).alias("largest_fold_error"),
        first_by(F.col("__gap")).alias("median_fold_error"),
    )
    labelled = F.array(
        *[
            F.struct(F.lit(c).alias("case_label"), F.col(c).alias("row"))
            for c in picks.columns
        ]
    )
    return picks.select(F.inline(labelled)).select("case_label", "row.*")


def dependence_table(long: DataFrame, importance: DataFrame, n: int, id_cols: Sequence[str]) -> DataFrame:
    """(value, contribution) points of the ``n`` most important features."""
    top = top_features(importance, n).select("feature", "rank")
    return long.join(top, "feature").select(*id_cols, "feature", "rank", "value", "contribution")


def explain_summary(
    importance: DataFrame, groups: DataFrame, reconstruction: DataFrame, n: int = 10
) -> DataFrame:
    """One row: top features, group shares and the reconstruction error."""
    top = top_features(importance, n).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]), ","
        ).alias("top_features")
    )
    shares = groups.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_group", "relative_percent")))).alias(
            "group_percent"
        )
    )
    return reconstruction.withColumns(
        {"top_features": top.scalar(), "group_percent": shares.scalar()}
    )
