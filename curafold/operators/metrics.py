"""Regression metrics over prediction tables and summaries of those metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curafold.functions.measurement import finite
from curafold.operators.ranking import exact_median, join_on

# The reported fold limits and the largest plausible log error.
FOLD_LIMITS = (2, 5, 10)
MAX_LOG_ERROR = 300.0

SUMMARY_METRICS = ("r2", "rmse", "mae", "within_2_fold_percent")


def _checked(value: Column, what: str) -> Column:
    """Pass finite numbers through; anything else fails the job instead of being dropped."""
    number = value.cast("double")
    return F.when(finite(number), number).otherwise(
        F.raise_error(F.lit(f"non-finite {what} in metric input")).cast("double")
    )


def _guarded(abs_error: Column) -> Column:
    return F.when(abs_error <= MAX_LOG_ERROR, abs_error).otherwise(
        F.raise_error(F.lit("log error above 300: check the target units")).cast("double")
    )


def _within(space: str, limit: int) -> Column:
    if space == "log":
        return F.col("__ae") <= F.log10(F.lit(float(limit)))
    return F.col("__fe") <= float(limit)


def regression_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    y: str = "y",
    pred: str = "pred",
    within_space: str = "log",
) -> DataFrame:
    """n, R2, RMSE, MAE, SSE, SST, population SD and fold-error summaries per ``by`` group.

    R2 is ``1 - SSE/SST`` with the group's own mean, NULL for one row or a constant
    target. Everything but the median is one partially aggregated pass; the median
    is exact without holding a group in one task.
    """
    if within_space not in ("log", "ratio"):
        raise ValueError("within_space must be 'log' or 'ratio'")
    keys = list(by) or ["__all"]
    source = df if by else df.withColumn("__all", F.lit(1))
    y_ok, p_ok = _checked(F.col(y), "target"), _checked(F.col(pred), "prediction")
    scored = source.select(
        *keys, y_ok.alias("__y"), _guarded(F.abs(p_ok - y_ok)).alias("__ae")
    ).withColumn("__fe", F.pow(F.lit(10.0), F.col("__ae")))
    base = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("__ae") * F.col("__ae")).alias("sse"),
        (F.var_pop("__y") * F.count(F.lit(1))).alias("sst"),
        F.avg("__ae").alias("mae"),
        F.avg("__fe").alias("mean_fold_error"),
        F.stddev_pop("__y").alias("y_sd"),
        *[
            (F.avg(_within(within_space, k).cast("double")) * 100).alias(f"within_{k}_fold_percent")
            for k in FOLD_LIMITS
        ],
    )
    medians = exact_median(scored, keys, "__fe", "median_fold_error")
    return join_on(base, medians, keys).select(
        *by,
        "n",
        F.when(
            (F.col("n") >= 2) & (F.col("sst") > 0),
            1 - F.try_divide(F.col("sse"), F.when(F.col("sst") > 0, F.col("sst"))),
        ).alias("r2"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        "mae",
        "sse",
        "sst",
        "y_sd",
        "median_fold_error",
        "mean_fold_error",
        *[f"within_{k}_fold_percent" for k in FOLD_LIMITS],
    )


def metrics_pooled_and_by_fold(
    df: DataFrame, arm: str = "arm", fold: str = "fold", y: str = "y", pred: str = "pred"
) -> DataFrame:
    """One metrics table with a row per (arm, fold) and a pooled row (``fold`` NULL) per arm.

    Pooled values come from the pooled errors, not from averaging fold values. Each
    row is expanded into its two grouping sets once, as GROUPING SETS would do.
    """
    expanded = df.select(
        arm,
        y,
        pred,
        F.explode(F.array(F.col(fold).cast("int"), F.lit(None).cast("int"))).alias(fold),
    )
    return regression_metrics(expanded, [arm, fold], y, pred).withColumn(
        "scope", F.when(F.col(fold).isNull(), F.lit("pooled")).otherwise(F.lit("fold"))
    )


def fold_mean_sd(
    metrics: DataFrame, by: Sequence[str] = ("arm",), values: Sequence[str] = SUMMARY_METRICS
) -> DataFrame:
    """Mean and sample SD over fold rows; the SD of a single fold is NULL."""
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for v in values:
        aggs += [F.avg(v).alias(f"fold_mean_{v}"), F.stddev_samp(v).alias(f"fold_sd_{v}")]
    return metrics.groupBy(*by).agg(*aggs)


def pool_from_fold_summaries(folds: DataFrame, cohort: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pooled metrics rebuilt from fold rows ``(n, sse, mae, within_2…)`` and cohort targets.

    ``cohort`` holds one row per evaluated row with the same ``by`` columns and ``y``.
    """
    total = folds.groupBy(*by).agg(
        F.sum("sse").alias("sse"),
        F.sum("n").alias("n"),
        (F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("mae"),
        (F.sum(F.col("within_2_fold_percent") * F.col("n")) / F.sum("n")).alias(
            "within_2_fold_percent"
        ),
    )
    spread = cohort.groupBy(*by).agg((F.var_pop("y") * F.count("y")).alias("sst"))
    return total.join(spread, list(by)).select(
        *by,
        "n",
        F.when(F.col("sst") > 0, 1 - F.try_divide("sse", "sst")).alias("r2"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        "mae",
        "within_2_fold_percent",
    )


def arm_comparison(metrics: DataFrame, removed_percent: DataFrame | None = None) -> DataFrame:
    """Pooled value, fold mean and fold SD side by side per arm.

    ``metrics`` comes from :func:`metrics_pooled_and_by_fold`; ``removed_percent`` has
    ``(arm, fold, removed_percent)`` and adds its mean.
    """
    pooled = metrics.where(F.col("scope") == "pooled").select(
        "arm", "n", *[F.col(v).alias(f"pooled_{v}") for v in SUMMARY_METRICS]
    )
    spread = fold_mean_sd(metrics.where(F.col("scope") == "fold"))
    out = pooled.join(spread, "arm")
    if removed_percent is not None:
        mean = removed_percent.groupBy("arm").agg(
            F.avg("removed_percent").alias("mean_removed_percent")
        )
        out = out.join(mean, "arm", "left")
    return out


def ensemble_mean(preds: DataFrame, key: Sequence[str], pred: str = "pred") -> DataFrame:
    return preds.groupBy(*key).agg(F.avg(pred).alias(pred), F.count(pred).alias("n_models"))


def seed_metrics(preds: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return regression_metrics(preds, ["seed"], y, pred)


def rank_seeds(metrics: DataFrame) -> DataFrame:
    """Seeds by R2, best first."""
    return metrics.orderBy(F.desc_nulls_last("r2"), "seed")


def common_rounds(rounds: DataFrame, max_rounds: int, by: Sequence[str] = ("outer_fold",)) -> DataFrame:
    """Half-even rounded median of the inner round counts, clamped to ``[1, max_rounds]``."""
    middle = exact_median(rounds, by, "rounds", "__m")
    return middle.select(
        *by,
        F.greatest(F.lit(1), F.least(F.lit(max_rounds), F.rint("__m").cast("int"))).alias("rounds"),
    )


def removal_counts(
    scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Rows at or above each threshold, all thresholds counted in one pass."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("fold_error") >= t).alias(f"removed_{t:g}") for t in thresholds],
    )


def cohort_design(
    scored: DataFrame, thresholds: Sequence[float | None], by: Sequence[str] = ()
) -> DataFrame:
    """Initial / removed / retained rows and removed percent per arm."""
    from curafold.functions.target import arm_label

    counts = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_initial"),
        *[
            F.count_if(F.lit(False) if t is None else F.col("fold_error") >= t).alias(f"__r{i}")
            for i, t in enumerate(thresholds)
        ],
    )
    arms = F.array(
        *[
            F.struct(F.lit(arm_label(t)).alias("arm"), F.col(f"__r{i}").alias("n_removed"))
            for i, t in enumerate(thresholds)
        ]
    )
    return counts.select(*by, "n_initial", F.inline(arms)).select(
        *by,
        "arm",
        "n_initial",
        "n_removed",
        (F.col("n_initial") - F.col("n_removed")).alias("n_retained"),
        (F.col("n_removed") * 100.0 / F.col("n_initial")).alias("removed_percent"),
    )


def max_abs_diff(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    return df.agg(
        *[F.max(F.abs(F.col(a) - F.col(b))).alias(name) for name, (a, b) in pairs.items()]
    )


def subgroup_metrics(
    df: DataFrame, groups: Mapping[str, Column], y: str = "y", pred: str = "pred"
) -> DataFrame:
    """Metrics of overlapping subsets: a row is expanded only into the subsets it is in."""
    names = F.array(*[F.when(cond, F.lit(name)) for name, cond in groups.items()])
    expanded = df.select(
        y, pred, F.explode(F.filter(names, lambda g: g.isNotNull())).alias("subset")
    )
    return regression_metrics(expanded, ["subset"], y, pred)


def group_census(assignments: DataFrame, group: str = "group_id", fold: str = "fold") -> DataFrame:
    """Rows, distinct groups and single-row groups per fold, plus a total row (fold NULL).

    Groups are pre-aggregated once; a hot group is one row afterwards.
    """
    sizes = assignments.groupBy(fold, group).agg(F.count(F.lit(1)).alias("__n"))
    per_fold = sizes.groupBy(fold).agg(
        F.sum("__n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("__n") == 1).alias("n_singletons"),
    )
    total = (
        sizes.groupBy(group)
        .agg(F.sum("__n").alias("__n"))
        .agg(
            F.sum("__n").alias("n_rows"),
            F.count(F.lit(1)).alias("n_groups"),
            F.count_if(F.col("__n") == 1).alias("n_singletons"),
        )
        .withColumn(fold, F.lit(None).cast(dict(assignments.dtypes)[fold]))
    )
    return per_fold.unionByName(total)
