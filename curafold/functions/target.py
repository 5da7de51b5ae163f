"""Target transforms, residuals, labels and stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarity limits of the three bands and the row-id salt format.
IDENTICAL_SIMILARITY = 1.0
NEAR_SIMILARITY = 0.70
NO_FILTER = "no_filter"


def to_log_target(value: Column, weight: Column) -> Column:
    """``-log10(value / 1000 / weight)``; NULL when undefined."""
    molar = F.try_divide(value / F.lit(1000.0), weight.cast("double"))
    return F.when(molar > 0, -F.log10(molar))


def from_log_target(y: Column, weight: Column) -> Column:
    return F.lit(1000.0) * weight.cast("double") * F.pow(F.lit(10.0), -y)


def fold_ratio(a: Column, b: Column) -> Column:
    """Symmetric ratio ``max(a/b, b/a)``."""
    return F.greatest(F.try_divide(a, b), F.try_divide(b, a))


def residual_columns(y: Column, pred: Column) -> dict[str, Column]:
    error = F.abs(y - pred)
    return {
        "residual": pred - y,
        "abs_error": error,
        "fold_error": F.pow(F.lit(10.0), error),
    }


def back_transform_columns(y: Column, pred: Column, weight: Column) -> dict[str, Column]:
    true_value = from_log_target(y, weight)
    pred_value = from_log_target(pred, weight)
    return {
        "true_molar": F.pow(F.lit(10.0), -y),
        "pred_molar": F.pow(F.lit(10.0), -pred),
        "true_value": true_value,
        "pred_value": pred_value,
        "fold_error": fold_ratio(true_value, pred_value),
    }


def stable_id(*cols: Column | str, length: int = 20) -> Column:
    """Prefix of the SHA-256 over the canonical JSON of the given columns."""
    return F.substring(F.sha2(F.to_json(F.struct(*cols)), 256), 1, length)


def source_membership(has_a: Column, has_b: Column, a: str = "A", b: str = "B") -> Column:
    return (
        F.when(has_a & has_b, F.lit("mixed"))
        .when(has_a, F.lit(f"{a}_only"))
        .when(has_b, F.lit(f"{b}_only"))
        .otherwise(F.lit("Unknown"))
    )


def similarity_band(similarity: Column) -> Column:
    return (
        F.when(similarity == IDENTICAL_SIMILARITY, F.lit("identical"))
        .when(similarity >= NEAR_SIMILARITY, F.lit("near"))
        .otherwise(F.lit("out"))
    )


def arm_label(threshold: float | None) -> str:
    return NO_FILTER if threshold is None else f"filter_{threshold:g}fold"


def arm_threshold(arm: Column) -> Column:
    """Numeric threshold of an arm label; NULL for the unfiltered arm."""
    return F.regexp_extract(arm, r"^filter_(.+)fold$", 1).try_cast("double")


def direction_label(rho: Column) -> Column:
    return (
        F.when(F.isnan(rho), F.lit("no clear direction"))
        .when(rho > 0, F.lit("increases with feature"))
        .when(rho < 0, F.lit("decreases with feature"))
        .otherwise(F.lit("no clear direction"))
    )


def feature_type(name: Column, prefix: str, matching: str, other: str) -> Column:
    return F.when(F.startswith(name, F.lit(prefix)), F.lit(matching)).otherwise(F.lit(other))
