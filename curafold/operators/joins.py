"""Key-based joins with explicit cardinality and comparison semantics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curafold.functions.target import arm_label, fold_ratio


def anti_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def duplicate_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unique_by(df: DataFrame, on: Sequence[str], label: str) -> DataFrame:
    """``df`` with a run-time check: a repeated key fails the job.

    Keys are counted beside the rows, as a subquery that reads the key columns only, so no payload is
    aggregated and the rows take part in a join as they are.
    """
    repeated = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    example = repeated.agg(F.min(F.to_json(F.struct(*on))).alias("key")).scalar()
    message = F.concat(F.lit(f"{label}: key is not unique: "), example)
    return df.where(F.when(example.isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def one_to_one_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join that fails when either side repeats a key."""
    return unique_by(left, on, "left").join(unique_by(right, on, "right"), list(on), how)


def lookup_in_order(keys: DataFrame, table: DataFrame, on: Sequence[str], probe: str) -> DataFrame:
    """Attach ``table`` to ``keys`` (which carry their own position); a missing key fails.

    ``probe`` is a column of ``table`` that is never NULL there.
    """
    joined = keys.join(unique_by(table, on, "table"), list(on), "left")
    message = F.concat(F.lit("no row for key "), F.to_json(F.struct(*on)))
    return joined.withColumn(
        probe, F.when(F.col(probe).isNotNull(), F.col(probe)).otherwise(F.raise_error(message))
    )


def compare_snapshots(
    a: DataFrame, b: DataFrame, key: Sequence[str], cols: Sequence[str], tol: float
) -> DataFrame:
    """Per column: rows only in a / only in b, differing values, largest numeric difference."""
    key = list(key)
    numeric = {n for n, t in a.dtypes if t in ("double", "float", "int", "bigint", "smallint")}
    left = a.select(*key, F.struct(*cols).alias("__a"))
    right = b.select(*key, F.struct(*cols).alias("__b"))
    both = left.join(right, key, "full_outer")
    aggs = [
        F.count_if(F.col("__b").isNull()).alias("only_a"),
        F.count_if(F.col("__a").isNull()).alias("only_b"),
    ]
    matched = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    for c in cols:
        va, vb = F.col("__a")[c], F.col("__b")[c]
        if c in numeric:
            diff = F.abs(va.cast("double") - vb.cast("double"))
            bad = ~F.coalesce(diff <= tol, va.isNull() & vb.isNull())
            aggs.append(F.max(F.when(matched, diff)).alias(f"diff_{c}"))
        else:
            bad = ~va.eqNullSafe(vb)
            aggs.append(F.max(F.lit(None).cast("double")).alias(f"diff_{c}"))
        aggs.append(F.count_if(matched & bad).alias(f"bad_{c}"))
    wide = both.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("only_a"),
                F.col("only_b"),
                F.col(f"bad_{c}").alias("n_different"),
                F.col(f"diff_{c}").alias("max_abs_diff"),
            )
            for c in cols
        ]
    )
    return wide.select(F.inline(rows))


def paired_delta(
    metrics: DataFrame, baseline: str, values: Sequence[str], arm: str = "arm", fold: str = "fold"
) -> DataFrame:
    """Arm minus baseline on the same fold; folds without a baseline row drop out."""
    base = metrics.where(F.col(arm) == baseline).select(
        fold, *[F.col(v).alias(f"__base_{v}") for v in values]
    )
    return (
        metrics.where(F.col(arm) != baseline)
        .join(base, fold)
        .select(fold, arm, *[(F.col(v) - F.col(f"__base_{v}")).alias(f"delta_{v}") for v in values])
    )


def arm_grid(scored: DataFrame, thresholds: Sequence[float | None], error: str = "fold_error") -> DataFrame:
    """Each row once per arm that retains it (``error < threshold``; None retains all).

    The arms are a literal array, exploded in place: no join and no shuffle.
    """
    arms = F.array(
        *[
            F.struct(
                F.lit(arm_label(t)).alias("arm"),
                F.lit(None if t is None else float(t)).cast("double").alias("threshold"),
            )
            for t in thresholds
        ]
    )
    keep = F.filter(arms, lambda x: x["threshold"].isNull() | (F.col(error) < x["threshold"]))
    exploded = scored.withColumn("__arm", F.explode(keep))
    return exploded.withColumns(
        {"arm": F.col("__arm")["arm"], "threshold": F.col("__arm")["threshold"]}
    ).drop("__arm")


def key_overlap_audit(
    train: DataFrame,
    test: DataFrame,
    levels: Mapping[str, Column],
    value: str,
    ratio: float = 1.01,
) -> DataFrame:
    """Per key expression: test rows whose key occurs in train, and those with a near-equal value.

    Train is reduced to its distinct (key, value) pairs first, and a test row is
    matched through a semi-join on a coarse log-value bin (own and both neighbours),
    so copies of one key never meet pairwise.
    """
    width = math.log10(ratio) * 1.000001
    out = None
    for level, key in levels.items():
        known = train.select(key.alias("__k"), F.col(value).alias("__t")).where(F.col("__k").isNotNull())
        binned = known.groupBy("__k", F.floor(F.log10("__t") / width).alias("__bin")).agg(
            F.min("__t").alias("__tmin"), F.max("__t").alias("__tmax")
        )
        probe = test.select(key.alias("__k"), F.col(value).alias("__v")).where(F.col("__k").isNotNull())
        grouped = probe.groupBy("__k", "__v").agg(F.count(F.lit(1)).alias("__n"))
        overlap = grouped.join(known.select("__k").distinct(), "__k", "left_semi")
        centre = F.floor(F.log10("__v") / width)
        near = (
            grouped.withColumn("__bin", F.explode(F.array(centre - 1, centre, centre + 1)))
            .join(binned, ["__k", "__bin"])
            .where(
                (fold_ratio(F.col("__v"), F.col("__tmin")) <= ratio)
                | (fold_ratio(F.col("__v"), F.col("__tmax")) <= ratio)
            )
            .select("__k", "__v", F.lit(True).alias("__near"))
            .distinct()
        )
        part = overlap.join(near, ["__k", "__v"], "left").agg(
            F.lit(level).alias("level"),
            F.coalesce(F.sum("__n"), F.lit(0)).alias("n_overlap"),
            F.coalesce(F.sum(F.when(F.col("__near"), F.col("__n"))), F.lit(0)).alias("n_near_equal"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def attach_features(df: DataFrame, *blocks: DataFrame, on: str) -> DataFrame:
    """Feature blocks side by side, matched on the key rather than by position.

    A block must have each key of ``df`` exactly once; a missing or repeated key fails the job.
    """
    for i, block in enumerate(blocks):
        checked = unique_by(block, [on], f"block {i}").withColumn("__found", F.lit(True))
        message = F.concat(F.lit(f"block {i}: no row for key "), F.to_json(F.struct(on)))
        df = df.join(checked, on, "left")
        found = F.when(F.col("__found"), F.col(on)).otherwise(F.raise_error(message))
        df = df.withColumn(on, found).drop("__found")
    return df
