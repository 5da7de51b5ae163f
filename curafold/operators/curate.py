"""Exclusion cascades, duplicate conflicts, entity aggregation and source routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curafold.functions.target import source_membership, to_log_target
from curafold.operators.ranking import grouped_agg
from curafold.session import materialize

Rules = Sequence[tuple[str, Column]]


def first_reason(rules: Rules) -> Column:
    """Name of the first rule that holds, NULL when none does."""
    return F.coalesce(*[F.when(pred, F.lit(name)) for name, pred in rules])


def exclusion_cascade(df: DataFrame, rules: Rules, reason: str = "remove_reason") -> DataFrame:
    """Tag each row with its first matching reason in one pass; kept rows have NULL."""
    return df.withColumn(reason, first_reason(rules))


def kept(tagged: DataFrame, reason: str = "remove_reason") -> DataFrame:
    return tagged.where(F.col(reason).isNull()).drop(reason)


def removed(tagged: DataFrame, reason: str = "remove_reason") -> DataFrame:
    return tagged.where(F.col(reason).isNotNull())


def range_rules(value: Column, low: float, high: float, name: str = "value") -> Rules:
    """Removal strictly outside ``[low, high]``; the bounds themselves stay."""
    return [(f"{name}_below_{low:g}", value < low), (f"{name}_above_{high:g}", value > high)]


def range_filter(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Keep ``low <= value <= high`` as plain comparisons, which reach the file scan."""
    return df.where((F.col(value) >= low) & (F.col(value) <= high))


def measurement_rules(
    parsed: Column, low: float, high: float, valid: Column | None = None
) -> Rules:
    """The ordered raw-record rules: limit, unparsable, non-positive, invalid, range."""
    value = parsed["value"]
    rules: list[tuple[str, Column]] = [
        ("limit_value", parsed["is_limit"]),
        ("numeric_parse_failed", value.isNull()),
        ("non_positive", value <= 0),
    ]
    if valid is not None:
        rules.append(("invalid_entity", ~F.coalesce(valid, F.lit(False))))
    return [*rules, *range_rules(value, low, high)]


def group_spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, min, max, median and max/min ratio per key."""
    return grouped_agg(
        df,
        [key],
        {
            "n": F.count(value),
            "min_value": F.min(value),
            "max_value": F.max(value),
            "spread": F.try_divide(F.max(value), F.min(value)),
        },
        {"median_value": value},
    )


def conflicting_keys(df: DataFrame, key: str, value: str, fold: float) -> DataFrame:
    """Keys with at least two rows whose max/min ratio exceeds ``fold``."""
    return (
        df.groupBy(key)
        .agg(
            F.count(value).alias("n"),
            F.try_divide(F.max(value), F.min(value)).alias("spread"),
        )
        .where((F.col("n") >= 2) & (F.col("spread") > fold))
        .select(key)
    )


def tag_conflicts(
    df: DataFrame, key: str, value: str, fold: float, reason: str = "remove_reason"
) -> DataFrame:
    """Add the conflict reason to the whole group; rows already removed do not count.

    The key statistics are aggregated map-side, so a hot key costs one partial row
    per task; the flagged keys come back through a left join Spark may broadcast.
    """
    live = df.where(F.col(reason).isNull())
    bad = conflicting_keys(live, key, value, fold).withColumn("__conflict", F.lit(True))
    name = f"duplicate_conflict_fold_above_{fold:g}"
    return (
        df.join(bad, key, "left")
        .withColumn(
            reason,
            F.coalesce(F.col(reason), F.when(F.col("__conflict"), F.lit(name))),
        )
        .drop("__conflict")
    )


def drop_conflicts(df: DataFrame, key: str, value: str, fold: float) -> DataFrame:
    return df.join(conflicting_keys(df, key, value, fold), key, "left_anti")


def aggregate_entities(
    df: DataFrame,
    key: str = "entity",
    value: str = "value",
    weight: str = "weight",
    source: str = "source",
    row_id: str = "row_id",
    max_of: Sequence[str] = (),
    first_of: Sequence[str] = (),
    source_a: str = "A",
    source_b: str = "B",
) -> DataFrame:
    """One row per entity. Links back to the raw rows stay a table: :func:`entity_row_links`.

    ``source`` must hold normalised labels, so the collected set is a handful of names. The columns in use are written
    once: aggregates, medians and the plans of consumers read them, and none parses or tests the raw rows again.
    """
    names = dict.fromkeys([key, value, weight, source, row_id, *max_of, *first_of])
    df = materialize(df.select(*names), "entity-rows")
    aggs: dict[str, Column] = {
        weight: F.min_by(weight, row_id),
        "n_raw_records": F.count(F.lit(1)),
        "min_raw": F.min(value),
        "max_raw": F.max(value),
        "mean_raw": F.avg(value),
        "first_row_id": F.min(row_id),
        "source_set": F.array_join(F.array_sort(F.collect_set(source)), ";"),
        "has_a": F.coalesce(F.bool_or(F.col(source) == source_a), F.lit(False)),
        "has_b": F.coalesce(F.bool_or(F.col(source) == source_b), F.lit(False)),
    }
    aggs |= {f"max_{c}": F.max(c) for c in max_of}
    aggs |= {f"first_{c}": F.min_by(c, row_id) for c in first_of}
    entities = grouped_agg(df, [key], aggs, {value: value})
    return entities.withColumns(
        {
            "source_type": source_membership(F.col("has_a"), F.col("has_b"), source_a, source_b),
            "y": to_log_target(F.col(value), F.col(weight)),
        }
    )


def entity_row_links(df: DataFrame, key: str = "entity", row_id: str = "row_id") -> DataFrame:
    """Long form of the row-id list: one row per (entity, raw row).

    A list column would put a hot entity's rows into one cell; as rows they stay
    partitioned, and sorting by ``(entity, row_id)`` gives the input order.
    """
    return df.select(key, row_id)


def entity_rules(scope: Column, value: Column, low: float, high: float, label: str) -> Rules:
    """Second-stage range rules that apply inside ``scope`` only."""
    return [(f"{label}_{name}", scope & pred) for name, pred in range_rules(value, low, high)]


def residual_rules(threshold: float, space: str = "ratio") -> Column:
    """Predicate of rows removed at ``threshold`` (equality is removed).

    ``ratio`` tests the fold error, ``log`` the absolute log error.
    """
    if space == "ratio":
        return F.col("fold_error") >= threshold
    if space == "log":
        return F.col("abs_error") >= F.log10(F.lit(float(threshold)))
    raise ValueError(f"space must be 'ratio' or 'log', not {space!r}")


def residual_filter(scored: DataFrame, threshold: float, space: str = "ratio") -> DataFrame:
    return scored.where(~residual_rules(threshold, space))


def source_route(
    entities: DataFrame, pool: Sequence[str], holdout: Sequence[str], out: str = "route"
) -> DataFrame:
    """Label each entity pool / holdout / unknown by its source class."""
    return entities.withColumn(
        out,
        F.when(F.col("source_type").isin(*pool), F.lit("pool"))
        .when(F.col("source_type").isin(*holdout), F.lit("holdout"))
        .otherwise(F.lit("unknown")),
    )


def source_holdout(
    entities: DataFrame, pool: Sequence[str], holdout: Sequence[str]
) -> dict[str, DataFrame]:
    routed = source_route(entities, pool, holdout)
    return {
        name: routed.where(F.col("route") == name).drop("route")
        for name in ("pool", "holdout", "unknown")
    }


def removed_reason_counts(levels: Mapping[str, DataFrame], reason: str = "remove_reason") -> DataFrame:
    """Exclusion counts per level and reason."""
    out = None
    for level, df in levels.items():
        part = (
            removed(df, reason)
            .groupBy(reason)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(level).alias("level"), reason, "n")
        )
        out = part if out is None else out.unionByName(part)
    return out


def value_counts(df: DataFrame, col: str, dropna: bool = False) -> DataFrame:
    source = df.where(F.col(col).isNotNull()) if dropna else df
    return source.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
