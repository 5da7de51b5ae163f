"""Unions, differences and identity checks over keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_logs(*logs: DataFrame) -> DataFrame:
    """Stage logs with different columns; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def union_partitions(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def complement(base: DataFrame, part: DataFrame, key: Sequence[str]) -> DataFrame:
    return base.join(part.select(*key).distinct(), list(key), "left_anti")


def members_difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(*key).distinct().join(b.select(*key).distinct(), list(key), "left_anti")


def check_row(name: str, bad: DataFrame, detail: str) -> DataFrame:
    """One report row ``(check, status, n_bad, detail)`` counting the rows of ``bad``."""
    return bad.agg(F.count(F.lit(1)).alias("n_bad")).select(
        F.lit(name).alias("check"),
        F.when(F.col("n_bad") == 0, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
        "n_bad",
        F.lit(detail).alias("detail"),
    )


def set_equal(a: DataFrame, b: DataFrame, key: Sequence[str], name: str = "set_equal") -> DataFrame:
    """Both key sets agree: the full outer join has no one-sided key."""
    left = a.select(*key).distinct().withColumn("__l", F.lit(1))
    right = b.select(*key).distinct().withColumn("__r", F.lit(1))
    one_sided = left.join(right, list(key), "full_outer").where(
        F.col("__l").isNull() | F.col("__r").isNull()
    )
    return check_row(name, one_sided, "keys present on one side only")


def disjoint(a: DataFrame, b: DataFrame, key: Sequence[str], name: str = "disjoint") -> DataFrame:
    shared = a.select(*key).distinct().join(b.select(*key), list(key), "left_semi")
    return check_row(name, shared, "keys present on both sides")


def covers_exactly_once(
    parts: DataFrame, base: DataFrame, key: Sequence[str], name: str = "covers_exactly_once"
) -> DataFrame:
    """Every base key occurs in ``parts`` exactly once and nothing else does."""
    times = parts.groupBy(*key).agg(F.count(F.lit(1)).alias("__times"))
    known = base.select(*key).distinct().withColumn("__base", F.lit(1))
    bad = times.join(known, list(key), "full_outer").where(
        F.col("__base").isNull() | (F.coalesce(F.col("__times"), F.lit(0)) != 1)
    )
    return check_row(name, bad, "keys missing, repeated or unknown")
