"""Data contracts: each check yields ``(check, status, n_bad, detail)`` rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curafold.functions.measurement import finite, strict_double
from curafold.operators.setops import check_row, set_equal, union_partitions


def _report(spark: SparkSession, rows: list[tuple[str, int, str]]) -> DataFrame:
    return spark.createDataFrame(
        [(name, "fail" if bad else "pass", bad, detail) for name, bad, detail in rows],
        "check string, status string, n_bad long, detail string",
    )


def required_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    return _report(
        df.sparkSession, [("required_columns", len(missing), "missing: " + ",".join(missing))]
    )


def row_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Count violating rows of several row-level predicates in one scan.

    Each value is the predicate of a *good* row; NULL counts as a violation.
    """
    counted = df.agg(
        *[
            F.count_if(~F.coalesce(good, F.lit(False))).alias(f"__c{i}")
            for i, good in enumerate(checks.values())
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.col(f"__c{i}").alias("n_bad"))
            for i, name in enumerate(checks)
        ]
    )
    return counted.select(F.inline(rows)).select(
        "check",
        F.when(F.col("n_bad") == 0, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
        "n_bad",
        F.lit("rows violating the rule").alias("detail"),
    )


def expected_count(df: DataFrame, expected: int, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("check"),
        F.when(F.col("n") == expected, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
        F.abs(F.col("n") - expected).alias("n_bad"),
        F.lit("difference from the expected row count").alias("detail"),
    )


def min_rows(df: DataFrame, n: int, name: str = "min_rows") -> DataFrame:
    """Passes when at least ``n`` rows exist; ``n_bad`` is the shortfall."""
    return df.agg(F.greatest(F.lit(n) - F.count(F.lit(1)), F.lit(0)).alias("n_bad")).select(
        F.lit(name).alias("check"),
        F.when(F.col("n_bad") == 0, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
        "n_bad",
        F.lit("rows short of the minimum").alias("detail"),
    )


def require_min_rows(df: DataFrame, n: int) -> DataFrame:
    """Same test as a guard: fails the job when rows are too few."""
    message = F.lit(f"fewer than {n} rows")
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") >= n, F.col("n")).otherwise(F.raise_error(message).cast("long")).alias("n")
    )


def key_checks(df: DataFrame, key: str) -> DataFrame:
    """Key present and unique; ``n_bad`` counts rows, respectively repeated keys."""
    present = row_checks(
        df, {f"{key}_present": F.trim(F.col(key).cast("string")) != ""}
    )
    repeated = (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    )
    return present.unionByName(check_row(f"{key}_unique", repeated, "repeated keys"))


def composition(df: DataFrame, col: str, expected: Mapping[str, int]) -> DataFrame:
    """Actual against expected rows per category, including unknown categories."""
    spark = df.sparkSession
    want = spark.createDataFrame(list(expected.items()), "category string, expected long")
    have = df.groupBy(F.col(col).cast("string").alias("category")).agg(
        F.count(F.lit(1)).alias("actual")
    )
    both = have.join(want, "category", "full_outer").select(
        "category",
        F.coalesce("actual", F.lit(0)).alias("actual"),
        F.coalesce("expected", F.lit(0)).alias("expected"),
    )
    return both.select(
        F.concat(F.lit(f"{col}="), F.coalesce("category", F.lit("NULL"))).alias("check"),
        F.when(F.col("actual") == F.col("expected"), F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
        F.abs(F.col("actual") - F.col("expected")).alias("n_bad"),
        F.lit("difference from the expected rows").alias("detail"),
    )


def allowed_values(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    return row_checks(df, {f"{col}_allowed": F.col(col).isin(*allowed)})


def finite_positive(df: DataFrame, cols: Sequence[str], positive: Sequence[str] = ()) -> DataFrame:
    rules = {f"{c}_finite": finite(F.col(c)) for c in cols}
    rules |= {f"{c}_positive": F.col(c) > 0 for c in positive}
    return row_checks(df, rules)


def numeric_problems(df: DataFrame, col: str) -> DataFrame:
    """Rows of a text column that are no finite number, counted by kind."""
    return (
        df.select(strict_double(F.col(col))["problem"].alias("problem"))
        .where(F.col("problem").isNotNull())
        .groupBy("problem")
        .agg(F.count(F.lit(1)).alias("n_bad"))
    )


def formula_matches(df: DataFrame, rules: Mapping[str, tuple[Column, Column]], tol: float) -> DataFrame:
    """Stored columns agree with their formula within ``tol``."""
    return row_checks(df, {name: F.abs(col - expr) <= tol for name, (col, expr) in rules.items()})


def flag_matches(
    df: DataFrame, flag: Column, rule: Column, listed: DataFrame, key: Sequence[str]
) -> DataFrame:
    """The flag equals its rule, and the flagged keys equal an exclusion table."""
    return row_checks(df, {"flag_follows_rule": flag == rule}).unionByName(
        set_equal(df.where(flag), listed, key, "flagged_keys_match_list")
    )


def metrics_match(
    actual: DataFrame, recorded: DataFrame, key: Sequence[str], cols: Sequence[str], tol: float
) -> DataFrame:
    """Recomputed metrics equal the recorded ones; two NULLs agree, a missing row fails."""
    left = actual.select(*key, F.struct(*cols).alias("__a"))
    right = recorded.select(*key, F.struct(*cols).alias("__b"))
    both = left.join(right, list(key), "full_outer")
    rules = {}
    for c in cols:
        a, b = F.col("__a")[c], F.col("__b")[c]
        present = F.col("__a").isNotNull() & F.col("__b").isNotNull()
        rules[c] = present & F.coalesce(F.abs(a - b) <= tol, a.isNull() & b.isNull())
    return row_checks(both, rules)


def similarity_contract(df: DataFrame, similarity: str, band: str) -> DataFrame:
    """Similarities lie in [0, 1] and each row carries exactly one known band."""
    return row_checks(
        df,
        {
            "similarity_in_unit_interval": F.col(similarity).between(0.0, 1.0),
            "band_known": F.col(band).isin("identical", "near", "out"),
        },
    )


def selection_matches_rule(
    selected: DataFrame, screened: DataFrame, keep: Column, by: Sequence[str], key: str
) -> DataFrame:
    """Per ``by`` group, the selected rows equal the rule applied to the screening table."""
    want = screened.where(keep).select(*by, key).distinct().withColumn("__want", F.lit(1))
    have = selected.select(*by, key).distinct().withColumn("__have", F.lit(1))
    mismatch = F.col("__want").isNull() | F.col("__have").isNull()
    return (
        want.join(have, [*by, key], "full_outer")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(mismatch).alias("n_bad"))
        .withColumn("status", F.when(F.col("n_bad") == 0, F.lit("pass")).otherwise(F.lit("fail")))
    )


def contract_report(*checks: DataFrame) -> DataFrame:
    """All checks in one table, each judged on its own row."""
    return union_partitions(*[c.select("check", "status", "n_bad", "detail") for c in checks])


def overall(report: DataFrame) -> DataFrame:
    """One row: PASS or FAIL, with check counts."""
    failed = F.count_if(F.col("status") != "pass")
    return report.agg(
        F.when(failed == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        F.count(F.lit(1)).alias("n_checks"),
        failed.alias("n_failed"),
    )
