"""Nested run summary documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Categories that fit into one row of a summary; a column with more is no category, and the job fails.
MOST_CATEGORIES = 10_000


def category_counts(df: DataFrame, col: str, name: str, most: int = MOST_CATEGORIES) -> DataFrame:
    """One row with a map category -> rows; NULL counts as ``NULL``.

    The number of categories is checked before they are gathered: more than ``most`` fail the job.
    """
    counts = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("NULL")).alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    checked = counts.where(
        F.assert_true(
            counts.agg(F.count(F.lit(1))).scalar() <= most,
            F.lit(f"column {col} has more than {most} categories"),
        ).isNull()
    )
    return checked.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name)
    )


def run_summary(config: Mapping[str, str], **sections: DataFrame) -> DataFrame:
    """One nested row: the configuration and one struct per single-row section."""
    spark = next(iter(sections.values())).sparkSession
    base = spark.range(1).select(
        F.create_map(*[F.lit(x) for kv in config.items() for x in kv]).alias("config")
    )
    for name, df in sections.items():
        base = base.withColumn(name, df.select(F.struct("*").alias("s")).scalar())
    return base


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)
