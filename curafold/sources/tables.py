"""Reading and writing record tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def clean_names(names: Sequence[str]) -> list[str]:
    """Strip a byte-order mark and blanks; repeated names are an error."""
    cleaned = [n.replace("﻿", "").strip() for n in names]
    repeated = sorted({n for n in cleaned if cleaned.count(n) > 1})
    if repeated:
        raise ValueError(f"repeated column names: {repeated}")
    return cleaned


def read_records(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv"
) -> DataFrame:
    """Read a record table under an explicit schema; nothing is inferred.

    Delimited files are matched by cleaned header name, so column order in the file
    does not matter; a schema column missing from the header is an error.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    options = {"header": True, "multiLine": False, "encoding": "UTF-8", "mode": "FAILFAST"}
    header = spark.read.options(**options).csv(path).columns
    cleaned = clean_names(header)
    missing = [f.name for f in schema if f.name not in cleaned]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    types = {f.name: f.dataType for f in schema}
    file_schema = T.StructType(
        [T.StructField(n, types.get(n, T.StringType())) for n in cleaned]
    )
    table = spark.read.options(**options, enforceSchema=True).schema(file_schema).csv(path)
    return table.select(*[f.name for f in schema])


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Read Parquet; a table in fewer splits than cores is spread by ``key``.

    Large tables arrive in many splits and are left alone. The guard only moves input
    that could not feed the cluster anyway.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if _few_splits(df, cores) else df


def _few_splits(df: DataFrame, cores: int) -> bool:
    return df.rdd.getNumPartitions() < cores


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df`` (resumable runs)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by
    ).parquet(path)


def fan_out(scored: DataFrame, path: str, flag: str) -> dict[str, DataFrame]:
    """One scored set written once, split by ``status``; returns report, removed and kept."""
    spark = scored.sparkSession
    status = F.when(F.col(flag), F.lit("removed")).otherwise(F.lit("kept"))
    tagged = scored.withColumn("status", status)
    write_table(tagged, path, partition_by=["status"])
    report = spark.read.schema(tagged.schema).parquet(path)
    return {
        "report": report,
        "removed": report.where(F.col("status") == "removed"),
        "kept": report.where(F.col("status") == "kept"),
    }


def seed_matrix(
    preds: DataFrame, key: str, seeds: Sequence[int], y: str = "y", pred: str = "pred"
) -> DataFrame:
    """Wide export: one prediction column per seed, plus mean prediction and truth."""
    wide = preds.groupBy(key).agg(
        F.first(y).alias("y"),
        *[F.max(F.when(F.col("seed") == s, F.col(pred))).alias(f"pred_seed_{s}") for s in seeds],
        F.avg(pred).alias("pred_mean"),
    )
    return wide


def seed_long(wide: DataFrame, key: str, seeds: Sequence[int]) -> DataFrame:
    """Inverse of :func:`seed_matrix`."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("seed"), F.col(f"pred_seed_{s}").alias("pred")) for s in seeds]
    )
    return wide.select(key, "y", F.inline(pairs)).where(F.col("pred").isNotNull())


def ordered_export(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Globally ordered (range partitioned) rows for an export."""
    return df.orderBy(*order)


def export_core(df: DataFrame, bookkeeping: Sequence[str]) -> DataFrame:
    """Drop bookkeeping columns before sharing a table."""
    return df.drop(*bookkeeping)
