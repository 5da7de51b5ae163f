"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("curafold")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. A session within one process may leave it unset: it gets a
    folder of its own, which goes with the process."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY
    )
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="spark-curafold-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


RUN_KEY = "spark.curafold.runFolder"


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get(RUN_KEY, None) or shared_folder(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of the block go into a folder of their own, which is deleted at its end, after a failure too.

    Results that are needed later must have been written elsewhere by then. Runs may be nested.
    """
    outer = spark.conf.get(RUN_KEY, None)
    folder = f"{outer or shared_folder(spark)}/run-{uuid.uuid4().hex}"
    spark.conf.set(RUN_KEY, folder)
    try:
        yield folder
    finally:
        spark.conf.unset(RUN_KEY) if outer is None else spark.conf.set(RUN_KEY, outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several consumers share an expensive result: the table survives a
    lost executor and cuts the lineage, and a reader prunes columns as usual.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Largest parameter table that is broadcast, and the copies of a larger one that a hot key is spread over.
PARAMETER_BYTES = 32 << 20
PARAMETER_SALTS = 16


def join_parameters(df: DataFrame, params: DataFrame, on: list[str], name: str, how: str = "inner") -> DataFrame:
    """Join wide data to a table of parameters; NULL keys match each other.

    The keys are folds, arms or features, so a plain shuffle would send all rows of a key to one task. The
    table is written and measured: up to ``PARAMETER_BYTES`` it is broadcast, a larger one is repeated for a few
    salts, over which the rows of a key are spread. Both give the same rows.
    """
    table = materialize(params, name)
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    right = table.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in table.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    if size <= PARAMETER_BYTES:
        joined = df.join(F.broadcast(right), same, how)
    else:
        right = right.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(PARAMETER_SALTS - 1))))
        left = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(PARAMETER_SALTS)).cast("int"))
        joined = left.join(right, same & (F.col("__salt") == F.col("__r_salt")), how).drop("__salt", "__r_salt")
    return joined.drop(*[f"__r_{c}" for c in on])
