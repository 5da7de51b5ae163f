"""Runs that can be stopped and taken up again: one written partition for each finished task."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curafold.operators.ranking import join_on

Task = Mapping[str, object]
AT_ONCE = 3


def signature_of(**settings) -> str:
    """A digest of everything a task's result depends on besides its key."""
    return hashlib.md5(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def resume_ledger(plan: DataFrame, done: DataFrame, task: Sequence[str]) -> DataFrame:
    """State of each planned task: ``todo``, ``done`` or ``signature_mismatch``; NULL parts of a task match each other."""
    seen = done.select(*task, F.col("signature").alias("__seen")).distinct()
    return join_on(plan, seen, task, "left").withColumn(
        "state",
        F.when(F.col("__seen").isNull(), F.lit("todo"))
        .when(F.col("__seen") == F.col("signature"), F.lit("done"))
        .otherwise(F.lit("signature_mismatch")),
    ).drop("__seen")


def pending_tasks(ledger: DataFrame) -> DataFrame:
    """Tasks still to run; a changed signature fails instead of being overwritten."""
    state = F.when(
        F.col("state") == "signature_mismatch",
        F.raise_error(F.lit("a finished task has a different signature")).cast("string"),
    ).otherwise(F.col("state"))
    return ledger.withColumn("state", state).where(F.col("state") == "todo").drop("state")


def finished(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The ledger of finished tasks; empty if none has finished."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/done/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_tasks(
    spark: SparkSession, folder: str, tasks: Sequence[Task], key_types: Mapping[str, str], signature: str,
    work: Callable[[Task], DataFrame], at_once: int = AT_ONCE,
) -> DataFrame:
    """The rows of all ``tasks``, of which only those without a finished result are worked on.

    ``tasks`` are dictionaries with the columns of ``key_types``; ``work`` gives a task's rows. A task writes
    its rows to a folder of its own and then its line in the ledger, so one that was interrupted between
    the two runs again and overwrites. Tasks that had finished with another signature fail the run
    before anything starts. A few tasks run at a time, each in a scheduler pool of its own name.
    """
    keys = list(key_types)
    schema = ", ".join([*[f"`{k}` {t}" for k, t in key_types.items()], "folder string", "signature string"])
    lines = []
    for task in tasks:
        name = hashlib.md5(json.dumps([task[k] for k in keys], default=str).encode()).hexdigest()
        lines.append((*[task[k] for k in keys], name, signature))
    plan = spark.createDataFrame(lines, schema)
    todo = pending_tasks(resume_ledger(plan, finished(spark, folder, schema), keys)).collect()

    def one(line) -> None:
        task = {k: line[k] for k in keys}
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", line["folder"])
        work(task).write.mode("overwrite").parquet(f"{folder}/rows/{line['folder']}")
        spark.createDataFrame([line], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/{line['folder']}")

    if todo:
        with ThreadPool(min(at_once, len(todo))) as pool:
            pool.map(inheritable_thread_target(spark)(one), todo, chunksize=1)
    return spark.read.parquet(*[f"{folder}/rows/{line[len(keys)]}" for line in lines])
