"""The row-level part of curation needs no state, so it runs unchanged on a stream.

Conflict detection and entity aggregation look at all rows of an entity and stay
batch jobs over the table this writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curafold.functions.measurement import parse_measurement
from curafold.operators.curate import exclusion_cascade, measurement_rules


def tag_measurements(df: DataFrame, raw: str, low: float, high: float) -> DataFrame:
    """Parse ``raw`` and add ``value`` and ``remove_reason``; batch or streaming input."""
    parsed = df.withColumn("__p", parse_measurement(F.col(raw)))
    tagged = exclusion_cascade(parsed, measurement_rules(F.col("__p"), low, high))
    return tagged.withColumn("value", F.col("__p.value")).drop("__p")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the tagged rows as Parquet, processing what is available now."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
