"""Mixing sources to target weights by weighted fair queueing.

Each source sends its shuffled documents as one stream, up to ``most`` times over. A copy's virtual finish time is
``tokens of its source up to its end / target of its source``. All copies that start before their source's target are sorted by
finish time over the whole cluster and cut where the budget is spent. Documents are served whole, so sources are then brought to
their targets: a copy that ends beyond the target by more than half of itself is given back, and waiting copies step
forward in the order of the stream, those that don't fit into what is left aside, until none fits. If one of those still brings
the source nearer, the nearest is served last.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curafold.llm.common import text_of
from curafold.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
KEY_BITS = 60
#: Waiting copies of a source that are walked one by one at a time, the first in its stream.
HEAD_ROWS = 512


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """``sizes(source, skey, source_size)`` with the ``target`` of each source.

    The budget is ``share`` of all sizes. A source's share goes by weight, up to ``most`` times its size,
    and what that cuts off goes to the others by weight. With sources in the order of cap by weight,
    the level ``(budget - caps before) / weights from here on`` rises while sources are capped and falls
    afterwards, so its maximum is the level at which the budget is used up. There is one row per
    source; these few rows are windowed in one task.
    """
    n = len(weights)
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % n + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    caps_before = F.sum("cap").over(order) - F.col("cap")
    weights_left = F.sum("weight").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.sum("weight").over(order) + F.col("weight")
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    rows = rows.withColumn("budget", budget).withColumn("level", (F.col("budget") - caps_before) / weights_left)
    target = F.least(F.col("cap"), F.max("level").over(every) * F.col("weight"))
    return rows.withColumn("target", F.round(target, 6)).select("source", "skey", "source_size", "target", "budget")


#: The order of a stream. Rows that agree in all but ``uid`` are copies of one row, whose places don't matter.
STREAM = ["key", "size", "mark", "uid"]


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The first waiting copies of one source, in order: those that fit are served, others step aside."""
    pdf = pdf.sort_values(["copy", *STREAM])
    gap, served = pdf["gap"].iloc[0], []
    for size in pdf["size"]:
        served.append(size <= gap)
        gap -= size if served[-1] else 0
    return pdf.loc[served, ["skey", "uid", "size"]]


def schedule(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0, seed: int = 42, carry: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, copies)``: one row per document with ``uid, size, source_size, target, copies`` and its columns
    (those in ``carry``) in ``doc``, and the schedule up to the cut: ``uid, skey, copy, size, finish, running``."""
    order_key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(f"`{doc_id}`").cast("string"))), 1, KEY_BITS // 4), 16, 10).cast("long")
    everything = materialize(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("doc"),
            F.monotonically_increasing_id().alias("uid"),
            F.col(f"`{source}`").cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("skey"),
            F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(text_of(text)).alias("mark"),
            order_key.alias("key"),
        ),
        "mix-rows",
    )
    sizes = everything.groupBy("skey").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, most, share), "mix-targets")

    # Streams are dealt out by ranges, so a source with most rows is many parts; the mark splits rows that share an id.
    rows = everything.select("uid", "skey", "size", "mark", "key")
    rows = materialize(rows.repartitionByRange("skey", *STREAM).withColumn("part", F.spark_partition_id()), "mix-ranges")
    parts = rows.groupBy("skey", "part").agg(F.count("*").alias("n"))
    goals = materialize(parts.join(targets.drop("source"), "skey").drop("n"), "mix-goals")
    rows = rows.join(goals, ["skey", "part"]).withColumn("fits", F.when(F.col("size") <= F.col("target"), F.col("size")).otherwise(0))
    sums = rows.groupBy("skey", "part").agg(F.sum("fits").alias("part_size"))
    sums = sums.select("skey", "part", (F.sum("part_size").over(W.partitionBy("skey").orderBy("part")) - F.col("part_size")).alias("before"), F.sum("part_size").over(W.partitionBy("skey")).alias("pass_size"))
    inside = F.sum("fits").over(W.partitionBy("skey", "part").orderBy(*STREAM).rowsBetween(W.unboundedPreceding, 0))
    queued = rows.withColumn("inside", inside).join(sums, ["skey", "part"]).withColumn("end", F.col("before") + F.col("inside"))
    queued = materialize(queued.drop("inside", "before"), "mix-queue")

    # A document longer than its source's target isn't part of the stream; an empty one is so once.
    last = F.when(F.col("size") == 0, 0).otherwise(most - 1)
    copies = queued.where("size <= target AND target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
    copies = copies.withColumn("tokens", F.col("copy") * F.col("pass_size") + F.col("end")).where(F.col("tokens") - F.col("size") < F.col("target"))
    served = _in_order(copies.withColumn("finish", F.col("tokens") / F.col("target"))).where(F.col("running") <= F.col("budget"))
    served = served.where((F.col("tokens") <= F.col("target")) | (2 * F.col("tokens") - F.col("size") <= 2 * F.col("target")))
    served = materialize(served.select("uid", "skey", "copy", "size", "finish", "running"), "mix-served")

    taken = served.groupBy("uid").agg(F.count("*").cast("int").alias("copies"))
    state = queued.join(taken, "uid", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    state = materialize(state.select("skey", *STREAM, "part", "source_size", "target", "copies"), "mix-state")
    by_source = served.groupBy("skey").agg(F.sum("size").alias("served"))
    gaps = targets.join(by_source, "skey", "left").select("skey", (F.col("target") - F.coalesce("served", F.lit(0))).alias("gap"))
    gaps = materialize(gaps, "mix-gaps")
    more = docs.sparkSession.createDataFrame([], "skey string, uid long, size long")
    while True:
        extra = more.groupBy("uid").agg(F.count("*").cast("int").alias("extra"))
        now = state.join(extra, "uid", "left").withColumn("taken", F.col("copies") + F.coalesce("extra", F.lit(0)))
        # Gaps reach the rows by part, so a source with most rows stays dealt out.
        now = now.join(parts.join(gaps, "skey").where("gap > 0").select("skey", "part", "gap"), ["skey", "part"])
        waiting = now.where((F.col("taken") < most) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
        waiting = waiting.select("skey", *STREAM, "gap", F.explode(F.sequence("taken", F.lit(most - 1))).alias("copy"))
        place = F.row_number().over(W.partitionBy("skey").orderBy("copy", *STREAM))
        head = waiting.withColumn("place", place).where(F.col("place") <= HEAD_ROWS).drop("place")
        step = materialize(head.groupBy("skey").applyInPandas(_walk, "skey string, uid long, size long"), "mix-step")
        if step.isEmpty():
            break
        more = materialize(more.unionByName(step), "mix-more")
        filled = step.groupBy("skey").agg(F.sum("size").alias("filled"))
        gaps = materialize(gaps.join(filled, "skey", "left").select("skey", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap")), "mix-gaps")
    nearer = now.where((F.col("taken") < most) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
    # All that wait are larger than the gap, so the smallest comes nearest.
    best = nearer.groupBy("skey", "part").agg(F.min(F.struct("size", "taken", "key", "mark", "uid")).alias("best"))
    best = best.groupBy("skey").agg(F.min("best").alias("best")).select("skey", "best.uid", "best.size")
    more = materialize(more.unionByName(best), "mix-more")

    extra = more.groupBy("uid").agg(F.count("*").cast("int").alias("extra"))
    final = state.join(extra, "uid", "left").select("uid", "size", "source_size", "target", (F.col("copies") + F.coalesce("extra", F.lit(0))).alias("copies"))
    return everything.select("uid", "doc").join(final, "uid"), served


def _in_order(copies: DataFrame) -> DataFrame:
    """Adds the words that the mix has given out when a copy ends: ``running`` along the finish times."""
    order = ["finish", "skey", "tokens", *STREAM]
    ranged = copies.repartitionByRange(*order).withColumn("slice", F.spark_partition_id())
    ranged = materialize(ranged.select("copy", "target", "budget", "slice", *order), "mix-ranged")
    sums = ranged.groupBy("slice").agg(F.sum("size").alias("slice_size"))
    # One row per partition of the order.
    sums = sums.select("slice", (F.sum("slice_size").over(W.orderBy("slice")) - F.col("slice_size")).alias("before"))
    running = F.sum("size").over(W.partitionBy("slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("running", running).join(sums, "slice").withColumn("running", F.col("before") + F.col("running"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """One row per document with what the mix takes of it: ``doc_id, size, source_size, target, taken, copies``.

    Null text has size 0; null is a source of its own, last in order. Empty documents are served once and add
    nothing. Rows that share an id are different documents; of rows with equal id, source and text any may be the one that
    is taken more often. An empty table gives no rows. The order of a source is a hash of ``seed`` and id, then size and a hash of
    the text, so another run or file layout gives the same rows.
    """
    rows, _ = schedule(docs, text, doc_id, source, carry=(doc_id,), **options)
    return rows.select(
        F.col(f"doc.`{doc_id}`").alias(doc_id), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    rows, _ = schedule(docs, **options)
    copies = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return copies.select("doc.*")
