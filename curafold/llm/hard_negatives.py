"""Hard negatives by bounds along a spanning tree of anchors.

Anchors are dealt into blocks of like labels and candidates into shards; each block meets each shard. A block
has a minimum spanning tree of its anchors. At its root every candidate of the shard is scored. From a parent ``p`` to
its child ``q`` a score moves by at most ``|q - p| |c|``, so the parent's score, or the bounds that it has itself, give
bounds at the child, and only candidates whose bounds overlap a window of the child are scored again. The windows of the
first search are open above and begin at the k-th largest lower bound; those of the second come from the positives.

Vectors are rounded down to whole numbers, and scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curafold.session import materialize

POSITIVES, NEGATIVES = 5, 5
SCALE = 256
#: A negative scores at least so many hundredths of the positive, and at most as much as it.
LEAST_PERCENT = 80
ANCHOR_ROWS, SHARD_ROWS = 256, 8_192
#: Sums of products below this are exact in doubles, whatever their order.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

PLACE = "struct<width:int,label:bigint,part:bigint>"
BLOCK = f"block {PLACE}, width int, points binary, ids binary, labels binary"


def usable(vector: str, label: str, row_id: str) -> Column:
    """Whether a row takes part: id, label and vector are there, and all components are finite."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(row_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def products(points: np.ndarray, norms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors; beyond 64 bits the nearest long."""
    safe = norms * np.sqrt(q @ q) < EXACT / 2
    if safe.all():
        return (points @ q).astype(np.int64)
    out = np.empty(len(points), np.int64)
    out[safe] = (points[safe] @ q).astype(np.int64)
    whole = [int(x) for x in q]
    for i in np.flatnonzero(~safe):
        exact = sum(int(a) * b for a, b in zip(points[i], whole, strict=True))
        out[i] = max(-LONG - 1, min(LONG, exact))
    return out


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, parent, length)``: a minimum spanning tree from the point nearest to the mean; parents come first."""
    n = len(points)
    distance = lambda a: np.sqrt(((points - points[a]) ** 2).sum(axis=1))
    root = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    order, parent, length = np.empty(n, np.int64), np.full(n, -1), np.zeros(n)
    near, via, done = np.full(n, np.inf), np.full(n, root), np.zeros(n, bool)
    now = root
    for k in range(n):
        order[k], done[now] = now, True
        if now != root:
            parent[now], length[now] = via[now], near[now]
        d = distance(now)
        closer = (d < near) & ~done
        near[closer], via[closer] = d[closer], now
        now = int(np.where(done, np.inf, near).argmin())
        if done[now] and k + 1 < n:  # distances beyond the range of doubles
            now = int(np.flatnonzero(~done)[0])
    return order, parent, length


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first by score, then smaller id."""
    some = np.arange(len(score))
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return some[np.lexsort([~ids[some], score[some]])[::-1][:k]]


class Bounds:
    """Lower and upper bounds of the scores of a shard at each anchor of a block, in tree order."""

    def __init__(self, anchors: np.ndarray, points: np.ndarray):
        self.anchors, self.points = anchors, points
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((points**2).sum(axis=1))
        self.order, self.parent, self.length = spanning_tree(anchors)
        self.low, self.high = np.empty((len(anchors), len(points))), np.empty((len(anchors), len(points)))
        self.scored = 0

    def enter(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The bounds at an anchor from those at its parent; at the root from the scores."""
        p = self.parent[a]
        if p < 0:
            self.rescore(a, np.arange(len(self.points)))
        else:
            with np.errstate(over="ignore", invalid="ignore"):
                reach = np.where(self.norms == 0, 0, self.length[a] * self.norms * (1 + 1e-9) + 1e-3)
                slack = 1e-9 * (np.abs(self.low[p]) + np.abs(self.high[p]))
                self.low[a], self.high[a] = self.low[p] - reach - slack, self.high[p] + reach + slack
        return self.low[a], self.high[a]

    def rescore(self, a: int, at: np.ndarray) -> np.ndarray:
        score = products(self.points[at], self.norms[at], self.anchors[a])
        self.low[a, at] = self.high[a, at] = score
        self.scored += len(at)
        return score


def _unique(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(points, ids, labels)`` of distinct rows, by label and id."""
    points = np.floor(SCALE * np.stack(group["vector"].to_numpy()).astype(np.float64))
    ids, labels = group["id"].to_numpy(np.int64), group["label"].to_numpy(np.int64)
    by = np.lexsort([*points.T, ids, labels])
    points, ids, labels = points[by], ids[by], labels[by]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (points[1:] != points[:-1]).any(axis=1)
    return points[new], ids[new], labels[new]


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    points, ids, labels = _unique(group)
    return pd.DataFrame({"block": [group["block"].iloc[0]], "width": [points.shape[1]], "points": [points.tobytes()], "ids": [ids.tobytes()], "labels": [labels.tobytes()]})


def _unpack(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}_ids"], np.int64)
    return np.frombuffer(row[f"{side}_points"]).reshape(len(ids), row["width"]), ids, np.frombuffer(row[f"{side}_labels"], np.int64)


def positives_of(anchors: tuple, shard: tuple, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(anchor, ids, scores)``: the first ``k`` other rows of the anchor's label in the shard."""
    (points, own, label), (others, ids, labels) = anchors, shard
    some = np.isin(labels, label)
    others, ids, labels = others[some], ids[some], labels[some]
    if not len(ids):
        return
    bounds = Bounds(points, others)
    for a in bounds.order:
        low, high = bounds.enter(a)
        first, last = np.searchsorted(labels, label[a]), np.searchsorted(labels, label[a], side="right")
        fit = first + np.flatnonzero(ids[first:last] != own[a])
        if not len(fit):
            continue
        least = np.partition(low[fit], len(fit) - k)[len(fit) - k] if len(fit) > k else -np.inf
        fit = fit[high[fit] >= least]
        score = bounds.rescore(a, fit)
        top = best(score, ids[fit], k)
        yield int(a), ids[fit[top]], score[top]


def negatives_of(anchors: tuple, limits: list[list[int]], shard: tuple, k: int, least_percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(anchor, positive's place, ids, scores)``: the first ``k`` rows of other labels in each positive's window."""
    (points, own, label), (others, ids, labels) = anchors, shard
    if (label == label[0]).all():
        some = labels != label[0]
        others, ids, labels = others[some], ids[some], labels[some]
    if not len(ids):
        return
    bounds = Bounds(points, others)
    for a in bounds.order:
        low, high = bounds.enter(a)
        windows = [(j, -((-least_percent * p) // 100), p) for j, p in enumerate(limits[a])]
        windows = [(j, w, p) for j, w, p in windows if w <= p]
        if not windows:
            continue
        open_ = np.zeros(len(ids), bool)
        for _, w, p in windows:
            open_ |= (high >= w) & (low <= p)
        fit = np.flatnonzero(open_ & (labels != label[a]) & (ids != own[a]))
        score = bounds.rescore(a, fit)
        for j, w, p in windows:
            inside = np.flatnonzero((score >= w) & (score <= p))
            top = inside[best(score[inside], ids[fit[inside]], k)]
            if len(top):
                yield int(a), j, ids[fit[top]], score[top]


def _search_positives(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for a, ids, scores in positives_of(_unpack(row, "anchor"), _unpack(row, "shard"), k):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]] * len(ids), batch.schema.field("block").type), "a": np.full(len(ids), a), "positive_id": ids, "score": scores})

    return search


def _search_negatives(k: int, least_percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors = _unpack(row, "anchor")
                limits: list[list[int]] = [[] for _ in anchors[1]]
                names: list[list[int]] = [[] for _ in anchors[1]]
                for p in sorted(row["positives"], key=lambda p: (p["a"], p["place"])):
                    limits[p["a"]].append(p["score"])
                    names[p["a"]].append(p["positive_id"])
                for a, j, ids, scores in negatives_of(anchors, limits, _unpack(row, "shard"), k, least_percent):
                    n = len(ids)
                    yield pa.RecordBatch.from_pydict(
                        {"block": pa.array([row["block"]] * n, batch.schema.field("block").type), "a": np.full(n, a), "place": np.full(n, j, np.int32), "anchor_id": np.full(n, anchors[1][a]),
                         "positive_id": np.full(n, names[a][j]), "negative_id": ids, "positive_score": np.full(n, limits[a][j]), "negative_score": scores}
                    )

    return search


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component ``x`` becomes ``floor(256 x)``; the score of a row is its inner product with the anchor, exact up
    to 64 bits and the nearest long beyond. An anchor's positives are its first ``positives`` rows of the same
    label, higher scores first, then smaller ids; for each, its negatives are the first rows of other labels that
    score between ``least_percent`` hundredths of the positive and as much as it. Rows without an id or a label and vectors with a null or
    non-finite component take no part. Equal rows are one; of rows that share an id but differ, each counts, but none is
    a positive or negative of an anchor with its id. Vectors of different lengths aren't compared. A positive of a
    negative score has an empty window. Anchors without positives and an empty table give no rows.
    """
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), is_anchor.alias("is_anchor"))
    # Copies are folded where they are, so a row that repeats often meets no single task.
    rows = rows.where(usable("vector", "label", "id")).dropDuplicates().withColumn("width", F.size("vector")).withColumn("h", F.xxhash64("id", "label", "vector"))
    asked = rows.where("is_anchor")
    # Labels with many anchors have blocks of their own; the others share blocks.
    by_label = materialize(asked.groupBy("width", "label").agg(F.count("*").alias("n")), "anchor-labels")
    few = F.col("n") < ANCHOR_ROWS // 2
    shared = by_label.where(few).groupBy("width").agg(F.sum("n").alias("shared"))
    asked = asked.join(by_label, ["width", "label"]).join(shared, "width", "left")
    part = F.when(few, F.pmod(F.xxhash64("label"), F.ceil(F.col("shared") / ANCHOR_ROWS))).otherwise(F.pmod("h", F.ceil(F.col("n") / ANCHOR_ROWS)))
    place = F.struct("width", F.when(~few, F.col("label")).alias("label"), part.cast("long").alias("part"))
    blocks = materialize(asked.withColumn("block", place).select("block", "id", "label", "vector").groupBy("block").applyInPandas(_pack, BLOCK), "anchor-blocks")

    widths = materialize(rows.groupBy("width").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("shards")), "shard-counts")
    placed = rows.join(widths, "width")
    shard = F.struct("width", F.lit(None).cast("long").alias("label"), F.pmod("h", F.col("shards")).cast("long").alias("part"))
    shards = materialize(placed.withColumn("block", shard).select("block", "id", "label", "vector").groupBy("block").applyInPandas(_pack, BLOCK), "candidate-shards")
    shards = shards.select("width", F.col("block.part").alias("part"), *[F.col(c).alias(f"shard_{c}") for c in ("points", "ids", "labels")])

    def meet(asking: DataFrame) -> DataFrame:
        """Each block with each shard of its width, in blocks: the stated queries against all rows."""
        named = asking.select("block", "width", *[F.col(c).alias(f"anchor_{c}") for c in ("points", "ids", "labels")], *[c for c in asking.columns if c == "positives"])
        sent = named.join(widths, "width").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
        return sent.hint("merge").join(shards, ["width", "part"])

    found = meet(blocks).mapInArrow(_search_positives(positives), f"block {PLACE}, a bigint, positive_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("block", "a").orderBy(F.desc("score"), "positive_id"))
    chosen = found.withColumn("place", rank).where(F.col("place") <= positives)
    # At most ANCHOR_ROWS anchors of a block, about, with a few positives each.
    chosen = chosen.groupBy("block").agg(F.collect_list(F.struct("a", "place", "positive_id", "score")).alias("positives"))
    asking = materialize(blocks.join(chosen, "block"), "asking-blocks")
    schema = f"block {PLACE}, a bigint, place int, anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    found = meet(asking).mapInArrow(_search_negatives(negatives, least_percent), schema)
    rank = F.row_number().over(W.partitionBy("block", "a", "place").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
