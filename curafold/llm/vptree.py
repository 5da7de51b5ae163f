"""Nearest neighbours by vantage-point trees, one per shard of near vectors.

Vectors are scaled to length one, where the Euclidean distance orders like the cosine and obeys the
triangle inequality. A node's points are split at the median distance to its vantage point; a side is
skipped if the bounds of its distances rule out anything nearer than the worst neighbour found so far,
divided by ``factor``. A factor of one is exact search; a larger one skips more.
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

NEIGHBOURS = 5
#: Divides the reach of a search; see the README for recall against brute force.
FACTOR = 1.0
SHARD_ROWS, QUERY_ROWS, LEAF = 16_384, 2_048, 128
#: Sampled vectors at most that cells are formed around; beyond that many shards, cells hold several.
MAX_CENTRES = 2_048
#: Neighbours kept beyond the wanted ones until the exact measure has ordered them.
SPARE = 8
#: Scores closer than this may be a tie. Rounding moves distances of unit vectors by less than the slack.
TIE, SLACK = 1e-12, 1e-7
#: Points of a wider search that are held at a time.
WIDE_POINTS = 65_536


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one. Scaling by the largest component first keeps squares in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision, summed in the order of the components."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        dot += a[:, k] * b[:, k]
        aa += a[:, k] * a[:, k]
        bb += b[:, k] * b[:, k]
    return np.clip(dot / np.sqrt(aa * bb), -1.0, 1.0)


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, inner, outer)`` of a tree over unit vectors.

    The node of a range has its vantage point first, then the nearer half, then the farther one;
    ``inner`` and ``outer`` at its first place hold the largest distance in the nearer half and the
    smallest in the farther one.
    """
    n = len(points)
    order, inner, outer = np.arange(n), np.zeros(n), np.zeros(n)
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if high - low <= LEAF:
            continue
        # Of a few points spread over the range, the one whose distances to the others vary most.
        tried = low + np.arange(5) * ((high - low - 1) // 5)
        probe = order[low : high : max(1, (high - low) // 64)]
        spread = (points[order[tried]] @ points[probe].T).var(axis=1)
        pick = tried[int(spread.argmax())]
        order[[low, pick]] = order[[pick, low]]
        rest = order[low + 1 : high]
        distance = np.sqrt(np.maximum(0, 2 - 2 * (points[rest] @ points[order[low]])))
        by = np.argsort(distance, kind="stable")
        order[low + 1 : high], distance = rest[by], distance[by]
        mid = (low + 1 + high) // 2
        inner[low], outer[low] = distance[mid - low - 2], distance[mid - low - 1]
        stack += [(low + 1, mid), (mid, high)]
    return order, inner, outer


class Search:
    """The nearest points of a batch of unit queries; points are in tree order."""

    def __init__(self, points: np.ndarray, inner: np.ndarray, outer: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.points, self.inner, self.outer, self.queries, self.factor = points, inner, outer, queries, factor
        self.similarity = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1, np.int64)
        self.visit(0, len(points), np.arange(len(queries)))

    def reach(self, active: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * self.similarity[active, -1])) / self.factor

    def offer(self, active: np.ndarray, low: int, high: int) -> np.ndarray:
        close = self.queries[active] @ self.points[low:high].T
        better = np.flatnonzero((close > self.similarity[active, -1:]).any(axis=1))
        if len(better):
            rows, k = active[better], self.similarity.shape[1]
            both = np.concatenate([self.similarity[rows], close[better]], axis=1)
            at = np.concatenate([self.found[rows], np.broadcast_to(np.arange(low, high), (len(rows), high - low))], axis=1)
            best = np.argpartition(-both, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(both, best, 1), axis=1, kind="stable"), 1)
            self.similarity[rows], self.found[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(at, best, 1)
        return close

    def visit(self, low: int, high: int, active: np.ndarray) -> None:
        if not len(active) or low >= high:
            return
        if high - low <= LEAF:
            self.offer(active, low, high)
            return
        distance = np.sqrt(np.maximum(0, 2 - 2 * self.offer(active, low, low + 1)[:, 0]))
        mid = (low + 1 + high) // 2
        nearer = distance <= (self.inner[low] + self.outer[low]) / 2
        for side, first in ((nearer, True), (~nearer, False)):
            group, d = active[side], distance[side]
            if not len(group):
                continue
            for inside in (first, not first):
                gap = d - self.inner[low] if inside else self.outer[low] - d
                left = group[gap <= self.reach(group) + SLACK]
                self.visit(*((low + 1, mid) if inside else (mid, high)), left)


def _index(k: int):
    def index(group: pd.DataFrame) -> pd.DataFrame:
        """A shard's tree as one row. Equal vectors are one point with its smallest ids; a query needs
        no more of them than its neighbours and itself."""
        vectors = np.stack(group["vector"].to_numpy()).astype(np.float64)
        ids = group["id"].to_numpy(np.int64)
        points, where = np.unique(vectors, axis=0, return_inverse=True)
        where = where.ravel()
        by = np.lexsort([ids, where])
        ids, where = ids[by], where[by]
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == ids[:-1]) & (where[1:] == where[:-1])
        ids, where = ids[~again], where[~again]
        place = np.arange(len(ids)) - np.searchsorted(where, where)
        ids, where = ids[place <= k], where[place <= k]
        order, inner, outer = build(unit(points))
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        by = np.lexsort([ids, at[where]])
        return pd.DataFrame(
            {"shard": [group["shard"].iloc[0]], "width": [vectors.shape[1]], "points": [points[order].tobytes()], "inner": [inner.tobytes()],
             "outer": [outer.tobytes()], "ids": [ids[by].tobytes()], "at": [at[where][by].tobytes()]}
        )

    return index


def _block(group: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack(group["vector"].to_numpy()).astype(np.float64)
    ids = group["id"].to_numpy(np.int64)
    return pd.DataFrame({"block": [group["block"].iloc[0]], "width": [vectors.shape[1]], "queries": [vectors.tobytes()], "query_ids": [ids.tobytes()]})


def _top(row: dict, k: int, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(query, item, score)`` of the ``k`` nearest of a shard for each query of a block, best first."""
    points = np.frombuffer(row["points"]).reshape(-1, row["width"])
    queries = np.frombuffer(row["queries"]).reshape(-1, row["width"])
    query_ids = np.frombuffer(row["query_ids"], np.int64)
    ids, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["at"], np.int64)
    tree = unit(points), np.frombuffer(row["inner"]), np.frombuffer(row["outer"])
    want = min(len(points), k + 1 + SPARE)
    parts = [np.arange(len(queries))]
    while parts:
        open_ = []
        for part in parts:
            asked, own = queries[part], query_ids[part]
            search = Search(*tree, unit(asked), want, factor)
            query, point = np.repeat(np.arange(len(part)), want), search.found.ravel()
            query, point = query[point >= 0], point[point >= 0]
            score = cosine(asked[query], points[point])
            first, last = np.searchsorted(at, point), np.searchsorted(at, point, side="right")
            times = last - first
            query, score = np.repeat(query, times), np.repeat(score, times)
            item = ids[np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            other = item != own[query]
            query, score, item = query[other], score[other], item[other]
            # Of an id with several vectors the nearest one counts.
            by = np.lexsort([-score, item, query])
            query, score, item = query[by], score[by], item[by]
            new = np.ones(len(query), bool)
            new[1:] = (query[1:] != query[:-1]) | (item[1:] != item[:-1])
            query, score, item = query[new], score[new], item[new]
            by = np.lexsort([item, -score, query])
            query, score, item = query[by], score[by], item[by]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            # Points that were not kept may tie with the last neighbour; a wider search settles it.
            least = np.full(len(part), -np.inf)
            least[query[place == k - 1]] = score[place == k - 1]
            tied = (least <= search.similarity[:, -1] + TIE) if want < len(points) else np.zeros(len(part), bool)
            top = (place < k) & ~tied[query]
            open_.append(part[tied])
            yield part[query[top]], item[top], score[top]
        again = np.concatenate(open_)
        want = min(len(points), 4 * want)
        step = max(1, WIDE_POINTS // want)
        parts = [again[i : i + step] for i in range(0, len(again), step)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows that follow each other and name one shard as one row, of up to ``QUERY_ROWS`` queries: a tree is walked for many at once."""
    row: dict = {}
    for batch in batches:
        asked, own, shards = (batch.column(batch.schema.names.index(c)) for c in ("queries", "query_ids", "shard"))
        for i in range(batch.num_rows):
            shard, ids = shards[i].as_py(), own[i].as_py()
            if row and row["shard"] == shard and len(row["query_ids"]) + len(ids) <= QUERY_ROWS * 8:
                row["queries"] += asked[i].as_py()
                row["query_ids"] += ids
            else:
                if row:
                    yield row
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
    if row:
        yield row


def _search(k: int, factor: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            own = np.frombuffer(row["query_ids"], np.int64)
            for query, item, score in _top(row, k, factor):
                yield pa.RecordBatch.from_pydict({"query_id": own[query], "vec_id": item, "score": score})

    return search


def _apart(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (queries @ centres.T)))


def _place(centres: dict[int, np.ndarray]):
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cell of each vector, the one of its nearest centre, and its distance to it."""
        for frame in frames:
            for width, part in frame.groupby("width"):
                cell, apart = np.zeros(len(part), np.int64), np.zeros(len(part))
                if width in centres:
                    vectors = unit(np.stack(part["vector"].to_numpy()).astype(np.float64))
                    for a in range(0, len(part), QUERY_ROWS):
                        d = _apart(vectors[a : a + QUERY_ROWS], centres[width])
                        cell[a : a + QUERY_ROWS], apart[a : a + QUERY_ROWS] = d.argmin(axis=1), d.min(axis=1)
                yield part.assign(cell=cell, apart=apart)

    return place


def _route(k: int, factor: float, centres: dict[int, np.ndarray], reach: dict[int, list[tuple[int, float, float]]]):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each cell, the queries of a block that may have a neighbour there, judged by their ``k``-th one at home."""
        for row in _rows(batches):
            width = row["width"]
            if width not in centres:
                yield pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "cell": [0], "queries": [row["queries"]], "query_ids": [row["query_ids"]]})
                continue
            queries, own = np.frombuffer(row["queries"]).reshape(-1, width), np.frombuffer(row["query_ids"], np.int64)
            least, times = np.full(len(own), np.inf), np.zeros(len(own), np.int64)
            for query, _, score in _top(row, k, factor):
                np.minimum.at(least, query, score)
                np.add.at(times, query, 1)
            worst = np.where(times == k, np.sqrt(np.maximum(0, 2 - 2 * np.where(times == k, least, 0))), np.inf) / factor
            for a in range(0, len(own), QUERY_ROWS):
                apart = _apart(unit(queries[a : a + QUERY_ROWS]), centres[width])
                for cell, low, high in reach[width]:
                    gap = np.maximum(apart[:, cell] - high, low - apart[:, cell])
                    go = a + np.flatnonzero(gap <= worst[a : a + QUERY_ROWS] + 2 * SLACK)
                    if len(go):
                        yield pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "cell": [cell], "queries": [queries[go].tobytes()], "query_ids": [own[go].tobytes()]})

    return route


def _centres(rows: DataFrame, n_centres: int, shard_rows: int) -> dict[int, np.ndarray]:
    """Unit vectors by length of vectors: those of the ``n_centres`` rows with the smallest hashes, of lengths that fill more than a shard."""
    large = rows.groupBy("width").count().where(F.col("count") > shard_rows).select("width")
    sample = rows.join(large, "width").select("width", "vector").orderBy(F.xxhash64("id", F.lit(2)), "id", "vector").limit(n_centres)
    found: dict[int, list[list[float]]] = {}
    for r in sample.collect():  # at most MAX_CENTRES rows
        found.setdefault(r["width"], []).append(r["vector"])
    return {w: np.unique(unit(np.array(v, np.float64)), axis=0) for w, v in found.items()}


def nearest(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, factor: float = FACTOR, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows of each row that ``is_query``.

    Every row is indexed, in the cell of the nearest of at most ``MAX_CENTRES`` sampled vectors; a cell with more than
    ``shard_rows`` rows has several shards. Blocks of queries search a shard of their own cell first. Their ``k``-th neighbour there
    rules out cells by the triangle inequality, relaxed by ``factor`` as within a tree, and each query visits all
    shards of the other cells. Vectors of different lengths aren't compared. Rows without an id and
    vectors that aren't ``usable`` take no part. Rows with equal id and vector are one; of an id with several vectors
    the nearest pair counts, as query and as neighbour. A query is never its own neighbour, nor is another row with its id. Ties go to the smaller id. With fewer than ``k``
    candidates all are given; an empty table gives no rows.
    """
    rows = vectors.where(usable(f"`{vector}`") & F.col(f"`{vec_id}`").isNotNull())
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), is_query.alias("query"))
    # Copies are folded where they are, so a row that repeats often meets no single task.
    rows = materialize(rows.dropDuplicates().withColumn("width", F.size("vector")), "vp-rows")
    centres = _centres(rows, min(MAX_CENTRES, -(-rows.count() // shard_rows)), shard_rows)
    kept = "id bigint, vector array<double>, query boolean, width int, cell bigint, apart double"
    placed = rows.mapInPandas(_place(centres), kept) if centres else rows.withColumns({"cell": F.lit(0).cast("long"), "apart": F.lit(0.0)})
    placed = materialize(placed, "vp-cells")
    cells = placed.groupBy("width", "cell").agg(
        F.min("apart").alias("low"), F.max("apart").alias("high"), F.ceil(F.count("*") / shard_rows).alias("shards"), F.ceil(F.sum(F.col("query").cast("long")) / QUERY_ROWS).alias("blocks")
    )
    cells = materialize(cells, "vp-cell-sizes")
    reach: dict[int, list[tuple[int, float, float]]] = {}
    for r in cells.where(F.col("width").isin(list(centres))).collect():  # at most a row per centre
        reach.setdefault(r["width"], []).append((r["cell"], r["low"], r["high"]))
    placed = placed.join(cells, ["width", "cell"])

    def shard(s: Column) -> Column:
        return F.struct("width", "cell", s.cast("long").alias("s")).alias("shard")

    index = placed.select(shard(F.pmod(F.xxhash64("id"), F.col("shards"))), "id", "vector").groupBy("shard").applyInPandas(
        _index(k), "shard struct<width:int,cell:bigint,s:bigint>, width int, points binary, inner binary, outer binary, ids binary, at binary"
    )
    index = materialize(index, "vp-index")
    asked = placed.where("query").withColumn("block", F.struct("width", "cell", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("long").alias("b"), "shards"))
    blocks = asked.select("block", "id", "vector").groupBy("block").applyInPandas(
        _block, "block struct<width:int,cell:bigint,b:bigint,shards:bigint>, width int, queries binary, query_ids binary"
    )
    home = blocks.select("block.*", "queries", "query_ids").select(shard(F.pmod(F.col("b"), F.col("shards"))), "queries", "query_ids")
    routes = index.hint("merge").join(home, "shard").mapInArrow(_route(k, factor, centres, reach), "width int, cell bigint, queries binary, query_ids binary")
    sent = routes.join(cells.select("width", "cell", "shards"), ["width", "cell"]).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    sent = sent.select(shard(F.col("s")), "queries", "query_ids")
    found = index.hint("merge").join(sent, "shard").mapInArrow(_search(k, factor), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
