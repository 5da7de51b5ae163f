"""Near-dedup by BagMinHash on multisets of word shingles.

A shingle that occurs ``c`` times has weight ``c``. Its weight axis is cut into the intervals (0, 1], (1, 2],
(2, 4], (4, 8], ...; each carries a Poisson process of points in time whose rate is its width, and each
point has a unit level in the interval and a slot of the signature. The points depend on shingle and
interval alone. A document sees the points below its weights and keeps the earliest of each slot;
two documents agree in a slot with a probability of exactly their weighted Jaccard similarity. A
document of total weight ``w`` needs points up to a time of about ``log(slots) / w`` only, hence a number that
doesn't grow with its length.

Slots are cut into bands. Documents that share a band are verified on the overlap of their multisets:
first against one pivot of the band's bucket, which is linear in the size of the bucket. Only
buckets whose members are still in different classes then compare, in blocks, members across classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curafold.llm.common import chunks, column_bytes, mix64, text_of
from curafold.llm.components import components
from curafold.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares none of 24 bands of 4 slots with probability 3e-6.
BANDS, BAND_SLOTS = 24, 4
SLOTS = BANDS * BAND_SLOTS
#: A slot stays empty with probability exp(-SLACK) / SLOTS; such a document draws again, further.
SLACK = 12.0
#: Members of a bucket that one task compares with as many others.
BLOCK = 256
COLUMNS = 4096

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
GOLD = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLD)
PLACE = mix64(np.arange(1001, 1001 + SHINGLE + 1, dtype=np.uint64) * GOLD) | np.uint64(1)
BASE = np.uint64(0x5851F42D4C957F2D)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = [_powers(BASE, 0), _powers(BASE_INVERSE, 0)]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row it belongs to; words are runs without separators."""
    n = len(data)
    if len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(BASE, n), _powers(BASE_INVERSE, n)]
    inside = ~SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    terms = BYTE_VALUE[data] * _POWERS[0][:n]
    terms[~inside] = 0
    hashes = mix64(np.add.reduceat(terms, starts) * _POWERS[1][starts])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, shingle, count)``, sorted. A text of fewer words than a shingle is one shingle; without words it has none."""
    hashes, row = words(data, offsets)
    n_rows = len(offsets) - 1
    n_words = np.bincount(row, minlength=n_rows)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    at = np.arange(len(hashes))
    ends = np.cumsum(n_words)
    left = ends[row] - at  # words from here to the end of the row
    value = np.zeros(len(hashes), np.uint64)
    for k in range(SHINGLE):
        value += np.where(left > k, padded[k : k + len(hashes)] * PLACE[k], np.uint64(0))
    value = mix64(value + np.minimum(left, SHINGLE).astype(np.uint64) * PLACE[SHINGLE])
    begins = at == (ends - n_words)[row]
    use = (left >= SHINGLE) | (begins & (n_words[row] < SHINGLE))
    row, value = row[use], value[use]
    order = np.lexsort([value, row])
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(new)
    return row[starts], value[starts], np.diff(np.append(starts, len(row)))


def signatures(row: np.ndarray, value: np.ndarray, count: np.ndarray, n_rows: int, reach: float = 1.0) -> np.ndarray:
    """The earliest point of each slot, ``n_rows x SLOTS``; rows without shingles have infinity."""
    total = np.bincount(row, count, n_rows)
    limit = reach * (np.log(SLOTS) + SLACK) / np.maximum(total, 1)
    levels = 1 + np.ceil(np.log2(count)).astype(np.int64)
    element = np.repeat(np.arange(len(row)), levels)
    interval = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(interval == 0, 1, 1 << np.maximum(interval - 1, 0)).astype(np.uint64)
    low = np.where(interval == 0, 0, width)
    seed = mix64(value[element] + (interval.astype(np.uint64) + np.uint64(1)) * PLACE[0])
    row, count = row[element], count[element]
    best = np.full(n_rows * SLOTS, np.inf)
    active, time, drawn, step = np.arange(len(element)), np.zeros(len(element)), 0, 1
    while len(active):
        a_row, a_width = row[active], width[active]
        random = mix64(seed[active][:, None] + np.arange(drawn + 1, drawn + step + 1, dtype=np.uint64) * GOLD)
        gap = -np.log1p(-(random >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (SLOTS * a_width.astype(np.float64))[:, None]
        gap[:, 0] += time
        when = np.cumsum(gap, axis=1)
        where = mix64(random ^ PLACE[1])
        level = low[active][:, None] + (((where & np.uint64(0xFFFFFFFF)) * a_width[:, None]) >> np.uint64(32)).astype(np.int64)
        seen = (when <= limit[a_row][:, None]) & (level < count[active][:, None])
        slot = (((where >> np.uint64(32)) * np.uint64(SLOTS)) >> np.uint64(32)).astype(np.int64) + (a_row * SLOTS)[:, None]
        np.minimum.at(best, slot[seen], when[seen])
        go_on = when[:, -1] <= limit[a_row]
        active, time = active[go_on], when[go_on, -1]
        drawn, step = drawn + step, min(2 * step, 64)
    best = best.reshape(n_rows, SLOTS)
    short = np.flatnonzero((total > 0) & np.isinf(best).any(axis=1))
    if len(short):
        again = np.isin(row, short) & (interval == 0)
        renumber = np.zeros(n_rows, np.int64)
        renumber[short] = np.arange(len(short))
        best[short] = signatures(renumber[row[again]], value[element[again]], count[again], len(short), reach * 2)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, of the band's number and its slots."""
    bits = best.view(np.uint64).reshape(len(best), BANDS, BAND_SLOTS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD, (len(best), BANDS)).copy()
    for k in range(BAND_SLOTS):
        key = mix64(key ^ bits[:, :, k]) * PLACE[2] + PLACE[3]
    return key.view(np.int64)


def units(row: np.ndarray, value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multiset as a set: the j-th copy of a shingle is a unit of its own, so overlaps are set overlaps."""
    at = np.repeat(np.arange(len(row)), count)
    copy = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return row[at], mix64(value[at] + copy.astype(np.uint64) * GOLD).view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        for a, b in chunks(offsets):
            row, value, count = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total = np.bincount(row, count, b - a).astype(np.int64)
            keys = band_keys(signatures(row, value, count, b - a))
            bands = _lists(keys[total > 0].ravel(), np.where(total > 0, BANDS, 0))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(total), bands], ["id", "key", "weight", "bands"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        for a, b in chunks(offsets):
            row, unit = units(*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            lists = _lists(unit, np.bincount(row, minlength=b - a))
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), lists], ["key", "units"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 blocks over the units that occur twice."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, unit, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[unit] > 1
    owner, unit = owner[shared], number[unit[shared]]
    order = np.argsort(unit, kind="stable")
    owner, unit = owner[order], unit[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(unit[-1]) + 1 if len(unit) else 0, COLUMNS):
        a, b = np.searchsorted(unit, [start, start + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[a:b], unit[a:b] - start] = 1
        out += block @ block.T
    return out


def _across(similarity: float):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """Links between classes inside a block of a bucket, one for each pair of classes."""
        group = group.sort_values("key").reset_index(drop=True)
        common = overlaps([np.asarray(u) for u in group["units"]])
        weight = group["weight"].to_numpy(np.float64)
        similar = common >= similarity * (weight[:, None] + weight[None, :] - common) - 1e-6
        label, names = pd.factorize(group["root"])
        a, b = np.nonzero(np.triu(similar, 1) & (label[:, None] != label[None, :]))
        pairs = np.unique(np.stack([np.minimum(label[a], label[b]), np.maximum(label[a], label[b])], axis=1), axis=0)
        return pd.DataFrame({"u": [names[i] for i in pairs[:, 0]], "v": [names[i] for i in pairs[:, 1]]})

    return compare


#: Stands for a null id in joins.
NO_ID = -(1 << 63)


def _rows(docs: DataFrame, text: str, doc_id: str, *more: Column) -> DataFrame:
    """``more`` columns of each row with its ``id`` and the ``key`` of its text."""
    return docs.select(*more, F.col(f"`{doc_id}`").cast("long").alias("id"), F.unhex(F.md5(text_of(text))).alias("key"))


def _text_classes(docs: DataFrame, text: str, doc_id: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(rows, texts)``: ``id, key`` of each row, and ``key, rep, copies, root`` of each distinct text: its smallest id,
    its rows and its class."""
    source = _rows(docs, text, doc_id, text_of(text).alias("text")).select("id", "key", "text")
    sketch = materialize(source.mapInArrow(_sketch, "id bigint, key binary, weight bigint, bands array<bigint>"), "sketch")

    reps = sketch.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    reps = materialize(reps, "texts")
    banded = reps.select("key", "weight", F.explode("bands").alias("band"))
    order = F.struct(F.xxhash64("key"), "key", "weight")
    buckets = banded.groupBy("band").agg(F.count("*").alias("members"), F.min(order).alias("pivot")).where("members > 1")
    members = banded.join(buckets, "band").select("band", "members", "key", "weight", F.col("pivot.key").alias("pivot"), F.col("pivot.weight").alias("pivot_weight"))
    members = materialize(members, "bucket-members")

    candidates = members.select("key").distinct().join(reps.select("key", "rep"), "key")
    # One row of each candidate text; the key keeps rows that share an id, or have none, apart.
    wanted = candidates.select("key", F.coalesce("rep", F.lit(NO_ID)).alias("id"))
    texts = source.withColumn("id", F.coalesce("id", F.lit(NO_ID))).join(wanted, ["key", "id"]).select("key", "text")
    sets = materialize(texts.mapInArrow(_units, "key binary, units array<bigint>").dropDuplicates(["key"]), "units")

    # Pass 1: every member against the pivot of its buckets.
    short = F.least("weight", "pivot_weight") >= similarity * F.greatest("weight", "pivot_weight") - 1e-6
    pairs = members.where((F.col("key") != F.col("pivot")) & short).groupBy("key", "pivot").agg(F.first("weight").alias("weight"), F.first("pivot_weight").alias("pivot_weight"))
    pairs = pairs.join(sets, "key").join(sets.select(F.col("key").alias("pivot"), F.col("units").alias("pivot_units")), "pivot")
    common = F.size(F.array_intersect("units", "pivot_units"))
    linked = pairs.where(common >= similarity * (F.col("weight") + F.col("pivot_weight") - common) - 1e-6)
    first = materialize(components(linked.select(F.col("key").alias("u"), F.col("pivot").alias("v"))), "classes")

    # Pass 2: buckets of three and more that still hold different classes compare across classes.
    inside = members.where("members > 2").select("band", "key", "weight").join(first.withColumnRenamed("node", "key"), "key", "left")
    inside = inside.withColumn("root", F.coalesce("root", "key"))
    tally = inside.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = tally.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
    mixed = mixed.select("band", F.col("main.root").alias("main"), F.ceil(F.col("main.n") / BLOCK).alias("main_blocks"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("rest_blocks"))
    rows = inside.join(mixed, "band")
    is_main = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("key"), F.when(is_main, F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("long")
    rest, main = F.sequence(F.lit(0).cast("long"), F.col("rest_blocks") - 1), F.sequence(F.lit(0).cast("long"), F.col("main_blocks") - 1)
    # A block pair is (smaller rest block, larger rest block, -1) or (rest block, -1, block of the main class).
    none = F.lit(-1).cast("long")
    with_rest = F.transform(rest, lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j"), none.alias("k")))
    with_main = F.transform(main, lambda k: F.struct(F.col("own").alias("i"), none.alias("j"), k.alias("k")))
    from_main = F.transform(rest, lambda i: F.struct(i.alias("i"), none.alias("j"), F.col("own").alias("k")))
    rows = rows.withColumn("own", own).withColumn("block", F.explode(F.when(is_main, from_main).otherwise(F.concat(with_rest, with_main))))
    rows = rows.select("band", "block.*", "key", "weight", "root").join(sets, "key")
    across = rows.groupBy("band", "i", "j", "k").applyInPandas(_across(similarity), "u binary, v binary")
    second = components(across)

    final = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = second.join(first, "node", "left_anti")  # texts that pass 2 linked for the first time
    final = final.unionByName(alone)
    named = reps.select("key", "rep", "copies").join(final.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = materialize(named, "text-classes")
    return sketch.select("id", "key"), named


def near_duplicate_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, class_size``: one row per document, dropped ones too.

    Classes are the connected components of pairs with a weighted Jaccard similarity of at least
    ``similarity`` on shingles of five words; the id of a class is its smallest document id. Equal texts are one
    text with many documents. A document without words (null, empty or blank) has no shingles and is only
    in one class with texts equal to its own. Null ids count as absent when the smallest is taken.
    """
    rows, named = _text_classes(docs, text, doc_id, similarity)
    classes = named.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    labels = named.join(classes, "root").select("key", "class_id", "class_size")
    return rows.join(labels, "key").select(F.col("id").alias(doc_id), "class_id", "class_size")


def near_deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its own columns: the one with the smallest id, or any one of those that share it.
    A class without any id keeps one document as well."""
    _, named = _text_classes(docs, "text", "doc_id", similarity)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "key")).alias("first"))
    stays = first.select("first.key", F.coalesce("first.rep", F.lit(NO_ID)).alias("id"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = _rows(docs, "text", "doc_id", row).withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    return rows.join(stays, ["key", "id"]).select("key", "doc").dropDuplicates(["key"]).select("doc.*")
