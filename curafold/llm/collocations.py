"""Phrase collocations by stripes.

A stripe is a prefix with an associative counter of its next words; the words themselves are the stripe of the
empty prefix. Tasks build the stripes of one phrase length from their texts, owners merge them elementwise, and
one merged table of ``(prefix, next word, count)`` holds everything: phrase counts, the totals of prefixes, and
the largest count among the extensions of a phrase.

Lengths are counted one after the other. A phrase can only be frequent if both phrases that it has one word more
than are, so a Bloom filter of the frequent ones of the length before, of bounded size, keeps most others from
being counted. Its false hits are counted like others and fall to the exact threshold, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curafold.llm.common import column_bytes, mix64, text_of
from curafold.session import materialize

LONGEST, LEAST, TOP = 5, 100, 2000
#: A stripe is cut in so many parts by a hash of the next word, so that no prefix is one task.
PARTS = {1: 1024}
MORE_PARTS = 4
#: Stripes travel in so many bundles by a hash of prefix and part; a row for each would be many times longer.
BUNDLES = 4096
#: Phrases of more words are counted in one pass: few of them aren't frequent if what they consist of is.
ALONE = 3
#: Bytes of text that a task turns into stripes at a time; a longer piece is taken whole.
TEXT_BYTES = 16 << 20
#: Filter bits: about 16 a phrase, between these bounds (64 MB at most).
LEAST_BITS, MOST_BITS, PROBES = 1 << 16, 1 << 29, 4
#: The phrases of a language are cut down to the best in so many groups first.
RANK_GROUPS = 256

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: 0 a byte of a word, 1 a blank, 2 the end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[32, 9]] = 1
KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2

#: Prefixes, next words and counts of a bundle: a line for each stripe, with spaces between. Words hold neither.
STRIPE = "lang string, bundle int, prefix string, next string, n string"
COUNT = "lang string, prefix string, next string, f bigint"


def words_of(body: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(words, row, piece)`` of lower-cased texts: the words, the text of each and a number of its piece."""
    kind = KIND[body]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = ends[:-1][(ends[:-1] < ends[1:])]
    begins[starts] = inside[starts]
    closes = kind == 2
    at = np.flatnonzero(begins)
    row = np.searchsorted(ends, at, side="right") - 1
    piece = np.cumsum(closes, dtype=np.int32)[at] + row
    # Words are the bytes that aren't separators, cut where a word begins.
    kept = np.ascontiguousarray(body[inside])
    place = np.cumsum(inside, dtype=np.int32)[at] - 1
    offsets = np.append(place, len(kept)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(kept))
    return words, row, piece


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes; used by the filter only, never for equality."""
    body, ends = column_bytes(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    place = np.arange(len(body)) - np.repeat(ends[:-1], np.diff(ends))
    with np.errstate(over="ignore"):
        salted = mix64(body.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        return mix64(sums[ends[1:]] - sums[ends[:-1]])


def chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its prefix and that of its last word."""
    with np.errstate(over="ignore"):
        return mix64(before * np.uint64(0x9E3779B97F4A7C15) + word)


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits that a phrase sets, one row of ``PROBES`` for each."""
    step = mix64(hashes) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def contains(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    step, bits = mix64(hashes) | np.uint64(1), np.uint64(len(filter_) * 8 - 1)
    with np.errstate(over="ignore"):
        for k in range(PROBES):
            at = (hashes + step * np.uint64(k)) & bits
            found &= (filter_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _filter(level: DataFrame) -> np.ndarray:
    """Bloom filter of the phrases of a level. The driver gets at most ``MOST_BITS / 64`` words of it."""
    n = level.count()
    bits = LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = hash_phrases(batch.column("lang"), batch.column("phrase"))
            at = np.unique(probes(hashes, bits).ravel())
            word = (at >> np.uint64(6)).astype(np.int64)
            mask = np.uint64(1) << (at & np.uint64(63))
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            masks = np.bitwise_or.reduceat(mask, first) if len(first) else mask
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(masks.view(np.int64))], ["word", "mask"])

    rows = level.select("lang", phrase().alias("phrase")).mapInArrow(run, "word bigint, mask bigint")
    found = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return words.view(np.uint8)


def hash_phrases(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hashes of whole phrases, as a task computes them word by word."""
    parts = pc.split_pattern(pc.cast(phrases, pa.large_string()), " ")
    hashes = hash_words(pc.list_flatten(parts))
    count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(count) - count
    out = hash_words(pc.cast(langs, pa.large_string()))
    for k in range(int(count.max(initial=0))):
        more = np.flatnonzero(count > k)
        out[more] = chained(out[more], hashes[start[more] + k])
    return out


def phrase() -> Column:
    return F.concat(F.col("prefix"), F.when(F.col("prefix") == "", "").otherwise(" "), F.col("next"))


def joined(texts: pa.Array, offsets: pa.Array, by: str) -> pa.Array:
    """Runs of texts as one text each."""
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, texts), pa.scalar(by, pa.large_string()))


def stripes_of(langs: list[str], body: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...], filter_: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The stripes of some phrase lengths over some texts. The filter has the frequent phrases of one word less than the shortest."""
    words, row, piece = words_of(LOWERED[body], ends)
    if not len(words):
        return
    coded = words.dictionary_encode()
    word, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    if lengths[0] <= 2:  # long stripes are shorter in a shuffle if their words are sorted
        by = pc.sort_indices(known).to_numpy()
        known, place = known.take(pa.array(by)), np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        word = place[word]
    names = sorted(set(langs))
    code = {name: i for i, name in enumerate(names)}
    lang = np.array([code[x] for x in langs], np.int64)[row]
    hashed = hash_words(known)
    passed, span = None, lengths[0] - 1
    if filter_ is not None:
        hash_ = hash_words(pa.array(names, pa.large_string()))[lang]
        for k in range(span):
            hash_ = chained(hash_[: len(word) - k], hashed[word[k:]])
        passed = contains(filter_, hash_)
    for length in lengths:
        n = len(word) - length + 1
        if n <= 0:
            return
        at = np.flatnonzero(piece[:n] == piece[length - 1 :])
        if passed is not None:
            for k in range(length - span + 1):
                at = at[passed[at + k]]
        if len(at):
            yield _grouped(names, lang, word, known, hashed, at, length)


def _grouped(names: list[str], lang: np.ndarray, word: np.ndarray, known: pa.Array, hashed: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """The phrases at the places ``at`` as stripes."""
    # The prefix as a number: exact, by numbering the distinct pairs step by step.
    group = lang[at]
    for k in range(length - 1):
        group = np.unique(group * len(known) + word[at + k], return_inverse=True)[1].ravel()
    pairs, first, counts = np.unique(group * len(known) + word[at + length - 1], return_index=True, return_counts=True)
    group, last, first = pairs // len(known), pairs % len(known), at[first]
    part = (hashed[last] % np.uint64(PARTS.get(length, MORE_PARTS))).astype(np.int64)
    order = np.lexsort([part, group])
    group, last, first, part, counts = group[order], last[order], first[order], part[order], counts[order]
    heads = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])))
    ends = pa.array(np.append(heads, len(group)))
    head, lang = first[heads], lang[first[heads]]
    prefix, hash_ = pa.array([""] * len(heads), pa.large_string()), np.zeros(len(heads), np.uint64)
    if length > 1:
        each = [word[head + k] for k in range(length - 1)]
        prefix = pc.binary_join_element_wise(*[known.take(pa.array(w)) for w in each], pa.scalar(" ", pa.large_string()))
        for w in each:
            hash_ = chained(hash_, hashed[w])
    bundle = ((hash_ + part[heads].astype(np.uint64)) % np.uint64(BUNDLES)).astype(np.int64)
    stripes = [prefix, joined(known.take(pa.array(last)), ends, " "), joined(pc.cast(pa.array(counts), pa.large_string()), ends, " ")]
    order = np.lexsort([bundle, lang])
    bundle, lang = bundle[order], lang[order]
    heads = np.flatnonzero(np.append(True, (bundle[1:] != bundle[:-1]) | (lang[1:] != lang[:-1])))
    ends = pa.array(np.append(heads, len(bundle)))
    lines = [pc.cast(joined(x.take(pa.array(order)), ends, "\n"), pa.string()) for x in stripes]
    langs = pa.array(names, pa.string()).take(pa.array(lang[heads]))
    return pa.RecordBatch.from_arrays([langs, pa.array(bundle[heads].astype(np.int32)), *lines], ["lang", "bundle", "prefix", "next", "n"])


def _texts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """``(langs, bytes, ends)`` of about ``limit`` bytes. A longer text is cut at the ends of pieces."""
    langs: list[str] = []
    bodies: list[np.ndarray] = []
    size = 0
    for batch in batches:
        body, ends = column_bytes(batch.column("text"))
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            at, stop = int(ends[i]), int(ends[i + 1])
            while at < stop:
                upto = min(stop, at + limit - size)
                if upto < stop:
                    breaks = np.flatnonzero(KIND[body[at:upto]] == 2)
                    if len(breaks):
                        upto = at + int(breaks[-1]) + 1
                    elif size:
                        upto = at
                    else:
                        breaks = np.flatnonzero(KIND[body[upto:stop]] == 2)
                        upto = upto + int(breaks[0]) + 1 if len(breaks) else stop
                if upto > at:
                    langs.append(lang)
                    bodies.append(np.array(body[at:upto]))
                    size += upto - at
                    at = upto
                if size >= limit or at < stop:
                    yield langs, np.concatenate(bodies), np.cumsum([0, *map(len, bodies)])
                    langs, bodies, size = [], [], 0
    if bodies:
        yield langs, np.concatenate(bodies), np.cumsum([0, *map(len, bodies)])


def _stripes(lengths: tuple[int, ...], filter_, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, body, ends in _texts(batches, limit):
            for made in stripes_of(langs, body, ends, lengths, filter_.value if filter_ is not None else None):
                for start in range(0, made.num_rows, 1024):
                    yield made.slice(start, 1024)

    return run


def summed(rows: pa.Table, keys: list[str]) -> pa.Table:
    return rows.group_by(keys).aggregate([("f", "sum")]).select([*keys, "f_sum"]).rename_columns([*keys, "f"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up stripes elementwise. They come sorted, so what is held is one bundle, or some small ones."""
    held: pa.Table | None = None
    keys = ["lang", "prefix", "next"]
    for batch in batches:
        lines = pc.split_pattern(batch.column("prefix"), "\n")
        row = pc.list_parent_indices(lines)
        next_, n = (pc.split_pattern(pc.list_flatten(pc.split_pattern(batch.column(c), "\n")), " ") for c in ("next", "n"))
        stripe = pc.list_parent_indices(next_)
        row = row.take(stripe)
        flat = pa.table(
            {
                "lang": batch.column("lang").take(row), "prefix": pc.list_flatten(lines).take(stripe), "next": pc.list_flatten(next_),
                "bundle": batch.column("bundle").take(row), "f": pc.cast(pc.list_flatten(n), pa.int64()),
            }
        )
        if not flat.num_rows:
            continue
        held = flat if held is None else pa.concat_tables([held, flat])
        if held.num_rows < 200_000:
            continue
        open_ = pc.and_(pc.equal(held.column("lang"), held.column("lang")[-1]), pc.equal(held.column("bundle"), held.column("bundle")[-1]))
        done = held.filter(pc.invert(open_))
        if done.num_rows:
            yield from summed(done, keys).to_batches()
        held = summed(held.filter(open_), [*keys, "bundle"])
    if held is not None and held.num_rows:
        yield from summed(held, keys).to_batches()


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, text_bytes: int = TEXT_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(counts, sizes)``: ``lang, prefix, next, f, k`` of all phrases of up to ``longest`` words that occur
    ``least`` times or more, and ``lang, n`` with all words of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text")).where("text != ''")
    levels, filter_, sizes = [], None, None
    passes = [(k,) for k in range(1, min(longest, ALONE) + 1)] + [tuple(range(ALONE + 1, longest + 1))] * (longest > ALONE)
    for lengths in passes:
        stripes = rows.mapInArrow(_stripes(lengths, filter_, text_bytes), STRIPE)
        by = ["lang", "bundle"]
        counts = stripes.repartition(*by).sortWithinPartitions(*by).mapInArrow(merged, COUNT)
        if lengths == (1,):
            # Rare words are one row of each language, which counts for its size.
            kept = F.when(F.col("f") >= least, F.col("next"))
            counts = materialize(counts.groupBy("lang", "prefix", kept.alias("next")).agg(F.sum("f").alias("f")), "word-counts")
            sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
            counts = counts.where("next IS NOT NULL")
        words = F.when(F.col("prefix") == "", 1).otherwise(F.size(F.split("prefix", " ")) + 1)
        level = materialize(counts.where(F.col("f") >= least).withColumn("k", words), f"phrases-{lengths[0]}")
        levels.append(level)
        if lengths != passes[-1]:
            filter_ = spark.sparkContext.broadcast(_filter(level))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, sizes


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of 2 to ``longest`` words that hold together best.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and
    tabs. ``n`` counts the words of a language, ``a, l, r`` the occurrences of the phrase and of both sides of its
    weakest cut; a cut scores ``floor(1000 a n / (l r))``, in decimals of 38 digits. Phrases that occur as often inside
    a longer one are left out; since a longer one never occurs more often than what it contains, looking at one word
    more on either side is enough. Null text is empty; a null language is ``und``, together with rows that say so.
    Repeated rows count each. An empty table, or one without a frequent phrase, gives no rows.
    """
    counts, sizes = phrase_counts(docs, text, lang, longest, least, text_bytes)
    counts = counts.withColumn("phrase", phrase())
    known = counts.select("lang", "phrase", "f")
    longer = counts.where("k > 1")
    # The largest count among a phrase's extensions: to the right its own stripe has it, to the left those of the phrases that end in it.
    right = longer.select("lang", F.col("prefix").alias("phrase"), "f")
    left = longer.select("lang", F.expr("substring_index(phrase, ' ', 1 - k)").alias("phrase"), "f")
    inside = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = longer.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("f")))
    cut = kept.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("first"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest"))
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(sizes, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alnr"}
    cut = cut.withColumn("over", wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).withColumn("under", wide["l"] * wide["r"])
    cut = cut.withColumn("score", F.expr("over div under"))
    weakest = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    weakest = weakest.select("lang", "phrase", "a", "n", "w.l", "w.r", "w.score")
    # A language may hold most phrases, so groups of it are cut down first.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    weakest = weakest.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)))
    first = weakest.withColumn("place", F.row_number().over(W.partitionBy("lang", "group").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
