"""Language identification: words first, then ever shorter character n-grams.

A known word scores with its log frequency in each language. An unseen word falls back to its
n-grams: the longest length at which any n-gram is known counts, by the mean of their scores.
Every word and n-gram of the training documents is known. The most frequent ones go to every executor; if
there are more, the other words of the documents are joined with the whole tables of counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curafold.llm.common import text_of
from curafold.session import materialize

#: So many words and n-grams, the most frequent ones, go to every executor; the rest is joined.
WORDS_KEPT, GRAMS_KEPT = 100_000, 50_000
LONGEST_GRAM = 4
SMOOTHING = 0.5
UNKNOWN = "und"
#: Distinct entries that a counting task holds before it passes them on.
COUNTER_ENTRIES = 1_000_000
#: Scores are summed as whole numbers of this part of one, so neither their order nor where they are summed matters.
UNIT = 2.0**-30
#: Scores of unseen words that a worker remembers.
MEMORY = 200_000
ROWS = 256

ASCII_WORD = re.compile(r"[a-z]+")
ANY_WORD = regex.compile(r"\p{L}+")


def words(text: str) -> list[str]:
    """Runs of letters, lower case."""
    return ASCII_WORD.findall(text.lower()) if text.isascii() else ANY_WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between its marks; the marks alone are none."""
    marked = f"^{word}$"
    if n == 1:
        return list(word)
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counts(counter: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in counter], pa.string()), pa.array([k[1] for k in counter], pa.string()), pa.array(list(counter.values()), pa.int64())],
        ["lang", "item", "n"],
    )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_lang: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            by_lang.setdefault(lang, Counter()).update(words(text.as_py()))
        if sum(map(len, by_lang.values())) > COUNTER_ENTRIES:
            yield from (_counts(Counter({(lang, w): n for w, n in c.items()})) for lang, c in by_lang.items())
            by_lang = {}
    yield from (_counts(Counter({(lang, w): n for w, n in c.items()})) for lang, c in by_lang.items())


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter: Counter = Counter()
    for batch in batches:
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "item", "n")), strict=True):
            for size in range(1, LONGEST_GRAM + 1):
                for gram in grams(word, size):
                    counter[lang, f"{size}{gram}"] += n
        if len(counter) > COUNTER_ENTRIES:
            yield _counts(counter)
            counter = Counter()
    yield _counts(counter)


class Model:
    """Scores by language, in units, of the items that every executor has: words, then n-grams."""

    def __init__(self, langs: list[str], items: list[list[str]], scores: list[np.ndarray]):
        self.langs, self.scores = langs, scores
        self.index = [{item: i for i, item in enumerate(names)} for names in items]
        self.memory: dict[str, np.ndarray] = {}

    def unseen(self, word: str) -> np.ndarray:
        found = self.memory.get(word)
        if found is None:
            found = np.zeros(len(self.langs), np.int64)
            for n in range(LONGEST_GRAM, 0, -1):
                at = [i for g in grams(word, n) if (i := self.index[1].get(f"{n}{g}")) is not None]
                if at:
                    mean = self.scores[1][at].sum(axis=0) / len(at)
                    found = (np.sign(mean) * np.floor(np.abs(mean) + 0.5)).astype(np.int64)  # halves away from zero, as Spark rounds
                    break
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[word] = found
        return found

    def partial(self, text: str) -> tuple[list[int] | None, Counter]:
        """Scores of the given words, null without a word, and the counts of the other words."""
        found = words(text)
        if not found or not self.langs:
            return None, Counter()
        get = self.index[0].get
        at = np.array([get(w, -1) for w in found])
        return self.scores[0][at[at >= 0]].sum(axis=0).tolist(), Counter(found[i] for i in np.flatnonzero(at < 0).tolist())

    def sums(self, text: str) -> list[int] | None:
        """The score of a text in each language, null without a word."""
        total, rest = self.partial(text)
        if total is not None:
            for word, n in rest.items():
                total = [x + n * y for x, y in zip(total, self.unseen(word).tolist(), strict=True)]
        return total


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _most_frequent(items: DataFrame, kept: int) -> DataFrame:
    """At most ``kept`` items: whole bands of frequency, eight to an octave, from the highest down."""
    band = F.floor(F.log2("all") * 8)
    left, lowest = kept, None
    for r in sorted(items.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["band"]):  # a few hundred bands
        if r["n"] > left:
            break
        left, lowest = left - r["n"], r["band"]
    return items.where(band >= lowest) if lowest is not None else items.limit(0)


def _units(bases: np.ndarray) -> list[Column]:
    """Scores of ``ns`` by language, in units. Both ways of scoring take them from here, so they agree to the last one."""
    return [F.round(F.log((F.col("ns")[i] + SMOOTHING) / F.lit(float(base))) / UNIT).cast("long") for i, base in enumerate(bases)]


def train(docs: DataFrame, words_kept: int = WORDS_KEPT, grams_kept: int = GRAMS_KEPT) -> tuple[Model, list[float], DataFrame, DataFrame, bool]:
    """The model with the most frequent items, log priors, all words and all n-grams with their scores ``s0, s1…``, and
    whether the model has them all.

    Counts the words of all documents with a language that aren't held out; a null id has no remainder and is left out.
    """
    use = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    rows = docs.where(use).select("lang", "text")
    schema = "lang string, item string, n bigint"
    prior = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(prior)
    items, scores, sizes, tables = [], [], [], []
    counted = rows.mapInArrow(_count_words, schema)
    by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("double") for x in langs]
    for kept in (words_kept, grams_kept):
        # Tasks have counted already, so rows go to the owner of their item as they are.
        wide = counted.repartition("item").groupBy("item").agg(F.sum("n").alias("all"), F.array(*by_lang).alias("ns") if langs else F.array().cast("array<double>").alias("ns"))
        wide = materialize(wide, "item-counts")
        sums = wide.select(F.count("*"), *[F.sum(F.col("ns")[i]) for i in range(len(langs))]).first()
        sizes.append(sums[0])
        units = _units(np.array([x or 0 for x in sums[1:]], float) + SMOOTHING * (sizes[-1] + 1))
        top = _most_frequent(wide, kept).select("item", F.array(*units).cast("array<bigint>").alias("units")).toArrow()
        items.append(top.column("item").to_pylist())
        flat = [chunk.flatten().to_numpy() for chunk in top.column("units").chunks]
        scores.append(np.concatenate([np.zeros(0, np.int64), *flat]).reshape(len(items[-1]), len(langs)))
        tables.append(wide.select("item", *[x.alias(f"s{i}") for i, x in enumerate(units)]))
        longs = F.transform("ns", lambda x, i: F.struct(F.array(*map(F.lit, langs))[i].alias("lang"), x.cast("bigint").alias("n"))) if langs else None
        counted = wide.select("item", F.inline(longs)).where("n > 0").select("lang", "item", "n").mapInArrow(_count_grams, schema) if langs else wide.select(F.lit("").alias("lang"), "item", F.col("all").alias("n"))
    shares = np.array([prior[x] for x in langs], float)
    return Model(langs, items, scores), np.log(shares / max(1.0, shares.sum())).tolist(), *tables, sizes == [len(names) for names in items]


def pieces(word: str, known: dict[str, int]) -> Iterator[tuple[int, str]]:
    """Lengths and n-grams of a word that can count, longest first: below a length with an n-gram in ``known``, none does."""
    for n in range(LONGEST_GRAM, 0, -1):
        found = [f"{n}{g}" for g in grams(word, n)]
        yield from ((n, g) for g in found)
        if any(g in known for g in found):
            return


def _unseen(unknown: DataFrame, all_grams: DataFrame, langs: int, shared: Broadcast) -> DataFrame:
    """``item`` and its scores by language, of the words in ``unknown`` that have a known n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.index[1]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                found = [(w, n, g) for w in batch.column("item").slice(start, ROWS).to_pylist() for n, g in pieces(w, known)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["item", "size", "gram"])

    names = [f"s{i}" for i in range(langs)]
    scored = unknown.mapInArrow(run, "item string, size int, gram string").join(all_grams.withColumnRenamed("item", "gram"), "gram")
    sizes = scored.groupBy("item", "size").agg(*[F.round(F.sum(x) / F.count("*")).cast("long").alias(x) for x in names])
    longest = sizes.groupBy("item").agg(F.max_by(F.struct(*names), "size").alias("s"))
    return longest.select("item", "s.*")


def _identify_joined(rows: DataFrame, model: Model, all_words: DataFrame, all_grams: DataFrame) -> DataFrame:
    """``doc_id, held_out, sums``: executors score the most frequent words, joins with all words and n-grams the others."""
    names = [f"s{i}" for i in range(len(model.langs))]
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = [known.partial(t) for t in part.column("text").to_pylist()]
                # A row of the document itself, whose item no word equals, and one for each of the other words.
                uids = part.column("uid").to_pylist()
                at = np.concatenate([np.arange(len(found)), np.repeat(np.arange(len(found)), [len(rest) for _, rest in found])])
                other = [None] * (len(at) - len(found))
                first = pa.array([*range(len(found)), *other], pa.int64())
                own = [part.column("doc_id").take(first), part.column("held_out").take(first), pa.array([x for x, _ in found] + other, pa.list_(pa.int64()))]
                columns = [
                    part.column("uid").take(pa.array(at)),
                    pa.array([f"-{u}" for u in uids] + [w for _, rest in found for w in rest], pa.string()),
                    pa.array([0] * len(found) + [n for _, rest in found for n in rest.values()], pa.int64()),
                    pa.StructArray.from_arrays(own, ["doc_id", "held_out", "total"], mask=pa.array(np.arange(len(at)) >= len(found))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "item", "n", "own"])

    parts = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text")
    parts = parts.mapInArrow(run, f"uid bigint, item string, n bigint, own struct<doc_id: {kind}, held_out: boolean, total: array<bigint>>")
    joined = parts.join(all_words.withColumn("known", F.lit(True)), "item", "left")
    absent = F.when(F.col("known").isNull() & (F.col("n") > 0), F.struct("item", "n"))
    scored = joined.groupBy("uid").agg(
        F.first("own", ignorenulls=True).alias("own"),
        *(F.coalesce(F.sum(F.col(x) * F.col("n")), F.lit(0)).alias(x) for x in names),
        F.collect_list(absent).alias("absent"),
    )
    scored = materialize(scored.select("uid", "own.*", *names, "absent"), "lang-scored")
    absent = scored.select("uid", F.inline("absent"))
    unseen = _unseen(absent.select("item").distinct(), all_grams, len(names), shared)
    more = absent.join(unseen, "item").groupBy("uid").agg(*[F.sum(F.col(x) * F.col("n")).alias(f"more_{x}") for x in names])
    total = F.array(*[F.col("total")[i] + F.col(x) + F.coalesce(f"more_{x}", F.lit(0)) for i, x in enumerate(names)])
    done = scored.drop("absent").join(more, "uid", "left")
    return done.select("doc_id", "held_out", F.when(F.col("total").isNotNull(), total).alias("sums"))


def _decided(scored: DataFrame, langs: list[str], prior: list[float]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` from the ``sums`` of units by language."""
    if not langs:
        return scored.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    total = F.array(*[F.lit(p) + F.col("sums")[i] * UNIT for i, p in enumerate(prior)])
    done = scored.withColumn("total", total).withColumn("top", F.array_max("total"))
    posterior = 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    best = F.array(*map(F.lit, langs))[F.array_position("total", F.col("top")).cast("int") - 1]
    return done.select(
        "doc_id", "held_out",
        F.when(F.col("sums").isNull(), UNKNOWN).otherwise(best).alias("lang_pred"),
        F.when(F.col("sums").isNull(), 0.0).otherwise(posterior).alias("score"),
    )


def identify(docs: DataFrame, words_kept: int = WORDS_KEPT, grams_kept: int = GRAMS_KEPT) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; one row per document, learnt from the same table.

    ``und`` with score 0 for a null text, a text without a letter, or if there is nothing to learn
    from. The score is the posterior of the language; equal posteriors give the first language by code point.
    ``words_kept`` and ``grams_kept`` set what goes to every executor; they don't change the result.
    """
    trained, prior, all_words, all_grams, whole = train(docs, words_kept, grams_kept)
    rows = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    if not whole:
        return _decided(_identify_joined(rows, trained, all_words, all_grams), trained.langs, prior)
    model = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = [known.sums(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "held_out", "sums"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return _decided(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, sums array<bigint>"), trained.langs, prior)
