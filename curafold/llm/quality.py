"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are perfect binary trees flattened into three arrays, so a batch of documents walks all
of them with a few vectorised look-ups per level.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curafold.llm.common import text_of

#: At most so many labelled documents are fitted on: those with the smallest md5 of their id.
SAMPLE_ROWS = 20_000
ROUNDS, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 80, 4, 64, 0.15, 2.0, 2.0
REJECT_BELOW = 0.3
ROWS = 512

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
SIGNS = "!#$%&*|@<>{}=_~^\\/+"
ENDS = np.array([ord(c) for c in ".,;:?"])

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letter_share", "digit_share", "upper_share", "symbol_share", "end_share",
    "other_byte_share", *(f"share_{ord(c)}" for c in SIGNS), "log_lines", "line_words", "distinct_lines", "worst_line_symbols",
    "worst_line_upper", "noisy_lines", "distinct_words", "top_word", "top_words", "doubled_words", "distinct_triples",
    "short_words", "signed_words", "compression",
)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        raw = text.encode("utf-8")
        n = len(raw)
        if not n:
            continue
        codes = np.frombuffer(raw, np.uint8)
        count = np.bincount(codes, minlength=256)
        words = text.split()
        n_words = len(words)
        letters, upper = count[LETTER].sum(), count[65:91].sum()
        values = [
            np.log1p(n), np.log1p(n_words), n / (n_words + 1), letters / n, count[48:58].sum() / n, upper / (letters + 1),
            count[SYMBOL].sum() / n, count[ENDS].sum() / n, count[128:].sum() / n, *(count[ord(c)] / n for c in SIGNS),
        ]
        symbol = SYMBOL[codes]
        starts = np.concatenate([[0], np.flatnonzero(codes[:-1] == 10) + 1])
        lengths = np.diff(np.append(starts, n))
        noise = np.add.reduceat(symbol.view(np.int8), starts, dtype=np.int64) / (lengths + 8)
        loud = np.add.reduceat(((codes >= 65) & (codes < 91)).view(np.int8), starts, dtype=np.int64) / (lengths + 8)
        lines = text.split("\n")
        values += [np.log1p(len(starts)), n_words / len(starts), len(set(lines)) / len(lines), noise.max(), loud.max(), (noise > 0.12).mean()]
        if n_words:
            seen = Counter(words)
            top = [c for _, c in seen.most_common(5)]
            second, third = words[1:], words[2:]
            values += [
                len(seen) / n_words, top[0] / n_words, sum(top) / n_words,
                sum(map(str.__eq__, words, second)) / n_words,
                len(set(zip(words, second, third, strict=False))) / max(1, n_words - 2),
                sum(c for w, c in seen.items() if len(w) <= 3) / n_words,
                sum(c for w, c in seen.items() if not w[-1].isalnum()) / n_words,
            ]
        else:
            values += [0.0] * 7
        values.append(len(zlib.compress(raw, 1)) / n)
        row[:] = values
    return out


@dataclass
class Forest:
    """Perfect trees of one depth, one after the other: inner nodes, then leaves."""

    base: float
    feature: np.ndarray  # (trees * inner)
    cut: np.ndarray  # (trees * inner); a value up to it goes left
    leaf: np.ndarray  # (trees * leaves)
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        trees = len(self.leaf) // leaves if len(self.leaf) else 0
        total = np.full(len(x), self.base)
        if trees and len(x):
            rows = np.arange(len(x))[:, None]
            node = np.zeros((len(x), trees), np.int64)
            first = np.arange(trees) * inner
            for _ in range(self.depth):
                at = first + node
                node = 2 * node + 1 + (x[rows, self.feature[at]] > self.cut[at])
            total += self.leaf[np.arange(trees) * leaves + node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic loss, depth-wise trees, histograms of ``BINS`` quantile bins.

    Without labels of both kinds the forest is a constant: the share of label 1, or 0.5 without rows.
    """
    share = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    empty = Forest(base, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), DEPTH)
    if not len(y) or y.min() == y.max():
        return empty
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    slot = binned + np.arange(width) * BINS
    inner = (1 << DEPTH) - 1
    features, limits, leaves = [], [], []
    margin = np.full(n, base)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, here = (1 << level) - 1, 1 << level
            code = ((node - first) * (width * BINS))[:, None] + slot
            size = here * width * BINS
            g = np.bincount(code.ravel(), np.repeat(slope, width), size).reshape(here, width, BINS).cumsum(axis=2)
            h = np.bincount(code.ravel(), np.repeat(curve, width), size).reshape(here, width, BINS).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(h < LEAST_WEIGHT) | (h_all - h < LEAST_WEIGHT)] = -1
            for k in range(here):
                f, b = divmod(int(gain[k].argmax()), BINS)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], limit[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        at = node - inner
        step = -np.bincount(at, slope, 1 << DEPTH) / (np.bincount(at, curve, 1 << DEPTH) + RIDGE) * RATE
        margin += step[at]
        features.append(feature)
        limits.append(limit)
        leaves.append(step)
    return Forest(base, np.concatenate(features), np.concatenate(limits), np.concatenate(leaves), DEPTH)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows of which no label is ever learnt."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fits on at most ``sample_rows`` labelled documents that aren't held out; the driver gets their statistics."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sample = (
        usable.groupBy("doc_id").agg(F.max("quality").cast("double").alias("__y"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample_rows)
    )
    rows = docs.select(F.col("doc_id"), text_of().alias("__text")).join(F.broadcast(sample), "doc_id").select("__y", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("__y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    found = rows.mapInArrow(run, "y double, x array<double>").toPandas()
    if not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(found["x"].to_numpy()), found["y"].to_numpy()
    order = np.lexsort([*x.T, y])  # the same forest in whatever order the rows come
    return fit(x[order], y[order])


def _scored(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """The row as ``doc``, with ``held_out``, ``score`` and ``predicted``."""
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), held_out().alias("held_out"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = forest.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                score = model.score(statistics(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("held_out"), pa.array(score)], ["doc", "held_out", "score"])

    scored = rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= REJECT_BELOW).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted``; one row per document.

    Only the text is an input of the score. A null text counts as empty and gets the score of an
    empty text; a null id is never held out and has no label. Labels without an id or a quality aren't
    learnt from; of several for one id the largest counts. Other columns of ``docs`` don't matter.
    """
    scored = _scored(docs.select("doc_id", "text"), labels, sample_rows)
    return scored.select("doc.doc_id", "held_out", "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns, whatever their names."""
    return _scored(docs, labels, sample_rows).where("predicted = 1").select("doc.*")
