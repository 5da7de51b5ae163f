"""Quality rules with an isolation forest on their statistics.

Documents first meet plain limits. The others are judged by how few random splits of the rule statistics isolate
them: the path length over a forest of random trees, compared with a threshold that labelled documents calibrate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curafold.llm.common import text_of
from curafold.operators.ranking import running_in_order
from curafold.session import materialize

#: Each tree isolates so many rows; that is the method's own subset, drawn anew for each tree from all labelled rows.
TREES, TREE_ROWS, SEED = 200, 256, 13
#: Share of the good labelled documents that the threshold may reject.
GOOD_REJECTED = 0.02
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
ROWS = 256

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes that begin no code point.
TAILS = bytes(range(0x80, 0xC0))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_chars", "symbols_a_word", "duplicate_lines", "repeated_words", "distinct_words", "top_word", "line_words",
    "upper_share", "digit_share", "sign_share", "end_share", "line_symbols",
)

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
ENDS = b".,;:!?"
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in ENDS)


def share(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def measure(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """``(BASE, FEATURES)`` of a text in UTF-8; all zero without words.

    ``n_repeat_words`` counts the words that a window of three words covers which occurs again in the text.
    """
    words = text.split()
    n = len(words)
    n_symbols = share(text, SYMBOLS)
    if not n:
        return (0, 0, n_symbols, 0, 0), (0.0,) * len(FEATURES)
    word_chars = len(text.translate(None, BLANKS + TAILS))
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    n_dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    n_repeat = 0
    times = Counter(windows)
    if len(times) < len(windows):
        covered = 0  # words before this place are counted
        for i, window in enumerate(windows):
            if times[window] > 1:
                n_repeat += i + 3 - max(covered, i)
                covered = i + 3
    seen = Counter(words)
    size = len(text)
    noisy = max(share(line, SIGNS) / (len(line) + 8) for line in set(lines))
    features = (
        np.log1p(n), word_chars / n, n_symbols / n, n_dup / len(lines), n_repeat / n, len(seen) / n, max(seen.values()) / n, np.log1p(n / len(lines)),
        share(text, UPPER) / size, share(text, DIGITS) / size, share(text, SIGNS) / size, share(text, ENDS) / n, noisy,
    )
    return (n, word_chars, n_symbols, n_dup, n_repeat), features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


def unsplit_path(n: np.ndarray) -> np.ndarray:
    """The mean number of splits that would still isolate one of ``n`` points."""
    n = np.asarray(n, np.float64)
    more = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Random trees as arrays over nodes; a leaf is its own child on both sides."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray  # smaller values go left
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray  # of a leaf: its depth and what its points would still take
    depth: int
    typical: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """``2 ** -(mean path / typical path)``: near 1 for anomalies, 0.5 and less for ordinary rows."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), 0.5)
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] < self.cut[node], self.left[node], self.right[node])
        return np.exp2(-self.path[node].mean(axis=1) / self.typical)


def grow(x: np.ndarray, around: np.ndarray | None = None, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """A forest over random subsets of ``x``: a random feature that varies, cut at a random value in its range.

    Ranges are those of the subset together with one of ``around``, whose rows take no other part; so a feature that is
    constant in ``x`` is cut as well if it varies around it.
    """
    around = x if around is None else around
    return _grow([(x[own], around[other]) for own, other in draws(len(x), len(around), trees, tree_rows, seed)], seed)


def draws(own: int, around: int, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree, the places of its rows among ``own`` ones and of those around it; no trees without rows."""
    rng = np.random.default_rng(seed)
    return [tuple(rng.choice(n, min(tree_rows, n), replace=False) for n in (own, around)) for _ in range(trees if own else 0)]


def _grow(subsets: list[tuple[np.ndarray, np.ndarray]], seed: int) -> Forest:
    rng = np.random.default_rng([seed, 1])
    feature, cut, left, right, path, roots = [], [], [], [], [], []
    size = len(subsets[0][0]) if subsets else 0
    deepest = int(np.ceil(np.log2(max(size, 2))))
    for subset in subsets:
        rows = np.concatenate(subset)
        stack = [(rows, np.arange(len(rows)) < size, 0, None)]
        while stack:
            rows, own, depth, link = stack.pop()
            at = len(feature)
            for column, value in ((feature, 0), (cut, 0.0), (left, at), (right, at), (path, 0.0)):
                column.append(value)
            if link is None:
                roots.append(at)
            else:
                link[0][link[1]] = at
            low, high = rows.min(axis=0), rows.max(axis=0)
            varies = np.flatnonzero(low < high)
            if depth >= deepest or own.sum() <= 1 or not len(varies):
                path[at] = depth + float(unsplit_path(own.sum()))
                continue
            f = int(rng.choice(varies))
            c = rng.uniform(low[f], high[f])
            c = c if c > low[f] else high[f]
            feature[at], cut[at] = f, c
            goes = rows[:, f] < c
            stack += [(rows[~goes], own[~goes], depth + 1, (right, at)), (rows[goes], own[goes], depth + 1, (left, at))]
    arrays = [np.array(v, kind) for v, kind in ((roots, np.int64), (feature, np.int64), (cut, float), (left, np.int64), (right, np.int64), (path, float))]
    return Forest(*arrays, deepest, max(1.0, float(unsplit_path(size))))


@dataclass
class Verdict:
    """A forest, the scale of its inputs and the largest score that is kept."""

    forest: Forest
    most: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.forest.score(x)


def calibrate(x: np.ndarray, good: np.ndarray, good_rejected: float = GOOD_REJECTED) -> Verdict:
    """Grows the forest on labelled rows that are good, in the ranges of all, and sets the threshold on the labelled rows.

    Of the thresholds that reject at most ``good_rejected`` of the good rows, the one with the largest difference of rejected
    shares of bad and good rows is taken; the highest of equal ones. Without good rows nothing is rejected.
    """
    if not good.any():
        return Verdict(grow(x[:0]), np.inf)
    forest = grow(x[good], x)
    score = forest.score(x)
    least = np.quantile(score[good], 1 - good_rejected, method="higher")
    tried = np.append(np.unique(score[score >= least]), np.inf)
    gain = np.array([(score[~good] > t).mean() if (~good).any() else 0.0 for t in tried]) - np.array([(score[good] > t).mean() for t in tried])
    return Verdict(forest, float(tried[len(tried) - 1 - int(gain[::-1].argmax())]))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc, base, x`` of each document, as a written table: texts are measured once."""
    rows = docs.select(F.col("doc_id").alias("doc"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = [measure(text.encode()) for text in part.column("text").to_pylist()]
                base, x = (pa.array([list(f[k]) for f in found], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.float64())))
                yield pa.RecordBatch.from_arrays([part.column("doc"), base, x], ["doc", "base", "x"])

    kind = rows.schema["doc"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"doc {kind}, base array<bigint>, x array<double>"), "rule-statistics")


def train(docs: DataFrame, labels: DataFrame) -> Verdict:
    return _train(statistics(docs), labels)


def _train(measured: DataFrame, labels: DataFrame) -> Verdict:
    """What :func:`calibrate` gives for all labelled documents that pass the limits.

    Rows are numbered in order of their values, so trees draw the same ones however rows come. The driver gets the rows that
    trees drew, at most ``2 * TREES * TREE_ROWS``, and the threshold, for which every labelled row is scored.
    """
    spark = measured.sparkSession
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    truth = usable.groupBy(F.col("doc_id").alias("doc")).agg((F.max("quality") > 0).alias("good"))
    n_words, n_repeat = F.col("base")[0], F.col("base")[BASE.index("n_repeat_words")]
    passing = measured.where((n_words >= LEAST_WORDS) & (100 * n_repeat <= MOST_REPEATED_PERCENT * n_words)).select("doc", "x")
    rows = materialize(passing.join(truth, "doc").select("good", "x"), "rule-labelled")
    n, good = rows.agg(F.count("*"), F.count_if("good")).first()
    if not good:
        return calibrate(np.zeros((0, len(FEATURES))), np.zeros(0, bool))
    drawn = [(n - good + own, around) for own, around in draws(good, n)]  # good rows come last
    places = np.unique(np.concatenate([np.concatenate(pair) for pair in drawn]))
    wanted = spark.createDataFrame([(int(p),) for p in places], "place bigint")
    numbered = running_in_order(rows, [], ["good", "x"], "place", "n")
    found = numbered.join(F.broadcast(wanted), "place").select("place", "x").toPandas().sort_values("place")
    x = np.stack(found["x"].to_numpy())
    forest = _grow([tuple(x[np.searchsorted(places, at)] for at in pair) for pair in drawn], SEED)
    return Verdict(forest, _threshold(rows, forest, n, good))


def _threshold(rows: DataFrame, forest: Forest, n: int, good: int, good_rejected: float = GOOD_REJECTED) -> float:
    """The threshold of :func:`calibrate` from the scores of all labelled rows, put in order by ranges."""
    model = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                score = model.value.score(np.array(part.column("x").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("good"), pa.array(score)], ["good", "score"])

    scores = rows.mapInArrow(run, "good boolean, score double").groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    placed = running_in_order(scores, [], ["score"], "good_below", "n_good", "good")
    placed = running_in_order(placed, [], ["score"], "bad_below", "n_bad", "bad")
    kept_good, kept_bad = F.col("good_below") + F.col("good"), F.col("bad_below") + F.col("bad")
    bad = n - good
    gain = ((F.lit(bad) - kept_bad) / F.lit(float(bad)) if bad else F.lit(0.0)) - (F.lit(good) - kept_good) / F.lit(float(good))
    # The place of the quantile among the good rows, the higher one between two.
    place = int(np.ceil((good - 1) * (1 - good_rejected)))
    best = placed.where(kept_good > place).agg(F.max(F.struct(gain.alias("gain"), "score"))).first()[0]
    return float(best["score"]) if best["gain"] > 0 else float("inf")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score``; a row per document.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]``. A document fails with fewer than 50 words or if windows of three words that
    repeat cover more than half of them; of the others the forest keeps those up to its threshold. Null and empty
    texts have no words and fail. ``score`` is null where the limits already decide. Repeated rows each
    have a row; a null id has no label. Without labels only the limits decide. An empty table gives no rows.
    """
    measured = statistics(docs)
    model = docs.sparkSession.sparkContext.broadcast(_train(measured, labels))
    rows = measured.select(F.col("doc").cast("long").alias("doc_id"), "base", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                base = np.array(part.column("base").to_pylist(), np.int64)
                failed = np.array([base_failed(b[0], b[4]) for b in base], bool)
                score = verdict.score(np.array(part.column("x").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(~failed & (score <= verdict.most)), pa.array(score, mask=failed)],
                    ["doc_id", *BASE, "base_failed", "kept", "score"],
                )

    return rows.mapInArrow(run, f"doc_id bigint, {', '.join(f'{c} bigint' for c in BASE)}, base_failed boolean, kept boolean, score double")
