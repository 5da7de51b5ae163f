"""BPE encoding and decoding: speculate with greedy longest match, verify pairs, merge exactly on failure.

A sequence of tokens is the BPE encoding of a word exactly if every token is its own encoding and
every two neighbours are the encoding of their concatenation. Greedy longest match is right for
most words, so it is tried first; one array look-up tests all neighbours of a batch, and only the
words that fail are merged by rank.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curafold.llm.common import text_of

WORD_END = "</w>"
#: Characters of distinct words whose encodings a worker remembers.
CACHE_CHARS = 16_000_000
ROWS = 256
#: Up to this many symbols a scan for the lowest rank is quicker than a heap.
SHORT = 32

# The pre-tokenizer's pattern; the same for lower-case ASCII text; white space of Unicode.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for i, b in enumerate(hidden):
        out[b] = chr(256 + i)
    return out


def load_model(path: str) -> dict:
    """What encoding needs of a tokenizer file; its size is that of the vocabulary, not of the data."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class WordEncoder:
    """Encodes words; keeps what it has learnt about pairs of tokens and, within a bound, words."""

    def __init__(self, model: dict):
        self.vocab = model["vocab"]
        self.special = model["special"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank = {pair: i for i, pair in enumerate(model["merges"])}
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(WORD_END)}
        self.last = {t[: -len(WORD_END)]: i for t, i in self.vocab.items() if t.endswith(WORD_END)}
        self.reach: dict[str, int] = {}  # length of the longest token by its first two characters
        for t in (*self.inner, *self.last):
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.bytes = dict(enumerate(byte_characters()))
        self.width = max(self.tokens, default=0) + 1
        self.known = np.zeros(0, np.int64)  # pairs seen so far, sorted, and whether they fit
        self.fits = np.zeros(0, bool)
        self.ids: dict[str, str] = {}
        self.shown: dict[str, str] = {}
        self.cached = 0
        cut = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, cut)) + ")") if cut else None

    # -- exact merging ---------------------------------------------------------

    def merge(self, symbols: list[str]) -> list[str]:
        """Repeatedly joins the neighbours of lowest rank, leftmost first."""
        if len(symbols) > SHORT:
            return self.merge_long(symbols)
        symbols, rank, none = list(symbols), self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The same by a heap over a linked list: the time stays near linear in a run of any length."""
        n = len(symbols)
        symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.rank.get((symbols[k], symbols[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, symbols[k], symbols[after[k]]))
        return [s for s, ok in zip(symbols, alive, strict=True) if ok]

    @staticmethod
    def symbols(token: str) -> list[str]:
        """The characters a token starts from; the end mark belongs to the last of them."""
        if token.endswith(WORD_END):
            body = token[: -len(WORD_END)]
            return [*body[:-1], body[-1:] + WORD_END]
        return list(token)

    # -- speculation and verification ---------------------------------------------

    def greedy(self, word: str) -> list[int] | None:
        out, i, n, inner, reach = [], 0, len(word), self.inner, self.reach
        while i < n:
            stop = i + reach.get(word[i : i + 2], 1)
            found = None
            if stop >= n:
                found, stop = self.last.get(word[i:]), n - 1
                if found is not None:
                    out.append(found)
                    return out
            while stop > i and (found := inner.get(word[i:stop])) is None:
                stop -= 1
            if found is None:
                return None
            out.append(found)
            i = stop
        return out

    def fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair ``left * width + right`` stays two tokens; ``token * width + token`` with
        the sign reversed asks whether a token is its own encoding."""
        asked, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.known, asked)
        new = asked[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != asked)] if len(self.known) else asked
        if len(new):
            fits = np.zeros(len(new), bool)
            for k, code in enumerate(new.tolist()):
                parts = [self.tokens[-code - 1]] if code < 0 else [self.tokens[code // self.width], self.tokens[code % self.width]]
                fits[k] = self.merge([s for p in parts for s in self.symbols(p)]) == parts
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.fits = known[order], np.concatenate([self.fits, fits])[order]
        return self.fits[np.searchsorted(self.known, asked)][back]

    def encode(self, words: list[str]) -> list[list[int]]:
        spelled = [w.encode("utf-8").decode("latin-1").translate(self.bytes) for w in words]
        guesses = [self.greedy(w) for w in spelled]
        sizes = np.array([len(g or ()) for g in guesses], np.int64)
        flat = np.fromiter((t for g in guesses for t in g or ()), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        neighbour = word[:-1] == word[1:]
        pairs = np.concatenate([-flat - 1, (flat[:-1] * self.width + flat[1:])[neighbour]])
        wrong = np.array([g is None for g in guesses], bool)
        wrong[np.concatenate([word, word[:-1][neighbour]])[~self.fit(pairs)]] = True
        for i in np.flatnonzero(wrong).tolist():
            merged = self.merge([*spelled[i][:-1], spelled[i][-1:] + WORD_END])
            guesses[i] = [self.vocab[s] for s in merged if s in self.vocab]
        return guesses

    # -- whole texts ------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Words of a text in the order of their tokens; a special token is a piece of its own."""
        if self.cut is not None and "<" in text and len(parts := self.cut.split(text)) > 1:
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self.pieces_of(p))]
        return self.pieces_of(text)

    @staticmethod
    def pieces_of(text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        # Characters are lower-cased one by one, so a sigma never takes its final form.
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def remember(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if self.cached + sum(map(len, new)) > CACHE_CHARS:
            self.ids, self.shown, self.cached = {}, {}, 0
            new = list(words)
        self.cached += sum(map(len, new))
        special = [w for w in new if w in self.special]
        plain = [w for w in new if w not in self.special]
        for w, ids in zip([*special, *plain], [*([self.special[w]] for w in special), *self.encode(plain)], strict=True):
            self.ids[w] = " ".join(map(str, ids))
            self.shown[w] = " ".join([self.tokens[i] for i in ids])

    def texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids and its decoded form: the tokens joined by a space."""
        words = [self.pieces(t) for t in texts]
        self.remember(set().union(*words))
        return [(" ".join(map(self.ids.__getitem__, w)), " ".join(map(self.shown.__getitem__, w))) for w in words]


_ENCODERS: dict[str, WordEncoder] = {}


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = False) -> DataFrame:
    """Each row's token count and digests; with ``full`` also the ids and the decoded text.

    One row in, one row out, with the ``keep`` columns. Null counts as empty; an empty text has no
    tokens and the digests of an empty string. ``path`` is a tokenizer file of words with end
    marks; the driver reads it and broadcasts the vocabulary, whose size doesn't depend on the data.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(load_model(path))
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], text_of(text).alias("__text"))
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes[:-1]])
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[path] = WordEncoder(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                done = encoder.texts(part.column(part.num_columns - 1).to_pylist())
                columns = list(part.columns)[:-1] + [
                    pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in done], pa.int64()),
                    pa.array([sha256(ids.encode()).hexdigest() for ids, _ in done], pa.string()),
                    pa.array([sha256(shown.encode()).hexdigest() for _, shown in done], pa.string()),
                ]
                names = [*part.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    columns += [pa.array([list(map(int, ids.split())) for ids, _ in done], pa.list_(pa.int32())), pa.array([s for _, s in done], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
