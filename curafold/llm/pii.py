"""Personal data: exact patterns, and a skip-chain conditional random field that completes them.

The mentions of a document are the nodes: matches of the base patterns, whose labels are fixed, and other
places that could hold personal data (long numbers with any separators, spelled-out addresses), whose
labels are inferred. Neighbours in the text are linked by a chain. Repeated mentions (the same
digits or the same address without punctuation) and similar ones (numbers that end in the same
digits) are linked over any distance by skip edges, which carry the message that an entity has one
label in the whole document: each open mention has an edge to every base match of its keys, whose label
is fixed, so this evidence is the same at any distance and for any number of copies; open mentions of a
key share a variable for the entity. Loopy belief propagation runs on each document until it settles.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curafold.llm.common import text_of
from curafold.session import materialize

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
ROWS = 256

#: Shapes whose label frequencies every executor has, the most frequent ones; those of others are joined.
SHAPES_KEPT = 10_000
#: Longer shapes go by their digest.
LONG_SHAPE = 24
COUNTER_ENTRIES = 200_000
#: Log-odds that the corpus may hold against a label; log-potentials of equal labels on skip edges.
FLOOR, REPEATED, SIMILAR = 4.0, 8.0, 6.0
CHAIN_LIMIT = 0.5
#: Digits of a number that make a mention, and trailing digits that make two numbers similar.
MENTION_DIGITS, SIMILAR_DIGITS = 9, 9
#: Damping of messages, which grows slowly if they don't settle; the last sweeps only guard against a cycle.
DAMPING, SLOWER, LAST_SWEEP, SETTLED = 0.3, 100, 20_000, 1e-4

# The base patterns. Possessive repeats match what plain ones do, without backtracking.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# Places that aren't base matches but could hold personal data.
NUMBER = re.compile(r"\+?[0-9(](?:[ ().:/_-]{0,2}[0-9])++")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]++ ?[\[(]? ?\b(?:at|AT)\b ?[\])]? ?[A-Za-z0-9-]++(?:(?: ?[\[(]? ?\b(?:dot|DOT)\b ?[\])]? ?|\.)[A-Za-z0-9-]++)+")
NOT_BLANK = re.compile(r"[^ ]+")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def digits(text: str) -> str:
    return NOT_DIGIT.sub("", text)


def luhn(number: str) -> bool:
    values = [int(c) for c in reversed(number)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from their at signs: what is left of one is the longest run of local characters."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """The base matches, by kind as in ``KINDS`` and then by start."""
    out = emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            number = digits(m[0])
            if 13 <= len(number) <= 19 and luhn(number):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Mentions that overlap no base match, without their outer separators."""
    found = []
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            if m.end() - m.start() >= MENTION_DIGITS and len(digits(m[0])) >= MENTION_DIGITS:
                pieces = [p.span() for p in NOT_BLANK.finditer(m[0])]
                if len(pieces) > 1 and all(len(digits(m[0][a:b])) >= MENTION_DIGITS for a, b in pieces):
                    found += [(m.start() + a, m.start() + b) for a, b in pieces]  # whole numbers side by side
                else:
                    found.append(m.span())
    if any(kind == "email" for kind, _, _ in base):
        found += [m.span() for m in SPELLED.finditer(text)]
    taken, out = sorted((a, b) for _, a, b in base), []
    reach = 0
    at = 0
    for a, b in sorted(found):
        if a < reach:
            continue
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        # A later base match may end earlier than the one before it, so the next few are looked at as well.
        if not any(s < b and a < e for s, e in taken[max(0, at - 4) : at + 4]):
            out.append((a, b))
            reach = b
    return out


def shape(mention: str) -> str:
    """Runs of digits and letters as one sign each; the rest as it is."""
    whole = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", mention))
    return whole if len(whole) <= LONG_SHAPE else sha256(whole.encode("utf-8", "surrogatepass")).hexdigest()


def keys(mention: str) -> tuple[str, str | None]:
    """What repeated mentions share, and what similar ones share."""
    number = digits(mention)
    if len(number) >= MENTION_DIGITS and not re.search(r"[A-Za-z@]", mention):
        return f"n{number}", f"s{number[-SIMILAR_DIGITS:]}"
    plain = re.sub(r"\b(?:at|dot)\b|[\W_]+", "", mention.lower())
    return f"w{plain}", None


def mentions(text: str) -> tuple[list[Span], list[tuple[int, int, int]]]:
    """Base matches, and all nodes ``(start, end, label)`` in text order; label -1 is open."""
    base = base_spans(text)
    nodes = [(a, b, LABELS.index(kind)) for kind, a, b in base] + [(a, b, -1) for a, b in candidates(text, base)]
    return base, sorted(nodes)


class Field:
    """Log-potentials: of labels by shape and of neighbouring labels, from counts over all documents."""

    def __init__(self, shapes: dict[str, list[int]], pairs: np.ndarray):
        n = len(LABELS)
        self.unary = {name: self.of_counts(counts) for name, counts in shapes.items()}
        joint = pairs + 1.0
        lift = np.log(joint * joint.sum() / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)))
        self.chain = np.clip(lift, -CHAIN_LIMIT, CHAIN_LIMIT)
        self.same = {REPEATED: np.eye(n) * REPEATED, SIMILAR: np.eye(n) * SIMILAR}

    @staticmethod
    def of_counts(counts: list[int]) -> np.ndarray:
        p = (np.array(counts, float) + 0.5) / (sum(counts) + 0.5 * len(LABELS))
        return np.maximum(np.log(p), np.log(p).max() - FLOOR)

    @staticmethod
    def linked(text: str, nodes: list[tuple[int, int, int]]) -> dict[tuple[str, float], list[int]]:
        """The nodes that share each key; nothing if no open node could follow a labelled one."""
        if all(label >= 0 for *_, label in nodes) or all(label < 0 for *_, label in nodes):
            return {}
        members: dict[tuple[str, float], list[int]] = {}
        for i, (a, b, _) in enumerate(nodes):
            same, similar = keys(text[a:b])
            for key, strength in ((same, REPEATED), (similar, SIMILAR)):
                if key is not None:
                    members.setdefault((key, strength), []).append(i)
        # Without a skip edge nothing repeats.
        return members if len(members) < sum(map(len, members.values())) else {}

    def missing(self, text: str, nodes: list[tuple[int, int, int]]) -> list[str]:
        """Shapes that inference needs and this executor doesn't have."""
        return sorted({shape(text[a:b]) for a, b, label in nodes if label < 0} - self.unary.keys()) if self.linked(text, nodes) else []

    def infer(self, text: str, nodes: list[tuple[int, int, int]], more: dict[str, list[int]] | None = None) -> tuple[list[Span], bool]:
        """Spans of open nodes whose most probable label isn't ``none``, and whether the messages have settled.

        ``more`` has the counts of shapes beyond those of the model.
        """
        members = self.linked(text, nodes)
        if not members:
            return [], True
        n, width = len(nodes), len(LABELS)
        known_shapes = self.unary | {name: self.of_counts(counts) for name, counts in more.items()} if more else self.unary
        labels = np.array([label for *_, label in nodes])
        unary = np.stack([known_shapes[shape(text[a:b])] if label < 0 else np.zeros(width) for a, b, label in nodes])
        edges: list[tuple[int, int, np.ndarray]] = [(i, i + 1, self.chain) for i in range(n - 1)]
        entities = n
        for (_, strength), found in members.items():
            at = np.array(found)
            known, open_ = labels[at][labels[at] >= 0], at[labels[at] < 0]
            unary[open_] += strength * np.bincount(known, minlength=width)
            if len(open_) > 1:
                edges += [(i, entities, self.same[strength]) for i in open_.tolist()]
                entities += 1
        unary = np.concatenate([unary, np.zeros((entities - n, width))])
        for i in np.flatnonzero(labels >= 0).tolist():
            unary[i] = -50.0
            unary[i, labels[i]] = 0.0
        source = np.array([e[0] for e in edges] + [e[1] for e in edges])
        target = np.array([e[1] for e in edges] + [e[0] for e in edges])
        potential = np.stack([e[2] for e in edges] + [e[2].T for e in edges])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), width))
        for sweep in range(LAST_SWEEP):
            belief = unary.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            new = np.logaddexp.reduce(out[:, :, None] + potential, axis=1)
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message += (1 - DAMPING) / (1 + sweep // SLOWER) * (new - message)
            settled = bool(moved < SETTLED)
            if settled:
                break
        belief = unary[:n].copy()
        inner = target < n
        np.add.at(belief, target[inner], message[inner])
        best = belief.argmax(axis=1)
        return [(LABELS[k], a, b) for (a, b, label), k in zip(nodes, best.tolist(), strict=True) if label < 0 and k > 0], settled


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of ``(what, label)``: what is ``s`` with a shape or ``p`` with the label before."""

    def rows(counter: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in counter], pa.string()), pa.array([v for _, v in counter], pa.int32()), pa.array(list(counter.values()), pa.int64())],
            ["what", "label", "n"],
        )

    counter: Counter = Counter()
    for batch in batches:
        for item in batch.column("text"):
            text = item.as_py()
            _, nodes = mentions(text)
            labels = [max(label, 0) for *_, label in nodes]
            counter.update(("s" + shape(text[a:b]), label) for (a, b, _), label in zip(nodes, labels, strict=True))
            counter.update((f"p{x}", y) for x, y in zip(labels, labels[1:], strict=False))
        if len(counter) > COUNTER_ENTRIES:
            yield rows(counter)
            counter = Counter()
    yield rows(counter)


def train(docs: DataFrame, shapes_kept: int = SHAPES_KEPT) -> tuple[Field, DataFrame]:
    """The field with the most frequent shapes, and the label counts of all shapes: ``shape, counts``."""
    rows = docs.select(text_of().alias("text"))
    counts = rows.mapInArrow(_tally, "what string, label int, n bigint").groupBy("what", "label").agg(F.sum("n").alias("n"))
    by = F.array(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)) for k in range(len(LABELS))])
    table = materialize(counts.groupBy("what").agg(F.sum("n").alias("all"), by.alias("counts")), "shape-counts")
    kept = table.where(F.col("what").startswith("s")).orderBy(F.desc("all"), "what").limit(shapes_kept).collect()
    pairs = np.zeros((len(LABELS), len(LABELS)))
    for r in table.where(F.col("what").startswith("p")).collect():  # a row per label
        pairs[int(r["what"][1:])] = r["counts"]
    shapes = table.where(F.col("what").startswith("s")).select(F.expr("substr(what, 2)").alias("shape"), "counts")
    return Field({r["what"][1:]: r["counts"] for r in kept}, pairs), shapes


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


RESULT = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "settled"]
RESULT_TYPES = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, settled boolean"


def _columns(found: list[tuple[list[Span], list[Span], bool]]) -> list[pa.Array]:
    """The result columns of documents from their base matches, added spans and whether messages settled."""
    kinds = [Counter(k for k, _, _ in base) for base, _, _ in found]
    return [
        *(pa.array([c[kind] for c in kinds], pa.int64()) for kind in KINDS),
        pa.array([sha256(written(base).encode()).hexdigest() for base, _, _ in found]),
        pa.array([written(base + more) for base, more, _ in found]),
        pa.array([len(more) for _, more, _ in found], pa.int64()),
        pa.array([settled for *_, settled in found]),
    ]


def find_personal_data(docs: DataFrame, shapes_kept: int = SHAPES_KEPT) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, settled``; one row per document.

    Counts and digest are those of the base matches, ``spans`` has the added ones too, as
    ``kind:start:end`` in code points. A null or empty text has no spans, and the digest of an empty string.
    Base matches of different kinds may overlap; added spans overlap no base match. ``settled`` is false if the messages
    of a document still moved after the last sweep. ``shapes_kept`` sets how many shapes every executor has;
    documents that need others wait for a join with the counts of all shapes, so it doesn't change the result.
    """
    trained, shapes = train(docs, shapes_kept)
    field = docs.sparkSession.sparkContext.broadcast(trained)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found, waiting, needs = [], [], []
                for text in part.column("text").to_pylist():
                    base, nodes = mentions(text)
                    missing = model.missing(text, nodes)
                    found.append((base, [], True) if missing else (base, *model.infer(text, nodes)))
                    waiting.append(text if missing else None)
                    needs.append(missing or None)
                columns = [part.column("doc_id"), *_columns(found), pa.array(waiting, pa.string()), pa.array(needs, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *RESULT, "text", "needs"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for batch in batches:
            found = []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("more").to_pylist(), strict=True):
                base, nodes = mentions(text)
                found.append((base, *model.infer(text, nodes, {m["shape"]: m["counts"] for m in more})))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_columns(found)], ["doc_id", *RESULT])

    first = rows.mapInArrow(run, f"doc_id {kind}, {RESULT_TYPES}, text string, needs array<string>")
    if shapes.count() <= shapes_kept:
        return first.drop("text", "needs")
    first = materialize(first.withColumn("uid", F.monotonically_increasing_id()), "pii-first")
    late = first.where("needs IS NOT NULL")
    wanted = late.select("uid", F.explode("needs").alias("shape")).join(shapes, "shape")
    # A document's list is as long as it has distinct shapes.
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("shape", "counts")).alias("more"))
    done = late.select("uid", "doc_id", "text").join(lists, "uid").select("doc_id", "text", "more")
    return first.where("needs IS NULL").select("doc_id", *RESULT).unionByName(done.mapInArrow(rest, f"doc_id {kind}, {RESULT_TYPES}"))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones joined, replaced by the kind of its first span."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
