"""Exact dedup by Patricia tries.

Copies are first folded inside the task that reads them, so a group of copies of any size sends one
row per task. Owners then hold the partitions of ``(length, content hash)``: each inserts the full
byte strings into a compressed radix trie, whose terminal nodes keep the row that stays and the
number of rows. Groups are told apart by the bytes in the trie; rows find their group by its SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curafold.llm.common import text_of
from curafold.session import materialize

#: The characters that don't count: space and the controls from tab to carriage return.
BLANK = b" \t\n\x0b\x0c\r"
BLANK_PATTERN = r"[\x20\x09-\x0D]+"
#: Bytes of labels that a trie may hold before it spills subtrees.
TRIE_BYTES = 48 << 20
#: Rough cost of a node beside its label.
NODE_BYTES = 300

PARTIAL = "n_bytes bigint, digest binary, body binary, chars bigint, id bigint, rows bigint"


class Node:
    __slots__ = ("label", "children", "best", "rows")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.best: tuple | None = None
        self.rows = 0


def common_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """A compressed trie of byte strings; a terminal keeps the smallest rank and counts its rows.

    The first byte of a key picks the subtree, which is the unit of spilling; ``held`` has the bytes of each. The empty
    key has a subtree of its own.
    """

    def __init__(self) -> None:
        self.subtrees: dict[int, Node] = {}
        self.held: dict[int, int] = {}

    def insert(self, key: bytes, rank: tuple, rows: int) -> None:
        first = key[0] if key else -1
        node = self.subtrees.setdefault(first, Node(b""))
        at, new = min(1, len(key)), 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                new += len(key) - at + NODE_BYTES
                node, at = child, len(key)
                continue
            if not key.startswith(child.label, at):
                shared = common_length(child.label, key[at : at + len(child.label)])
                upper = Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                child = node.children[key[at]] = upper
                new += NODE_BYTES
            node, at = child, at + len(child.label)
        node.best = rank if node.best is None else min(node.best, rank)
        node.rows += rows
        self.held[first] = self.held.get(first, 0) + new

    def pop(self, first: int) -> Iterator[tuple[bytes, tuple, int]]:
        """Removes a subtree and gives its terminals as ``(key, rank, rows)``."""
        self.held.pop(first)
        stack = [(self.subtrees.pop(first), bytes([first]) if first >= 0 else b"")]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.rows:
                yield prefix, node.best, node.rows
            stack.extend((c, prefix) for c in node.children.values())


def ranked(chars: int, doc_id: int | None) -> tuple:
    """The smallest rank stays: most code points, then the smallest id; a null id comes last."""
    return (-chars, doc_id is None, doc_id)


def _rows(found: list[tuple[bytes, tuple, int]], body: bool) -> pa.RecordBatch:
    keys = [k for k, _, _ in found]
    columns = {
        "n_bytes": pa.array([len(k) for k in keys], pa.int64()),
        "digest": pa.array([sha256(k).digest() for k in keys], pa.binary()),
        "body": pa.array([k if body else None for k in keys], pa.binary()),
        "chars": pa.array([-r[0] for _, r, _ in found], pa.int64()),
        "id": pa.array([r[2] for _, r, _ in found], pa.int64()),
        "rows": pa.array([n for _, _, n in found], pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _emit(found: Iterator[tuple[bytes, tuple, int]], body: bool) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for item in found:
        part.append(item)
        size += len(item[0]) if body else 100
        if size > 4 << 20:
            yield _rows(part, body)
            part, size = [], 0
    if part:
        yield _rows(part, body)


def fold_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within one task become one row. A trie over its bound hands on its heaviest subtrees as
    they are: their rows are partial counts, which the owners add up."""
    trie, total = RadixTrie(), 0
    for batch in batches:
        ids, chars = batch.column("id").to_pylist(), batch.column("chars").to_pylist()
        for i, text in enumerate(batch.column("text")):
            trie.insert(text.as_py().translate(None, BLANK), ranked(chars[i], ids[i]), 1)
        total = sum(trie.held.values())
        while total > TRIE_BYTES:
            heavy = max(trie.held, key=trie.held.get)
            total -= trie.held[heavy]
            yield from _emit(trie.pop(heavy), True)
    for first in sorted(trie.subtrees):
        yield from _emit(trie.pop(first), True)


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owner of a partition, which arrives sorted by text.

    Over the bound all subtrees are spilled as soon as another text comes: in sorted input what was inserted before is
    complete, so the terminals are final.
    """
    trie, last = RadixTrie(), None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("body", "chars", "id", "rows")]
        for body, chars, doc_id, rows in zip(*columns, strict=True):
            if body != last and sum(trie.held.values()) > TRIE_BYTES:
                for first in sorted(trie.subtrees):
                    yield from _emit(trie.pop(first), False)
            trie.insert(body, ranked(chars, doc_id), rows)
            last = body
    for first in sorted(trie.subtrees):
        yield from _emit(trie.pop(first), False)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Distinct texts: ``digest, n_bytes, keep_id, group_size`` and the code points of the row that stays."""
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"),
        F.char_length(text_of(text)).cast("long").alias("chars"),
        text_of(text).cast("binary").alias("text"),
    )
    partial = rows.mapInArrow(fold_in_task, PARTIAL)
    owners = partial.repartition("n_bytes", "digest").sortWithinPartitions("body").mapInArrow(own, PARTIAL)
    return owners.select("digest", "n_bytes", F.col("id").alias("keep_id"), F.col("rows").alias("group_size"), F.col("chars").alias("keep_chars"))


def _placed(docs: DataFrame, text: str, doc_id: str, *more: Column) -> DataFrame:
    """``more`` columns of each row with its ``id``, the digest of its text and its code points."""
    # Never null, so a join needs no filter that would compute it a second time.
    digest = F.coalesce(F.unhex(F.sha2(F.regexp_replace(text_of(text), BLANK_PATTERN, "").cast("binary"), 256)), F.lit(bytearray()))
    return docs.select(*more, F.col(f"`{doc_id}`").cast("long").alias("id"), digest.alias("digest"), F.char_length(text_of(text)).cast("long").alias("chars"))


def _stays() -> Column:
    return F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))


def mark_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``; one row per document, dropped ones too.

    Texts are equal if they are identical without the characters of ``BLANK``; null counts as empty.
    Of equal texts the row with the most code points stays, then the one with the smallest id. A null id counts as the largest,
    and is null in ``keep_id``. Exactly one row of a group is kept: of rows that share the id and the code points of
    the one that stays, any one. A group of any size reaches the join from one side only, so a skewed join is
    split by adaptive execution.
    """
    rows = materialize(_placed(docs, text, doc_id, F.monotonically_increasing_id().alias("row")), "digests")
    owners = materialize(exact_groups(docs, text, doc_id).drop("n_bytes"), "groups")
    marked = rows.join(owners, "digest").withColumn("stays", _stays())
    first = marked.where("stays").groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = marked.join(first.select("digest", "first"), "digest", "left")
    kept = F.col("stays") & (F.col("first").isNull() | (F.col("row") == F.col("first")))
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns, whatever their names; of rows that share the id that stays, any one."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    owners = exact_groups(docs).select("digest", "keep_id", "keep_chars")
    stays = _placed(docs, "text", "doc_id", row).join(owners, "digest").where(_stays())
    return stays.select("digest", "doc").dropDuplicates(["digest"]).select("doc.*")
