"""Exact dedup, near-dedup and removal of repeated strings against brute force."""

import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from helpers import BLANK, awkward, classes, empty, near_copies, shingles

from curafold.llm import bagminhash, exact_dedup, suffix_dedup


def exact_truth(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(BLANK, "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out, taken = [], set()
    for doc_id, text in rows:
        key = re.sub(BLANK, "", text or "")
        best = min(groups[key])
        kept = best == (-len(text or ""), doc_id is None, doc_id) and key not in taken
        taken |= {key} if kept else set()
        out.append((doc_id, best[2], len(groups[key]), kept, sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, exact_dedup.mark_duplicates(docs).collect()), key=repr) == exact_truth(rows)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("key = 'k' AND kept").count() == kept.count()
    assert exact_dedup.mark_duplicates(empty(spark)).count() == 0


def test_exact_groups_with_a_hot_one(spark):
    rows = [(i, f"t {i % 50}" if i % 3 else "hot  text" + " " * (i % 4)) for i in range(3000)]
    got = exact_dedup.mark_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))
    assert sorted(map(tuple, got.collect()), key=repr) == exact_truth(rows)


def test_one_row_of_a_group_stays(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (None, "ab"), (2, "a  b"), (2, "a  b"), (None, "c"), (None, "c"), (3, None), (3, ""), (4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = exact_dedup.mark_duplicates(docs).where("kept").collect()
    assert sorted((r.doc_id, r.group_size) for r in kept if r.doc_id) == [(2, 6), (3, 2), (4, 1)] and len(kept) == 4
    left = exact_dedup.drop_duplicates(docs).collect()
    assert sorted((repr(r.doc_id), r.text or "") for r in left) == [("2", "a  b"), ("3", ""), ("4", "d"), ("None", "c")]


def test_one_row_of_a_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (1, text), (1, text), (2, text), (7, text + " x"), (None, "alone"), (None, "alone"), (1, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((repr(r.doc_id), r.text) for r in bagminhash.near_deduplicated(docs).collect())
    assert got == [("1", "other"), ("1", text), ("None", "alone")]


def test_one_id_for_all_texts(spark):
    rows = [(None if i % 2 else 5, t) for i, t in near_copies(seed=3, n=30, copies=12)]
    got = bagminhash.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = set(classes([(i, t) for i, (_, t) in enumerate(rows)]).values())
    assert got.count() == len(want)


def test_trie_shares_prefixes():
    trie = exact_dedup.RadixTrie()
    for key in (b"", b"road", b"roads", b"rose", b"road", b"x"):
        trie.insert(key, (len(key),), 1)
    assert set(trie.subtrees) == {-1, ord("r"), ord("x")}
    (inner,) = trie.subtrees[ord("r")].children.values()
    assert inner.label == b"o" and {c.label for c in inner.children.values()} == {b"ad", b"se"}
    assert sorted((k, n) for f in list(trie.subtrees) for k, _, n in trie.pop(f)) == [(b"", 1), (b"road", 2), (b"roads", 1), (b"rose", 1), (b"x", 1)]


def test_trie_spills_and_keeps_counts(monkeypatch):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 3000)
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) * 40 for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(400)), "chars": [len(t) for t in texts], "text": texts})
    partial = pa.Table.from_batches(exact_dedup.fold_in_task(iter([batch])))
    assert partial.num_rows >= len(set(texts)) and sum(partial.column("rows").to_pylist()) == 400
    ordered = partial.sort_by([("body", "ascending")])
    owned = pa.Table.from_batches(exact_dedup.own(iter(ordered.to_batches(max_chunksize=7))))
    want = {sha256(t).digest(): (min(i for i, x in enumerate(texts) if x == t), texts.count(t)) for t in texts}
    got = {r["digest"]: (r["id"], r["rows"]) for r in owned.to_pylist()}
    assert got == want and owned.num_rows == len(want)


def test_near_classes_match_all_pairs(spark):
    rows = near_copies()
    got = bagminhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {r.doc_id: (r.class_id, r.class_size) for r in got.collect()}
    want = classes(rows)
    assert {k: c for k, (c, _) in got.items()} == want
    assert all(n == list(want.values()).count(c) for c, n in got.values())


def test_near_classes_of_awkward_rows(spark):
    docs = awkward(spark)
    got = bagminhash.near_duplicate_classes(docs)
    assert got.count() == docs.count()
    by_id = defaultdict(set)
    for r in got.collect():
        by_id[r.doc_id].add(r.class_id)
    assert by_id[1] == by_id[2] == {1} and 1 in by_id[None] and by_id[3] == by_id[4] == {3} and by_id[5] == {5}
    kept = bagminhash.near_deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 5, 6, 7, 8] and kept.count() == 6
    assert bagminhash.near_duplicate_classes(empty(spark)).count() == 0


def test_buckets_in_blocks_lose_no_link(spark, monkeypatch):
    """A chain of edits: neighbours are similar, ends are not, and the pivot sees few of them."""
    monkeypatch.setattr(bagminhash, "BLOCK", 4)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        words = list(words)
        for _ in range(3):
            words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_signatures_estimate_the_weighted_similarity():
    rng = random.Random(4)
    gaps = []
    for _ in range(120):
        a = [f"w{rng.randrange(30)}" for _ in range(rng.randint(20, 200))]
        cut = rng.randint(0, len(a))
        b = a[:cut] + [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 60))]
        texts = [" ".join(a * 3), " ".join(b * 3) or "x"]
        data, offsets = bagminhash.column_bytes(pa.array(texts))
        best = bagminhash.signatures(*bagminhash.shingles(data, offsets), 2)
        x, y = map(shingles, texts)
        true = sum((x & y).values()) / sum((x | y).values())
        gaps.append((best[0] == best[1]).mean() - true)
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.08


def test_overlaps_of_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 80))) for _ in range(25)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = bagminhash.overlaps(sets)
    off = ~np.eye(25, dtype=bool)  # a set's overlap with itself counts shared units only
    assert (got[off] == np.array(want)[off]).all()


def repeats_truth(rows, length=50):
    low = {}
    for doc_id, text in rows:
        b, k = (text or "").encode(), suffix_dedup.NO_ID if doc_id is None else doc_id
        for p in range(len(b) - length + 1):
            low[b[p : p + length]] = min(low.get(b[p : p + length], suffix_dedup.NO_ID), k)
    out = []
    for doc_id, text in rows:
        b, k = (text or "").encode(), suffix_dedup.NO_ID if doc_id is None else doc_id
        covered = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if low[b[p : p + length]] < k:
                covered[p : p + length] = True
        spans = int((covered[:-1] & ~np.concatenate([[False], covered[:-2]])).sum()) if len(b) else 0
        kept = bytes(c for c, x in zip(b, covered, strict=False) if not x)
        out.append((doc_id, len(b), int(covered.sum()), spans, sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("alphabet", ["ab", "abé ", "abcdefgh ", "a"])
def test_repeats_match_brute_force(spark, alphabet):
    rng = random.Random(5)
    base = "".join(rng.choice(alphabet) for _ in range(2000))
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            at, n = rng.randrange(1900), rng.choice([10, 49, 50, 51, 80, 300])
            parts.append(base[at : at + n] if rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(n)))
        rows.append((rng.choice([i, i, i, None, 7]), None if rng.random() < 0.1 else "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = repeats_truth(rows)
    for hot in (4, suffix_dedup.HOT_OCCURRENCES):
        got = suffix_dedup.remove_repeats(docs, block_bytes=2000, hot_occurrences=hot, with_text=True)
        assert sorted([tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got.collect()], key=repr) == want


def test_contexts_are_sorted_a_few_at_a_time(monkeypatch):
    """Slices of anchors give what one sort of all gives."""
    rng = np.random.default_rng(8)
    n = 400
    body = rng.integers(97, 99, (n, suffix_dedup.SLOT)).astype(np.uint8)
    body[:, 12:70] = body[rng.integers(0, 6, n), 12:70]
    near, far = np.zeros(n, np.uint8), np.full(n, suffix_dedup.PLACES - 1, np.uint8)
    h, least = rng.integers(0, 30, n).astype(np.uint64), rng.permutation(n)
    prints = suffix_dedup.fingerprints(body, near, far)
    raw = body.tobytes()
    columns = {"hashes": h, "prints": prints, "least": least, "flags": np.zeros(n, np.uint8), "near": near, "far": far}
    table = pa.table({"block": [0], **{k: pa.array([suffix_dedup.packed(v)], pa.binary()) for k, v in columns.items()}, "bytes": pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary()), "size": [len(raw)]})
    whole = suffix_dedup._judge((), table).to_pylist()
    monkeypatch.setattr(suffix_dedup, "SORTED_CONTEXTS", 7)
    assert suffix_dedup._judge((), table).to_pylist() == whole
    masks = suffix_dedup.unpacked(whole[0]["masks"], np.uint64)
    sent = {(int(a), int(b)): int(m) for a, b, m in zip(suffix_dedup.unpacked(whole[0]["hashes"], np.uint64), suffix_dedup.unpacked(whole[0]["least"], np.int64), masks, strict=True)}
    low = {}
    for i in range(n):
        for p in range(suffix_dedup.PLACES):
            k = (int(h[i]), p, body[i, 32 - p : 82 - p].tobytes())
            low[k] = min(low.get(k, n), int(least[i]))
    for i in range(n):
        want = sum(1 << p for p in range(suffix_dedup.PLACES) if low[int(h[i]), p, body[i, 32 - p : 82 - p].tobytes()] < least[i])
        assert sent.get((int(h[i]), int(least[i])), 0) == want


def test_repeats_of_awkward_rows(spark):
    docs = awkward(spark)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[6].n_removed == 0 and got[3].n_bytes == 0 and got[3].kept_sha256 == sha256(b"").hexdigest()
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_repeats_in_slices_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 300)
    rng = random.Random(6)
    text = "".join(rng.choice("abcdef ") for _ in range(3000))
    data, offsets = suffix_dedup.column_bytes(pa.array([text, text[500:1500], "", text[100:149]]))
    windows = set()
    for _, anchor, first, last, part, start in suffix_dedup.contexts(data, offsets):
        for a, b in zip(first, last, strict=True):
            windows |= set(range(a + start, b + start + 1))
    want = {p for a, b in zip(offsets, offsets[1:], strict=False) for p in range(a, b - 49)}
    assert windows == want
