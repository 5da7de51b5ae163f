"""Collocations, hard negatives and quality rules against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from helpers import awkward, empty
from pyspark.sql import functions as F

from curafold.llm import anomalies, collocations, hard_negatives

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_collocations(rows, least, top, longest=5):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in many.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in many.items():
            if inside[p] < a:
                score, cut = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def texts(seed, n=300):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([*(f"w{i}" for i in range(25)), "É", "é", "Ä", "x y", "日本", "a.b", "THE", "the", "c,d\te"])
    rows = []
    for i in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(0, 40)), p=np.arange(len(vocabulary), 0, -1) / sum(range(len(vocabulary) + 1))))
        if i % 3 == 0:
            words += ["new", "york", "city", "hall"] * int(rng.integers(1, 3))
        if i % 5 == 0:
            words += ["ab"] * 7
        rows.append((" ".join(words) + ("\r\n" if i % 2 else "!"), [None, "und", "en", "en", "de"][i % 5]))
    return rows


@pytest.mark.parametrize("text_bytes", [1 << 24, 97])
def test_collocations_match_brute_force(spark, text_bytes):
    rows = texts(1) + [(None, "en"), ("", None), ("one two", "xx"), ("q " * 500 + "tail", "en")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for least, top in ((5, 2000), (9, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(df, least=least, top=top, text_bytes=text_bytes).collect())
        assert got == brute_collocations(rows, least, top)
        assert len(got) > 20 or top == 7


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = texts(2, 120)
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=6).collect())
    assert got == brute_collocations(rows, 6, 2000)


def test_filter_knows_all_its_phrases():
    import pyarrow as pa

    body = np.frombuffer("the new york city hall. É the".lower().encode(), np.uint8)
    words, _, piece = collocations.words_of(body, np.array([0, len(body)]))
    assert words.to_pylist() == ["the", "new", "york", "city", "hall", "é", "the"] and piece.tolist() == [0] * 5 + [1] * 2
    hashed = collocations.hash_words(words)
    chain = collocations.chained(collocations.chained(collocations.hash_words(pa.array(["en"], pa.large_string())), hashed[:1]), hashed[1:2])
    whole = collocations.hash_phrases(pa.array(["en", "en"]), pa.array(["the new", "x"]))
    assert chain[0] == whole[0] != whole[1]


def test_collocation_arithmetic_passes_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**9, 5 * 10**13, 10**10, 7 * 10**11)], "a long, n long, l long, r long")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alnr"}
    over = row.select((wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).alias("over"), (wide["l"] * wide["r"]).alias("under"))
    assert over.select(F.expr("over div under")).first()[0] == 1000 * 3 * 10**9 * 5 * 10**13 // (10**10 * 7 * 10**11)


def test_collocations_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    assert got == brute_collocations(rows, 100, 2000) and got
    assert collocations.collocations(empty(spark)).count() == 0


def brute_negatives(rows, is_anchor, k=5):
    rows = sorted({(i, label, tuple(int(np.floor(256 * float(x))) for x in v)) for i, label, v in rows if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))
        others = sorted((-score(w), j, m) for j, m, w in rows if j != i)
        for s, j, _ in [o for o in others if o[2] == label][:k]:
            window = [o for o in others if o[2] != label and -80 * s <= -100 * o[0] <= -100 * s][:k]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(window, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, rank string, block int, score double"


@pytest.mark.parametrize(("kind", "sizes"), [("clusters", (8, 60)), ("ties", (4, 50)), ("plain", (256, 8192))])
def test_hard_negatives_match_brute_force(spark, monkeypatch, kind, sizes):
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", sizes[0])
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", sizes[1])
    rng = np.random.default_rng(len(kind))
    n, width = 400, 6
    centres = rng.normal(size=(5, width))
    vectors = {"clusters": centres[rng.integers(0, 5, n)] + 0.1 * rng.normal(size=(n, width)), "ties": rng.integers(0, 3, (n, width)) / 2, "plain": rng.normal(size=(n, width))}[kind].astype(np.float32)
    label = np.where(rng.random(n) < 0.4, 3, rng.integers(0, 9, n))
    rows = [(int(i), int(label[i]), [float(x) for x in vectors[i]]) for i in range(n)]
    rows += [rows[0], rows[0], rows[20], (None, 1, rows[1][2]), (500, None, rows[1][2]), (520, 1, None), (540, 1, [None] * width), (560, 3, [float("nan")] * width), (580, 3, [0.0] * width)]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], VECTORS).repartition(4)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute_negatives(rows, lambda i: i % 20 == 0) and got


def test_hard_negatives_of_awkward_rows(spark):
    run = lambda rows: sorted(tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 10 == 0).collect())
    assert run([]) == []
    assert run([(0, 1, [1.0])]) == []
    # Vectors without components are only compared with each other; all score 0.
    assert run([(0, 1, []), (1, 1, []), (2, 2, []), (3, 2, [1.0])]) == [(0, 1, 1, 2, 0, 0)]
    # Exact beyond the whole numbers of doubles, and clipped beyond 64 bits.
    big = [(0, 1, [3e6, 1.0]), (1, 1, [3e6, 1.0]), (2, 2, [3e6, 0.5]), (3, 2, [3e6, 1.5])]
    assert run(big) == brute_negatives(big, lambda i: i % 10 == 0) != []
    huge = [(0, 1, [1e200]), (1, 1, [1e200]), (2, 2, [1e190])]
    assert run(huge) == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]
    # One id for all rows: a row is nobody's negative within its own id.
    assert run([(0, k % 2, [float(k)]) for k in range(9)]) == []


def test_bounds_hold_and_leave_candidates_out():
    rng = np.random.default_rng(4)
    centres = 400 * rng.normal(size=(6, 12))
    anchors = np.floor(np.repeat(centres, 5, axis=0) + 8 * rng.normal(size=(30, 12)))
    points = np.floor(centres[rng.integers(0, 6, 900)] + 30 * rng.normal(size=(900, 12)))
    bounds = hard_negatives.Bounds(anchors, points)
    placed = {int(bounds.order[0])}
    exact = points @ anchors.T
    for a in bounds.order:
        assert bounds.parent[a] in placed or bounds.parent[a] < 0
        placed.add(int(a))
        low, high = bounds.enter(int(a))
        assert (low <= exact[:, a]).all() and (exact[:, a] <= high).all()
        bounds.rescore(int(a), np.flatnonzero(high >= np.sort(exact[:, a])[-20]))
    assert bounds.scored < 0.6 * exact.size


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def naive_score(forest, row):
    total = 0.0
    for root in forest.roots:
        node = root
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] < forest.cut[node] else forest.right[node]
        total += forest.path[node]
    return 2 ** -(total / len(forest.roots) / forest.typical)


def rule_docs(n=240):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        words = [f"{'abcdefgh'[rng.integers(8)]}{rng.integers(300)}" for _ in range(int(rng.integers(40, 200)))]
        bad = i % 4 == 0
        if bad:
            words = [w + "$$$" if rng.random() < 0.6 else w.upper() for w in words]
        text = " ".join(words[:20]) + "\n" + " ".join(words[20:]) + "\n \n" + " ".join(words[:20]) * int(i % 3 == 0)
        rows.append((i, text + " é 漢" * int(rng.integers(0, 3))))
        if i % 8 < 6:
            labels.append((i, int(not bad)))
    return rows, labels


def test_rules_match_brute_force_and_catch_the_odd_ones(spark):
    rows, labels = rule_docs()
    rows += [(1000, None), (1001, ""), (None, "a b c " * 40), (1002, "x " * 49), (1003, " ".join(f"w{i}" for i in range(50))), (1004, "a b c a b c a b\x0bc\x1ca\x85b"), (1004, " # \n # \n \n#")]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, score string, kept boolean").repartition(6)
    truth = spark.createDataFrame([*labels, (None, 1), (3, None), (7, 0)], "doc_id long, quality int")
    got = anomalies.judge(docs, truth).toPandas()
    want = Counter((i, *brute_rules(t)) for i, t in rows)
    assert want == Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.itertuples())
    assert not (got.kept & got.base_failed).any() and (got.score.isna() == got.base_failed).all()
    judged = got[~got.base_failed & (got.doc_id < 240)]
    bad = judged.doc_id % 4 == 0
    assert judged.kept[~bad].mean() > 0.9 and judged.kept[bad].mean() < 0.1
    verdict = anomalies.train(docs, truth)
    for r in judged.head(20).itertuples():
        features = anomalies.measure(dict(rows)[r.doc_id].encode())[1]
        assert r.score == pytest.approx(naive_score(verdict.forest, features), abs=1e-12)
        assert r.kept == (r.score <= verdict.most)
    again = anomalies.judge(docs.repartition(3), truth).toPandas()
    order = ["doc_id", "n_words", "n_symbols"]
    assert again.sort_values(order).reset_index(drop=True).equals(got.sort_values(order).reset_index(drop=True))


def test_paths_of_trees_and_calibration():
    x = np.array([[0.0], [0.0], [0.0], [9.0]])
    forest = anomalies.grow(x, trees=3, tree_rows=4)
    # Any cut parts the odd row at depth 1; the equal ones would take the mean path of three.
    wait = 1 + 2 * (np.log(2) + np.euler_gamma) - 4 / 3
    assert forest.score(x) == pytest.approx(np.exp2(-np.array([wait, wait, wait, 1.0]) / forest.typical))
    assert anomalies.unsplit_path([0, 1, 2]).tolist() == [0, 0, 1]
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 3)), 8 + rng.normal(size=(30, 3))])
    good = np.arange(330) < 300
    verdict = anomalies.calibrate(x, good)
    kept = verdict.score(x) <= verdict.most
    assert kept[good].mean() >= 1 - anomalies.GOOD_REJECTED and not kept[~good].any()
    assert (anomalies.calibrate(x[:0], good[:0]).score(x) <= np.inf).all()
    assert anomalies.calibrate(x[good], good[good]).most == np.inf


def test_rules_of_awkward_rows(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = anomalies.judge(docs, none).collect()
    want = Counter((r.doc_id, *brute_rules(r.text)) for r in docs.collect())
    assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert all(r.kept != r.base_failed for r in got)
    assert anomalies.judge(empty(spark), none).count() == 0


def test_rules_are_fitted_and_calibrated_on_all_labelled_rows(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "Delta", "eps;", "7zeta", "eta.", "th#ta"]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 6], 60 + i % 40)) + f" {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 6 > 1)) for i in range(400)], "doc_id bigint, quality int")
    got = anomalies.train(docs, labels)
    measured = [(i % 6 > 1, anomalies.measure(t.encode())) for i, t in rows]
    used = sorted((good, list(x)) for good, (base, x) in measured if not anomalies.base_failed(base[0], base[4]))
    good, x = np.array([g for g, _ in used]), np.array([v for _, v in used])
    want = anomalies.calibrate(x, good)
    assert got.most == want.most and got.score(x).tolist() == want.score(x).tolist()
    assert not hasattr(anomalies, "SAMPLE_ROWS")
