"""Mixing, nearest neighbours and the pipeline."""

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import BLANK, awkward, classes, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from curafold.llm import catalog, mixing, quality, vptree

FOLDER = "/root/testdata/sf0.001"


def reshared(sizes, weights, most=3.0):
    """Targets by sharing again and again what the capped sources leave."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 900, "c": 400, None: 30}, {"a": 5}, {"a": 1, "b": 1, "c": 1000}, {"a": 0, "b": 7}])
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(s, f"={s}", n) for s, n in sizes.items()], "source string, skey string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(reshared(sizes, mixing.WEIGHTS), abs=1e-5)


def test_mix_takes_near_the_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs.repartition(7)).toPandas()
    again = mixing.mix(docs.repartition(3)).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert len(got) == 4000 and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"] == 0).all()
    by = got.merge(docs.toPandas()[["doc_id", "source"]], on="doc_id").groupby("source")
    assert ((by.taken.sum() - by.target.first()).abs() <= 40).all()
    assert got.taken.sum() <= got["size"].sum() + 40 * 8
    spread = by.copies.agg(lambda c: c.max() - c.min())
    assert (spread <= 2).all()


@pytest.mark.parametrize("seed", range(10))
def test_one_long_document_leaves_no_gap(spark, seed):
    rows = [(i, " ".join(["w"] * 100), "a") for i in range(300)] + [(300, " ".join(["w"] * 100_000), "a"), (301, " ".join(["w"] * 198_572), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1.0, 1.0), seed=seed).where("doc_id < 301").toPandas()
    assert got.target.iloc[0] == pytest.approx(164_286)
    assert abs(got.taken.sum() - 164_286) <= 100 and (got.copies <= 3).all()
    # A document longer than its source's target steps aside.
    small = mixing.mix(docs, weights=(1.0, 3.0), seed=seed).where("doc_id < 301").toPandas()
    assert small.target.iloc[0] == pytest.approx(82_143) and abs(small.taken.sum() - 82_143) <= 100


def test_one_id_for_all_rows_is_dealt_out(spark):
    rows = [(None if i % 2 else 7, " ".join(["w"] * (1 + i % 50)), "a" if i % 3 else "b") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (mixing.mix(docs.repartition(n, "text")).groupBy("doc_id", "size", "taken").count() for n in (3, 8))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(one) == key(two)
    by = mixing.mix(docs).groupBy("source_size").agg(F.sum("taken"), F.max("target")).collect()
    assert all(abs(r[1] - r[2]) <= 1 for r in by)


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.mix(docs)
    assert got.count() == docs.count()
    assert {r.doc_id for r in got.where("size = 0").collect()} == {3, 4, 5, None}
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(docs.where("text IS NULL")).where("taken = 0").count() == 2


def neighbours(ids, vectors, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[i]
        order = [j for j in np.lexsort([ids, -np.round(score, 12)]) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vptree, "QUERY_ROWS", 5)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32)
    vectors[::3] = vectors[0]  # a hot vector
    ids = np.arange(1500)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": [v.tolist() for v in vectors]}), "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in vptree.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(vptree.cosine(*(vectors[[x]].astype(float) for x in (r.query_id, r.vec_id)))[0], abs=1e-12)
    assert got == neighbours(ids, vectors.astype(float))


def test_far_cells_are_not_visited(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 24))
    vectors = middles[rng.integers(0, 12, 1800)] + 0.02 * rng.normal(size=(1800, 24))
    vectors[:600] = vectors[0]  # a hot cell, which has several shards
    ids = np.arange(1800)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": [v.tolist() for v in vectors]}), "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vptree.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == neighbours(ids, vectors)

    units = vptree.unit(vectors)
    centres = units[[0, *range(601, 1800, 100)]]
    cell = vptree._apart(units, centres).argmin(axis=1)
    apart = vptree._apart(units, centres).min(axis=1)
    reach = {24: [(int(c), apart[cell == c].min(), apart[cell == c].max()) for c in np.unique(cell)]}
    home = cell == cell[1000]
    order, inner, outer = vptree.build(units[home])
    row = {"shard": 0, "width": 24, "points": vectors[home][order].tobytes(), "inner": inner.tobytes(), "outer": outer.tobytes(), "ids": ids[home][order].tobytes(),
           "at": np.arange(home.sum()).tobytes(), "queries": vectors[[1000]].tobytes(), "query_ids": ids[[1000]].tobytes()}
    batch = pa.RecordBatch.from_pylist([row])
    visited = {r["cell"] for b in vptree._route(5, 1.0, {24: centres}, reach)([batch]) for r in b.to_pylist()}
    score = vptree.cosine(np.stack([vectors[1000]] * 1800), vectors)
    score[1000] = -2
    needed = set(cell[np.argsort(-score, kind="stable")[:5]])
    assert needed <= visited and len(visited) < len(reach[24]) / 2


def test_repeated_queries_and_ids_do_not_repeat_neighbours(spark):
    rows = [(i, [1.0, i / 10]) for i in range(8)] + [(0, [1.0, 0.0])] * 3 + [(3, [1.0, 0.05]), (2, [-1.0, 0.0])]
    got = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 3), (2, 1), (3, 2), (4, 4), (5, 5)]
    assert got[0].score == pytest.approx(1 / np.sqrt(1 + 0.05**2))


@pytest.mark.parametrize("width", [1, 4])
def test_ties_of_different_vectors_go_to_smaller_ids(spark, width):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, width)).round(3)
    # Scaled by powers of two, so cosines are equal to the last bit; smaller ids are spread over the scales.
    ids = rng.permutation(360)
    rows = [(int(i), (base[j % 3] * 2.0 ** (j // 3 - 60)).tolist()) for j, i in enumerate(ids)] + [(1000 + i, (base[0] * (1 + i)).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = {i: np.array(v) for i, v in rows}
    got = defaultdict(list)
    for r in vptree.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert len(got) == 9
    for q, found in got.items():
        others = [i for i in vectors if i != q]
        score = vptree.cosine(np.stack([vectors[q]] * len(others)), np.stack([vectors[i] for i in others]))
        assert found == [(i, s) for s, i in sorted(zip(score, others, strict=True), key=lambda x: (-x[0], x[1]))[:5]]


def test_factor_trades_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    points = vptree.unit(centres[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 32)))
    order, inner, outer = vptree.build(points)
    queries = points[::60]
    true = np.argsort(-(queries @ points[order].T), axis=1)[:, :6]

    def recall(factor):
        found = vptree.Search(points[order], inner, outer, queries, 6, factor).found
        return np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, true, strict=True)])

    assert recall(1.0) == 1.0 and recall(1.2) >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []),
            (None, [1.0, 0.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0, 0.0]), (50, [-1.0, 0.0]), (100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 0.0), (0, 3, 50, -1.0), (50, 1, 8, 0.0), (50, 2, 0, -1.0), (50, 3, 1, -1.0)]
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def brute_pipeline(docs, good):
    """``(doc_id, text)`` after the first three stages."""
    rows = [(i, t) for i, t in docs if i in good]
    best = {}
    for i, t in rows:
        key = re.sub(BLANK, "", t or "")
        best[key] = min(best.get(key, (0, None)), (-len(t or ""), i)) if key in best else (-len(t or ""), i)
    kept = {i for _, i in best.values()}
    rows = [(i, t) for i, t in rows if i in kept]
    label = classes(rows)
    return {i: t for i, t in rows if label[i] == i}


def test_pipeline_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    left = brute_pipeline([(r.doc_id, r.text) for r in docs.collect()], good)
    frame = docs.where(F.col("doc_id").isin(list(left)))
    copies = {r.doc_id: r.copies for r in mixing.mix(frame).collect() if r.copies}
    library = Tokenizer.from_file(catalog.TOKENIZER)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert pd.Series([r.doc_id for r in got]).value_counts().to_dict() == copies
    for r in got:
        assert r.ids == library.encode(left[r.doc_id] or "", add_special_tokens=False).ids


def test_stages_take_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (awkward(spark), empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_names_of_queries():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES)
    assert numbers == list(range(1, 14))
