"""Operators against brute force on small inputs, hot groups and failure cases."""

import gzip
import hashlib
import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from curafold import session
from curafold.catalog import base
from curafold.operators import contracts, curate, explain, features, joins, metrics, ranking, setops, similarity, splits
from curafold.plans import boosting, learners, runner, workflows
from curafold.session import materialize
from curafold.sources import integrity, summary, tables
from curafold.streaming import curation as streaming


def skewed(n=4000, seed=3):
    """A third of all rows share one key; values contain ties, negatives and zero."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(60)}"
        value = rng.choice([0.0, -1.5, 2.0, rng.gauss(0, 50), rng.expovariate(0.01)])
        rows.append((i, key, value))
    return pd.DataFrame(rows, columns=["id", "key", "value"])


def test_exact_median_with_hot_group(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    want = pdf.groupby("key")["value"].median().to_dict()
    got = {r["key"]: r["median"] for r in ranking.exact_median(df, ["key"], "value").collect()}
    assert got == pytest.approx(want)


def test_grouped_agg_with_hot_group(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    out = ranking.grouped_agg(df, ["key"], {"n": F.count("value"), "m": F.avg("value")}, {"med": "value"})
    got = out.toPandas().set_index("key").sort_index()
    want = pdf.groupby("key")["value"].agg(["count", "mean", "median"]).sort_index()
    np.testing.assert_allclose(got[["n", "m", "med"]].to_numpy(float), want.to_numpy(float))


def test_medians_of_extreme_values(spark):
    inf, nan = float("inf"), float("nan")
    sets = {"a": [1.0, 2.0, inf], "b": [1.0, nan, 2.0], "c": [-inf, 5.0], "d": [3.0], "e": [1e-300, 2e-300, -4e-310], None: [7.0, 9.0]}
    sets["f"] = [1.0 + k * 2.0**-52 for k in range(9)]
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "key string, value double")
    want = {k: float((sorted(vs, key=lambda v: (v != v, v))[(len(vs) - 1) // 2] / 2 + sorted(vs, key=lambda v: (v != v, v))[len(vs) // 2] / 2)) for k, vs in sets.items()}
    one = {r["key"]: r["median"] for r in ranking.exact_median(df, ["key"], "value").collect()}
    two = {r["key"]: r["m"] for r in ranking.grouped_agg(df, ["key"], {}, {"m": "value"}).collect()}
    assert one == want and two == want


def test_null_groups_and_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id long, arm string")
    assert splits.kfold(df, "id", 2, 1, ["arm"]).count() == 4
    assert splits.holdout(df, "id", 0.5, 1, ["arm"]).count() == 4
    keys = spark.createDataFrame([(None,), (5,), (3,), (3,)], "k long")
    assert sorted(r.p for r in ranking.row_positions(keys, "k", out="p").collect()) == [0, 1, 2, 3]


def test_positions_of_close_and_equal_keys_are_dealt_out(spark):
    times = spark.range(20000).select((F.col("id") + 1_700_000_000).alias("t"))
    got = ranking.row_positions(times, "t", out="p").where(F.col("t") - 1_700_000_000 != F.col("p"))
    assert got.count() == 0
    same = spark.range(3000).select(F.lit("x").alias("t"), "id")
    assert ranking.row_positions(same, "t", out="p").agg(F.countDistinct("p")).first()[0] == 3000


def test_attach_features_refuses_missing_and_repeated_keys(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    good = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id long, x double")
    assert joins.attach_features(df, good, on="id").count() == 2
    for bad in ([(1, 0.5)], [(1, 0.5), (1, 0.7), (2, 1.0)]):
        with pytest.raises(PySparkException):
            joins.attach_features(df, spark.createDataFrame(bad, "id long, x double"), on="id").collect()
    with pytest.raises(ValueError):
        splits.group_fold_table(df.withColumnRenamed("id", "g"), "g", 5)


def test_linear_fit_of_many_columns_with_offset(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 60)) + 1e6
    y = x @ rng.normal(size=60) + 3.0
    names = [f"f{i}" for i in range(60)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y, id=range(400)))
    scored = learners.predict_linear(df, learners.fit_linear(df, [], names, "y"), [], names)
    assert scored.agg(F.max(F.abs(F.col("pred") - F.col("y")))).first()[0] < 1e-3


def test_average_rank_matches_pandas(spark):
    pdf = skewed()
    want = pdf.assign(r=pdf.groupby("key")["value"].rank()).set_index("id")["r"].sort_index()
    got = ranking.rows_with_average_rank(spark.createDataFrame(pdf), ["key"], "value").toPandas()
    np.testing.assert_allclose(got.set_index("id")["avg_rank"].sort_index(), want)


def test_row_positions_numbers_and_text(spark):
    pdf = skewed(600)
    df = spark.createDataFrame(pdf).repartition(7)
    got = ranking.row_positions(df, "id", out="pos").toPandas()
    assert (got["pos"] == got["id"]).all()
    names = df.select(F.concat(F.lit("n"), "id").alias("name"), "key")
    got = ranking.row_positions(names, "name", ["key"], "pos").toPandas().sort_values(["key", "name"])
    assert (got.groupby("key").cumcount() == got["pos"]).all()


def test_cascade_first_reason_and_bounds(spark):
    rows = [(1, ">5000"), (2, "abc"), (3, "-1"), (4, "0.4"), (5, "0.5"), (6, "300"), (7, "301")]
    df = spark.createDataFrame(rows, "i int, raw string")
    tagged = streaming.tag_measurements(df, "raw", 0.5, 300.0)
    got = {r.i: r.remove_reason for r in tagged.collect()}
    assert got == {
        1: "limit_value", 2: "numeric_parse_failed", 3: "non_positive", 4: "value_below_0.5",
        5: None, 6: None, 7: "value_above_300",
    }


def test_conflict_is_strict_and_ignores_removed_rows(spark):
    rows = [("a", 1.0, None), ("a", 5.0, None), ("b", 1.0, None), ("b", 5.1, None), ("c", 1.0, None), ("c", 99.0, "x")]
    df = spark.createDataFrame(rows, "k string, v double, remove_reason string")
    got = curate.tag_conflicts(df, "k", "v", 5.0).where("remove_reason like 'duplicate%'").select("k").distinct()
    assert [r.k for r in got.collect()] == ["b"]


def test_row_links_and_entities(spark):
    rows = [(1, "e", 1.0, 2, "A"), (2, "e", 3.0, 2, "B"), (3, "e", 2.0, 2, "Unknown"), (4, "f", 7.0, 2, "Unknown")]
    df = spark.createDataFrame(rows, "row_id int, entity string, value double, weight int, source string")
    got = {r.entity: r for r in curate.aggregate_entities(df).collect()}
    assert got["e"].value == 2.0 and got["e"].source_type == "mixed" and got["e"].source_set == "A;B;Unknown"
    assert got["f"].source_type == "Unknown" and got["f"].has_a is False
    assert curate.entity_row_links(df).count() == 4


def greedy(sizes, k):
    totals, out = [0] * k, {}
    for key, size in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
        fold = min(range(k), key=lambda f: (totals[f], f))
        out[key] = fold + 1
        totals[fold] += size
    return out


@pytest.mark.parametrize("seed", range(4))
def test_group_folds_equal_plain_greedy(spark, seed):
    rng = random.Random(seed)
    sizes = {f"g{i:03d}": rng.choice([1, 1, 1, 1, 2, 3, 7, rng.randrange(1, 60)]) for i in range(150)}
    sizes["huge"] = sum(sizes.values()) // 2
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    for k in (2, 3, 5):
        got = {r.g: r.fold for r in splits.group_fold_table(df, "g", k).collect()}
        assert got == greedy(sizes, k)


def test_group_folds_seeded_isolate_groups(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 37)
    out = splits.group_folds_seeded(df, "g", 4, 11)
    assert out.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 14


def test_kfold_sizes_and_holdout(spark):
    df = spark.range(103)
    sizes = sorted(r["count"] for r in splits.kfold(df, "id", 5, 42).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    assert splits.kfold(spark.range(3), "id", 5, 1).select("fold").distinct().count() == 3
    assert splits.holdout(df, "id", 0.1, 42).where("part = 'valid'").count() == 11


def test_leakage_report_finds_planted_leak(spark):
    ledger = materialize(splits.nested_ledger(spark.range(60), "id", 3, 3, 0.2, 1), "ledger")
    clean = splits.leakage_report(ledger, "id")
    assert {r.status for r in clean.collect()} == {"pass"}
    row = ledger.where("role = 'test'").limit(1).withColumn("role", F.lit("pilot_train"))
    broken = {r["check"]: r.n_bad for r in splits.leakage_report(ledger.unionByName(row), "id").collect()}
    assert broken["outer_test_untouched"] == 1


def test_metrics_reject_bad_input_and_handle_degenerate(spark):
    one = spark.createDataFrame([("a", 1.0, 1.5), ("b", 2.0, 2.0), ("b", 2.0, 3.0)], "g string, y double, pred double")
    rows = {r.g: r for r in metrics.regression_metrics(one, ["g"]).collect()}
    assert rows["a"].r2 is None and rows["b"].r2 is None and rows["b"].mae == 0.5
    for bad in (float("nan"), float("inf"), 1e6, None):
        with pytest.raises(PySparkException):
            df = spark.createDataFrame([(1.0, bad), (2.0, 2.0)], "y double, pred double")
            metrics.regression_metrics(df).collect()


def test_metrics_arithmetic_of_published_summary(spark):
    """Published fold rows: R2 0.744008 from SSE 236.181824 with SD 0.929447 on n = 1068."""
    folds = spark.createDataFrame([("all", 1068, 236.181824, 0.24454, 78.183521)], "arm string, n long, sse double, mae double, within_2_fold_percent double")
    sd = 0.929447
    y = [("all", sd if i % 2 else -sd) for i in range(1068)]
    cohort = spark.createDataFrame(y, "arm string, y double")
    row = metrics.pool_from_fold_summaries(folds, cohort, ["arm"]).first()
    assert row.r2 == pytest.approx(0.744008, abs=2e-6) and row.rmse == pytest.approx(0.470260, abs=2e-6)


def test_one_to_one_and_lookup_fail_loudly(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    with pytest.raises(PySparkException, match="not unique"):
        joins.one_to_one_join(a, b, ["k"]).collect()
    missing = spark.createDataFrame([(2, 0)], "k int, pos int")
    with pytest.raises(PySparkException, match="no row for key"):
        joins.lookup_in_order(missing, b, ["k"], "b").collect()


def fingerprints(spark, seed, n, width=64):
    rng = random.Random(seed)
    shared = random.Random(0)
    base = [sorted(shared.sample(range(width), shared.randrange(3, 20))) for _ in range(6)]
    rows = []
    for i in range(n):
        if i % 3 == 0:
            bits = base[0]
        elif i % 3 == 1:
            bits = sorted(set(rng.choice(base)) ^ set(rng.sample(range(width), 2)))
        else:
            bits = sorted(rng.sample(range(width), rng.randrange(0, 30)))
        rows.append((i, bits))
    return rows, spark.createDataFrame(rows, "id int, bits array<int>")


def jaccard(a, b):
    union = len(set(a) | set(b))
    return len(set(a) & set(b)) / union if union else 0.0


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_similarity_against_brute_force(spark, block_rows):
    q_rows, q = fingerprints(spark, 1, 60)
    r_rows, r = fingerprints(spark, 2, 90)
    got = similarity.ad_profile(q, r, "id", width=64, block_rows=block_rows).toPandas().set_index("id")
    for i, bits in q_rows:
        sims = sorted((jaccard(bits, other) for _, other in r_rows), reverse=True)
        assert got.loc[i, "max_similarity"] == pytest.approx(sims[0])
        assert got.loc[i, "mean_top5_similarity"] == pytest.approx(sum(sims[:5]) / 5)
        for t in similarity.THRESHOLDS:
            assert got.loc[i, similarity.count_name(t)] == sum(s >= t for s in sims)
    pairs = similarity.tanimoto_pairs(q, r, 0.6, 64, block_rows)
    total = pairs.agg(F.sum(F.col("q_copies") * F.col("r_copies"))).first()[0]
    assert total == sum(jaccard(a, b) >= 0.6 for _, a in q_rows for _, b in r_rows)


def test_fewer_references_than_k(spark):
    q = spark.createDataFrame([(1, [1, 2]), (2, [9])], "id int, bits array<int>")
    r = spark.createDataFrame([(1, [1, 2]), (2, [1, 3])], "id int, bits array<int>")
    got = {x.id: x for x in similarity.ad_profile(q, r, "id", width=16).collect()}
    assert got[1].mean_top5_similarity == pytest.approx((1 + 1 / 3) / 2) and got[2].max_similarity == 0.0


def test_oof_equals_refitting(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(120), "fold": [i % 4 + 1 for i in range(120)], "a": rng.normal(size=120), "b": rng.normal(size=120)})
    pdf["y"] = 1 + 2 * pdf.a - pdf.b + rng.normal(size=120)
    got = learners.oof_predict(spark.createDataFrame(pdf), "fold", ["a", "b"], "y").toPandas().set_index("id")["pred"]
    for f in range(1, 5):
        tr, te = pdf[pdf.fold != f], pdf[pdf.fold == f]
        beta = np.linalg.lstsq(np.c_[np.ones(len(tr)), tr[["a", "b"]]], tr.y, rcond=None)[0]
        np.testing.assert_allclose(got.loc[te.id], np.c_[np.ones(len(te)), te[["a", "b"]]] @ beta)


def test_patience_stop():
    def kept(curve, patience):
        stall = boosting.Stall(patience)
        seen = next((i for i, e in enumerate(curve, 1) if stall.add(e)), len(curve))
        return stall.best, seen

    assert kept([5, 4, 3, 3.5, 3.4, 1], 2) == (3, 5)
    assert kept([5, 4, 3, 3.5, 1, 2], 3) == (5, 6)


def test_preprocess_uses_training_rows_only(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None), ("c", 2.0), ("c", 2.0)], "feature string, value double")
    params = {r.feature: r for r in features.fit_preprocess(train).collect()}
    assert params["a"].median == 2.0 and params["a"].kept
    assert not params["b"].kept and not params["c"].kept
    other = spark.createDataFrame([("a", None), ("b", 5.0)], "feature string, value double")
    out = features.transform_preprocess(other, features.fit_preprocess(train)).collect()
    assert [(r.feature, r.value) for r in out] == [("a", 2.0)]


def test_spearman_null_when_constant(spark):
    rows = [("up", float(i), 2.0 * i) for i in range(5)] + [("flat", float(i), 1.0) for i in range(5)] + [("down", float(i), -1.0 * i) for i in range(5)]
    long = spark.createDataFrame(rows, "feature string, value double, contribution double")
    got = {r.feature: r.spearman for r in explain.feature_spearman(long).collect()}
    assert got["flat"] is None and got["up"] == pytest.approx(1) and got["down"] == pytest.approx(-1)


def test_resume_ledger(spark):
    plan = spark.createDataFrame([("a", 1, "s1"), ("a", 2, "s1"), ("a", 3, "s1")], "arm string, fold int, signature string")
    done = plan.where("fold = 1")
    ledger = runner.resume_ledger(plan, done, ["arm", "fold"])
    assert sorted(r.fold for r in runner.pending_tasks(ledger).collect()) == [2, 3]
    changed = done.withColumn("signature", F.lit("s0"))
    with pytest.raises(PySparkException, match="different signature"):
        runner.pending_tasks(runner.resume_ledger(plan, changed, ["arm", "fold"])).collect()


def test_set_checks(spark):
    a, b = spark.range(5), spark.range(3, 8)
    assert setops.set_equal(a, b, ["id"]).first().n_bad == 6
    assert setops.disjoint(a, b, ["id"]).first().n_bad == 2
    twice = a.unionByName(spark.range(1))
    assert setops.covers_exactly_once(twice, a, ["id"]).first().n_bad == 1
    assert contracts.min_rows(a, 9).first().n_bad == 4
    with pytest.raises(PySparkException, match="fewer than"):
        contracts.require_min_rows(a, 9).collect()


def test_read_records_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿b , a\n1.5,x\n", encoding="utf-8")
    df = tables.read_records(spark, str(tmp_path / "t.csv"), "a string, b double")
    assert [tuple(r) for r in df.collect()] == [("x", 1.5)]
    (tmp_path / "d.csv").write_text("a,a \n1,2\n")
    with pytest.raises(ValueError):
        tables.read_records(spark, str(tmp_path / "d.csv"), "a string")


def test_integrity(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for name in ("a.txt", "b.txt", "c.txt"):
        (folder / name).write_text(name)
    integrity.write_manifest(integrity.hash_files(spark, str(folder)), str(tmp_path / "m"))
    manifest = integrity.read_manifest(spark, str(tmp_path / "m"), one_document=False)
    (folder / "b.txt").write_text("other")
    (folder / "c.txt").unlink()
    document = {"files": [r.asDict() for r in manifest.collect()]}
    (tmp_path / "doc.json").write_text(json.dumps(document, indent=2))
    assert integrity.read_manifest(spark, str(tmp_path / "doc.json")).count() == 3
    got = {r.path: r.status for r in integrity.verify_files(manifest, integrity.hash_files(spark, str(folder))).collect()}
    assert got == {"a.txt": "ok", "b.txt": "changed", "c.txt": "missing"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["5", ">3", "x", "-2", "400"])]
    spark.createDataFrame(rows, "i int, raw string").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    tagged = streaming.tag_measurements(stream, "raw", 0.5, 300.0)
    streaming.write_stream(tagged, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted(map(tuple, streaming.tag_measurements(batch, "raw", 0.5, 300.0).collect()), key=str)


def wide_sets(seed, n, width=16_384):
    """Sets of rare and frequent bits, near copies, exact copies, one bit that all share, and empty sets."""
    rng = random.Random(seed)
    sets = []
    for i in range(n):
        if sets and i % 4 == 0:
            base = list(rng.choice(sets))
            for _ in range(rng.randint(0, 5)):
                base[rng.randrange(len(base))] = rng.randrange(width) if base else 0
            sets.append(sorted(set(base)))
        else:
            sets.append(sorted({7, *(int(width * rng.random() ** 3) for _ in range(rng.randint(1, 60)))}))
    return sets


def test_rare_bits_find_all_pairs_and_verify_few(spark, monkeypatch):
    q, r = wide_sets(1, 300), wide_sets(1, 200) + wide_sets(2, 200) + [[], [3]]
    frames = [spark.createDataFrame(list(enumerate(x)), "id int, bits array<int>") for x in (q, r)]
    key = lambda bits: hashlib.md5(",".join(map(str, bits)).encode()).hexdigest()
    monkeypatch.setattr(similarity, "POSTINGS", 16)
    for t in (0.3, 0.6, 1.0):
        want = {}
        for a in q:
            for b in r:
                s = len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0
                if s >= t:
                    want[key(a), key(b)] = s
        got = {}
        for share in (2.0, 0.0):
            monkeypatch.setattr(similarity, "INDEX_SHARE", share)
            rows = similarity.tanimoto_pairs(*frames, t, 16_384).collect()
            got[share] = {(x.q_set, x.r_set): (x.similarity, x.q_copies, x.r_copies) for x in rows}
            assert len(rows) == len(got[share])
        assert got[2.0] == got[0.0] and {k: v[0] for k, v in got[2.0].items()} == pytest.approx(want)
    sets = [similarity.distinct_sets(f) for f in frames]
    candidates = similarity.RareBits(*sets, 0.6, 16_384).candidates()
    assert candidates.count() == candidates.distinct().count() < 0.1 * sets[0].count() * sets[1].count()


def test_tables_of_a_run_go_with_it(spark):
    rows = spark.range(5)
    with session.scratch_run(spark) as outer:
        table = materialize(rows, "a")
        with session.scratch_run(spark) as inner:
            assert inner.startswith(outer) and materialize(rows, "b").inputFiles()[0].removeprefix("file:").lstrip("/").startswith(inner.removeprefix("file:").lstrip("/"))
        assert not os.path.exists(inner) and os.path.exists(outer) and table.count() == 5
    assert not os.path.exists(outer) and materialize(rows, "c").count() == 5
    with pytest.raises(ValueError), session.scratch_run(spark) as failed:
        materialize(rows, "d")
        raise ValueError
    assert not os.path.exists(failed)


def test_a_column_with_too_many_categories_fails(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "c string")
    assert summary.category_counts(df, "c", "m").first().m == {"a": 2, "b": 1, "NULL": 1}
    assert summary.category_counts(df, "c", "m", most=3).first().m == {"a": 2, "b": 1, "NULL": 1}
    with pytest.raises(PySparkException, match="more than 2 categories"):
        summary.category_counts(df, "c", "m", most=2).collect()


def test_references_that_share_nothing_count_in_the_mean(spark):
    q = spark.createDataFrame([(1, [1, 2]), (2, [40]), (3, [])], "id int, bits array<int>")
    r = spark.createDataFrame([(1, [1, 2]), *[(i, [10 + i]) for i in range(2, 9)]], "id int, bits array<int>")
    got = {x.id: x for x in similarity.ad_profile(q, r, "id", width=64, block_rows=1).collect()}
    assert [got[i].mean_top5_similarity for i in (1, 2, 3)] == pytest.approx([1 / 5, 0, 0])


def test_blocks_that_meet_are_not_shuffled_for_each_pair(spark):
    rows = [(i, sorted({i % 61, *(int(x) for x in np.random.default_rng(i).integers(0, 512, 40))})) for i in range(1200)]
    frame = spark.createDataFrame(rows, "id int, bits array<int>")
    plan = similarity._block_pairs_above(*[similarity.distinct_sets(frame)] * 2, 0.6, 512, 16)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroupsInPandas" not in plan
    wide = similarity.threshold_neighbors(frame, frame, "id", 0.6, 512, 16)
    profile = similarity.ad_profile(frame, frame, "id", width=512, block_rows=16)
    sets = {i: set(b) for i, b in rows}
    want = {i: sum(len(a & b) >= 0.6 * len(a | b) for b in sets.values()) for i, a in sets.items() if i < 40}
    assert {x.id: x.n_neighbors for x in wide.where("id < 40").collect()} == want
    assert {x.id: x.n_sim_ge_060 for x in profile.where("id < 40").collect()} == want


def test_rank_correlation_of_contributions_that_differ_when_worked_out_again(spark):
    jitter = F.udf(lambda x: x + random.SystemRandom().random() * 1e-9, "double").asNondeterministic()
    rows = spark.range(300).select(F.lit("f").alias("feature"), F.col("id").cast("double").alias("value"))
    long = rows.withColumn("contribution", jitter("value"))
    assert explain.feature_spearman(long).first().spearman == pytest.approx(1.0)


def test_a_folder_of_part_files_is_one_table_of_a_manifest(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "t.parquet").mkdir(parents=True)
    for name, text in (("one.parquet", "x"), ("t.parquet/a.parquet", "yy"), ("t.parquet/b.parquet", "z")):
        (folder / name).write_text(text)

    def entries():
        return {r.path: r for r in integrity.whole_tables(integrity.hash_files(spark, str(folder))).collect()}

    got = entries()
    assert {k: v.bytes for k, v in got.items()} == {"one.parquet": 1, "t.parquet": 3}
    assert got["one.parquet"].sha256 == hashlib.sha256(b"x").hexdigest()
    (folder / "t.parquet/b.parquet").write_text("w")
    assert entries()["t.parquet"].sha256 != got["t.parquet"].sha256


def test_raw_rows_are_parsed_once_for_a_selection(spark, monkeypatch):
    """Conflicts, aggregates, medians, roles and the selection read written rows, none of them the raw text again."""
    from curafold.catalog import QUERIES, base

    parsed, real = spark.sparkContext.accumulator(0), base.events

    def counted(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(base, "events", lambda s, d: (df := real(s, d)).mapInArrow(counted, df.schema))
    assert QUERIES["f10_select_by_role"](spark, "/root/testdata/sf0.001").count() > 0
    assert parsed.value == real(spark, "/root/testdata/sf0.001").count()


def test_tokens_are_counted_where_a_row_is_read(spark, monkeypatch):
    monkeypatch.setattr(features, "COUNTED_TOKENS", 3)
    texts = [(1, "a b  a\tc"), (2, None), (3, ""), (4, "\n x x"), (5, "é ü é"), (6, "w"), (7, "w w w w w"), (8, "a")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    tokens = F.when(F.col("doc_id") == 6, F.array(F.lit(None).cast("string"))).otherwise(features.words(F.col("text")))

    def wanted(rows):
        spread = rows.select("doc_id", F.explode(tokens).alias("t")).select("doc_id", features.token_bit(F.col("t")).alias("bit"))
        return sorted(map(str, spread.groupBy("doc_id", "bit").agg(F.count("*").alias("cnt")).collect()))

    once = features.count_fingerprint(df, "doc_id", tokens)
    assert sorted(map(str, once.select("doc_id", "bit", "cnt").collect())) == wanted(df)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    # Rows that share an id, or have none, are added up.
    twice = df.unionAll(df.where("doc_id < 5")).unionAll(df.where("doc_id in (1, 7)").withColumn("doc_id", F.lit(None).cast("bigint")))
    got = features.count_fingerprint(twice, "doc_id", tokens).select("doc_id", "bit", "cnt").collect()
    assert sorted(map(str, got)) == wanted(twice)


def related_sets(width, n, size, seed):
    """Unrelated sets, and after each a near copy of it."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = rng.choice(width, int(rng.integers(1, size)), replace=False)
        drop = rng.random(len(base)) < rng.choice([0.02, 0.1, 0.2])
        out += [sorted(base.tolist()), sorted({*base[~drop].tolist(), *rng.choice(width, int(drop.sum())).tolist()})]
    return out


def as_sets(tools, sets):
    return tools.Sets(np.array([len(x) for x in sets]), np.array([b for x in sets for b in x], dtype=np.int32))


def test_sketches_rule_out_unrelated_sets_and_no_similar_ones():
    width, t = 16_384, 0.7
    tools = similarity._sketch_tools(width, t)
    sets = [x for x in related_sets(width, 400, 300, 5) if len(x) > 100]
    block = as_sets(tools, sets)
    words = tools.words_for(int(block.sizes.mean()))
    sketch = block.sketch(words)
    i, j, apart = tools.near(block, block, words, 0, len(sets), sketch, np.ascontiguousarray(sketch.T), len(sets) ** 2)
    left = {(a, b): d for a, b, d in zip(i.tolist(), j.tolist(), apart.tolist())}
    similar = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if jaccard(x, y) >= t}
    assert similar <= set(left) and len(left) < len(similar) + 0.01 * len(sets) ** 2
    assert all(d <= len(set(sets[a]) ^ set(sets[b])) for (a, b), d in left.items())
    assert 0 < words <= 8 and tools.near(block, block, words, 0, len(sets), sketch, np.ascontiguousarray(sketch.T), 5) is None


@pytest.mark.parametrize(("width", "size", "t", "left_share"), [(16_384, 300, 0.7, 64), (16_384, 300, 0.7, 1 << 40), (2048, 1900, 0.6, 64), (100, 90, 0.6, 1), (70_000, 200, 0.3, 1), (5000, 900, 0.05, 64)])
def test_matches_of_blocks_against_brute_force(monkeypatch, width, size, t, left_share):
    monkeypatch.setattr(similarity, "LEFT_SHARE", left_share)
    tools = similarity._sketch_tools(width, t)
    sets = [x for x in related_sets(width, 60, size, width) if x]
    q, r = as_sets(tools, sets[::2]), as_sets(tools, sets[1::2] + sets[:20])
    q.kept_sketch = q.sketch
    got = {(a, b): s for i, j, values in tools.matches(q, r) for a, b, s in zip(i.tolist(), j.tolist(), values.tolist())}
    both = {(a, b): jaccard(x, y) for a, x in enumerate(sets[::2]) for b, y in enumerate(sets[1::2] + sets[:20])}
    assert got == {k: s for k, s in both.items() if s >= t}


def test_neighbors_of_packed_blocks_against_brute_force(spark):
    sets = related_sets(2048, 150, 500, 3) + [[], [7]]
    q, r = list(enumerate(sets)), list(enumerate(sets[1::2] + sets[1:60:2] + [[], [7], [7]]))
    frames = [spark.createDataFrame(x, "id int, bits array<int>") for x in (q, r)]
    got = {x.id: (x.n_neighbors, x.best_similarity) for x in similarity.threshold_neighbors(*frames, "id", 0.6, block_rows=50).collect()}
    for a, x in q:
        s = [v for v in (jaccard(x, y) for _, y in r) if v >= 0.6]
        assert got[a] == (len(s), max(s, default=None))
    pairs = similarity.tanimoto_pairs(*frames, 0.6, block_rows=50).collect()
    assert sum(x.q_copies * x.r_copies for x in pairs) == sum(jaccard(x, y) >= 0.6 for _, x in q for _, y in r)
    plan = similarity.threshold_neighbors(*frames, "id", 0.6)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_bit_sets_of_odd_texts(spark, monkeypatch):
    texts = ["a b a", "", " ", "\n", None, "\ta  b\n", "a b c　", " \n x", "x \x0b\x0c\r y ", "ä ö", "\x85 a\x1cb", "a" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(1)
    want = {x.id: x.bits for x in df.select("id", features.bit_set(features.words(F.col("text")), 512).alias("bits")).collect()}
    assert {x.id: x.bits for x in features.bit_sets(df, "id", "text", 512).collect()} == want
    monkeypatch.setattr(features, "KNOWN_TOKENS", 2)
    assert {x.id: x.bits for x in features.bit_sets(df, "id", "text", 512).collect()} == want


def test_documents_are_read_once_for_queries_and_references(spark):
    for side in base.query_and_reference(spark, "/root/testdata/sf0.001"):
        assert not any("documents" in f for f in side.inputFiles())


@pytest.mark.parametrize(("width", "size"), [(2048, 500), (5000, 300)])
def test_best_values_and_counts_alone_equal_the_profile(spark, width, size):
    sets = related_sets(width, 120, size, 4) + [[], [7]]
    q, r = list(enumerate(sets)), list(enumerate(sets[1::2] + sets[1:60:2] + [[], [7], [7]]))
    frames = [spark.createDataFrame(x, "id int, bits array<int>") for x in (q, r)]
    best = {x.id: x.max_similarity for x in similarity.best_similarity(*frames, "id", width, 50).collect()}
    counts = {x.id: x for x in similarity.neighbor_counts(*frames, "id", width=width, block_rows=50).collect()}
    profile = {x.id: x for x in similarity.ad_profile(*frames, "id", width=width, block_rows=50).collect()}
    for a, x in q:
        s = sorted((jaccard(x, y) for _, y in r), reverse=True)
        assert best[a] == profile[a].max_similarity == s[0] and profile[a].mean_top5_similarity == pytest.approx(sum(s[:5]) / 5)
        for t in similarity.THRESHOLDS:
            assert counts[a][similarity.count_name(t)] == profile[a][similarity.count_name(t)] == sum(v >= t for v in s)


def test_pairs_that_are_given_up_cannot_reach_what_is_needed():
    tools = similarity._sketch_tools(2048, 0.5)
    sets = [x for x in related_sets(2048, 200, 400, 9) if x]
    q, r = as_sets(tools, sets), as_sets(tools, sets[::2])
    q.kept_sketch = q.sketch
    need = np.array([max(1, len(x) // 3) for x in sets])
    got = {(a, b): c for i, j, common in tools.reaching(q, r, np.arange(len(sets)), need) for a, b, c in zip(i.tolist(), j.tolist(), common.tolist())}
    shared = {(a, b): len(set(x) & set(y)) for a, x in enumerate(sets) for b, y in enumerate(sets[::2])}
    assert got == {k: c for k, c in shared.items() if c >= need[k[0]]}


def test_files_are_hashed_in_pieces(spark, tmp_path):
    rng = random.Random(1)
    files = {
        "a.bin": rng.randbytes(3_000_000), "sub dir/ä %.bin": b"\xef\xbb\xbfabc\n", "mark": b"\xef\xbb\xbf", "feeds": b"\n\n", "crlf": b"\r\nx\r",
        "text": b"abc", "zeros": bytes(100_000), "t.gz": gzip.compress(b"abc\n" * 9), "fake.gz": b"no gzip", "b.parquet": rng.randbytes(70_000) + b"\n",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = integrity.hash_files(spark, str(tmp_path))
    assert {r.path: (r.bytes, r.sha256) for r in found.collect()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    # No file is a row that a task holds as a whole.
    tables = integrity.hash_files(spark, str(tmp_path), "*.parquet")
    assert [r.path for r in tables.collect()] == ["b.parquet"] and "content" not in tables._jdf.queryExecution().toString()
