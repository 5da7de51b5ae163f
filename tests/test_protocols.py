"""Learners, resumable runs, group folds, medians and checksums on awkward rows, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from curafold import session
from curafold.operators import joins, ranking, splits
from curafold.plans import boosting, learners, runner, workflows
from curafold.session import scratch_path
from curafold.sources import integrity


# --- folds ---


def greedy(sizes, k, seed, names):
    """One group after the other; of the emptiest folds the one with the smallest draw."""
    totals, out = [0] * k, {}
    for name in names:
        level = min(totals)
        draws = splits._draws(np.int64(seed), np.array([sizes[name]]), np.array([level]), k)[0]
        fold = min((int(draws[f]), f) for f in range(k) if totals[f] == level)[1]
        out[name] = fold + 1
        totals[fold] += sizes[name]
    return out


@pytest.mark.parametrize("seed", [1, 7, 42])
def test_seeded_folds_equal_the_greedy_walk(spark, seed):
    rng = random.Random(seed)
    sizes = {f"g{i}": rng.choice([1, 1, 1, 2, 3, 5, 8, 30]) for i in range(120)} | {None: 25}
    rows = [(g,) for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "g string")
    out = splits.group_folds_seeded(df, "g", 4, seed)
    assert out.count() == len(rows)
    got = {r.g: r.fold for r in out.distinct().collect()}
    groups = df.groupBy("g").agg(F.count("*").alias("size"))
    order = [r.g for r in ranking.hash_rank(groups, "g", seed, ["size"], "r", "n").orderBy(F.desc("size"), "r").collect()]
    assert got == greedy(sizes, 4, seed, order)


def test_ties_are_drawn_anew():
    draws = [tuple(np.argsort(splits._draws(np.int64(5), np.array([1]), np.array([level]), 5)[0])) for level in range(40)]
    assert len(set(draws)) > 15


def test_rows_without_a_group_stay(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"g{i % 7}") for i in range(60)], "id int, g string")
    for out in (splits.group_folds(df, "g", 3), splits.group_folds_seeded(df, "g", 3, 1), splits.group_holdout(df, "g", 0.3, 1)):
        assert out.count() == 60
        assert out.where("g IS NULL").select(out.columns[-1]).distinct().count() == 1


# --- fits with NULL groups ---


def test_oof_prediction_loses_no_row(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        g = [None, "a", "b"][i % 3]
        x = None if g == "b" else float(rng.normal())
        rows.append((i, g, i // 3 % 4, x, 2.0 * x + 1 if x is not None else 5.0))
    df = spark.createDataFrame(rows, "id int, g string, fold int, x double, y double")
    got = {r.id: r for r in learners.oof_predict(df, "fold", ["x"], "y", by=["g"]).collect()}
    assert len(got) == 60
    for i, g, _, x, y in rows:
        assert got[i].pred is None if g == "b" else got[i].pred == pytest.approx(y)
    folds = df.withColumn("fold", F.when(F.col("fold") > 0, F.col("fold")))
    assert learners.oof_predict(folds, "fold", ["x"], "y").where("pred IS NOT NULL").count() == 40


def test_parameters_join_alike_on_both_sides_of_the_bound(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 4) for i in range(40)], "id int, k int")
    params = spark.createDataFrame([(None, "n"), (1, "x"), (2, "y")], "k int, p string")
    run = lambda how: sorted(map(repr, session.join_parameters(df, params, ["k"], "p", how).collect()))
    small = [run("inner"), run("left")]
    monkeypatch.setattr(session, "PARAMETER_BYTES", 0)
    assert [run("inner"), run("left")] == small and [len(x) for x in small] == [30, 40]


# --- medians ---

VALUES = [float("nan"), float("inf"), float("-inf"), 0.0, -1.5, 2.0, 1e308, -1e308, None]


def plain_median(values):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    a, b = v[(len(v) - 1) // 2], v[len(v) // 2]
    return a if a == b else a / 2 + b / 2


def median_rows():
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [(None, rng.choice(VALUES)) for _ in range(301)]
    for i in range(60):
        rows += [(f"g{i}", rng.choice([*VALUES, rng.random()])) for _ in range(rng.randint(1, 9))]
    return rows + [("none", None), ("both", float("inf")), ("both", float("-inf")), ("nans", float("nan")), ("nans", 1.0)]


def same(a, b):
    return a is b is None or (a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-15)))


@pytest.mark.parametrize("bound", [20_000, 4, 0])
def test_group_medians_across_the_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(ranking, "SMALL_GROUP", bound)
    rows = median_rows()
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in ranking.grouped_agg(df, ["g"], {"n": F.count("*")}, {"m": "v"}).collect()}
    assert len(got) == len({g for g, _ in rows})
    for g, r in got.items():
        values = [v for k, v in rows if k == g]
        assert r.n == len(values) and same(r.m, plain_median(values)), (g, r)


def test_medians_of_large_groups(spark):
    rng = random.Random(4)
    rows = median_rows() + [("ties", float(rng.randint(0, 3))) for _ in range(5000)] + [("big", rng.lognormvariate(0, 5)) for _ in range(40_001)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r.median for r in ranking.exact_median(df, ["g"], "v").collect()}
    want = {g: plain_median([v for k, v in rows if k == g]) for g in {g for g, _ in rows}}
    assert set(got) == {g for g, m in want.items() if m is not None}
    assert all(same(got[g], want[g]) for g in got)
    assert same(ranking.exact_median(df, [], "v").first()["median"], plain_median([v for _, v in rows]))


# --- boosting against a brute-force booster ---


def grow(x, y, depth, least):
    """A regression tree: the cut with the largest gain, at the middle between neighbours, first feature first."""
    if depth and len(y) >= 2 * least:
        best = (1e-12 * len(y), None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                side = x[:, f] <= cut
                if min(side.sum(), (~side).sum()) < least:
                    continue
                gain = ((y - y.mean()) ** 2).sum() - ((y[side] - y[side].mean()) ** 2).sum() - ((y[~side] - y[~side].mean()) ** 2).sum()
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, cut))
        if best[1]:
            f, cut = best[1]
            side = x[:, f] <= cut
            left, right = grow(x[side], y[side], depth - 1, least), grow(x[~side], y[~side], depth - 1, least)
            return lambda row: left(row) if row[f] <= cut else right(row)
    mean = y.mean()
    return lambda row: mean


def brute_boost(x, y, rounds, depth, step, least):
    trees, weights, left = [], [], y.copy()
    for m in range(rounds):
        trees.append(grow(x, left, depth, least))
        weights.append(1.0 if m == 0 else step)
        left = left - weights[-1] * np.array([trees[-1](r) for r in x])
    return lambda rows: np.array([sum(w * t(r) for w, t in zip(weights, trees)) for r in rows])


PARAMS = dict(maxDepth=2, stepSize=0.4, subsamplingRate=1.0, minInstancesPerNode=3)


def regression_rows(spark, seed, n=150):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 9, n), rng.integers(0, 2, n)]).astype(float)
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] * x[:, 2] + rng.normal(0, 0.2, n)
    df = spark.createDataFrame([(i, f"g{i % 11}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, g string, a double, b double, c double, y double")
    return df.withColumn("features", array_to_vector(F.array("a", "b", "c"))).repartition(3), x, y


def test_boosting_equals_brute_force(spark):
    df, x, y = regression_rows(spark, 1)
    model = learners.fit_fixed(df, "y", 5, 3, **PARAMS)
    got = np.array([r.pred for r in model.transform(df).orderBy("id").collect()])
    assert got == pytest.approx(brute_boost(x, y, 5, 2, 0.4, 3)(x), abs=1e-9)


def test_early_stop_trains_nothing_twice(spark, monkeypatch):
    from pyspark.ml.regression import DecisionTreeRegressor

    df, x, y = regression_rows(spark, 2)
    train, valid = df.where("id < 90"), df.where("id >= 90")
    fits, fit = [], DecisionTreeRegressor.fit
    monkeypatch.setattr(DecisionTreeRegressor, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    params = {**PARAMS, "stepSize": 1.0, "maxDepth": 3, "minInstancesPerNode": 1}
    model, best = learners.fit_early_stop(train, valid, "y", 30, 2, 3, **params)
    errors = [((brute_boost(x[:90], y[:90], m, 3, 1.0, 1)(x[90:]) - y[90:]) ** 2).mean() for m in range(1, len(fits) + 1)]
    stall = boosting.Stall(2)
    assert next(i for i, e in enumerate(errors, 1) if stall.add(e)) == len(fits) < 30
    assert best == stall.best == model.getNumTrees
    once = learners.fit_fixed(train, "y", best, 3, **params)
    both = [[r.pred for r in m.transform(valid).orderBy("id").collect()] for m in (model, once)]
    assert both[0] == pytest.approx(both[1], abs=1e-12)


def test_group_pilot_and_oof_trees(spark):
    df, x, y = regression_rows(spark, 5)
    n = learners.select_rounds(df, "id", "y", 0.3, 6, 2, 1, group="g", **PARAMS)
    assert 1 <= n <= 6
    folded = df.withColumn("fold", F.col("id") % 3 + 1)
    got = {r.id: r.pred for r in learners.oof_predict_trees(folded, "fold", 3, "y", 3, 1, **PARAMS).collect()}
    for f in range(3):
        rest = np.arange(150) % 3 != f
        want = brute_boost(x[rest], y[rest], 3, 2, 0.4, 3)(x[~rest])
        assert [got[i] for i in np.flatnonzero(~rest)] == pytest.approx(want, abs=1e-9)


# --- resumable runs ---


def test_a_stopped_run_goes_on(spark):
    folder = scratch_path(spark, "run-test")
    tasks = [{"arm": a, "fold": f} for a in ("x", None) for f in (1, 2, 3)]
    worked = []

    def work(task, stop=None):
        if len(worked) == stop:
            raise RuntimeError("stopped")
        worked.append((task["arm"], task["fold"]))
        return spark.range(task["fold"]).select(F.lit(task["arm"]).cast("string").alias("arm"), F.lit(task["fold"]).alias("fold"), "id")

    types = {"arm": "string", "fold": "int"}
    with pytest.raises(RuntimeError):
        runner.run_tasks(spark, folder, tasks, types, "s", lambda t: work(t, 4), at_once=1)
    first = list(worked)
    worked.clear()
    rows = runner.run_tasks(spark, folder, tasks, types, "s", work)
    assert sorted(map(repr, first + worked)) == sorted(repr((t["arm"], t["fold"])) for t in tasks) and len(worked) == 2
    assert Counter((r.arm, r.fold) for r in rows.collect()) == {(a, f): f for a in ("x", None) for f in (1, 2, 3)}
    worked.clear()
    assert runner.run_tasks(spark, folder, tasks, types, "s", work).count() == 12 and not worked
    with pytest.raises(PySparkException, match="different signature"):
        runner.run_tasks(spark, folder, tasks, types, "t", work)


def test_nested_trees_resume_with_groups(spark, monkeypatch):
    df, _, _ = regression_rows(spark, 6)
    folder = scratch_path(spark, "nested-test")
    run = lambda: workflows.nested_cv_trees(df, "id", "y", [None, 3.0], 2, 2, 1, 3, 1, [1], group="g", folder=folder, **PARAMS)
    fits, fit = [], workflows.fit_fixed

    def counted(*a, **k):
        fits.append(1)
        if len(fits) == 6:
            raise RuntimeError("stopped")
        return fit(*a, **k)

    monkeypatch.setattr(workflows, "fit_fixed", counted)
    monkeypatch.setattr(runner, "AT_ONCE", 1)
    with pytest.raises(RuntimeError):
        run()
    assert len(fits) >= 6
    before = len(fits)
    out = run()
    got = out["predictions"].collect()
    assert len(got) == 300 and len(fits) - before <= 4
    test_groups = out["outer"].groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count()
    assert test_groups == 0


# --- checksums and unique keys ---


def test_checksums_tell_rows_apart(spark):
    sums = [
        integrity.table_checksum(spark.createDataFrame(rows, "a string, b string")).first()["checksum"]
        for rows in ([("a|b", "c")], [("a", "b|c")], [("a", None)], [("a", "\\N")], [("a", "")], [("aN:", "")], [(None, "a")], [("1:a", "")])
    ]
    assert len(set(sums)) == len(sums)
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    assert integrity.table_checksum(rows).first() == integrity.table_checksum(rows.repartition(5)).first()


def test_one_changed_row_reads_one_bucket(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("t"), (F.col("id") % 3).cast("string").alias("p"))
    old, new = (scratch_path(spark, x) for x in ("old", "new"))
    integrity.write_snapshot(rows, ["id"], old, "p", 32)
    integrity.write_snapshot(rows.withColumn("t", F.when(F.col("id") == 77, "x").otherwise(F.col("t"))), ["id"], new, "p", 32)
    trees = [spark.read.parquet(f"{x}/tree") for x in (old, new)]
    assert integrity.changed_buckets(*trees).count() == 1
    out = integrity.compare_stored(spark, old, new, ["id"])
    assert [tuple(r) for r in out.collect()] == [(77, "changed")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and plan.count("bucket") and "2000" not in plan
    assert integrity.compare_stored(spark, old, old, ["id"]).count() == 0


def test_unique_keys_move_no_payload(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    out = joins.one_to_one_join(a, a.withColumnRenamed("v", "w"), ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, "x", "x"), (2, "y", "y")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "first(" not in plan and "min(struct" not in plan
    for bad in ([(1, "x"), (1, "x")], [(None, "x"), (None, "y")]):
        with pytest.raises(PySparkException, match="key is not unique"):
            joins.one_to_one_join(a, spark.createDataFrame(bad, "k int, w string"), ["k"]).collect()


# --- preprocessing as a stored model ---


def test_stored_preprocessing_of_many_features(spark):
    from curafold.plans.preprocess import Preprocess, PreprocessModel

    rng = np.random.default_rng(9)
    width, rows = 2000, []
    for i in range(25):
        values = [None if rng.random() < 0.3 or k % 50 == 0 else 1.0 if k % 50 == 1 else float(rng.normal()) for k in range(width)]
        rows.append((i, values))
    df = spark.createDataFrame(rows, "id int, values array<double>")
    model = Preprocess().fit(df)
    medians = [plain_median([v[k] for _, v in rows]) for k in range(width)]
    kept = [k for k in range(width) if len({v[k] for _, v in rows} - {None}) > 1]
    assert model.getOrDefault("kept") == kept
    out = {r.id: r.filled for r in model.transform(df).collect()}
    assert all(out[i] == pytest.approx([medians[k] if v[k] is None else v[k] for k in kept]) for i, v in rows)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    again = PreprocessModel.load(path).transform(df)
    assert {r.id: r.filled for r in again.collect()} == out
    plan = again._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("coalesce") == 1
    short = spark.createDataFrame([(1, None), (2, [0.5])], "id int, values array<double>")
    assert model.transform(short).select(F.size("filled")).collect() == [(len(kept),)] * 2


def test_documents_are_tokenised_once_for_nested_trees(spark, monkeypatch):
    """Group sizes, ranks and folds read written rows, none of them the text again."""
    from curafold.catalog import QUERIES, base

    read, real = spark.sparkContext.accumulator(0), base.documents

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(base, "documents", lambda s, d: (df := real(s, d)).mapInArrow(counted, df.schema))
    assert QUERIES["m9_nested_trees_groups"](spark, "/root/testdata/sf0.001").count() > 0
    assert read.value == real(spark, "/root/testdata/sf0.001").count()
