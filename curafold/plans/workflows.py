"""Screening, post-selection and nested cross-validation, final fits and resumption.

The three protocols differ in what a reported error may have seen:

``oof_screen``      screens the whole pool; its errors describe the screening only.
``threshold_cv``    re-validates each *retained* cohort; arms are scored on different rows.
``nested_cv``       screens inside each outer training part; every arm is scored on the
                    same untouched outer test rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curafold.functions.target import arm_label, back_transform_columns, residual_columns
from curafold.operators.curate import residual_rules
from curafold.operators.joins import arm_grid
from curafold.operators.metrics import cohort_design, common_rounds, ensemble_mean, regression_metrics
from curafold.operators.splits import OUTER_SEED_STEP, PILOT_SEED_STEP, group_folds_seeded, inner_folds, kfold
from curafold.session import materialize, scratch_path
from curafold.plans.preprocess import Preprocess, as_values
from curafold.plans.runner import run_tasks, signature_of
from curafold.plans.learners import fit_fixed, fit_linear, oof_predict, predict_linear, select_rounds


def with_residuals(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.withColumns(residual_columns(F.col(y), F.col(pred)))


def oof_screen(
    df: DataFrame, id_col: str, features: Sequence[str], label: str, k: int, seed: int, threshold: float
) -> DataFrame:
    """Out-of-fold report: fold, prediction, errors and the removal flag of every row."""
    folded = materialize(kfold(df, id_col, k, seed), "folds")
    scored = with_residuals(oof_predict(folded, "fold", features, label), label)
    return scored.withColumn("remove_flag", residual_rules(threshold))


def screen_summary(report: DataFrame, label: str = "y") -> DataFrame:
    """Metrics of the whole pool and of the kept rows, with the removed count."""
    both = F.when(F.col("remove_flag"), F.array(F.lit("before"))).otherwise(
        F.array(F.lit("before"), F.lit("after"))
    )
    return regression_metrics(
        report.select(label, "pred", F.explode(both).alias("stage")), ["stage"], label, "pred"
    )


def threshold_cv(
    scored: DataFrame,
    id_col: str,
    features: Sequence[str],
    label: str,
    thresholds: Sequence[float | None],
    k: int,
    seed: int,
) -> DataFrame:
    """Cross-validate each arm's retained cohort; all arms in one pass.

    ``scored`` carries the screening ``fold_error``. Returns ``(arm, fold, id, y, pred)``.
    """
    arms = arm_grid(scored.select(id_col, label, "fold_error", *features), thresholds)
    folded = materialize(kfold(arms, id_col, k, seed, by=["arm"]), "arm-folds")
    return oof_predict(folded, "fold", features, label, by=["arm"]).select(
        "arm", "fold", id_col, F.col(label).alias("y"), "pred"
    )


def nested_screening(
    assigned: DataFrame,
    id_col: str,
    features: Sequence[str],
    label: str,
    outer_k: int,
    inner_k: int,
    seed: int,
) -> DataFrame:
    """Inner out-of-fold errors of every outer training part.

    ``assigned`` has the outer fold in ``fold``. Outer test rows never enter.
    """
    inner = materialize(
        inner_folds(assigned.select(id_col, "fold", label, *features), id_col, outer_k, inner_k, seed),
        "inner",
    )
    scored = oof_predict(inner, "inner_fold", features, label, by=["outer_fold"])
    return with_residuals(scored.drop("fold"), label)


def nested_predictions(
    assigned: DataFrame,
    screening: DataFrame,
    id_col: str,
    features: Sequence[str],
    label: str,
    thresholds: Sequence[float | None],
) -> DataFrame:
    """Fit each (outer fold, arm) on its retained rows and score the outer test rows."""
    arms = arm_grid(screening, thresholds)
    coefs = fit_linear(arms, ["outer_fold", "arm"], features, label).withColumnRenamed(
        "outer_fold", "fold"
    )
    return predict_linear(
        assigned.select(id_col, "fold", label, *features), coefs, ["fold"], features
    ).select("arm", "fold", id_col, F.col(label).alias("y"), "pred")


def nested_cv(
    df: DataFrame,
    id_col: str,
    features: Sequence[str],
    label: str,
    thresholds: Sequence[float | None],
    outer_k: int,
    inner_k: int,
    seed: int,
    assigned: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Nested comparison; pass ``assigned`` to use group folds outside."""
    outer = assigned if assigned is not None else kfold(df, id_col, outer_k, seed)
    outer = materialize(outer.select(id_col, "fold", label, *features), "outer")
    screening = materialize(
        nested_screening(outer, id_col, features, label, outer_k, inner_k, seed), "screening"
    )
    predictions = nested_predictions(outer, screening, id_col, features, label, thresholds)
    design = cohort_design(screening, thresholds, ["outer_fold"]).withColumnRenamed(
        "outer_fold", "fold"
    )
    return {"screening": screening, "predictions": predictions, "design": design}


def impute_wide(
    train: DataFrame, parts: Sequence[DataFrame], features: Sequence[str]
) -> tuple[list[str], list[DataFrame]]:
    """Fit null/median/constant handling on ``train`` and apply it to every part.

    ``(names, parts)``: the kept features, and each part with them in ``filled``, an array in this order, and as columns.
    """
    model = Preprocess(inputCol="__values", outputCol="filled").fit(as_values(train, features, "__values"))
    names = [features[k] for k in model.getOrDefault("kept")]
    filled = [model.transform(as_values(part, features, "__values")).drop("__values") for part in parts]
    return names, [part.withColumns({f: F.get("filled", F.lit(i)) for i, f in enumerate(names)}) for part in filled]


def final_fit_predict(
    train: DataFrame, holdout: DataFrame, features: Sequence[str], label: str, weight: str
) -> DataFrame:
    """Preprocess and fit on ``train`` alone; score and back-transform ``holdout``."""
    names, (fit_rows, test_rows) = impute_wide(train, [train, holdout], features)
    scored = predict_linear(test_rows, fit_linear(fit_rows, [], names, label), [], names)
    return scored.withColumns(
        back_transform_columns(F.col(label), F.col("pred"), F.col(weight))
    )


def bagging(
    train: DataFrame,
    holdout: DataFrame,
    id_col: str,
    features: Sequence[str],
    label: str,
    seeds: Sequence[int],
    rate: float = 0.75,
) -> DataFrame:
    """Per-seed predictions of fits on hash-drawn row subsamples, all seeds in one pass."""
    seed_list = F.array(*[F.lit(s) for s in seeds])
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.col("seed").cast("string")))
    draw = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    limit = int(rate * (1 << 32))
    drawn = train.withColumn("seed", F.explode(seed_list)).where(draw < limit)
    coefs = fit_linear(drawn, ["seed"], features, label)
    rows = holdout.withColumn("seed", F.explode(seed_list))
    return predict_linear(rows, coefs, ["seed"], features).select(
        id_col, "seed", F.col(label).alias("y"), "pred"
    )


def bagging_ensemble(preds: DataFrame, id_col: str) -> DataFrame:
    return ensemble_mean(preds, [id_col, "y"])


# --- the same protocols with boosted trees: distributed fits in a fixed order -----------


def _scored(model, rows: DataFrame, *columns: Column | str) -> DataFrame:
    return model.transform(rows).select(*columns, "pred")


def final_fit_predict_trees(
    train: DataFrame, holdout_rows: DataFrame, id_col: str, label: str, weight: str, fraction: float,
    max_rounds: int, patience: int, seed: int, **params,
) -> tuple[DataFrame, DataFrame]:
    """``(predictions, metrics)`` of the holdout: rounds from a pilot inside ``train``, then a fit on all of it."""
    rounds = select_rounds(train, id_col, label, fraction, max_rounds, patience, seed, **params)
    scored = fit_fixed(train, label, rounds, seed, **params).transform(holdout_rows)
    scored = scored.withColumns(back_transform_columns(F.col(label), F.col("pred"), F.col(weight)))
    return scored, regression_metrics(scored, [], label, "pred").withColumn("rounds", F.lit(rounds))


def threshold_cv_trees(
    scored: DataFrame, id_col: str, label: str, thresholds: Sequence[float | None], k: int, seed: int,
    fraction: float, max_rounds: int, patience: int, min_rows: int = 2, folder: str | None = None, **params,
) -> DataFrame:
    """``(arm, fold, rounds, id, y, pred)``: each arm's cohort in folds, each fold with its own early stop.

    Each (arm, fold) is a task of :func:`run_tasks`; with ``folder`` a stopped run goes on where it was.
    """
    spark = scored.sparkSession
    arms = arm_grid(scored.select(id_col, label, "fold_error", "features"), thresholds)
    folded = materialize(kfold(arms, id_col, k, seed, by=["arm"]), "tree-arms")

    def work(task) -> DataFrame:
        arm, fold = task["arm"], task["fold"]
        here = folded.where(F.col("arm") == arm)
        train = here.where(F.col("fold") != fold)
        require_rows(train, min_rows, f"arm {arm}, fold {fold}")
        rounds = select_rounds(train, id_col, label, fraction, max_rounds, patience, seed + fold, **params)
        model = fit_fixed(train, label, rounds, seed, **params)
        test = here.where(F.col("fold") == fold)
        return _scored(model, test, F.col("arm"), F.col("fold"), F.lit(rounds).alias("rounds"), F.col(id_col), F.col(label).alias("y"))

    tasks = [{"arm": arm, "fold": fold} for arm in map(arm_label, thresholds) for fold in range(1, k + 1)]
    settings = signature_of(protocol="threshold_cv", id=id_col, label=label, k=k, seed=seed, fraction=fraction, max_rounds=max_rounds, patience=patience, params=params)
    return run_tasks(spark, folder or scratch_path(spark, "tree-cv"), tasks, {"arm": "string", "fold": "int"}, settings, work)


def require_rows(df: DataFrame, n: int, what: str) -> None:
    if df.limit(n).count() < n:
        raise ValueError(f"{what}: fewer than {n} rows are left")


def nested_cv_trees(
    df: DataFrame, id_col: str, label: str, thresholds: Sequence[float | None], outer_k: int, inner_k: int, seed: int,
    max_rounds: int, patience: int, model_seeds: Sequence[int], fraction: float = 0.2, group: str | None = None,
    min_rows: int = 2, folder: str | None = None, **params,
) -> dict[str, DataFrame]:
    """Nested comparison of screening thresholds with boosted trees.

    In each outer training part: inner folds; the rounds of each from a pilot inside its training rows;
    out-of-fold errors with these rounds; the half-even median of the rounds as the common number; per
    arm and model seed a fit on the rows that the arm retains, scored on the outer test rows. With
    ``group`` outer folds, inner folds and pilots keep groups whole. Fails if an arm retains too few
    rows, if a training row has no out-of-fold error, or if there are fewer groups than folds.

    Each (outer fold, inner fold) and each (outer fold, arm, seed) is a task of :func:`run_tasks`; with ``folder`` a
    stopped run goes on where it was, as long as rows and settings are the same. ``id_col`` must be unique.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "tree-nested")
    settings = dict(id=id_col, label=label, outer_k=outer_k, inner_k=inner_k, seed=seed, max_rounds=max_rounds, patience=patience, fraction=fraction, group=group, params=params)
    columns = [id_col, label, "features", *([group] if group else [])]
    rows = df.select(*columns)
    outer = kfold(rows, id_col, outer_k, seed) if group is None else group_folds_seeded(rows, group, outer_k, seed)
    outer = materialize(outer, "tree-outer")
    inner_parts = {}
    for o in range(1, outer_k + 1):
        train, inner_seed = outer.where(F.col("fold") != o).drop("fold"), seed + OUTER_SEED_STEP * o
        inner = kfold(train, id_col, inner_k, inner_seed, out="inner_fold") if group is None else group_folds_seeded(train, group, inner_k, inner_seed, "inner_fold")
        inner_parts[o] = materialize(inner, "tree-inner")

    def screen(task) -> DataFrame:
        o, i = task["outer_fold"], task["inner_fold"]
        inner_seed = seed + OUTER_SEED_STEP * o
        fit_rows = inner_parts[o].where(F.col("inner_fold") != i)
        n = select_rounds(fit_rows, id_col, label, fraction, max_rounds, patience, inner_seed + PILOT_SEED_STEP * i, group, **params)
        model = fit_fixed(fit_rows, label, n, inner_seed + i, **params)
        test = inner_parts[o].where(F.col("inner_fold") == i)
        return _scored(model, test, F.lit(o).alias("outer_fold"), "inner_fold", F.col(id_col), F.col(label).alias("y"), F.lit(n).alias("rounds"))

    tasks = [{"outer_fold": o, "inner_fold": i} for o in inner_parts for i in range(1, inner_k + 1)]
    screened = run_tasks(spark, f"{folder}/screening", tasks, {"outer_fold": "int", "inner_fold": "int"}, signature_of(**settings), screen)
    screened = with_residuals(screened)
    # A line for each pair of folds.
    pilot = screened.groupBy("outer_fold", "inner_fold").agg(F.max("rounds").alias("rounds"), F.count("fold_error").alias("n")).collect()
    common = {}
    for o in inner_parts:
        here = [(r["outer_fold"], r["inner_fold"], float(r["rounds"])) for r in pilot if r["outer_fold"] == o]
        if sum(r["n"] for r in pilot if r["outer_fold"] == o) != inner_parts[o].count():
            raise ValueError(f"outer fold {o}: rows without an out-of-fold error")
        counts = spark.createDataFrame(here, "outer_fold int, inner_fold int, rounds double")
        common[o] = int(common_rounds(counts, max_rounds).first()["rounds"])
    limits = {arm_label(t): t for t in thresholds}

    def fit(task) -> DataFrame:
        o, arm, s = task["outer_fold"], task["arm"], task["seed"]
        errors = screened.where(F.col("outer_fold") == o)
        kept = errors if limits[arm] is None else errors.where(F.col("fold_error") < limits[arm])
        train = outer.where(F.col("fold") != o).join(kept.select(id_col), id_col, "left_semi")
        require_rows(train, min_rows, f"outer fold {o}, arm {arm}")
        model = fit_fixed(train, label, common[o], s, **params)
        return _scored(model, outer.where(F.col("fold") == o), F.lit(arm).alias("arm"), F.col("fold"), F.lit(s).alias("seed"), F.col(id_col), F.col(label).alias("y"))

    tasks = [{"outer_fold": o, "arm": arm, "seed": s} for o in inner_parts for arm in limits for s in model_seeds]
    key = {"outer_fold": "int", "arm": "string", "seed": "int"}
    per_seed = run_tasks(spark, f"{folder}/fits", tasks, key, signature_of(**settings), fit)
    rounds_rows = [(r["outer_fold"], r["inner_fold"], r["rounds"], common[r["outer_fold"]]) for r in pilot]
    return {
        "screening": screened.select("outer_fold", "inner_fold", id_col, "y", "pred", "abs_error", "fold_error"),
        "rounds": spark.createDataFrame(rounds_rows, "outer_fold int, inner_fold int, rounds int, common_rounds int"),
        "per_seed": per_seed,
        "predictions": per_seed.groupBy("arm", "fold", id_col).agg(F.any_value("y").alias("y"), F.avg("pred").alias("pred"), F.count("*").alias("n_models")),
        "outer": outer,
    }
