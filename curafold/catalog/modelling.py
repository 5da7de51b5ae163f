"""Queries: out-of-fold screening, cross-validation protocols, final fits and tree learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from curafold.catalog.base import (
    FEATURES, METRIC_NAMES, SEED, SQL_FRAME, frame, frame_table, holdout_sql, kfold_sql, metric_sql, oof_sql, r,
    register, rs, seeded_folds_sql, solve_sql, sums_sql,
)
from curafold.operators import features, metrics, ranking, splits
from curafold.plans import learners, runner, workflows
from curafold.session import materialize

ARM_LIST = [None, 1.05, 1.1, 1.2]
THRESHOLD = 1.1

FOLDED = f"folded AS ({kfold_sql('frame', 'id', 5, '42')})"
SQL_OOF = f"""{SQL_FRAME}, {FOLDED}, {oof_sql('folded', [], 'fold', 'o')},
report AS (SELECT id, lang, source, weight, value, y, log_words, upper_share, fold, pred, pred - y AS residual, abs(y - pred) AS abs_error,
  pow(10, abs(y - pred)) AS fold_error, pow(10, abs(y - pred)) >= {THRESHOLD} AS remove_flag FROM o_oof)"""


def rows(spark, d):
    """The regression frame as a written table: several plans read it more than once."""
    return materialize(
        frame(spark, d).select("id", "lang", "source", "weight", "value", "y", "word_ratio", "digit_share", *FEATURES), "frame"
    )


def report(spark, d):
    return workflows.oof_screen(rows(spark, d), "id", FEATURES, "y", 5, SEED, THRESHOLD)


@register("m3_oof_predict", f"WITH {SQL_OOF} SELECT id, fold, {rs(['y', 'pred'])} FROM report")
def _(spark, d):
    folded = splits.kfold(rows(spark, d), "id", 5, SEED)
    return learners.oof_predict(folded, "fold", FEATURES, "y").select("id", "fold", "y", "pred")


@register("m4_oof_screen", f"WITH {SQL_OOF} SELECT id, fold, {rs(['pred', 'residual', 'abs_error', 'fold_error'])}, remove_flag FROM report")
def _(spark, d):
    return report(spark, d).select("id", "fold", "pred", "residual", "abs_error", "fold_error", "remove_flag")


@register("m4_screen_summary", f"""WITH {SQL_OOF}, st AS (SELECT 'before' AS stage, y, pred FROM report UNION ALL SELECT 'after', y, pred FROM report WHERE NOT remove_flag),
  mm AS ({metric_sql('st', ['stage'])}) SELECT stage, n, {rs(METRIC_NAMES)} FROM mm""")
def _(spark, d):
    return workflows.screen_summary(materialize(report(spark, d), "report"))


SQL_FINAL = f"""{SQL_FRAME}, tr AS (SELECT * FROM frame WHERE lang <> 'en'), s AS ({sums_sql('tr', [])}), c AS ({solve_sql('s', [])}),
scored AS (SELECT frame.*, b0 + b1 * log_words + b2 * upper_share AS pred FROM frame, c WHERE lang = 'en')"""


@register("m5_final_fit_predict", f"""WITH {SQL_FINAL} SELECT id, {rs(['y', 'pred'])}, {r('pow(10, -y) * weight * 1000', 'true_value')},
  {r('pow(10, -pred) * weight * 1000', 'pred_value')}, {r('pow(10, abs(pred - y))', 'fold_error')} FROM scored""")
def _(spark, d):
    df = frame_table(spark, d)
    out = workflows.final_fit_predict(
        df.where(F.col("lang") != "en"), df.where(F.col("lang") == "en"), [*FEATURES, "const_one", "all_null"], "y", "weight"
    )
    return out.select("id", "y", "pred", "true_value", "pred_value", "fold_error")


SEEDS = [1, 2, 3, 42]
SQL_BAG = f"""{SQL_FRAME}, sd AS (SELECT * FROM (VALUES {', '.join(f'({s})' for s in SEEDS)}) v(seed)),
dr AS (SELECT frame.*, seed FROM frame, sd WHERE lang <> 'en' AND ('0x' || substr(md5(id || '|' || seed), 1, 8))::BIGINT < 3221225472),
s AS ({sums_sql('dr', ['seed'])}), c AS ({solve_sql('s', ['seed'])}),
bag AS (SELECT id, seed, y, b0 + b1 * log_words + b2 * upper_share AS pred FROM frame, c WHERE lang = 'en')"""


def bagged(spark, d):
    df = rows(spark, d)
    return workflows.bagging(df.where(F.col("lang") != "en"), df.where(F.col("lang") == "en"), "id", FEATURES, "y", SEEDS)


@register("m6_bagging", f"WITH {SQL_BAG} SELECT id, seed, {rs(['y', 'pred'])} FROM bag")
def _(spark, d):
    return bagged(spark, d)


@register("m6_bagging_ensemble", f"WITH {SQL_BAG} SELECT id, {r('avg(pred)', 'pred')}, {r('any_value(y)', 'y')}, count(*) AS n_models FROM bag GROUP BY id")
def _(spark, d):
    return workflows.bagging_ensemble(bagged(spark, d), "id")


VALUES_ARMS = "(VALUES ('no_filter', 1e30), ('filter_1.05fold', 1.05), ('filter_1.1fold', 1.1), ('filter_1.2fold', 1.2)) t(arm, t)"
SQL_TCV = f"""{SQL_OOF}, ar AS (SELECT arm, id, y, log_words, upper_share FROM report, {VALUES_ARMS} WHERE fold_error < t.t),
af AS ({kfold_sql('ar', 'id', 5, '42', ['arm'])}), {oof_sql('af', ['arm'], 'fold', 'a')}"""


@register("m8_threshold_cv", f"WITH {SQL_TCV} SELECT arm, fold, id, {rs(['y', 'pred'])} FROM a_oof")
def _(spark, d):
    return workflows.threshold_cv(report(spark, d), "id", FEATURES, "y", ARM_LIST, 5, SEED)


@register("m8_threshold_summary", f"""WITH {SQL_TCV}, mf AS ({metric_sql('a_oof', ['arm', 'fold'])}), mp AS ({metric_sql('a_oof', ['arm'])}),
  f AS (SELECT arm, count(*) AS n_folds, {', '.join(f"{r(f'avg({v})', f'fold_mean_{v}')}, {r(f'stddev_samp({v})', f'fold_sd_{v}')}" for v in metrics.SUMMARY_METRICS)} FROM mf GROUP BY arm)
  SELECT arm, n, {', '.join(r(v, f'pooled_{v}') for v in metrics.SUMMARY_METRICS)}, f.* EXCLUDE (arm) FROM mp JOIN f USING (arm)""")
def _(spark, d):
    cv = materialize(workflows.threshold_cv(report(spark, d), "id", FEATURES, "y", ARM_LIST, 5, SEED), "threshold-cv")
    return metrics.arm_comparison(metrics.metrics_pooled_and_by_fold(cv))


def nested_sql(outer: str) -> str:
    return f"""{SQL_FRAME}, {outer},
tr AS (SELECT id, y, log_words, upper_share, f AS outer_fold FROM outer_f, (VALUES (1), (2), (3)) v(f) WHERE f <> fold),
inn AS ({kfold_sql('tr', 'id', 3, '42 + 1000 * outer_fold', ['outer_fold'], 'inner_fold')}),
{oof_sql('inn', ['outer_fold'], 'inner_fold', 'i')},
screening AS (SELECT *, abs(y - pred) AS abs_error, pow(10, abs(y - pred)) AS fold_error FROM i_oof),
ar AS (SELECT screening.* , arm FROM screening, {VALUES_ARMS} WHERE fold_error < t.t),
s AS ({sums_sql('ar', ['outer_fold', 'arm'])}), c AS ({solve_sql('s', ['outer_fold', 'arm'])}),
nested AS (SELECT c.arm, o.fold, o.id, o.y, b0 + b1 * log_words + b2 * upper_share AS pred FROM outer_f o JOIN c ON c.outer_fold = o.fold)"""


SQL_NESTED = nested_sql(f"outer_f AS ({kfold_sql('frame', 'id', 3, '42')})")


def nested(spark, d, assigned=None):
    return workflows.nested_cv(rows(spark, d), "id", FEATURES, "y", ARM_LIST, 3, 3, SEED, assigned)


@register("m9_nested_screening", f"WITH {SQL_NESTED} SELECT outer_fold, inner_fold, id, {rs(['pred', 'abs_error', 'fold_error'])} FROM screening")
def _(spark, d):
    return nested(spark, d)["screening"].select("outer_fold", "inner_fold", "id", "pred", "abs_error", "fold_error")


@register("m9_nested_cv", f"WITH {SQL_NESTED} SELECT arm, fold, id, {rs(['y', 'pred'])} FROM nested")
def _(spark, d):
    return nested(spark, d)["predictions"]


@register("m9_nested_comparison", f"""WITH {SQL_NESTED}, mf AS ({metric_sql('nested', ['arm', 'fold'])}), mp AS ({metric_sql('nested', ['arm'])}),
  f AS (SELECT arm, count(*) AS n_folds, {', '.join(f"{r(f'avg({v})', f'fold_mean_{v}')}, {r(f'stddev_samp({v})', f'fold_sd_{v}')}" for v in metrics.SUMMARY_METRICS)} FROM mf GROUP BY arm),
  ds AS (SELECT outer_fold, arm, count(*) FILTER (fold_error >= t.t) * 100.0 / count(*) AS p FROM screening, {VALUES_ARMS} GROUP BY ALL),
  dm AS (SELECT arm, avg(p) AS p FROM ds GROUP BY arm)
  SELECT mp.arm, n, {', '.join(r(v, f'pooled_{v}') for v in metrics.SUMMARY_METRICS)}, f.* EXCLUDE (arm), {r('p', 'mean_removed_percent')} FROM mp JOIN f USING (arm) JOIN dm USING (arm)""")
def _(spark, d):
    parts = nested(spark, d)
    predictions = materialize(parts["predictions"], "nested")
    both = metrics.metrics_pooled_and_by_fold(predictions)
    return metrics.arm_comparison(both, parts["design"])


SQL_NESTED_GROUPS = nested_sql("outer_f AS (SELECT frame.*, gstep.fold FROM frame JOIN gstep ON gstep.grp = frame.source)")
SQL_NESTED_GROUPS = SQL_NESTED_GROUPS.removeprefix(SQL_FRAME + ", ")


@register("m9_nested_group_cv", f"""WITH RECURSIVE {SQL_FRAME}, gs AS (SELECT source AS grp, count(*) AS size FROM frame GROUP BY 1),
go AS (SELECT *, row_number() OVER (ORDER BY size DESC, grp) AS k FROM gs),
gstep AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS grp, 0 AS fold, [0, 0, 0]::BIGINT[] AS tot UNION ALL
  SELECT go.k, go.grp, CAST(list_position(s.tot, list_min(s.tot)) AS INTEGER),
    list_transform(range(1, 4), lambda i: s.tot[i] + CASE WHEN i = list_position(s.tot, list_min(s.tot)) THEN go.size ELSE 0 END)
  FROM gstep s JOIN go ON go.k = s.k + 1),
{SQL_NESTED_GROUPS}
SELECT arm, fold, id, {rs(['y', 'pred'])} FROM nested""")
def _(spark, d):
    df = rows(spark, d)
    assigned = splits.group_folds(df, "source", 3)
    return workflows.nested_cv(df, "id", FEATURES, "y", ARM_LIST, 3, 3, SEED, assigned)["predictions"]


@register("m12_resume_ledger", f"""WITH t AS (SELECT arm, CAST(f AS INTEGER) AS fold, 'cfg-1' AS signature FROM (VALUES ('no_filter'), ('filter_1.1fold')) a(arm), range(1, 6) r(f)),
  {SQL_FRAME}, {FOLDED},
  dn AS (SELECT DISTINCT 'no_filter' AS arm, fold, CASE WHEN fold = 3 THEN 'cfg-0' ELSE 'cfg-1' END AS signature FROM folded WHERE fold <= 3)
  SELECT t.arm, t.fold, t.signature, CASE WHEN dn.signature IS NULL THEN 'todo' WHEN dn.signature = t.signature THEN 'done' ELSE 'signature_mismatch' END AS state
  FROM t LEFT JOIN dn ON t.arm = dn.arm AND t.fold = dn.fold""")
def _(spark, d):
    folded = splits.kfold(rows(spark, d), "id", 5, SEED)
    arms = F.array(F.lit("no_filter"), F.lit("filter_1.1fold"))
    plan = folded.select("fold").distinct().select(F.explode(arms).alias("arm"), "fold", F.lit("cfg-1").alias("signature"))
    done = (
        folded.where(F.col("fold") <= 3).select("fold").distinct()
        .select(F.lit("no_filter").alias("arm"), "fold", F.when(F.col("fold") == 3, "cfg-0").otherwise("cfg-1").alias("signature"))
    )
    return runner.resume_ledger(plan, done, ["arm", "fold"])


# --- tree learners ---------------------------------------------------------------------
# One binary feature, depth 1 and no subsampling: the first tree is the mean of each side and later
# trees add nothing, so SQL gives predictions and rounds.

STUMP = dict(maxDepth=1, stepSize=1.0, subsamplingRate=1.0, minInstancesPerNode=1)
SQL_STUMP = f"""{SQL_FRAME}, b AS (SELECT id, y, weight, source, lang = 'en' AS f FROM frame WHERE y IS NOT NULL)"""
SQL_PARTS = f"""{SQL_STUMP}, h AS ({holdout_sql('b', 'id', 0.2, '42')}),
m AS (SELECT f, avg(y) AS pred FROM h WHERE part = 'train' GROUP BY f),
scored AS (SELECT h.*, pred FROM h JOIN m USING (f) WHERE part = 'valid')"""


def stump_rows(spark, d):
    """The rows as a written table: folds and their group sizes read them several times, the text is tokenised once."""
    df = frame(spark, d).where(F.col("y").isNotNull())
    df = df.withColumns({"is_en": (F.col("lang") == "en").cast("double"), "one": F.lit(1.0)})
    return materialize(features.assemble_vector(df, ["is_en", "one"]).select("id", "y", "weight", "source", "features"), "stump-rows")


def tree_parts(spark, d):
    parts = materialize(splits.holdout(stump_rows(spark, d), "id", 0.2, SEED), "tree-rows")
    return parts.where(F.col("part") == "train").drop("part"), parts.where(F.col("part") == "valid").drop("part")


@register("m1_fit_early_stop", f"WITH {SQL_PARTS} SELECT id, {rs(['y', 'pred'])}, 1 AS rounds FROM scored")
def _(spark, d):
    train, valid = tree_parts(spark, d)
    model, n = learners.fit_early_stop(train, valid, "y", 6, 2, SEED, **STUMP)
    return model.transform(valid).select("id", "y", "pred", F.lit(n).alias("rounds"))


@register("m2_fit_fixed", f"WITH {SQL_PARTS} SELECT id, {rs(['y', 'pred'])} FROM scored")
def _(spark, d):
    train, valid = tree_parts(spark, d)
    return learners.fit_fixed(train, "y", 3, SEED, **STUMP).transform(valid).select("id", "y", "pred")


@register("m3_oof_predict_trees", f"""WITH {SQL_STUMP}, k AS ({kfold_sql('b', 'id', 3, '42')}),
  m AS (SELECT x.fold, k.f, avg(k.y) AS pred FROM (SELECT DISTINCT fold FROM k) x JOIN k ON k.fold <> x.fold GROUP BY x.fold, k.f)
  SELECT id, fold, {rs(['y', 'pred'])} FROM k JOIN m USING (fold, f)""")
def _(spark, d):
    folded = splits.kfold(stump_rows(spark, d), "id", 3, SEED)
    return learners.oof_predict_trees(folded, "fold", 3, "y", 2, SEED, **STUMP).select("id", "fold", "y", "pred")


@register("m5_final_fit_trees", f"WITH {SQL_PARTS} SELECT id, {rs(['y', 'pred'])}, {r('pow(10, -pred) * weight * 1000', 'pred_value')}, {r('pow(10, abs(pred - y))', 'fold_error')} FROM scored")
def _(spark, d):
    train, valid = tree_parts(spark, d)
    scored, _metrics = workflows.final_fit_predict_trees(train, valid, "id", "y", "weight", 0.2, 4, 2, SEED, **STUMP)
    return scored.select("id", "y", "pred", "pred_value", "fold_error")


@register("m6_bagging_trees", f"WITH {SQL_PARTS} SELECT id, {r('pred')}, {r('y')}, CAST(2 AS BIGINT) AS n_models FROM scored")
def _(spark, d):
    train, valid = tree_parts(spark, d)
    parts = [
        learners.fit_fixed(train, "y", 2, s, **STUMP).transform(valid).select("id", F.lit(s).alias("seed"), "y", "pred")
        for s in (1, 2)
    ]
    return workflows.bagging_ensemble(parts[0].unionByName(parts[1]), "id")


@register("m7_select_rounds", f"WITH {SQL_PARTS} SELECT id, {rs(['y', 'pred'])}, 1 AS rounds FROM scored")
def _(spark, d):
    train, valid = tree_parts(spark, d)
    n = learners.select_rounds(train, "id", "y", 0.2, 5, 2, SEED, **STUMP)
    return learners.fit_fixed(train, "y", n, SEED, **STUMP).transform(valid).select("id", "y", "pred", F.lit(n).alias("rounds"))


SQL_STUMP_OOF = f"""{SQL_STUMP}, k3 AS ({kfold_sql('b', 'id', 3, '42')}),
k3m AS (SELECT x.fold, k3.f, avg(k3.y) AS pred FROM (SELECT DISTINCT fold FROM k3) x JOIN k3 ON k3.fold <> x.fold GROUP BY x.fold, k3.f),
rep AS (SELECT id, y, f, pow(10, abs(y - pred)) AS fold_error FROM k3 JOIN k3m USING (fold, f))"""
TREE_ARMS = [None, 1.2]
SQL_TREE_ARMS = "(VALUES ('no_filter', 1e30), ('filter_1.2fold', 1.2)) t(arm, t)"


@register("m8_threshold_cv_trees", f"""WITH {SQL_STUMP_OOF}, ar AS (SELECT arm, id, y, f FROM rep, {SQL_TREE_ARMS} WHERE fold_error < t.t),
  af AS ({kfold_sql('ar', 'id', 2, '42', ['arm'])}),
  m AS (SELECT x.arm, x.fold, af.f, avg(af.y) AS pred FROM (SELECT DISTINCT arm, fold FROM af) x JOIN af ON af.arm = x.arm AND af.fold <> x.fold GROUP BY ALL)
  SELECT arm, fold, 1 AS rounds, id, {rs(['y', 'pred'])} FROM af JOIN m USING (arm, fold, f)""")
def _(spark, d):
    folded = splits.kfold(stump_rows(spark, d), "id", 3, SEED)
    oof = workflows.with_residuals(learners.oof_predict_trees(folded, "fold", 3, "y", 1, SEED, **STUMP))
    scored = materialize(oof.select("id", "y", "features", "fold_error"), "tree-screen")
    return workflows.threshold_cv_trees(scored, "id", "y", TREE_ARMS, 2, SEED, 0.2, 3, 1, **STUMP)


SQL_NESTED_TREES = f"""{SQL_STUMP}, o AS ({kfold_sql('b', 'id', 2, '42')}),
tr AS (SELECT id, y, o.f, x.n AS outer_fold FROM o, (VALUES (1), (2)) x(n) WHERE x.n <> fold),
inn AS ({kfold_sql('tr', 'id', 2, '42 + 1000 * outer_fold', ['outer_fold'], 'inner_fold')}),
im AS (SELECT x.outer_fold, x.inner_fold, inn.f, avg(inn.y) AS pred FROM (SELECT DISTINCT outer_fold, inner_fold FROM inn) x
       JOIN inn ON inn.outer_fold = x.outer_fold AND inn.inner_fold <> x.inner_fold GROUP BY ALL),
screening AS (SELECT outer_fold, inner_fold, id, y, f, pred, abs(y - pred) AS abs_error, pow(10, abs(y - pred)) AS fold_error FROM inn JOIN im USING (outer_fold, inner_fold, f)),
am AS (SELECT outer_fold AS fold, arm, f, avg(y) AS pred FROM screening, {SQL_TREE_ARMS} WHERE fold_error < t.t GROUP BY ALL)"""


def nested_trees(spark, d, group=None):
    return workflows.nested_cv_trees(
        stump_rows(spark, d), "id", "y", TREE_ARMS, 2, 2, SEED, 3, 1, [1, 2], group=group, **STUMP
    )


@register("m9_nested_trees", f"WITH {SQL_NESTED_TREES} SELECT arm, fold, id, {rs(['y', 'pred'])}, CAST(2 AS BIGINT) AS n_models FROM o JOIN am USING (fold, f)")
def _(spark, d):
    return nested_trees(spark, d)["predictions"]


@register("m9_nested_trees_screening", f"WITH {SQL_NESTED_TREES} SELECT outer_fold, inner_fold, id, {rs(['y', 'pred', 'abs_error', 'fold_error'])} FROM screening")
def _(spark, d):
    return nested_trees(spark, d)["screening"]


@register("m10_contributions_trees", f"""WITH {SQL_PARTS}, med AS (SELECT median(f::INT)::INT::BOOLEAN AS f FROM h WHERE part = 'train'),
  mid AS (SELECT pred AS middle FROM m JOIN med USING (f))
  SELECT id, 'is_en' AS feature, {r('f::INT::DOUBLE', 'value')}, {r('pred - middle', 'contribution')} FROM scored, mid
  UNION ALL SELECT id, 'one', {r('1.0::DOUBLE', 'value')}, {r('0.0::DOUBLE', 'contribution')} FROM scored""")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    train, valid = tree_parts(spark, d)
    model = learners.fit_fixed(train, "y", 1, SEED, **STUMP)
    values = train.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
    medians = [x["median"] for x in ranking.exact_median(values, ["feature"], "value").orderBy("feature").collect()]
    return learners.ablation_contributions(model, valid, ["id"], ["is_en", "one"], medians)


# --- the same learners on all features, with several rounds -------------------------------
# No SQL: tests compare them with a brute-force booster.

TREES = dict(maxDepth=3, stepSize=0.5)


def wide_rows(spark, d):
    """All features, missing values filled with the median, as one vector."""
    df = rows(spark, d).where(F.col("y").isNotNull())
    names, (filled,) = workflows.impute_wide(df, [df], ["word_ratio", "digit_share", *FEATURES])
    return materialize(features.assemble_vector(filled, names).select("id", "y", "weight", "source", "features"), "wide-rows")


def wide_parts(spark, d):
    parts = materialize(splits.holdout(wide_rows(spark, d), "id", 0.2, SEED), "wide-parts")
    return parts.where(F.col("part") == "train").drop("part"), parts.where(F.col("part") == "valid").drop("part")


@register("m1_fit_early_stop_all")
def _(spark, d):
    train, valid = wide_parts(spark, d)
    model, n = learners.fit_early_stop(train, valid, "y", 12, 2, SEED, **TREES)
    return model.transform(valid).select("id", "y", "pred", F.lit(n).alias("rounds"))


@register("m2_fit_fixed_all")
def _(spark, d):
    train, valid = wide_parts(spark, d)
    return learners.fit_fixed(train, "y", 4, SEED, **TREES).transform(valid).select("id", "y", "pred")


@register("m3_oof_predict_trees_all")
def _(spark, d):
    folded = splits.kfold(wide_rows(spark, d), "id", 3, SEED)
    return learners.oof_predict_trees(folded, "fold", 3, "y", 3, SEED, **TREES).select("id", "fold", "y", "pred")


@register("m6_bagging_trees_all")
def _(spark, d):
    train, valid = wide_parts(spark, d)
    scored = [
        learners.fit_fixed(train, "y", 3, s, **TREES).transform(valid).select("id", F.lit(s).alias("seed"), "y", "pred") for s in (1, 2, 3)
    ]
    return workflows.bagging_ensemble(scored[0].unionByName(scored[1]).unionByName(scored[2]), "id")


@register("m7_select_rounds_all")
def _(spark, d):
    train, valid = wide_parts(spark, d)
    n = learners.select_rounds(train, "id", "y", 0.2, 8, 2, SEED, **TREES)
    return learners.fit_fixed(train, "y", n, SEED, **TREES).transform(valid).select("id", "y", "pred", F.lit(n).alias("rounds"))


@register("m7_select_rounds_groups")
def _(spark, d):
    train, valid = wide_parts(spark, d)
    n = learners.select_rounds(train, "id", "y", 0.2, 8, 2, SEED, group="source", **TREES)
    return learners.fit_fixed(train, "y", n, SEED, **TREES).transform(valid).select("id", "y", "pred", F.lit(n).alias("rounds"))


# Whole groups outside, inside and in the pilots. Stumps make the predictions of each fold a mean, so SQL can state all of it
# from the recursion of the seeded group folds.
SQL_GROUP_OUTER = f"""{SQL_STUMP}, {seeded_folds_sql('SELECT source AS grp, count(*) AS size FROM b GROUP BY 1', 2, SEED, 'o')},
o AS (SELECT id, y, source, f, CAST(fold AS INTEGER) AS fold FROM b JOIN o_step ON source IS NOT DISTINCT FROM grp WHERE k > 0)"""


def _inner_sql(outer: int) -> str:
    name = f"i{outer}"
    sizes = f"SELECT source AS grp, count(*) AS size FROM o WHERE fold <> {outer} GROUP BY 1"
    return f"""{seeded_folds_sql(sizes, 2, SEED + splits.OUTER_SEED_STEP * outer, name)},
{name} AS (SELECT {outer} AS outer_fold, id, y, f, CAST({name}_step.fold AS INTEGER) AS inner_fold FROM o JOIN {name}_step ON source IS NOT DISTINCT FROM grp WHERE k > 0 AND o.fold <> {outer})"""


SQL_GROUP_NESTED = f"""{SQL_GROUP_OUTER}, {_inner_sql(1)}, {_inner_sql(2)},
inn AS (SELECT * FROM i1 UNION ALL SELECT * FROM i2),
im AS (SELECT x.outer_fold, x.inner_fold, inn.f, avg(inn.y) AS pred FROM (SELECT DISTINCT outer_fold, inner_fold FROM inn) x
       JOIN inn ON inn.outer_fold = x.outer_fold AND inn.inner_fold <> x.inner_fold GROUP BY ALL),
screening AS (SELECT outer_fold, inner_fold, id, y, f, pred, pow(10, abs(y - pred)) AS fold_error FROM inn JOIN im USING (outer_fold, inner_fold, f)),
am AS (SELECT outer_fold AS fold, arm, f, avg(y) AS pred FROM screening, {SQL_TREE_ARMS} WHERE fold_error < t.t GROUP BY ALL)"""


@register("m9_nested_trees_groups", f"WITH RECURSIVE {SQL_GROUP_NESTED} SELECT arm, fold, id, {rs(['y', 'pred'])}, CAST(2 AS BIGINT) AS n_models FROM o JOIN am USING (fold, f)")
def _(spark, d):
    return nested_trees(spark, d, "source")["predictions"]


def leak_sql(name: str, bad: str, detail: str) -> str:
    return f"""SELECT '{name}' AS "check", CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, n AS n_bad, '{detail}' AS detail FROM (SELECT count(*) AS n FROM ({bad}))"""


@register("m9_nested_trees_groups_leakage", f"""WITH RECURSIVE {SQL_GROUP_NESTED},
ledger AS (SELECT fold AS outer_fold, 0 AS inner_fold, 'test' AS role, id FROM o UNION ALL SELECT outer_fold, inner_fold, 'oof_prediction', id FROM screening)
""" + " UNION ALL ".join([
    leak_sql("outer_test_untouched", "SELECT 1 FROM ledger GROUP BY outer_fold, id HAVING bool_or(role = 'test') AND bool_or(role <> 'test')", "outer test rows used in screening"),
    leak_sql("inner_prediction_once", "SELECT 1 FROM ledger WHERE role <> 'test' GROUP BY outer_fold, id HAVING count(*) <> 1", "outer train rows not predicted exactly once"),
    leak_sql("inner_role_single", "SELECT 1 FROM ledger WHERE role <> 'test' GROUP BY outer_fold, inner_fold, id HAVING count(*) <> 1", "rows with several roles"),
    leak_sql("outer_test_once", "SELECT 1 FROM ledger WHERE role = 'test' GROUP BY id HAVING count(*) <> 1", "rows tested more than once"),
    leak_sql("group_isolated", "SELECT 1 FROM ledger JOIN b USING (id) GROUP BY outer_fold, source HAVING bool_or(role = 'test') AND bool_or(role <> 'test')", "groups on both sides of an outer split"),
]))
def _(spark, d):
    run = nested_trees(spark, d, "source")
    test = run["outer"].select(F.col("fold").alias("outer_fold"), F.lit(0).alias("inner_fold"), F.lit("test").alias("role"), "id")
    screened = run["screening"].select("outer_fold", "inner_fold", F.lit("oof_prediction").alias("role"), "id")
    groups = run["outer"].select("id", F.col("source").alias("group_id"))
    return splits.leakage_report(materialize(test.unionByName(screened), "tree-ledger"), "id", groups)
