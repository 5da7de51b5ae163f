"""Queries: residuals, regression metrics, summaries, comparisons and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from curafold.catalog.base import (
    METRIC_NAMES, SQL_ENT, SQL_FRAME, SQL_PRED, SQL_SEEDS, entities, events, frame,
    metric_query, metric_sql, predictions, r, register, rs, seed_predictions,
)
from curafold.functions import target as ft
from curafold.operators import contracts, curate, joins, metrics, ranking
from curafold.sources import tables

THRESHOLDS = [2.0, 2.5, 3.0]
ARM_LIST = [None, *THRESHOLDS]

SQL_SCORED = SQL_PRED + """,
scored AS (SELECT *, pred - y AS residual, abs(pred - y) AS abs_error, pow(10, abs(pred - y)) AS fold_error
           FROM pred WHERE arm = 'no_filter')"""


def scored(spark, d):
    p = predictions(spark, d).where(F.col("arm") == "no_filter")
    return p.withColumns(ft.residual_columns(F.col("y"), F.col("pred")))


@register("p5_back_transform", f"""WITH {SQL_PRED} SELECT id, arm, {r('pow(10, -y)', 'true_molar')}, {r('pow(10, -pred)', 'pred_molar')},
  {r('1000 * weight * pow(10, -y)', 'true_value')}, {r('1000 * weight * pow(10, -pred)', 'pred_value')},
  {r('pow(10, abs(pred - y))', 'fold_error')} FROM pred""")
def _(spark, d):
    p = predictions(spark, d)
    cols = ft.back_transform_columns(F.col("y"), F.col("pred"), F.col("weight"))
    return p.select("id", "arm", *[c.alias(n) for n, c in cols.items()])


@register("p6_residual_columns", f"WITH {SQL_SCORED} SELECT id, {rs(['residual', 'abs_error', 'fold_error'])} FROM scored")
def _(spark, d):
    return scored(spark, d).select("id", "residual", "abs_error", "fold_error")


@register("p13_arm_threshold", f"WITH {SQL_PRED} SELECT id, arm, CAST(nullif(regexp_extract(arm, '^filter_(.+)fold$', 1), '') AS DOUBLE) AS threshold FROM pred")
def _(spark, d):
    return predictions(spark, d).select("id", "arm", ft.arm_threshold(F.col("arm")).alias("threshold"))


@register("f6_residual_filter", f"WITH {SQL_SCORED} SELECT id, {r('fold_error')} FROM scored WHERE abs_error < log10(2.5)")
def _(spark, d):
    return curate.residual_filter(scored(spark, d), 2.5, "log").select("id", "fold_error")


@register("a4_regression_metrics", metric_query(SQL_PRED, "pred", ["arm"]))
def _(spark, d):
    return metrics.regression_metrics(predictions(spark, d), ["arm"])


@register("a4_metrics_by_source", metric_query(SQL_PRED, "pred", ["arm", "source"]))
def _(spark, d):
    return metrics.regression_metrics(predictions(spark, d), ["arm", "source"])


SQL_BOTH = SQL_PRED + f""",
mf AS ({metric_sql('pred', ['arm', 'fold'])}), mp AS ({metric_sql('pred', ['arm'])}),
both_scopes AS (SELECT * FROM mf UNION ALL BY NAME SELECT * FROM mp)"""


@register("a5_metrics_pooled_and_by_fold", f"""WITH {SQL_BOTH} SELECT arm, fold, n, {rs(METRIC_NAMES)},
  CASE WHEN fold IS NULL THEN 'pooled' ELSE 'fold' END AS scope FROM both_scopes""")
def _(spark, d):
    return metrics.metrics_pooled_and_by_fold(predictions(spark, d))


@register("a6_pool_from_fold_summaries", f"""WITH {SQL_PRED}, mp AS ({metric_sql('pred', ['arm'])})
  SELECT arm, n, {rs(['r2', 'rmse', 'mae', 'within_2_fold_percent'])} FROM mp""")
def _(spark, d):
    p = predictions(spark, d)
    folds = metrics.regression_metrics(p, ["arm", "fold"])
    return metrics.pool_from_fold_summaries(folds, p.select("arm", "y"), ["arm"]).withColumn("n", F.col("n").cast("long"))


FOLD_SQL = ", ".join(
    f"{r(f'avg({v})', f'fold_mean_{v}')}, {r(f'stddev_samp({v})', f'fold_sd_{v}')}" for v in metrics.SUMMARY_METRICS
)


@register("a7_fold_mean_sd", f"WITH {SQL_BOTH} SELECT arm, count(*) AS n_folds, {FOLD_SQL} FROM mf GROUP BY arm")
def _(spark, d):
    return metrics.fold_mean_sd(metrics.regression_metrics(predictions(spark, d), ["arm", "fold"]))


@register("a8_arm_comparison", f"""WITH {SQL_BOTH}, f AS (SELECT arm, count(*) AS n_folds, {FOLD_SQL} FROM mf GROUP BY arm)
  SELECT arm, n, {', '.join(r(v, f'pooled_{v}') for v in metrics.SUMMARY_METRICS)}, f.* EXCLUDE (arm) FROM mp JOIN f USING (arm)""")
def _(spark, d):
    return metrics.arm_comparison(metrics.metrics_pooled_and_by_fold(predictions(spark, d)))


@register("j6_paired_delta", f"""WITH {SQL_BOTH} SELECT a.fold, a.arm, {', '.join(r(f'a.{v} - b.{v}', f'delta_{v}') for v in metrics.SUMMARY_METRICS)}
  FROM mf a JOIN mf b ON a.fold = b.fold AND b.arm = 'no_filter' WHERE a.arm <> 'no_filter'""")
def _(spark, d):
    m = metrics.regression_metrics(predictions(spark, d), ["arm", "fold"])
    return joins.paired_delta(m, "no_filter", metrics.SUMMARY_METRICS)


@register("j8_arm_grid", f"""WITH {SQL_SCORED} SELECT id, 'no_filter' AS arm, CAST(NULL AS DOUBLE) AS threshold FROM scored
  UNION ALL SELECT id, 'filter_' || t.l || 'fold', CAST(t.t AS DOUBLE) FROM scored, (VALUES (2.0, '2'), (2.5, '2.5'), (3.0, '3')) t(t, l)
  WHERE fold_error < t.t""")
def _(spark, d):
    return joins.arm_grid(scored(spark, d), ARM_LIST).select("id", "arm", "threshold")


@register("a13_ensemble_mean", f"WITH {SQL_SEEDS} SELECT id, {r('avg(pred)', 'pred')}, count(*) AS n_models FROM seeds GROUP BY id")
def _(spark, d):
    return metrics.ensemble_mean(seed_predictions(spark, d), ["id"])


@register("a14_common_rounds", """WITH r AS (SELECT user_id % 5 AS outer_fold, CAST(round_even(value * 100, 0) AS INTEGER) AS rounds FROM events)
  SELECT CAST(outer_fold AS INTEGER) AS outer_fold, CAST(greatest(1, least(3400, round_even(median(rounds), 0))) AS INTEGER) AS rounds FROM r GROUP BY outer_fold""")
def _(spark, d):
    rounds = events(spark, d).select(
        (F.col("user_id") % 5).cast("int").alias("outer_fold"), F.rint(F.col("value") * 100).cast("int").alias("rounds")
    )
    return metrics.common_rounds(rounds, 3400)


@register("a15_removal_counts", f"""WITH {SQL_SCORED} SELECT fold, count(*) AS n, {', '.join(f'count(*) FILTER (fold_error >= {t}) AS "removed_{t:g}"' for t in THRESHOLDS)} FROM scored GROUP BY fold""")
def _(spark, d):
    return metrics.removal_counts(scored(spark, d), THRESHOLDS, ["fold"])


@register("a16_cohort_design", f"""WITH {SQL_SCORED}, t AS (SELECT * FROM (VALUES ('no_filter', 1e30), ('filter_2fold', 2.0), ('filter_2.5fold', 2.5), ('filter_3fold', 3.0)) v(arm, t)),
  c AS (SELECT scored.fold, t.arm, count(*) AS n_initial, count(*) FILTER (fold_error >= t.t) AS n_removed FROM scored, t GROUP BY ALL)
  SELECT fold, arm, n_initial, n_removed, n_initial - n_removed AS n_retained, {r('n_removed * 100.0 / n_initial', 'removed_percent')} FROM c""")
def _(spark, d):
    return metrics.cohort_design(scored(spark, d), ARM_LIST, ["fold"])


@register("a18_max_abs_diff", f"WITH {SQL_PRED} SELECT {r('max(abs(y - pred))', 'y_vs_pred')}, {r('max(abs(value - weight))', 'value_vs_weight')} FROM pred")
def _(spark, d):
    return metrics.max_abs_diff(predictions(spark, d), {"y_vs_pred": ("y", "pred"), "value_vs_weight": ("value", "weight")})


@register("a19_seed_metrics", metric_query(SQL_SEEDS, "seeds", ["seed"]))
def _(spark, d):
    return metrics.seed_metrics(seed_predictions(spark, d))


@register("w5_rank_seeds", f"WITH {SQL_SEEDS}, mm AS ({metric_sql('seeds', ['seed'])}) SELECT seed, {r('r2')}, CAST(row_number() OVER (ORDER BY r2 DESC, seed) AS INTEGER) AS position FROM mm")
def _(spark, d):
    from pyspark.sql import Window

    best = metrics.rank_seeds(metrics.seed_metrics(seed_predictions(spark, d)))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("r2"), "seed")
    return best.select("seed", "r2", F.row_number().over(order).alias("position"))


@register("s7_seed_matrix", f"""WITH {SQL_SEEDS} SELECT id, {r('any_value(y)', 'y')}, {', '.join(r(f'max(pred) FILTER (seed = {s})', f'pred_seed_{s}') for s in (1, 2, 3))},
  {r('avg(pred)', 'pred_mean')} FROM seeds GROUP BY id""")
def _(spark, d):
    return tables.seed_matrix(seed_predictions(spark, d), "id", [1, 2, 3])


@register("s7_seed_long", f"WITH {SQL_SEEDS} SELECT id, seed, {rs(['y', 'pred'])} FROM seeds")
def _(spark, d):
    return tables.seed_long(tables.seed_matrix(seed_predictions(spark, d), "id", [1, 2, 3]), "id", [1, 2, 3])


@register("d6_subgroup_metrics", metric_query(
    SQL_SCORED + """,
    subs AS (SELECT 'all' AS subset, * FROM scored UNION ALL SELECT 'close', * FROM scored WHERE fold_error < 2
      UNION ALL SELECT 'far', * FROM scored WHERE fold_error >= 2 UNION ALL SELECT 'short', * FROM scored WHERE weight < 100
      UNION ALL SELECT 'long', * FROM scored WHERE weight >= 100 UNION ALL SELECT 'long_far', * FROM scored WHERE weight >= 100 AND fold_error >= 2)""",
    "subs", ["subset"],
))
def _(spark, d):
    far, long = F.col("fold_error") >= 2, F.col("weight") >= 100
    return metrics.subgroup_metrics(
        scored(spark, d),
        {"all": F.lit(True), "close": ~far, "far": far, "short": ~long, "long": long, "long_far": long & far},
    )


@register("j5_compare_snapshots", f"""WITH {SQL_PRED},
  a AS (SELECT id, y, pred, source FROM pred WHERE arm = 'no_filter' AND id <> 3), b AS (SELECT id, y, pred, source FROM pred WHERE arm = 'filter_20fold' AND id <> 5),
  j AS (SELECT a.id IS NOT NULL AS ia, b.id IS NOT NULL AS ib, a.y AS ya, b.y AS yb, a.pred AS pa, b.pred AS pb, a.source AS sa, b.source AS sb FROM a FULL JOIN b ON a.id = b.id),
  o AS (SELECT count(*) FILTER (NOT ib) AS only_a, count(*) FILTER (NOT ia) AS only_b FROM j)
  SELECT 'y' AS "column", o.only_a, o.only_b, count(*) FILTER (ia AND ib AND NOT abs(ya - yb) <= 0.001) AS n_different, {r('max(abs(ya - yb))', 'max_abs_diff')} FROM j, o GROUP BY ALL
  UNION ALL SELECT 'pred', o.only_a, o.only_b, count(*) FILTER (ia AND ib AND NOT abs(pa - pb) <= 0.001), {r('max(abs(pa - pb))', 'max_abs_diff')} FROM j, o GROUP BY ALL
  UNION ALL SELECT 'source', o.only_a, o.only_b, count(*) FILTER (ia AND ib AND sa <> sb), CAST(NULL AS DOUBLE) FROM j, o GROUP BY ALL""")
def _(spark, d):
    p = predictions(spark, d).select("id", "arm", "y", "pred", "source")
    a = p.where((F.col("arm") == "no_filter") & (F.col("id") != 3))
    b = p.where((F.col("arm") == "filter_20fold") & (F.col("id") != 5))
    return joins.compare_snapshots(a, b, ["id"], ["y", "pred", "source"], 0.001)


@register("w9_average_rank", f"""SELECT event_id, event_type, {r('value')}, {r('rank() OVER w + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0', 'avg_rank')}
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)""")
def _(spark, d):
    e = events(spark, d).select("event_id", "event_type", "value")
    return ranking.rows_with_average_rank(e, ["event_type"], "value")


@register("w8_ordered_export", f"WITH {SQL_PRED} SELECT id, arm, fold, {r('pred')} FROM pred")
def _(spark, d):
    return tables.ordered_export(predictions(spark, d).select("id", "arm", "fold", "pred"), ["arm", "fold", "id"])


# --- contracts -------------------------------------------------------------------


def chk(name: str, bad: str, source: str, detail: str = "rows violating the rule") -> str:
    """SQL of one report row: count of rows where ``bad`` holds."""
    return f"""SELECT '{name}' AS "check", CASE WHEN count(*) FILTER ({bad}) = 0 THEN 'pass' ELSE 'fail' END AS status,
      count(*) FILTER ({bad}) AS n_bad, '{detail}' AS detail FROM {source}"""


@register("q1_required_columns", """SELECT 'required_columns' AS "check", CASE WHEN count(*) = 2 THEN 'pass' ELSE 'fail' END AS status,
  2 - count(*) AS n_bad, 'missing: absent_column' AS detail FROM information_schema.columns WHERE table_name = 'events' AND column_name IN ('event_id', 'absent_column')""")
def _(spark, d):
    return contracts.required_columns(events(spark, d), ["event_id", "absent_column"])


@register("q2_row_count", """SELECT 'row_count' AS "check", CASE WHEN count(*) = 10000 THEN 'pass' ELSE 'fail' END AS status,
  abs(count(*) - 10000) AS n_bad, 'difference from the expected row count' AS detail FROM events""")
def _(spark, d):
    return contracts.expected_count(events(spark, d), 10_000)


@register("q3_key_checks", chk("user_id_present", "user_id IS NULL", "events") + " UNION ALL " + chk(
    "user_id_unique", "c > 1", "(SELECT user_id, count(*) AS c FROM events GROUP BY user_id)", "repeated keys"))
def _(spark, d):
    return contracts.key_checks(events(spark, d), "user_id")


@register("q4_categories", chk("event_type_allowed", "event_type NOT IN ('click', 'view', 'purchase') OR event_type IS NULL", "events") + f""" UNION ALL
  SELECT 'source_type=' || coalesce(a.k, b.k), CASE WHEN coalesce(n, 0) = coalesce(e, 0) THEN 'pass' ELSE 'fail' END, abs(coalesce(n, 0) - coalesce(e, 0)), 'difference from the expected rows'
  FROM (WITH {SQL_ENT} SELECT source_type AS k, count(*) AS n FROM ent GROUP BY 1) a
  FULL JOIN (VALUES ('mixed', 620), ('A_only', 700), ('C_only', 5)) b(k, e) ON a.k = b.k""")
def _(spark, d):
    kinds = contracts.allowed_values(events(spark, d), "event_type", ["click", "view", "purchase"])
    classes = contracts.composition(entities(spark, d), "source_type", {"mixed": 620, "A_only": 700, "C_only": 5})
    return contracts.contract_report(kinds, classes)


@register("q5_finite_positive", f"WITH {SQL_FRAME} " + " UNION ALL ".join([
    chk("y_finite", "y IS NULL OR isnan(y) OR isinf(y)", "frame"),
    chk("digit_share_finite", "digit_share IS NULL", "frame"),
    chk("weight_positive", "weight IS NULL OR weight <= 0", "frame")]))
def _(spark, d):
    return contracts.finite_positive(frame(spark, d), ["y", "digit_share"], ["weight"])


@register("q6_formula_matches", f"WITH {SQL_SCORED} " + " UNION ALL ".join([
    chk("target", "NOT abs(y - -log10(value / 1000 / weight)) <= 1e-9", "scored"),
    chk("fold_error", "NOT abs(fold_error - greatest(pow(10, residual), pow(10, -residual))) <= 1e-9", "scored"),
    chk("prediction_is_target", "NOT abs(pred - y) <= 1e-9", "scored")]))
def _(spark, d):
    s = scored(spark, d)
    ratio = ft.fold_ratio(F.pow(F.lit(10.0), "pred"), F.pow(F.lit(10.0), "y"))
    return contracts.formula_matches(
        s,
        {
            "target": (F.col("y"), ft.to_log_target(F.col("value"), F.col("weight"))),
            "fold_error": (F.col("fold_error"), ratio),
            "prediction_is_target": (F.col("pred"), F.col("y")),
        },
        1e-9,
    )


@register("q7_flag_matches", f"WITH {SQL_SCORED} " + chk(
    "flag_follows_rule", "(abs_error >= log10(2.5) OR id % 13 = 0) <> (abs_error >= log10(2.5))", "scored") + " UNION ALL " + chk(
    "flagged_keys_match_list", "true", "(SELECT id FROM scored WHERE (abs_error >= log10(2.5) OR id % 13 = 0) <> (abs_error >= log10(3)))", "keys present on one side only"))
def _(spark, d):
    s = scored(spark, d).withColumn("flag", (F.col("abs_error") >= F.log10(F.lit(2.5))) | (F.col("id") % 13 == 0))
    listed = s.where(F.col("abs_error") >= F.log10(F.lit(3.0))).select("id")
    return contracts.flag_matches(s, F.col("flag"), curate.residual_rules(2.5, "log"), listed, ["id"])


@register("q8_metrics_match", f"""WITH {SQL_PRED}, a AS ({metric_sql('pred', ['arm'])}),
  b AS (SELECT arm, avg(abs(pred - y)) + CASE WHEN arm = 'filter_20fold' THEN 0.001 ELSE 0 END AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM pred GROUP BY arm),
  j AS (SELECT abs(a.mae - b.mae) AS dm, abs(a.rmse - b.rmse) AS dr FROM a JOIN b USING (arm)) """ + chk("mae", "dm > 1e-6", "j") + " UNION ALL " + chk("rmse", "dr > 1e-6", "j"))
def _(spark, d):
    p = predictions(spark, d)
    error = F.col("pred") - F.col("y")
    shift = F.when(F.col("arm") == "filter_20fold", 0.001).otherwise(0.0)
    recorded = (
        p.groupBy("arm")
        .agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
        .withColumn("mae", F.col("mae") + shift)
    )
    actual = metrics.regression_metrics(p, ["arm"])
    return contracts.metrics_match(actual, recorded, ["arm"], ["mae", "rmse"], 1e-6)


@register("q11_contract_report", f"WITH {SQL_FRAME}, c AS (" + " UNION ALL ".join([
    chk("id_present", "id IS NULL", "frame"), chk("id_unique", "c > 1", "(SELECT id, count(*) AS c FROM frame GROUP BY id)"),
    chk("y_finite", "y IS NULL", "frame"), chk("digit_share_finite", "digit_share IS NULL", "frame"),
]) + """) SELECT CASE WHEN count(*) FILTER (status <> 'pass') = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n_checks, count(*) FILTER (status <> 'pass') AS n_failed FROM c""")
def _(spark, d):
    f = frame(spark, d)
    report = contracts.contract_report(contracts.key_checks(f, "id"), contracts.finite_positive(f, ["y", "digit_share"]))
    return contracts.overall(report)
