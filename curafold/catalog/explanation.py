"""Queries: contribution summaries of a linear model over the regression frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from curafold.catalog.base import FEATURES, SQL_FRAME, frame, r, register, rs, solve_sql, sums_sql
from curafold.functions import target as ft
from curafold.operators import explain
from curafold.plans import learners
from curafold.session import materialize

SQL_CONTRIB = f"""{SQL_FRAME}, s AS ({sums_sql('frame', [])}), c AS ({solve_sql('s', [])}),
scored AS (SELECT frame.*, b0 + b1 * log_words + b2 * upper_share AS pred, pow(10, abs(y - (b0 + b1 * log_words + b2 * upper_share))) AS fold_error FROM frame, c),
long AS (SELECT id, 'log_words' AS feature, log_words AS value, b1 * (log_words - m1) AS contribution FROM frame, c
  UNION ALL SELECT id, 'upper_share', upper_share, b2 * (upper_share - m2) FROM frame, c),
imp AS (SELECT feature, avg(abs(contribution)) AS mean_abs, avg(contribution) AS mean FROM long GROUP BY feature),
rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY contribution) + (count(*) OVER (PARTITION BY feature, contribution) - 1) / 2.0 AS ry FROM long),
rho AS (SELECT feature, corr(rx, ry) AS spearman FROM rk GROUP BY feature),
kinds AS (SELECT imp.*, spearman, CASE WHEN starts_with(feature, 'log_') THEN 'size' ELSE 'style' END AS feature_type,
  CASE WHEN spearman > 0 THEN 'increases with feature' WHEN spearman < 0 THEN 'decreases with feature' ELSE 'no clear direction' END AS direction FROM imp JOIN rho USING (feature))"""


def kind():
    return ft.feature_type(F.col("feature"), "log_", "size", "style")


def parts(spark, d, features=FEATURES):
    """Frame, coefficients, long contributions and bias of one linear fit."""
    df = materialize(frame(spark, d).select("id", "y", *[F.coalesce(f, F.lit(0.0)).alias(f) if f == "digit_share" else f for f in features]), "frame")
    coefs = materialize(learners.fit_linear(df, [], features, "y"), "coefs")
    long, bias = explain.linear_contributions(df, ["id"], coefs, features)
    scored = learners.predict_linear(df, coefs, [], features)
    scored = scored.withColumn("fold_error", F.pow(F.lit(10.0), F.abs(F.col("y") - F.col("pred"))))
    return long, bias, scored


@register("m10_contributions", f"WITH {SQL_CONTRIB} SELECT id, feature, {rs(['value', 'contribution'])} FROM long")
def _(spark, d):
    return parts(spark, d)[0]


@register("m10_reconstruction", f"""WITH {SQL_CONTRIB}, t AS (SELECT id, sum(contribution) AS s FROM long GROUP BY id)
  SELECT count(*) AS n, {r('max(abs(t.s + b0 + b1 * m1 + b2 * m2 - pred))', 'max_abs_diff')} FROM scored JOIN t USING (id), c""")
def _(spark, d):
    long, bias, scored = parts(spark, d)
    return explain.reconstruction_error(long, bias, scored, "id")


@register("a10_contribution_importance", f"WITH {SQL_CONTRIB} SELECT feature, {rs(['mean_abs', 'mean'])} FROM imp")
def _(spark, d):
    return explain.contribution_importance(parts(spark, d)[0])


@register("a11_group_importance", f"""WITH {SQL_CONTRIB}, g AS (SELECT feature_type AS feature_group, sum(mean_abs) AS mean_abs FROM kinds GROUP BY 1)
  SELECT feature_group, {r('mean_abs')}, {r('mean_abs * 100 / (SELECT sum(mean_abs) FROM imp)', 'relative_percent')} FROM g""")
def _(spark, d):
    return explain.group_importance(explain.contribution_importance(parts(spark, d)[0]), kind())


@register("a12_feature_spearman", f"WITH {SQL_CONTRIB} SELECT feature, {r('spearman')} FROM rho")
def _(spark, d):
    return explain.feature_spearman(parts(spark, d)[0])


@register("p15_direction_label", f"WITH {SQL_CONTRIB} SELECT feature, direction FROM kinds")
def _(spark, d):
    rho = explain.feature_spearman(parts(spark, d)[0])
    return rho.select("feature", ft.direction_label(F.col("spearman")).alias("direction"))


@register("p16_feature_type", f"WITH {SQL_CONTRIB} SELECT id, feature, CASE WHEN starts_with(feature, 'log_') THEN 'size' ELSE 'style' END AS feature_type FROM long")
def _(spark, d):
    return parts(spark, d)[0].select("id", "feature", kind().alias("feature_type"))


@register("w1_top_features", f"""WITH {SQL_CONTRIB}, t AS (SELECT *, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM kinds)
  SELECT feature, {rs(['mean_abs', 'mean', 'spearman'])}, feature_type, direction, rank FROM t WHERE rank <= 1""")
def _(spark, d):
    return explain.top_features(explain.importance_table(parts(spark, d)[0], kind()), 1)


SQL_CASES = SQL_CONTRIB + """, md AS (SELECT median(fold_error) AS m FROM scored),
cs AS (SELECT 'highest_prediction' AS case_label, (SELECT id FROM scored ORDER BY pred DESC, id LIMIT 1) AS id
  UNION ALL SELECT 'lowest_prediction', (SELECT id FROM scored ORDER BY pred, id LIMIT 1)
  UNION ALL SELECT 'largest_fold_error', (SELECT id FROM scored ORDER BY fold_error DESC, id LIMIT 1)
  UNION ALL SELECT 'median_fold_error', (SELECT id FROM scored, md ORDER BY round(abs(fold_error - m), 12), id LIMIT 1)),
cases AS (SELECT case_label, id, y, pred, fold_error FROM cs JOIN scored USING (id))"""


def _cases(scored):
    return explain.representative_cases(scored, "id")


@register("w3_representative_cases", f"WITH {SQL_CASES} SELECT case_label, id, {rs(['y', 'pred', 'fold_error'])} FROM cases")
def _(spark, d):
    return _cases(parts(spark, d)[2])


@register("w2_local_top", f"""WITH {SQL_CASES}, t AS (SELECT case_label, id, feature, long.value, contribution,
  CAST(row_number() OVER (PARTITION BY case_label, id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank FROM long JOIN cases USING (id))
  SELECT case_label, id, feature, {rs(['value', 'contribution'])}, rank FROM t WHERE rank <= 1""")
def _(spark, d):
    long, _, scored = parts(spark, d)
    return explain.local_top(long, _cases(scored), "id", 1)


@register("m11_dependence_table", f"""WITH {SQL_CONTRIB}, t AS (SELECT feature, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM imp)
  SELECT id, feature, rank, {rs(['value', 'contribution'])} FROM long JOIN t USING (feature) WHERE rank <= 1""")
def _(spark, d):
    long = parts(spark, d)[0]
    return explain.dependence_table(long, explain.contribution_importance(long), 1, ["id"])


@register("m13_explain_summary", f"""WITH {SQL_CONTRIB}, t AS (SELECT feature, row_number() OVER (ORDER BY mean_abs DESC, feature) AS k FROM imp),
  rec AS (SELECT id, sum(contribution) AS s FROM long GROUP BY id)
  SELECT (SELECT count(*) FROM frame) AS n, {r("(SELECT max(abs(rec.s + b0 + b1 * m1 + b2 * m2 - pred)) FROM scored JOIN rec USING (id), c)", 'max_abs_diff')}, (SELECT string_agg(feature, ',' ORDER BY k) FROM t) AS top_features,
    {r("(SELECT sum(mean_abs) FILTER (feature_type = 'size') * 100 / sum(mean_abs) FROM kinds)", 'size_percent')}""")
def _(spark, d):
    long, bias, scored = parts(spark, d)
    table = explain.importance_table(long, kind())
    out = explain.explain_summary(
        table, explain.group_importance(table, F.col("feature_type")), explain.reconstruction_error(long, bias, scored, "id")
    )
    return out.select("n", "max_abs_diff", "top_features", F.col("group_percent")["size"].alias("size_percent"))


# The same reports over all four varying features. SQL fits them by making each one orthogonal to those before it, so
# that simple slopes and a substitution backwards give the coefficients.
WIDE = ["log_words", "upper_share", "word_ratio", "digit_share"]


def wide_fit_sql() -> str:
    """CTEs ``o0`` to ``o4`` (residuals ``r0`` to ``r3``) and ``wc`` with coefficients ``b0`` to ``b3`` and means ``m0`` to ``m3``."""
    steps = ["o0 AS (SELECT id, y, log_words AS x0, upper_share AS x1, word_ratio AS x2, coalesce(digit_share, 0) AS x3 FROM frame)"]
    names = ["id", "y", "x0", "x1", "x2", "x3"]
    for j in range(4):
        slopes = [f"regr_slope(x{j}, r{k}) AS s{j}{k}" for k in range(j)]
        rest = "".join(f" - s{j}{k} * r{k}" for k in range(j))
        steps.append(f"t{j} AS (SELECT {', '.join([f'avg(x{j}) AS m{j}', *slopes])} FROM o{j})")
        steps.append(f"o{j + 1} AS (SELECT {', '.join(names)}, x{j} - m{j}{rest} AS r{j} FROM o{j}, t{j})")
        names.append(f"r{j}")
    steps.append(f"c AS (SELECT avg(y) AS my, {', '.join(f'regr_slope(y, r{j}) AS c{j}' for j in range(4))} FROM o4)")
    back = "c, t0, t1, t2, t3"
    steps.append(f"w3 AS (SELECT *, c3 AS b3 FROM {back})")
    steps.append("w2 AS (SELECT *, c2 - s32 * b3 AS b2 FROM w3)")
    steps.append("w1 AS (SELECT *, c1 - s31 * b3 - s21 * b2 AS b1 FROM w2)")
    steps.append("wc AS (SELECT *, c0 - s30 * b3 - s20 * b2 - s10 * b1 AS b0 FROM w1)")
    return ", ".join(steps)


SQL_WIDE = f"""{SQL_FRAME}, {wide_fit_sql()},
scored AS (SELECT o0.id, o0.y, my + {' + '.join(f'b{j} * (x{j} - m{j})' for j in range(4))} AS pred FROM o0, wc),
errors AS (SELECT *, pow(10, abs(y - pred)) AS fold_error FROM scored),
long AS ({' UNION ALL '.join(f"SELECT id, '{f}' AS feature, x{j} AS value, b{j} * (x{j} - m{j}) AS contribution FROM o0, wc" for j, f in enumerate(WIDE))}),
imp AS (SELECT feature, avg(abs(contribution)) AS mean_abs, avg(contribution) AS mean FROM long GROUP BY feature),
t AS (SELECT *, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM imp)"""


@register("m10_contributions_wide", f"WITH {SQL_WIDE} SELECT id, feature, {rs(['value', 'contribution'])} FROM long")
def _(spark, d):
    return parts(spark, d, WIDE)[0]


@register("w1_top_features_wide", f"WITH {SQL_WIDE} SELECT feature, {rs(['mean_abs', 'mean'])}, rank FROM t WHERE rank <= 3")
def _(spark, d):
    return explain.top_features(explain.contribution_importance(parts(spark, d, WIDE)[0]), 3)


@register("w2_local_top_wide", f"""WITH {SQL_WIDE}, md AS (SELECT median(fold_error) AS m FROM errors),
  cs AS (SELECT 'highest_prediction' AS case_label, (SELECT id FROM errors ORDER BY pred DESC, id LIMIT 1) AS id
    UNION ALL SELECT 'lowest_prediction', (SELECT id FROM errors ORDER BY pred, id LIMIT 1)
    UNION ALL SELECT 'largest_fold_error', (SELECT id FROM errors ORDER BY fold_error DESC, id LIMIT 1)
    UNION ALL SELECT 'median_fold_error', (SELECT id FROM errors, md ORDER BY round(abs(fold_error - m), 12), id LIMIT 1)),
  ranked AS (SELECT case_label, id, feature, long.value, contribution,
    CAST(row_number() OVER (PARTITION BY case_label, id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank FROM long JOIN cs USING (id))
  SELECT case_label, id, feature, {rs(['value', 'contribution'])}, rank FROM ranked WHERE rank <= 3""")
def _(spark, d):
    long, _, scored = parts(spark, d, WIDE)
    return explain.local_top(long, _cases(scored), "id", 3)


@register("m11_dependence_table_wide", f"""WITH {SQL_WIDE} SELECT id, feature, rank, {rs(['value', 'contribution'])} FROM long JOIN t USING (feature) WHERE rank <= 3""")
def _(spark, d):
    long = parts(spark, d, WIDE)[0]
    return explain.dependence_table(long, explain.contribution_importance(long), 3, ["id"])
