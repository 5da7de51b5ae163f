"""Queries: hashed features, descriptors, preprocessing and set similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from curafold.catalog.base import (
    ALL_FEATURES, METRIC_NAMES, SEED, SQL_BITS, SQL_FRAME, documents, frame, frame_table, kfold_sql, metric_sql,
    query_and_reference, r, register, rs,
)
from curafold.functions import target as ft
from curafold.operators import contracts, features, similarity, splits
from curafold.plans import preprocess
from curafold.session import materialize, scratch_path



@register("e1_count_fingerprint", f"""WITH {SQL_BITS} SELECT doc_id, bit, count(*) AS cnt, {r('ln(1 + count(*))', 'value')}
  FROM tok JOIN vocab USING (w) GROUP BY doc_id, bit""")
def _(spark, d):
    return features.count_fingerprint(documents(spark, d), "doc_id", features.words(F.col("text")))


@register("e2_binary_fingerprint", f"WITH {SQL_BITS} SELECT doc_id, bit FROM bits")
def _(spark, d):
    return features.binary_fingerprint(documents(spark, d), "doc_id", features.words(F.col("text")))


@register("e3_descriptors", r"""WITH b AS (SELECT doc_id, n_chars, CAST(len(regexp_extract_all(text, '[0-9]')) AS DOUBLE) AS dg FROM documents)
  SELECT doc_id, round(n_chars / nullif(dg, 0), 6) + 0.0 AS chars_per_digit, round(CASE WHEN dg > 0 THEN log10(dg) END, 6) + 0.0 AS log_digits,
    round(sqrt(n_chars), 6) + 0.0 AS root_chars, CAST(NULL AS DOUBLE) AS overflow FROM b""")
def _(spark, d):
    df = documents(spark, d).withColumn("dg", F.regexp_count("text", F.lit("[0-9]")).cast("double"))
    return features.descriptors(
        df, "doc_id",
        {"chars_per_digit": "try_divide(n_chars, dg)", "log_digits": F.log10("dg"), "root_chars": "sqrt(n_chars)", "overflow": "1e39 * (n_chars + 1)"},
    )


SQL_LONG = SQL_FRAME + ", long AS (" + " UNION ALL ".join(
    f"SELECT id, '{f}' AS feature, {f} AS value FROM frame" for f in ALL_FEATURES
) + ")"


def long_frame(spark, d):
    return features.to_long(frame(spark, d), ["id"], ALL_FEATURES)


@register("e4_assemble_long", f"""WITH {SQL_BITS}, {SQL_LONG} SELECT doc_id, 'count_bit_' || bit AS feature, {r('ln(1 + count(*))', 'value')}
  FROM tok JOIN vocab USING (w) GROUP BY doc_id, bit UNION ALL SELECT id, feature, {r('value')} FROM long""")
def _(spark, d):
    counts = features.count_fingerprint(documents(spark, d), "doc_id", features.words(F.col("text")))
    dense = features.to_long(frame(spark, d).withColumnRenamed("id", "doc_id"), ["doc_id"], ALL_FEATURES)
    return features.assemble_long(counts, dense, "doc_id")


@register("e5_sanitize", f"""SELECT event_id, {r("CASE WHEN event_id % 4 IN (1, 2) OR value IS NULL THEN NULL WHEN event_id % 4 = 3 THEN NULL ELSE value END", 'value')} FROM events""")
def _(spark, d):
    from curafold.catalog.base import events
    from curafold.functions.measurement import sanitize

    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.lit(float("-inf")))
        .when(kind == 3, F.col("value") + 3.5e38).otherwise(F.col("value"))
    )
    return events(spark, d).select("event_id", sanitize(raw).alias("value"))


SQL_TRAIN = SQL_LONG + f""", a AS ({kfold_sql('frame', 'id', 5, '42')}),
train AS (SELECT long.* FROM long JOIN a USING (id) WHERE fold <> 1), test AS (SELECT long.* FROM long JOIN a USING (id) WHERE fold = 1),
params AS (SELECT feature, count(value) AS n_values, median(value) AS median, coalesce(min(value) < max(value), false) AS kept FROM train GROUP BY feature)"""


def train_and_test(spark, d):
    a = materialize(splits.kfold(frame_table(spark, d), "id", 5, SEED), "folded-frame")
    long = features.to_long(a, ["id", "fold"], ALL_FEATURES)
    return long.where(F.col("fold") != 1).drop("fold"), long.where(F.col("fold") == 1).drop("fold")


@register("e6_drop_all_null", f"WITH {SQL_TRAIN} SELECT feature FROM params WHERE n_values > 0")
def _(spark, d):
    return features.drop_all_null(train_and_test(spark, d)[0])


@register("e7_fit_apply_median", f"""WITH {SQL_TRAIN} SELECT id, feature, {r('coalesce(value, median)', 'value')} FROM test JOIN params USING (feature) WHERE n_values > 0""")
def _(spark, d):
    train, test = train_and_test(spark, d)
    return features.apply_median(test, features.fit_median(train))


@register("e8_drop_constant", f"WITH {SQL_TRAIN} SELECT feature FROM params WHERE kept")
def _(spark, d):
    return features.drop_constant(train_and_test(spark, d)[0])


@register("e9_preprocess_model", f"WITH {SQL_TRAIN} SELECT feature, n_values, {r('median')}, kept FROM params")
def _(spark, d):
    return features.fit_preprocess(train_and_test(spark, d)[0])


@register("e9_preprocess_transform", f"WITH {SQL_TRAIN} SELECT id, feature, {r('coalesce(value, median)', 'value')} FROM test JOIN params USING (feature) WHERE kept")
def _(spark, d):
    train, test = train_and_test(spark, d)
    return features.transform_preprocess(test, features.fit_preprocess(train))


@register("e9_preprocess_stored", f"WITH {SQL_TRAIN} SELECT id, feature, {r('coalesce(value, median)', 'value')} FROM test JOIN params USING (feature) WHERE kept")
def _(spark, d):
    folded = materialize(splits.kfold(frame_table(spark, d), "id", 5, SEED), "folded-frame")
    rows = preprocess.as_values(folded, ALL_FEATURES)
    path = scratch_path(spark, "preprocess-model")
    preprocess.Preprocess().fit(rows.where("fold <> 1")).write().overwrite().save(path)
    model = preprocess.PreprocessModel.load(path)
    out = model.transform(rows.where("fold = 1")).select("id", F.posexplode("filled").alias("place", "value"))
    names = F.array(*[F.lit(ALL_FEATURES[k]) for k in model.getOrDefault("kept")])
    return out.select("id", F.get(names, "place").alias("feature"), "value")


@register("e9_preprocess_dims", f"""WITH {SQL_TRAIN} SELECT count(*) AS n_raw, count(*) FILTER (n_values > 0) AS n_not_all_null, count(*) FILTER (kept) AS n_kept FROM params""")
def _(spark, d):
    return features.preprocess_dims(features.fit_preprocess(train_and_test(spark, d)[0]))


@register("e10_require_width", f"""WITH {SQL_LONG} SELECT 'feature_width' AS "check", CASE WHEN count(*) FILTER (c <> 6) = 0 THEN 'pass' ELSE 'fail' END AS status,
  count(*) FILTER (c <> 6) AS n_bad, 'rows without exactly 6 features' AS detail FROM (SELECT id, count(*) AS c FROM long GROUP BY id)""")
def _(spark, d):
    return features.require_width(long_frame(spark, d), "id", len(ALL_FEATURES))


@register("a17_null_census", f"""WITH {SQL_TRAIN}, z AS (SELECT feature, CASE WHEN value > 0.9 THEN 'inf'::DOUBLE ELSE value END AS value FROM train)
  SELECT feature, count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing, count(*) FILTER (isinf(value)) AS n_non_finite FROM z GROUP BY feature""")
def _(spark, d):
    train, _ = train_and_test(spark, d)
    return features.null_census(train.withColumn("value", F.when(F.col("value") > 0.9, F.lit(float("inf"))).otherwise(F.col("value"))))


NAMED = ["log_words", "upper_share", "word_ratio"]


@register("p17_name_features", f"WITH {SQL_LONG} SELECT id, feature, {r('value')} FROM long WHERE feature IN ('log_words', 'upper_share', 'word_ratio')")
def _(spark, d):
    return features.name_features(features.assemble_vector(frame(spark, d), NAMED), "id", "features", NAMED)


# --- similarity --------------------------------------------------------------------

SQL_SETS = SQL_BITS + """,
sets AS (SELECT doc_id, md5(array_to_string(list(bit ORDER BY bit), ',')) AS set_id FROM bits GROUP BY doc_id),
allq AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
allr AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
full_s AS (SELECT allq.doc_id AS qid, allr.doc_id AS rid, coalesce(s, 0) AS s FROM allq CROSS JOIN allr LEFT JOIN sims ON qid = allq.doc_id AND rid = allr.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC) AS k FROM full_s)"""
COUNT_SQL = ", ".join(
    f"count(*) FILTER (s >= {t}::DOUBLE) AS {similarity.count_name(t)}" for t in similarity.THRESHOLDS
)
SQL_PROFILE = SQL_SETS + f""",
prof AS (SELECT qid AS doc_id, max(s) AS max_similarity, avg(s) FILTER (k <= 5) AS mean_top5_similarity, {COUNT_SQL} FROM ranked GROUP BY qid)"""
COUNT_NAMES = ", ".join(similarity.count_name(t) for t in similarity.THRESHOLDS)


def profile(spark, d):
    q, ref = query_and_reference(spark, d)
    return similarity.ad_profile(q, ref, "doc_id")


def counts(spark, d):
    return similarity.neighbor_counts(*query_and_reference(spark, d), "doc_id")


def best(spark, d):
    return similarity.best_similarity(*query_and_reference(spark, d), "doc_id")


@register("d1_tanimoto_pairs", f"""WITH {SQL_SETS} SELECT a.set_id AS q_set, b.set_id AS r_set, {r('any_value(s)', 'similarity')},
  count(DISTINCT qid) AS q_copies, count(DISTINCT rid) AS r_copies FROM sims JOIN sets a ON a.doc_id = qid JOIN sets b ON b.doc_id = rid
  WHERE s >= 0.7::DOUBLE GROUP BY a.set_id, b.set_id""")
def _(spark, d):
    return similarity.tanimoto_pairs(*query_and_reference(spark, d), 0.7)


@register("d2_ad_profile", f"WITH {SQL_PROFILE} SELECT doc_id, {rs(['max_similarity', 'mean_top5_similarity'])}, {COUNT_NAMES} FROM prof")
def _(spark, d):
    return profile(spark, d)


@register("j7_similarity_topk_join", f"WITH {SQL_PROFILE} SELECT doc_id, {rs(['max_similarity', 'mean_top5_similarity'])}, n_sim_ge_050, n_sim_ge_080 FROM prof")
def _(spark, d):
    q, ref = query_and_reference(spark, d)
    return similarity.ad_profile(q, ref, "doc_id", [0.5, 0.8])


@register("d3_ad_flags", f"WITH {SQL_PROFILE} SELECT doc_id, " + ", ".join(
    f"{similarity.count_name(t)} >= {c} AS in_{similarity.rule_name(t, c)}" for t in similarity.THRESHOLDS for c in similarity.COUNTS) + " FROM prof")
def _(spark, d):
    flags = similarity.ad_flags(counts(spark, d))
    return flags.select("doc_id", *[c for c in flags.columns if c.startswith("in_")])


SQL_REGION = SQL_PROFILE + """,
pr AS (SELECT prof.*, CAST(n_chars AS DOUBLE) / 1000 AS y, CAST(n_chars AS DOUBLE) / 1000 + (doc_id % 41 - 20) / 40.0::DOUBLE AS pred FROM prof JOIN documents USING (doc_id)),
rl AS (""" + " UNION ALL ".join(
    f"SELECT '{similarity.rule_name(t, c)}' AS rule, CASE WHEN {similarity.count_name(t)} >= {c} THEN 'inside' ELSE 'outside' END AS region, y, pred FROM pr"
    for t in similarity.THRESHOLDS for c in similarity.COUNTS) + f"""),
mm AS ({metric_sql('rl', ['rule', 'region'])}),
region AS (SELECT rule, region, n, {rs(METRIC_NAMES)}, {r('n * 100.0 / sum(n) OVER (PARTITION BY rule)', 'region_percent')} FROM mm)"""


def region_metrics(spark, d):
    base = documents(spark, d).select(
        "doc_id",
        (F.col("n_chars").cast("double") / 1000).alias("y"),
        (F.col("n_chars").cast("double") / 1000 + (F.col("doc_id") % 41 - 20) / 40.0).alias("pred"),
    )
    return similarity.ad_region_metrics(counts(spark, d).join(base, "doc_id"))


@register("d4_ad_region_metrics", f"WITH {SQL_REGION} SELECT * FROM region")
def _(spark, d):
    return region_metrics(spark, d)


@register("d5_ad_key_rules", f"WITH {SQL_REGION} SELECT * FROM region WHERE rule IN ('s070_n1', 's070_n3', 's050_n5')")
def _(spark, d):
    return similarity.ad_key_rules(region_metrics(spark, d), ["s070_n1", "s070_n3", "s050_n5"])


@register("d7_threshold_neighbors", f"""WITH {SQL_SETS} SELECT allq.doc_id, count(rid) AS n_neighbors, {r('max(s)', 'best_similarity')}
  FROM allq LEFT JOIN sims ON qid = allq.doc_id AND s >= 0.6::DOUBLE GROUP BY allq.doc_id""")
def _(spark, d):
    return similarity.threshold_neighbors(*query_and_reference(spark, d), "doc_id", 0.6)


# In a wide space few sets share their rare bits, so pairs come from the index.
WIDE = 16_384
SQL_WIDE = SQL_SETS.replace("% 2048", f"% {WIDE}")


@register("d1_tanimoto_pairs_wide", f"""WITH {SQL_WIDE} SELECT a.set_id AS q_set, b.set_id AS r_set, {r('any_value(s)', 'similarity')},
  count(DISTINCT qid) AS q_copies, count(DISTINCT rid) AS r_copies FROM sims JOIN sets a ON a.doc_id = qid JOIN sets b ON b.doc_id = rid
  WHERE s >= 0.7::DOUBLE GROUP BY a.set_id, b.set_id""")
def _(spark, d):
    return similarity.tanimoto_pairs(*query_and_reference(spark, d, WIDE), 0.7, WIDE)


@register("d7_threshold_neighbors_wide", f"""WITH {SQL_WIDE} SELECT allq.doc_id, count(rid) AS n_neighbors, {r('max(s)', 'best_similarity')}
  FROM allq LEFT JOIN sims ON qid = allq.doc_id AND s >= 0.6::DOUBLE GROUP BY allq.doc_id""")
def _(spark, d):
    return similarity.threshold_neighbors(*query_and_reference(spark, d, WIDE), "doc_id", 0.6, WIDE)


@register("w4_mean_top_k", f"WITH {SQL_SETS} SELECT qid AS doc_id, {r('avg(s)', 'mean_top5_similarity')} FROM ranked WHERE k <= 5 GROUP BY qid")
def _(spark, d):
    return profile(spark, d).select("doc_id", "mean_top5_similarity")


SQL_BAND = SQL_PROFILE + """, band AS (SELECT doc_id, max_similarity, CASE WHEN max_similarity = 1 THEN 'identical'
  WHEN max_similarity >= 0.7::DOUBLE THEN 'near' ELSE 'out' END AS band FROM prof)"""


@register("p12_similarity_band", f"WITH {SQL_BAND} SELECT doc_id, {r('max_similarity')}, band FROM band")
def _(spark, d):
    p = best(spark, d)
    return p.select("doc_id", "max_similarity", ft.similarity_band(F.col("max_similarity")).alias("band"))


@register("p19_annotate_groups", f"""WITH {SQL_BAND} SELECT substr(sha256('{{"doc_id":' || doc_id || '}}'), 1, 20) AS record_id, doc_id, {r('max_similarity')}, band,
  max_similarity < 1 AS non_identical, max_similarity >= 0.7::DOUBLE AS in_domain FROM band""")
def _(spark, d):
    s = F.col("max_similarity")
    return best(spark, d).select(
        ft.stable_id("doc_id").alias("record_id"), "doc_id", "max_similarity", ft.similarity_band(s).alias("band"),
        (s < 1).alias("non_identical"), (s >= ft.NEAR_SIMILARITY).alias("in_domain"),
    )


SQL_ODD = SQL_BAND + """, odd AS (SELECT max_similarity + (doc_id % 11 = 0)::INT AS max_similarity, CASE WHEN doc_id % 7 <> 0 THEN band END AS band FROM band)"""


@register("q9_similarity_contract", f"WITH {SQL_ODD} " + " UNION ALL ".join(
    f"""SELECT '{name}' AS "check", CASE WHEN count(*) FILTER ({bad}) = 0 THEN 'pass' ELSE 'fail' END AS status, count(*) FILTER ({bad}) AS n_bad, 'rows violating the rule' AS detail FROM odd"""
    for name, bad in (("similarity_in_unit_interval", "max_similarity NOT BETWEEN 0 AND 1"), ("band_known", "band IS NULL"))
))
def _(spark, d):
    p = best(spark, d).withColumn("band", ft.similarity_band(F.col("max_similarity")))
    odd = p.withColumns({
        "max_similarity": F.col("max_similarity") + (F.col("doc_id") % 11 == 0).cast("int"),
        "band": F.when(F.col("doc_id") % 7 != 0, F.col("band")),
    })
    return contracts.similarity_contract(odd, "max_similarity", "band")
