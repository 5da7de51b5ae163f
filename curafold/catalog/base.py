"""Registry, shared inputs and the SQL fragments that describe the same inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curafold.functions.measurement import normalize_source, parse_measurement
from curafold.functions.target import to_log_target
from curafold.operators.curate import (
    aggregate_entities,
    exclusion_cascade,
    kept,
    measurement_rules,
    tag_conflicts,
)
from curafold.operators import splits
from curafold.operators.features import bit_sets, words
from curafold.session import materialize
from curafold.sources.tables import read_spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
LOW, HIGH, CONFLICT = 0.5, 300.0, 5.0
SEED = 42


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles so that summation order does not show; ``+ 0.0`` removes minus zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), DIGITS) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(query(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def r(expr: str, alias: str | None = None) -> str:
    """SQL twin of :func:`tidy`."""
    return f"round({expr}, {DIGITS}) + 0.0 AS {alias or expr}"


def rs(names: Sequence[str]) -> str:
    return ", ".join(r(n) for n in names)


# --- measurements: events as raw multi-source records --------------------------

SOURCE_EXACT = {"7": "A", "7.0": "A", "9": "B", "9.0": "B"}
SOURCE_CONTAINS = {"registry-a": "A", "registry-b": "B"}


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, f"{d}/events.parquet", "event_id")


def raw_label() -> F.Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "click", F.lit("7"))
        .when(kind == "view", F.lit(" 7.0 "))
        .when(kind == "purchase", F.lit("9"))
        .when(kind == "signup", F.lit("Registry-B v2"))
        .when(F.col("event_id") % 2 == 0, F.lit("x"))
    )


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """Raw records: row id, entity, text value, source label, entity weight."""
    return events(spark, d).select(
        F.col("event_id").alias("row_id"),
        F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("entity"),
        F.col("value").cast("string").alias("raw_value"),
        normalize_source(raw_label(), SOURCE_EXACT, SOURCE_CONTAINS).alias("source"),
        (F.lit(1) + F.col("user_id") % 50).alias("weight"),
    )


def parsed(spark: SparkSession, d: str) -> DataFrame:
    p = measurements(spark, d).withColumn("p", parse_measurement(F.col("raw_value")))
    return p.withColumn("value", F.col("p.value"))


def row_tagged(spark: SparkSession, d: str) -> DataFrame:
    df = parsed(spark, d)
    return exclusion_cascade(df, measurement_rules(F.col("p"), LOW, HIGH)).drop("p")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    # The conflict test reads entity and value once more. As a filter its rules would spell out the parsed value, and
    # its regular expressions, again for each mention, so the rows are parsed once and written.
    return tag_conflicts(materialize(row_tagged(spark, d), "row-tagged"), "entity", "value", CONFLICT)


def entities(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_entities(kept(tagged(spark, d)))


SQL_MEAS = """m AS (
  SELECT event_id AS row_id, user_id || '|' || strftime(ts, '%Y-%m-%d') AS entity,
         CAST(value AS VARCHAR) AS raw_value, value,
         CASE WHEN event_type IN ('click', 'view') THEN 'A'
              WHEN event_type IN ('purchase', 'signup') THEN 'B' ELSE 'Unknown' END AS source,
         1 + user_id % 50 AS weight
  FROM events)"""
SQL_TAGGED = SQL_MEAS + """,
t0 AS (SELECT *, CASE WHEN value IS NULL THEN 'numeric_parse_failed' WHEN value <= 0 THEN 'non_positive'
                      WHEN value < 0.5 THEN 'value_below_0.5' WHEN value > 300 THEN 'value_above_300' END AS r0
       FROM m),
bad AS (SELECT entity FROM t0 WHERE r0 IS NULL GROUP BY entity
        HAVING count(*) >= 2 AND max(value) / min(value) > 5),
tagged AS (SELECT t0.*, coalesce(r0, CASE WHEN bad.entity IS NOT NULL
                  THEN 'duplicate_conflict_fold_above_5' END) AS remove_reason
           FROM t0 LEFT JOIN bad ON t0.entity = bad.entity),
kept AS (SELECT * FROM tagged WHERE remove_reason IS NULL)"""
SQL_ENT = SQL_TAGGED + """,
ent0 AS (
  SELECT entity, median(value) AS value, min(value) AS min_raw, max(value) AS max_raw, avg(value) AS mean_raw,
         count(*) AS n_raw_records, min(row_id) AS first_row_id, arg_min(weight, row_id) AS weight,
         array_to_string(list_sort(list_distinct(list(source))), ';') AS source_set,
         bool_or(source = 'A') AS has_a, bool_or(source = 'B') AS has_b,
         max(weight) AS max_weight, arg_min(raw_value, row_id) AS first_raw_value
  FROM kept GROUP BY entity),
ent AS (SELECT *, CASE WHEN has_a AND has_b THEN 'mixed' WHEN has_a THEN 'A_only'
                       WHEN has_b THEN 'B_only' ELSE 'Unknown' END AS source_type,
               -log10(value / 1000 / weight) AS y FROM ent0)"""


# --- regression frame: documents with descriptors ------------------------------

FEATURES = ["log_words", "upper_share"]
ALL_FEATURES = ["log_words", "upper_share", "word_ratio", "digit_share", "const_one", "all_null"]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_spread(spark, f"{d}/documents.parquet", "doc_id")


def frame(spark: SparkSession, d: str) -> DataFrame:
    w = documents(spark, d).withColumn("w", words(F.col("text")))
    n_words = F.size("w").cast("double")
    digits = F.regexp_count("text", F.lit("[0-9]"))
    return w.select(
        F.col("doc_id").alias("id"),
        "lang",
        "source",
        F.col("n_chars").cast("double").alias("value"),
        n_words.alias("weight"),
        F.log10(n_words).alias("log_words"),
        F.try_divide(F.regexp_count("text", F.lit("[A-Z]")).cast("double"), F.col("n_chars")).alias("upper_share"),
        F.try_divide(F.size(F.array_distinct("w")).cast("double"), n_words).alias("word_ratio"),
        F.try_divide(F.when(digits > 0, digits).cast("double"), F.col("n_chars")).alias("digit_share"),
        F.lit(1.0).alias("const_one"),
        F.lit(None).cast("double").alias("all_null"),
        to_log_target(F.col("n_chars").cast("double"), n_words).alias("y"),
    )


def frame_table(spark: SparkSession, d: str) -> DataFrame:
    """The frame as a written table: the text is tokenised once, consumers read numbers."""
    return materialize(frame(spark, d), "frame")


SQL_FRAME = r"""frame AS (
  SELECT doc_id AS id, lang, source, CAST(n_chars AS DOUBLE) AS value, CAST(len(w) AS DOUBLE) AS weight,
         log10(len(w)) AS log_words,
         len(regexp_extract_all(text, '[A-Z]')) / CAST(n_chars AS DOUBLE) AS upper_share,
         len(list_distinct(w)) / CAST(len(w) AS DOUBLE) AS word_ratio,
         nullif(len(regexp_extract_all(text, '[0-9]')), 0) / CAST(n_chars AS DOUBLE) AS digit_share,
         CAST(1.0 AS DOUBLE) AS const_one, CAST(NULL AS DOUBLE) AS all_null,
         -log10(CAST(n_chars AS DOUBLE) / 1000 / len(w)) AS y
  FROM (SELECT *, regexp_split_to_array(trim(text), '\s+') AS w FROM documents))"""


# --- predictions: a deterministic stand-in over the regression frame -----------

ARMS = ["no_filter", "filter_10fold", "filter_20fold"]


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """``(id, arm, fold, y, pred)`` plus the columns of the frame's keys."""
    base = frame_table(spark, d).select("id", "y", "weight", "value", "source", (F.col("id") % 5 + 1).cast("int").alias("fold"))
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(i).alias("k")) for i, a in enumerate(ARMS)])
    return base.select("*", F.inline(arms)).select(
        "id", "y", "weight", "value", "source", "fold", "arm",
        (F.col("y") + (F.col("id") % 41 - 20) / 37.0 + 0.03 * F.col("k") * (F.col("id") % 3)).alias("pred"),
    )


SQL_PRED = SQL_FRAME + """,
pred AS (
  SELECT id, y, weight, value, source, CAST(id % 5 + 1 AS INTEGER) AS fold, arm,
         y + (id % 41 - 20) / 37.0::DOUBLE + 0.03::DOUBLE * k * (id % 3) AS pred
  FROM frame, (VALUES ('no_filter', 0), ('filter_10fold', 1), ('filter_20fold', 2)) a(arm, k))"""


def seed_predictions(spark: SparkSession, d: str) -> DataFrame:
    base = predictions(spark, d).where(F.col("arm") == "no_filter")
    return base.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        "id", "seed", "y", (F.col("pred") + 0.02 * F.col("seed") * (F.col("id") % 7 - 3)).alias("pred")
    )


SQL_SEEDS = SQL_PRED + """,
seeds AS (SELECT id, seed, y, pred + 0.02::DOUBLE * seed * (id % 7 - 3) AS pred
          FROM pred, (VALUES (1), (2), (3)) s(seed) WHERE arm = 'no_filter')"""


def metric_sql(source: str, by: Sequence[str], y: str = "y", pred: str = "pred") -> str:
    """SQL of the regression metrics; ``by`` may be empty."""
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    e = f"({pred} - {y})"
    return f"""SELECT {keys}count(*) AS n,
  CASE WHEN count(*) >= 2 AND var_pop({y}) > 0 THEN 1 - sum({e} * {e}) / (var_pop({y}) * count(*)) END AS r2,
  sqrt(sum({e} * {e}) / count(*)) AS rmse, avg(abs({e})) AS mae, sum({e} * {e}) AS sse,
  var_pop({y}) * count(*) AS sst, stddev_pop({y}) AS y_sd, median(pow(10, abs({e}))) AS median_fold_error,
  avg(pow(10, abs({e}))) AS mean_fold_error,
  100 * avg(CAST(abs({e}) <= log10(2) AS DOUBLE)) AS within_2_fold_percent,
  100 * avg(CAST(abs({e}) <= log10(5) AS DOUBLE)) AS within_5_fold_percent,
  100 * avg(CAST(abs({e}) <= 1 AS DOUBLE)) AS within_10_fold_percent
FROM {source}{group}"""


METRIC_NAMES = [
    "r2", "rmse", "mae", "sse", "sst", "y_sd", "median_fold_error", "mean_fold_error",
    "within_2_fold_percent", "within_5_fold_percent", "within_10_fold_percent",
]


def metric_query(ctes: str, source: str, by: Sequence[str], y: str = "y", pred: str = "pred") -> str:
    keys = "".join(f"{b}, " for b in by)
    return f"WITH {ctes}, mm AS ({metric_sql(source, by, y, pred)}) SELECT {keys}n, {rs(METRIC_NAMES)} FROM mm"


# --- token bits -----------------------------------------------------------------


def prints(spark: SparkSession, d: str, width: int = 2048) -> DataFrame:
    return bit_sets(documents(spark, d), "doc_id", "text", width)


def query_and_reference(spark: SparkSession, d: str, width: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Unlabelled documents against labelled ones."""
    p = materialize(prints(spark, d, width), "prints")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id")
    return p.join(labels, "doc_id", "left_anti"), p.join(labels, "doc_id", "left_semi")


SQL_BITS = r"""tok AS (SELECT doc_id, unnest(regexp_split_to_array(trim(text), '\s+')) AS w FROM documents),
vocab AS (SELECT w, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 2048 AS INTEGER) AS bit FROM (SELECT DISTINCT w FROM tok)),
bits AS (SELECT DISTINCT tok.doc_id, bit FROM tok JOIN vocab USING (w)),
sz AS (SELECT doc_id, count(*) AS n FROM bits GROUP BY doc_id),
q AS (SELECT bits.* FROM bits WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
rr AS (SELECT bits.* FROM bits WHERE doc_id IN (SELECT doc_id FROM labels)),
common AS (SELECT q.doc_id AS qid, rr.doc_id AS rid, count(*) AS c FROM q JOIN rr USING (bit) GROUP BY ALL),
sims AS (SELECT qid, rid, c / CAST(a.n + b.n - c AS DOUBLE) AS s FROM common
         JOIN sz a ON a.doc_id = qid JOIN sz b ON b.doc_id = rid)"""


# --- least squares on two features in SQL ---------------------------------------

_SUMS = {
    "n": "count(*)", "s1": "sum(log_words)", "s2": "sum(upper_share)", "sy": "sum(y)",
    "s11": "sum(log_words * log_words)", "s22": "sum(upper_share * upper_share)",
    "s12": "sum(log_words * upper_share)", "s1y": "sum(log_words * y)", "s2y": "sum(upper_share * y)",
}


def sums_sql(source: str, by: Sequence[str]) -> str:
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"SELECT {keys}{', '.join(f'{e} AS {k}' for k, e in _SUMS.items())} FROM {source}{group}"


def leave_out_sql(source: str, by: Sequence[str], part: str) -> str:
    over = f"PARTITION BY {', '.join(by)}" if by else ""
    keys = "".join(f"{b}, " for b in [*by, part])
    return f"SELECT {keys}{', '.join(f'sum({k}) OVER ({over}) - {k} AS {k}' for k in _SUMS)} FROM {source}"


def solve_sql(source: str, by: Sequence[str]) -> str:
    keys = "".join(f"{b}, " for b in by)
    return f"""SELECT {keys}b1, b2, (sy - b1 * s1 - b2 * s2) / n AS b0, s1 / n AS m1, s2 / n AS m2, sy / n AS my FROM (
  SELECT *, ((s1y - s1*sy/n) * (s22 - s2*s2/n) - (s2y - s2*sy/n) * (s12 - s1*s2/n))
            / ((s11 - s1*s1/n) * (s22 - s2*s2/n) - pow(s12 - s1*s2/n, 2)) AS b1,
            ((s2y - s2*sy/n) * (s11 - s1*s1/n) - (s1y - s1*sy/n) * (s12 - s1*s2/n))
            / ((s11 - s1*s1/n) * (s22 - s2*s2/n) - pow(s12 - s1*s2/n, 2)) AS b2
  FROM {source})"""


def oof_sql(rows: str, by: Sequence[str], fold: str, prefix: str) -> str:
    """CTEs ``{prefix}_oof``: ``rows`` with the out-of-fold prediction ``pred``."""
    keys = [*by, fold]
    on = " AND ".join(f"x.{k} = c.{k}" for k in keys)
    return f"""{prefix}_s AS ({sums_sql(rows, keys)}),
{prefix}_l AS ({leave_out_sql(prefix + '_s', by, fold)}),
{prefix}_c AS ({solve_sql(prefix + '_l', keys)}),
{prefix}_oof AS (SELECT x.*, b0 + b1 * log_words + b2 * upper_share AS pred FROM {rows} x JOIN {prefix}_c c ON {on})"""


def kfold_sql(rows: str, id_col: str, k: int, seed: str, by: Sequence[str] = (), out: str = "fold") -> str:
    over = f"PARTITION BY {', '.join(by)} " if by else ""
    return (
        f"SELECT *, CAST(ntile({k}) OVER ({over}ORDER BY md5({id_col} || '|' || ({seed})), {id_col}) AS INTEGER)"
        f" AS {out} FROM {rows}"
    )


def holdout_sql(rows: str, id_col: str, fraction: float, seed: str, by: str = "") -> str:
    over = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, CASE WHEN row_number() OVER ({over} ORDER BY md5({id_col} || '|' || ({seed})), {id_col})
      <= ceil({fraction}::DOUBLE * count(*) OVER ({over})) THEN 'valid' ELSE 'train' END AS part FROM {rows}"""


def seeded_folds_sql(sizes: str, k: int, seed: int, name: str) -> str:
    """Greedy folds of groups, a step a group; of the emptiest folds the one with the smallest draw.

    ``sizes`` gives ``grp, size``. The result is ``{name}_step(k, grp, fold, tot)``, with a first row of ``k = 0``.
    """
    prime = splits.DRAW_PRIME
    by_seed, by_size, by_level, by_fold, mixed = splits.DRAW_FACTORS
    x = f"(({seed % prime} * {by_seed} + o.size % {prime} * {by_size} + list_min(s.tot) % {prime} * {by_level} + i * {by_fold}) % {prime})"
    y = f"(({x} * {x} % {prime} * {mixed} + i) % {prime})"
    folds = f"range(1, {k + 1})"
    chosen = f"list_sort(list_transform(list_filter({folds}, lambda i: s.tot[i] = list_min(s.tot)), lambda i: {{'d': {y} * {y} % {prime}, 'i': i}}))[1].i"
    return f"""{name}_sizes AS ({sizes}),
{name}_order AS (SELECT *, row_number() OVER (ORDER BY size DESC, md5(coalesce(grp || '|', '') || '{seed}'), grp NULLS FIRST) AS k FROM {name}_sizes),
{name}_step AS (
  SELECT 0::BIGINT AS k, NULL::VARCHAR AS grp, 0 AS fold, {[0] * k}::BIGINT[] AS tot
  UNION ALL
  SELECT k, grp, fold, list_transform({folds}, lambda i: tot[i] + CASE WHEN i = fold THEN size ELSE 0 END)
  FROM (SELECT o.k, o.grp, o.size, s.tot, CAST({chosen} AS INTEGER) AS fold FROM {name}_step s JOIN {name}_order o ON o.k = s.k + 1))"""
