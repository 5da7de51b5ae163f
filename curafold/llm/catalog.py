"""Registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curafold.llm.anomalies import judge
from curafold.llm.bagminhash import near_duplicate_classes
from curafold.llm.bpe import encode_documents
from curafold.llm.collocations import collocations
from curafold.llm.common import table
from curafold.llm.exact_dedup import mark_duplicates
from curafold.llm.hard_negatives import hard_negatives
from curafold.llm.langid import identify
from curafold.llm.licences import scan, scan_sql
from curafold.llm.mixing import mix
from curafold.llm.pii import find_personal_data
from curafold.llm.quality import score_quality
from curafold.llm.suffix_dedup import remove_repeats
from curafold.llm.vptree import nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    return score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query(r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""")
def op2_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return mark_duplicates(table(spark, d, "documents"))


@query(r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('42|' || doc_id), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM r GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS budget, sum(weight) OVER () AS all_w FROM s),
l AS (
  SELECT *, (budget - (sum(cap) OVER o - cap)) / (all_w - sum(weight) OVER o + weight) AS level
  FROM c WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, source_size, CAST(budget AS BIGINT) AS budget, round(least(cap, max(level) OVER () * weight), 6) AS target FROM l),
q AS (
  SELECT r.*, source_size, target, budget, size <= target AND target > 0 AS fits,
         CAST(sum(CASE WHEN size <= target THEN size ELSE 0 END) OVER (PARTITION BY r.source ORDER BY key, size, doc_id) AS BIGINT) AS stop,
         CAST(sum(CASE WHEN size <= target THEN size ELSE 0 END) OVER (PARTITION BY r.source) AS BIGINT) AS pass
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT q.*, n, n * pass + stop AS tokens, (n * pass + stop) / target AS finish
  FROM q, range(3) x(n) WHERE fits AND (size > 0 OR n = 0) AND n * pass + stop - size < target),
v AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, tokens, key, size, doc_id) AS running FROM p),
d AS (SELECT doc_id, count(*) AS copies FROM v WHERE running <= budget AND (tokens <= target OR 2 * tokens - size <= 2 * target) GROUP BY doc_id),
z AS (SELECT q.*, coalesce(copies, 0) AS copies FROM q LEFT JOIN d USING (doc_id)),
g AS (SELECT source, any_value(target) - sum(copies * size) AS gap FROM z GROUP BY source),
w AS (
  SELECT z.source, doc_id, size, row_number() OVER (PARTITION BY z.source ORDER BY n, key, size, doc_id) AS place
  FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source, range(3) x(n) WHERE n >= copies AND size > 0 AND size <= gap),
walk AS (
  SELECT source, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS doc_id, gap FROM g
  UNION ALL
  SELECT w.source, w.place, CASE WHEN size <= gap THEN w.doc_id END, CASE WHEN size <= gap THEN gap - size ELSE gap END
  FROM walk JOIN w ON w.source IS NOT DISTINCT FROM walk.source AND w.place = walk.place + 1),
e AS (SELECT doc_id, count(*) AS extra FROM walk WHERE doc_id IS NOT NULL GROUP BY doc_id),
y AS (SELECT z.*, copies + coalesce(extra, 0) AS most FROM z LEFT JOIN e USING (doc_id)),
h AS (SELECT source, arg_max(gap, place) AS gap FROM walk GROUP BY source),
f AS (
  SELECT arg_min(doc_id, (size, most, key, doc_id)) AS doc_id
  FROM y JOIN h ON y.source IS NOT DISTINCT FROM h.source
  WHERE most < 3 AND size > 0 AND size < 2 * gap GROUP BY y.source)
SELECT doc_id, size, source_size, target, CAST(size * (most + (doc_id IN (FROM f))::INT) AS BIGINT) AS taken,
       CAST(most + (doc_id IN (FROM f))::INT AS INTEGER) AS copies
FROM y""")
def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"))


@query("""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, len(x) // 2 AS n_bytes FROM d),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(n_bytes - 49)) AS p FROM n WHERE n_bytes >= 50)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS low FROM w) WHERE low < doc_id),
edge AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hit),
span AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge),
run AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM span GROUP BY doc_id, k),
piece AS (SELECT run.doc_id, k, substr(x, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS kept, a, b, x
          FROM run JOIN n USING (doc_id) WINDOW o AS (PARTITION BY run.doc_id ORDER BY k)),
done AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY k) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM piece GROUP BY doc_id)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM n LEFT JOIN done USING (doc_id)""")
def op4_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return remove_repeats(table(spark, d, "documents"))


@query(scan_sql())
def op5_licences(spark: SparkSession, d: str) -> DataFrame:
    return scan(table(spark, d, "documents"))


@query()
def op6_personal_data(spark: SparkSession, d: str) -> DataFrame:
    return find_personal_data(table(spark, d, "documents"))


@query(r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS rep, count(*) AS copies FROM documents GROUP BY 1),
w AS (SELECT rep, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (SELECT rep, array_to_string(w[i : i + 4], ' ') AS shingle FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
u AS (SELECT rep, shingle, row_number() OVER (PARTITION BY rep, shingle) AS j FROM s),
n AS (SELECT rep, count(*) AS n FROM u GROUP BY rep),
c AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM u a JOIN u b USING (shingle, j) WHERE a.rep < b.rep GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.rep = x JOIN n b ON b.rep = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-6),
link AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
k AS (SELECT t.text, rep, copies, min(y) AS low FROM t LEFT JOIN reach ON x = rep GROUP BY ALL),
z AS (SELECT *, CAST(sum(copies) OVER (PARTITION BY class_id) AS BIGINT) AS class_size FROM (SELECT text, copies, least(rep, coalesce(low, rep)) AS class_id FROM k))
SELECT doc_id, class_id, class_size FROM documents d JOIN z ON z.text = coalesce(d.text, '')""")
def op7_bagminhash(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_classes(table(spark, d, "documents"))


@query()
def op8_bpe(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"), TOKENIZER)


@query()
def op9_langid(spark: SparkSession, d: str) -> DataFrame:
    return identify(table(spark, d, "documents"))


@query("""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5""")
def op10_vptree(spark: SparkSession, d: str) -> DataFrame:
    return nearest(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


@query(r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
inner_ AS (
  SELECT lang, phrase, max(f) AS most
  FROM (SELECT lang, f, array_to_string(w[i : i + m - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) t(m) WHERE m < k))
  GROUP BY ALL),
cut AS (
  SELECT lang, array_to_string(w, ' ') AS phrase, f AS a, k, x, array_to_string(w[1 : x], ' ') AS head, array_to_string(w[x + 1 : k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS x FROM c)),
s AS (
  SELECT lang, cut.phrase, a, x, h.f AS l, t.f AS r, n,
         CAST((1000::HUGEINT * a::HUGEINT * n::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT) AS BIGINT) AS score
  FROM cut JOIN n USING (lang) JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f t ON t.lang = cut.lang AND t.phrase = tail
  LEFT JOIN inner_ i ON i.lang = cut.lang AND i.phrase = cut.phrase
  WHERE most IS NULL OR 100 * most < 100 * a),
weak AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weak QUALIFY rank <= 2000""")
def op11_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations(table(spark, d, "documents"))


@query("""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.e, c.e)]) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s
  WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""")
def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query()
def op13_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return judge(table(spark, d, "documents"), table(spark, d, "labels"))
