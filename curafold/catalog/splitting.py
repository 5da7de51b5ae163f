"""Queries: fold assignment, group splits, nested ledgers and leakage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from curafold.catalog.base import SEED, events, frame, holdout_sql, kfold_sql, register, r, seeded_folds_sql, SQL_FRAME
from curafold.catalog.curation import SQL_ROUTE, routed
from curafold.operators import contracts, metrics, splits
from curafold.operators.ranking import row_positions
from curafold.session import materialize

EV = "(SELECT event_id, user_id FROM events)"


def ids(spark, d):
    return events(spark, d).select("event_id", "user_id")


@register("k1_kfold", f"SELECT event_id, fold FROM ({kfold_sql(EV, 'event_id', 5, '42')})")
def _(spark, d):
    return splits.kfold(ids(spark, d), "event_id", 5, SEED).select("event_id", "fold")


SQL_NULL_BY = "(SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN user_id % 4 END AS g FROM events)"


def null_by(spark, d):
    return ids(spark, d).select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 4).alias("g"))


@register("k1_kfold_null_groups", f"SELECT event_id, g, fold FROM ({kfold_sql(SQL_NULL_BY, 'event_id', 5, '42', ['g'])})")
def _(spark, d):
    return splits.kfold(null_by(spark, d), "event_id", 5, SEED, ["g"])


@register("k2_holdout_null_groups", f"SELECT event_id, g, part FROM ({holdout_sql(SQL_NULL_BY, 'event_id', 0.1, '42', 'g')})")
def _(spark, d):
    return splits.holdout(null_by(spark, d), "event_id", 0.1, SEED, ["g"])


@register("k2_holdout", f"SELECT event_id, part FROM ({holdout_sql(EV, 'event_id', 0.1, '42')})")
def _(spark, d):
    return splits.holdout(ids(spark, d), "event_id", 0.1, SEED).select("event_id", "part")


def group_of():
    return F.concat(F.lit("u"), F.col("user_id").cast("string"))


GREEDY = """g AS (SELECT 'u' || user_id AS grp, count(*) AS size FROM events GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY size DESC, grp) AS k FROM g),
step AS (
  SELECT 0::BIGINT AS k, NULL::VARCHAR AS grp, 0 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS tot
  UNION ALL
  SELECT o.k, o.grp, CAST(list_position(s.tot, list_min(s.tot)) AS INTEGER),
    list_transform(range(1, 6), lambda i: s.tot[i] + CASE WHEN i = list_position(s.tot, list_min(s.tot)) THEN o.size ELSE 0 END)
  FROM step s JOIN o ON o.k = s.k + 1)"""


@register("k3_group_folds", f"WITH RECURSIVE {GREEDY} SELECT grp AS group_id, fold FROM step WHERE k > 0")
def _(spark, d):
    return splits.group_fold_table(ids(spark, d).select(group_of().alias("group_id")), "group_id", 5)


def greedy_seeded(events: str) -> str:
    sql = seeded_folds_sql(f"SELECT grp, count(*) AS size FROM {events} GROUP BY 1", 5, SEED, "s")
    return f"{sql}, step AS (SELECT k, grp, fold FROM s_step)"


EVENT_GROUPS = "(SELECT event_id, 'u' || user_id AS grp FROM events)"
#: A third of the rows has no group.
NULL_GROUPS = "(SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'u' || user_id END AS grp FROM events)"


def null_groups(spark, d):
    return ids(spark, d).withColumn("group_id", F.when(F.col("event_id") % 3 > 0, group_of()))


@register("k4_group_folds_seeded", f"""WITH RECURSIVE {greedy_seeded(EVENT_GROUPS)}
  SELECT event_id, e.grp AS group_id, fold FROM {EVENT_GROUPS} e JOIN step USING (grp) WHERE k > 0""")
def _(spark, d):
    rows = ids(spark, d).withColumn("group_id", group_of())
    return splits.group_folds_seeded(rows, "group_id", 5, SEED).select("event_id", "group_id", "fold")


@register("k3_group_folds_null_groups", f"""WITH RECURSIVE {GREEDY.replace("SELECT 'u' || user_id AS grp, count(*) AS size FROM events GROUP BY 1", f"SELECT grp, count(*) AS size FROM {NULL_GROUPS} GROUP BY 1").replace("size DESC, grp", "size DESC, grp NULLS FIRST")}
  SELECT event_id, e.grp AS group_id, fold FROM {NULL_GROUPS} e JOIN step ON e.grp IS NOT DISTINCT FROM step.grp WHERE k > 0""")
def _(spark, d):
    return splits.group_folds(null_groups(spark, d), "group_id", 5).select("event_id", "group_id", "fold")


@register("k4_group_folds_seeded_null_groups", f"""WITH RECURSIVE {greedy_seeded(NULL_GROUPS)}
  SELECT event_id, e.grp AS group_id, fold FROM {NULL_GROUPS} e JOIN step ON e.grp IS NOT DISTINCT FROM step.grp WHERE k > 0""")
def _(spark, d):
    return splits.group_folds_seeded(null_groups(spark, d), "group_id", 5, SEED).select("event_id", "group_id", "fold")


@register("k5_group_holdout_null_groups", f"""WITH h AS ({holdout_sql(f"(SELECT DISTINCT grp FROM {NULL_GROUPS})", 'grp', 0.2, '42')})
  SELECT event_id, part FROM {NULL_GROUPS} e JOIN h ON e.grp IS NOT DISTINCT FROM h.grp""")
def _(spark, d):
    return splits.group_holdout(null_groups(spark, d), "group_id", 0.2, SEED).select("event_id", "part")


@register("k5_group_holdout", f"""WITH h AS ({holdout_sql("(SELECT DISTINCT 'u' || user_id AS grp FROM events)", 'grp', 0.2, '42')})
  SELECT event_id, part FROM events JOIN h ON grp = 'u' || user_id""")
def _(spark, d):
    rows = ids(spark, d).withColumn("group_id", group_of())
    return splits.group_holdout(rows, "group_id", 0.2, SEED).select("event_id", "part")


@register("k6_group_key", """WITH k AS (SELECT doc_id, regexp_extract(text, '[0-9]{2}') AS coarse FROM documents)
  SELECT doc_id, CASE WHEN coarse = '' THEN 'SINGLE::' || doc_id ELSE 'G::' || coarse END AS own_group,
    CASE WHEN coarse = '' THEN 'SHARED::' ELSE 'G::' || coarse END AS shared_group FROM k""")
def _(spark, d):
    from curafold.catalog.base import documents

    coarse = F.regexp_extract("text", "[0-9]{2}", 0)
    return documents(spark, d).select(
        "doc_id",
        splits.group_key(coarse, F.col("doc_id"), "singleton").alias("own_group"),
        splits.group_key(coarse, F.col("doc_id"), "shared").alias("shared_group"),
    )


LEDGER = f"""o AS ({kfold_sql(EV, 'event_id', 3, '42')}),
x AS (SELECT event_id, fold, f AS outer_fold FROM o, (VALUES (1), (2), (3)) v(f)),
inn AS ({kfold_sql('(SELECT event_id, outer_fold FROM x WHERE outer_fold <> fold)', 'event_id', 3, '42 + 1000 * outer_fold', ['outer_fold'], 'own')}),
ex AS (SELECT event_id, outer_fold, own, j AS inner_fold FROM inn, (VALUES (1), (2), (3)) v(j)),
pil AS ({holdout_sql('(SELECT * FROM ex WHERE own <> inner_fold)', 'event_id', 0.1, '42 + 10000 * outer_fold + inner_fold', 'outer_fold, inner_fold')}),
ledger AS (SELECT outer_fold, 0 AS inner_fold, 'test' AS role, event_id FROM x WHERE outer_fold = fold
  UNION ALL SELECT outer_fold, inner_fold, 'oof_prediction', event_id FROM ex WHERE own = inner_fold
  UNION ALL SELECT outer_fold, inner_fold, 'pilot_' || part, event_id FROM pil)"""


def ledger(spark, d):
    return splits.nested_ledger(ids(spark, d).select("event_id"), "event_id", 3, 3, 0.1, SEED)


@register("k7_nested_ledger", f"WITH {LEDGER} SELECT * FROM ledger")
def _(spark, d):
    return ledger(spark, d)


def leak(name: str, sql: str, detail: str) -> str:
    return f"""SELECT '{name}' AS "check", CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, n AS n_bad, '{detail}' AS detail FROM ({sql})"""


@register("k8_leakage_report", f"WITH {LEDGER} " + " UNION ALL ".join([
    leak("outer_test_untouched", "SELECT count(*) AS n FROM (SELECT 1 FROM ledger GROUP BY outer_fold, event_id HAVING bool_or(role = 'test') AND bool_or(role <> 'test'))", "outer test rows used in screening"),
    leak("inner_prediction_once", "SELECT count(*) AS n FROM (SELECT 1 FROM ledger WHERE role <> 'test' GROUP BY outer_fold, event_id HAVING count(*) FILTER (role = 'oof_prediction') <> 1)", "outer train rows not predicted exactly once"),
    leak("inner_role_single", "SELECT count(*) AS n FROM (SELECT 1 FROM ledger WHERE role <> 'test' GROUP BY outer_fold, inner_fold, event_id HAVING count(*) <> 1)", "rows with several roles"),
    leak("outer_test_once", "SELECT count(*) AS n FROM (SELECT 1 FROM ledger WHERE role = 'test' GROUP BY event_id HAVING count(*) <> 1)", "rows tested more than once"),
    leak("group_isolated", """SELECT count(*) AS n FROM (SELECT 1 FROM ledger JOIN events USING (event_id) GROUP BY outer_fold, user_id
       HAVING bool_or(role = 'test') AND bool_or(role <> 'test'))""", "groups on both sides of an outer split"),
]))
def _(spark, d):
    groups = ids(spark, d).select("event_id", F.col("user_id").alias("group_id"))
    written = materialize(ledger(spark, d), "ledger")
    return splits.leakage_report(written, "event_id", groups)


@register("a9_group_census", f"""WITH a AS ({kfold_sql(EV, 'event_id', 5, '42')}), s AS (SELECT fold, user_id, count(*) AS c FROM a GROUP BY ALL),
  t AS (SELECT user_id, sum(c) AS c FROM s GROUP BY ALL)
  SELECT fold, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_groups, count(*) FILTER (c = 1) AS n_singletons FROM s GROUP BY fold
  UNION ALL SELECT NULL, CAST(sum(c) AS BIGINT), count(*), count(*) FILTER (c = 1) FROM t""")
def _(spark, d):
    assigned = splits.kfold(ids(spark, d), "event_id", 5, SEED).withColumnRenamed("user_id", "group_id")
    return metrics.group_census(assigned)


SQL_ROLES = SQL_ROUTE + f""",
parts AS ({holdout_sql("(SELECT entity FROM routed WHERE route = 'pool' AND y <= 3.3)", 'entity', 0.1, '42')}),
roles AS (SELECT r.entity, CASE WHEN route = 'holdout' THEN 'external' WHEN route <> 'pool' THEN 'unused'
    WHEN r.y > 3.3 THEN 'excluded' WHEN p.part = 'valid' THEN 'valid' ELSE 'train' END AS role
  FROM routed r LEFT JOIN parts p ON p.entity = r.entity)"""


def routed_table(spark, d):
    """Routed entities as a written table: roles, positions and the selection all read them."""
    return materialize(routed(spark, d).select("entity", "route", "y"), "routed")


def roles(ents):
    excluded = F.coalesce(F.col("y") > 3.3, F.lit(False))
    pool = ents.where((F.col("route") == "pool") & ~excluded).select("entity")
    parts = splits.holdout(pool, "entity", 0.1, SEED)
    return splits.role_table(ents.join(parts, "entity", "left"), "entity", F.col("route"), excluded, F.col("part"))


@register("k9_role_table", f"WITH {SQL_ROLES} SELECT entity, role FROM roles")
def _(spark, d):
    return roles(routed_table(spark, d))


@register("f10_select_by_role", f"""WITH {SQL_ROLES} SELECT entity, {r('y')}, row_number() OVER (PARTITION BY role ORDER BY entity) - 1 AS partition_row_order
  FROM roles JOIN routed USING (entity) WHERE role = 'train'""")
def _(spark, d):
    table = routed_table(spark, d)
    ordered = row_positions(roles(table), "entity", ["role"], "partition_row_order")
    return splits.select_by_role(ordered, table.select("entity", "y"), "entity", "train", "partition_row_order")


@register("q10_selection_matches_rule", f"""WITH {SQL_FRAME}, a AS ({kfold_sql('frame', 'id', 3, '42')}),
  want AS (SELECT fold, id FROM a WHERE y < 2.2), have AS (SELECT fold, id FROM a WHERE y < 2.15),
  j AS (SELECT want.fold, have.id IS NULL AS bad FROM want LEFT JOIN have ON want.fold = have.fold AND want.id = have.id)
  SELECT fold, count(*) AS n_rows, count(*) FILTER (bad) AS n_bad, CASE WHEN count(*) FILTER (bad) = 0 THEN 'pass' ELSE 'fail' END AS status FROM j GROUP BY fold""")
def _(spark, d):
    a = splits.kfold(frame(spark, d).select("id", "y"), "id", 3, SEED)
    return contracts.selection_matches_rule(a.where(F.col("y") < 2.15), a, F.col("y") < 2.2, ["fold"], "id")
