"""Reproducible fold assignment, nested split ledgers and leakage reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curafold.operators.ranking import hash_rank, join_on, row_positions
from curafold.operators.setops import check_row, union_partitions
from curafold.session import materialize

# How the split seed is varied per outer fold and per pilot split.
OUTER_SEED_STEP = 1000
PILOT_SEED_STEP = 10000


def _fold_of_rank(rank: Column, n: Column, k: int) -> Column:
    """Contiguous folds of ``n`` ranks; the first ``n mod k`` folds hold one more."""
    small = F.floor(n / k)
    larger = n % k
    cut = larger * (small + 1)
    pos = rank - 1
    return (
        F.when(pos < cut, F.floor(pos / (small + 1)))
        .otherwise(larger + F.floor((pos - cut) / F.greatest(small, F.lit(1))))
        .cast("int")
        + 1
    )


def kfold(
    df: DataFrame,
    id_col: str,
    k: int,
    seed: int | Column,
    by: Sequence[str] = (),
    out: str = "fold",
) -> DataFrame:
    """Shuffled k folds with sizes differing by at most one, per ``by`` group."""
    ranked = hash_rank(df, id_col, seed, by, "__rank", "__size")
    return ranked.withColumn(out, _fold_of_rank(F.col("__rank"), F.col("__size"), k)).drop(
        "__rank", "__size"
    )


def holdout(
    df: DataFrame,
    id_col: str,
    fraction: float,
    seed: int | Column,
    by: Sequence[str] = (),
    out: str = "part",
) -> DataFrame:
    """``valid`` for ``ceil(fraction * n)`` rows in hash order, ``train`` for the rest."""
    ranked = hash_rank(df, id_col, seed, by, "__rank", "__size")
    chosen = F.col("__rank") <= F.ceil(F.col("__size") * F.lit(fraction))
    return ranked.withColumn(
        out, F.when(chosen, F.lit("valid")).otherwise(F.lit("train"))
    ).drop("__rank", "__size")


# The modulus and factors of the draw among equally full folds.
DRAW_PRIME = 2147483647
DRAW_FACTORS = (48271, 69621, 16807, 1140671485, 39373)


def _draws(seed, size, level, k: int):
    """A number for each fold; of equally full folds the one with the smallest is served first.

    Whole-number arithmetic below 64 bits, so SQL can state it as well.
    """
    import numpy as np

    by_seed, by_size, by_level, by_fold, mixed = DRAW_FACTORS
    fold = np.arange(1, k + 1, dtype=np.int64)
    x = (seed % DRAW_PRIME * by_seed + size % DRAW_PRIME * by_size + level % DRAW_PRIME * by_level)[:, None] + fold * by_fold
    x = x % DRAW_PRIME
    x = (x * x % DRAW_PRIME * mixed + fold) % DRAW_PRIME
    return x * x % DRAW_PRIME


def _deal_functions(seed: int | None):
    """Closed form of "give the next equal-sized group to the smallest fold".

    With totals T and size s, fold f receives its groups at levels T_f, T_f+s, …; the
    r-th group goes to the fold owning the r-th smallest (level, fold) pair. With a seed, the
    folds of one level are served in an order drawn for that size and level.
    """
    import numpy as np

    def level_of(rank, size, totals):
        low = totals.min(axis=1) - 1
        high = low + 1 + (rank - 1) * size
        while (low + 1 < high).any():
            mid = (low + high) // 2
            steps = np.where(mid[:, None] >= totals, (mid[:, None] - totals) // size[:, None] + 1, 0)
            enough = steps.sum(axis=1) >= rank
            high = np.where(enough, mid, high)
            low = np.where(enough, low, mid)
        before = np.where(
            high[:, None] - 1 >= totals, (high[:, None] - 1 - totals) // size[:, None] + 1, 0
        )
        at_level = (high[:, None] >= totals) & ((high[:, None] - totals) % size[:, None] == 0)
        turn = np.broadcast_to(np.arange(totals.shape[1]), totals.shape)
        if seed is not None:
            turn = _draws(np.int64(seed), size, high, totals.shape[1])
        served = np.argsort(np.where(at_level, turn, DRAW_PRIME), axis=1, kind="stable")
        return before, served, rank - before.sum(axis=1)

    def fold_of(rank, size, totals):
        _, served, nth = level_of(rank, size, totals)
        return served[np.arange(len(rank)), nth - 1] + 1

    def totals_after(count, size, totals):
        before, served, nth = level_of(count, size, totals)
        extra = np.zeros_like(totals)
        np.put_along_axis(extra, served, (np.arange(totals.shape[1]) < nth[:, None]).astype(np.int64), axis=1)
        return totals + (before + extra) * size[:, None]

    return fold_of, totals_after


def _greedy_folds(sizes: DataFrame, group: str, k: int, ranked: DataFrame, seed: int | None) -> DataFrame:
    """Greedy balance over size classes.

    Only the distinct sizes are walked in order. They number at most sqrt(2 N) for N
    rows, however many groups there are; the groups themselves are placed in
    parallel from their rank within the size class.
    """
    import pandas as pd

    fold_of, totals_after = _deal_functions(seed)

    def walk(pdf):
        import numpy as np

        pdf = pdf.sort_values("size", ascending=False)
        totals = np.zeros((1, k), dtype=np.int64)
        seen = []
        for size, count in zip(pdf["size"], pdf["n_groups"]):
            seen.append(totals[0].tolist())
            totals = totals_after(np.array([count]), np.array([size]), totals)
        return pdf[["size"]].assign(totals=seen)

    def place(rank, size, totals):
        import numpy as np

        folds = fold_of(
            rank.to_numpy(np.int64), size.to_numpy(np.int64), np.stack(totals.to_numpy()).astype(np.int64)
        )
        return pd.Series(folds.astype(np.int32))

    place.__annotations__ = {
        "rank": pd.Series, "size": pd.Series, "totals": pd.Series, "return": pd.Series
    }
    classes = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))
    starts = classes.groupBy(F.lit(0).alias("__one")).applyInPandas(
        walk, "size long, totals array<long>"
    )
    fold = F.pandas_udf(place, "int")
    return (
        ranked.join(starts, "size")
        .select(group, (F.col("__pos") + 1).alias("__r"), "size", "totals")
        .select(group, fold("__r", "size", "totals").alias("fold"))
    )


def _group_sizes(df: DataFrame, group: str, k: int) -> DataFrame:
    """Rows per group; fewer groups than folds would leave a fold empty and are refused."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    if sizes.limit(k).count() < k:
        raise ValueError(f"fewer than {k} groups in {group}")
    return sizes


def group_fold_table(df: DataFrame, group: str, k: int) -> DataFrame:
    """``(group, fold)``: groups by (−size, key), each to the smallest, lowest fold."""
    sizes = _group_sizes(df, group, k)
    ranked = row_positions(sizes, group, ["size"], "__pos")
    return _greedy_folds(sizes, group, k, ranked, None)


def group_folds(df: DataFrame, group: str, k: int, out: str = "fold") -> DataFrame:
    """Whole groups into ``k`` balanced folds, deterministic; NULL is a group."""
    table = group_fold_table(df, group, k).withColumnRenamed("fold", out)
    return join_on(df, table, [group])


def group_folds_seeded(df: DataFrame, group: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """Like :func:`group_folds` with chance among equals: groups of one size come in a seeded order, and
    equally full folds are served in an order drawn anew for each size and filling.
    """
    sizes = _group_sizes(df, group, k)
    ranked = hash_rank(sizes, group, seed, ["size"], "__rank", "__size").select(
        group, "size", (F.col("__rank") - 1).alias("__pos")
    )
    table = _greedy_folds(sizes, group, k, ranked, seed).withColumnRenamed("fold", out)
    return join_on(df, table, [group])


def group_holdout(
    df: DataFrame, group: str, fraction: float, seed: int, out: str = "part"
) -> DataFrame:
    """Whole groups to ``valid`` until ``ceil(fraction * groups)`` groups are chosen; NULL is a group."""
    table = holdout(df.select(group).distinct(), group, fraction, seed, out=out)
    return join_on(df, table, [group])


def group_key(coarse: Column, id_col: Column, empty: str = "singleton") -> Column:
    """Group label from a coarse key; an empty key is its own group or one shared group."""
    blank = F.coalesce(coarse == "", F.lit(True))
    if empty == "singleton":
        alone = F.concat(F.lit("SINGLE::"), id_col.cast("string"))
    elif empty == "shared":
        alone = F.lit("SHARED::")
    else:
        raise ValueError("empty must be 'singleton' or 'shared'")
    return F.when(blank, alone).otherwise(F.concat(F.lit("G::"), coarse))


def outer_expanded(
    assigned: DataFrame, id_col: str, outer_k: int, own: str = "fold"
) -> DataFrame:
    """Each row once per outer fold, with ``is_test`` where it is that fold's test row."""
    return assigned.withColumn("outer_fold", F.explode(F.sequence(F.lit(1), F.lit(outer_k)))).withColumn(
        "is_test", F.col("outer_fold") == F.col(own)
    )


def inner_folds(
    assigned: DataFrame, id_col: str, outer_k: int, inner_k: int, seed: int, own: str = "fold"
) -> DataFrame:
    """Outer-train rows of every outer fold with their inner fold (salted per outer fold)."""
    train = outer_expanded(assigned, id_col, outer_k, own).where(~F.col("is_test")).drop("is_test")
    salted = F.lit(seed) + F.lit(OUTER_SEED_STEP) * F.col("outer_fold")
    return kfold(train, id_col, inner_k, salted, ["outer_fold"], "inner_fold")


def nested_ledger(
    df: DataFrame,
    id_col: str,
    outer_k: int,
    inner_k: int,
    pilot_fraction: float,
    seed: int,
    assigned: DataFrame | None = None,
) -> DataFrame:
    """All roles of a nested split in one table ``(outer_fold, inner_fold, role, id)``.

    Roles: ``test`` (inner_fold 0), ``oof_prediction``, ``pilot_train``, ``pilot_valid``;
    the last two together are that inner fold's training rows. ``assigned`` may bring
    outer folds (for example group folds) in a column ``fold``.
    """
    base = assigned if assigned is not None else kfold(df.select(id_col), id_col, outer_k, seed)
    # Each ranking reads its input twice, so stacked rankings would repeat the work of
    # the earlier ones; the narrow id tables are written between the stages.
    base = materialize(base.select(id_col, "fold"), "outer-folds")
    test = base.select(
        F.col("fold").alias("outer_fold"), F.lit(0).alias("inner_fold"), F.lit("test").alias("role"), id_col
    )
    inner = materialize(inner_folds(base, id_col, outer_k, inner_k, seed), "inner-folds")
    inner = inner.withColumnRenamed("inner_fold", "__own")
    every = inner.withColumn("inner_fold", F.explode(F.sequence(F.lit(1), F.lit(inner_k))))
    scored = every.where(F.col("__own") == F.col("inner_fold")).select(
        "outer_fold", "inner_fold", F.lit("oof_prediction").alias("role"), id_col
    )
    pilot_seed = (
        F.lit(seed) + F.lit(PILOT_SEED_STEP) * F.col("outer_fold") + F.col("inner_fold")
    )
    pilot = holdout(
        every.where(F.col("__own") != F.col("inner_fold")),
        id_col,
        pilot_fraction,
        pilot_seed,
        ["outer_fold", "inner_fold"],
    ).select("outer_fold", "inner_fold", F.concat(F.lit("pilot_"), "part").alias("role"), id_col)
    return union_partitions(test, scored, pilot)


def leakage_report(ledger: DataFrame, id_col: str, groups: DataFrame | None = None) -> DataFrame:
    """Contract rows for a split ledger; ``groups`` is ``(id, group_id)``."""
    is_test = F.col("role") == "test"
    per_outer = ledger.groupBy("outer_fold", id_col).agg(
        F.count_if(is_test).alias("n_test"),
        F.count_if(~is_test).alias("n_train"),
        F.count_if(F.col("role") == "oof_prediction").alias("n_pred"),
    )
    per_inner = (
        ledger.where(~is_test)
        .groupBy("outer_fold", "inner_fold", id_col)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    tests = ledger.where(is_test).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    checks = [
        check_row(
            "outer_test_untouched",
            per_outer.where((F.col("n_test") > 0) & (F.col("n_train") > 0)),
            "outer test rows used in screening",
        ),
        check_row(
            "inner_prediction_once",
            per_outer.where((F.col("n_test") == 0) & (F.col("n_pred") != 1)),
            "outer train rows not predicted exactly once",
        ),
        check_row("inner_role_single", per_inner.where(F.col("n") != 1), "rows with several roles"),
        check_row("outer_test_once", tests.where(F.col("n") != 1), "rows tested more than once"),
    ]
    if groups is not None:
        per_group = (
            join_on(ledger.select("outer_fold", id_col, "role"), groups, [id_col])
            .groupBy("outer_fold", "group_id")
            .agg(F.bool_or(is_test).alias("in_test"), F.bool_or(~is_test).alias("in_train"))
        )
        checks.append(
            check_row(
                "group_isolated",
                per_group.where(F.col("in_test") & F.col("in_train")),
                "groups on both sides of an outer split",
            )
        )
    return union_partitions(*checks)


def role_table(
    entities: DataFrame, key: str, route: Column, excluded: Column, part: Column
) -> DataFrame:
    """Role of every entity: external, excluded, valid, train or unused."""
    return entities.select(
        key,
        F.when(route == "holdout", F.lit("external"))
        .when(route != "pool", F.lit("unused"))
        .when(excluded, F.lit("excluded"))
        .when(part == "valid", F.lit("valid"))
        .otherwise(F.lit("train"))
        .alias("role"),
    )


def select_by_role(
    roles: DataFrame, table: DataFrame, key: str, role: str, order: str
) -> DataFrame:
    """The table rows of one role, in the role's recorded order."""
    wanted = roles.where(F.col("role") == role).select(key, order)
    return wanted.join(table, key).orderBy(order)
