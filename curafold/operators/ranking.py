"""Exact ranks, positions and medians that survive a hot group.

Spark's ``median`` keeps every distinct value of a group in one task, and a window
over a whole group sorts that group in one task. Both fail when one key holds a
third of all rows. Here a group's order is dealt out instead: by ranges of the rows
themselves (``running_in_order``), by leading digits of a hash (``hash_rank``), or by
brackets of a sketch around the middle (``exact_median``). NULL is a group like any other, and
no row is lost.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curafold.session import join_parameters, materialize

# The sketch of a group errs by one rank in so many; the bracket around the middle is wider than that.
SKETCH_ACCURACY = 10_000
BRACKET = 5 / SKETCH_ACCURACY
# Groups of up to so many rows (about 1 MB of values with their counts) are sorted as a whole.
SMALL_GROUP = 20_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating NULL as a value, keeping one copy of the keys.

    ``full_outer_coalesced`` is a full outer join whose keys come from either side. Internal columns (leading ``__``) are never NULL and use plain equality.
    """
    if not keys:
        raise ValueError("join_on needs at least one key")
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    cond = F.lit(True)
    for k in keys:
        l, r = F.col(k), F.col(f"__r_{k}")
        cond = cond & (l == r if k.startswith("__") else l.eqNullSafe(r))
    if how == "full_outer_coalesced":
        joined = left.withColumn("__left", F.lit(True)).join(renamed, cond, "full_outer")
        from_left = F.col("__left").isNotNull()
        either = {k: F.when(from_left, F.col(k)).otherwise(F.col(f"__r_{k}")) for k in keys}
        return joined.withColumns(either).drop("__left", *[f"__r_{k}" for k in keys])
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def _group(by: Sequence[str]) -> Column:
    """The group as one value that is never NULL itself, so NULL keys join like others."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def _running_before(total: str, by: Sequence[str], order: Sequence[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(w), F.lit(0))


def running_in_order(
    df: DataFrame, by: Sequence[str], order: Sequence[str], before: str, total: str, weight: str | None = None
) -> DataFrame:
    """Per row the weight (or number) of the rows before it in its group, and of the whole group.

    Rows are dealt out by ranges that Spark samples from them, so any distribution of keys gives
    even partitions; a hash of the row splits runs of equal keys. Only sums per partition
    and group are windowed together. The dealt rows are written once, since both uses must see the
    same ranges.
    """
    named = df.withColumns({"__by": _group(by), "__tie": F.xxhash64(*df.columns)})
    ranged = named.repartitionByRange("__by", *order, "__tie").withColumn("__part", F.spark_partition_id())
    rows = materialize(ranged.withColumn("__w", F.lit(1).cast("long") if weight is None else F.col(weight)), "ranges")
    parts = rows.groupBy("__by", "__part").agg(F.sum("__w").alias("__sum"))
    offsets = parts.select(
        "__by",
        "__part",
        _running_before("__sum", ["__by"], ["__part"]).alias("__start"),
        F.sum("__sum").over(Window.partitionBy("__by")).alias(total),
    )
    inside = _running_before("__w", ["__by", "__part"], [*order, "__tie"])
    return (
        rows.withColumn("__inside", inside)
        .join(offsets, ["__by", "__part"])
        .withColumn(before, F.col("__start") + F.col("__inside"))
        .drop("__by", "__tie", "__part", "__w", "__inside", "__start")
    )


def rank_in_cells(
    df: DataFrame, by: Sequence[str], cell: Column, order: Sequence[Column], rank: str, size: str
) -> DataFrame:
    """Exact 1-based ``row_number`` per ``by``-group plus the group size.

    ``cell`` must be non-decreasing along ``order`` and spread the rows evenly. Only the
    per-cell counts are seen by the prefix sum; the rows are numbered cell by cell.
    """
    celled = df.withColumns({"__by": _group(by), "__cell": cell})
    keys = ["__by", "__cell"]
    counts = celled.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *keys,
        _running_before("__n", ["__by"], ["__cell"]).alias("__before"),
        F.sum("__n").over(Window.partitionBy("__by")).alias(size),
    )
    numbered = celled.withColumn(
        "__pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return (
        numbered.join(offsets, keys)
        .withColumn(rank, F.col("__before") + F.col("__pos"))
        .drop("__by", "__cell", "__pos", "__before")
    )


def hash_rank(
    df: DataFrame,
    id_col: str,
    seed: int | Column,
    by: Sequence[str] = (),
    rank: str = "rank",
    size: str = "group_n",
    digits: int = 4,
) -> DataFrame:
    """Rank by ``md5(id|seed)``: a reproducible shuffle, numbered without a global sort.

    The cell is the leading ``digits`` hex digits of the hash, so cells are equally
    full whatever the ids are. NULL ids are hashed like an empty text.
    """
    seed_col = F.lit(seed) if isinstance(seed, int) else seed
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), seed_col.cast("string")))
    hashed = df.withColumn("__h", key)
    cell = F.conv(F.substring("__h", 1, digits), 16, 10).cast("int")
    return rank_in_cells(
        hashed, by, cell, [F.col("__h"), F.col(id_col)], rank, size
    ).drop("__h")


def row_positions(
    df: DataFrame, key: str, by: Sequence[str] = (), out: str = "row_id", size: str | None = None
) -> DataFrame:
    """Zero-based position in ascending ``key`` order, per ``by``-group; NULL keys come first."""
    placed = running_in_order(df, by, [key], out, "__size")
    return placed.drop("__size") if size is None else placed.withColumnRenamed("__size", size)


def _value_counts(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values per group with their multiplicity; spread over (group, value)."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("__v"))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__c"))
    )


def exact_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Interpolated median per group; one row per group with a value. For few groups of many rows.

    A pass makes a mergeable quantile sketch of each group, which brackets the middle; another counts the rows below
    the bracket and keeps the distinct values inside, a few in ten thousand. Only these are put in order. NaN
    counts as the largest value; the middle of opposite infinities is NaN.
    """
    rows = df.where(F.col(value).isNotNull()).select(_group(by).alias("group"), F.col(value).cast("double").alias("__v"))
    # For the bracket NaN is as good as infinity, which it follows.
    rows = rows.withColumn("__w", F.when(F.isnan("__v"), F.lit(float("inf"))).otherwise(F.col("__v")))
    sketch = F.percentile_approx("__w", [0.5 - BRACKET, 0.5 + BRACKET], SKETCH_ACCURACY)
    brackets = rows.groupBy("group").agg(sketch.alias("__s"), F.count("*").alias("__n"))
    brackets = brackets.select("group", "__n", F.col("__s")[0].alias("__low"), F.col("__s")[1].alias("__high"))
    near = join_parameters(rows, brackets, ["group"], "median-brackets").where(F.col("__w") <= F.col("__high"))
    inside = F.when(F.col("__w") >= F.col("__low"), F.col("__v"))
    # All rows below are one entry, NULL, which comes first in the order.
    counts = near.groupBy("group", inside.alias("__v")).agg(F.count("*").alias("__c"), F.any_value("__n").alias("__n"))
    placed = running_in_order(counts, ["group"], ["__v"], "__before", "__size", "__c")
    upto = F.col("__before") + F.col("__c")
    lower, upper = F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)
    halves = [F.max(F.when((F.col("__before") < at) & (at <= upto), F.col("__v") / 2)) for at in (lower, upper)]
    middle = placed.groupBy("group").agg((halves[0] + halves[1]).alias(out))
    missed = F.raise_error(F.lit("the bracket of a median misses it")).cast("double")
    return middle.select(*[F.col("group")[b].alias(b) for b in by], F.coalesce(out, missed).alias(out))


def _median_in_order(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Medians from the distinct values of each group with their counts, dealt out in order over all groups together."""
    placed = running_in_order(_value_counts(df, by, value), by, ["__v"], "__before", "__size", "__c")
    upto = F.col("__before") + F.col("__c")
    lower, upper = F.floor((F.col("__size") + 1) / 2), F.floor((F.col("__size") + 2) / 2)
    halves = [
        F.when((F.col("__before") < at) & (at <= upto), F.col("__v").cast("double") / 2) for at in (lower, upper)
    ]
    return placed.groupBy(*by).agg((F.max(halves[0]) + F.max(halves[1])).alias(out))


def grouped_agg(
    df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column], medians: Mapping[str, str]
) -> DataFrame:
    """``groupBy(by)`` with ``aggs`` and exact medians ``{output: value column}``. For many groups of any size.

    Groups are counted first. Up to ``SMALL_GROUP`` rows, Spark's own median keeps a group's values with their
    counts in one aggregate; the rows of larger groups are put in order by ranges instead, so no hot group is one
    task's. Both give the same: NaN is the largest value, and the middle of opposite infinities is NaN.
    """
    by = list(by)
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"), *[c.alias(name) for name, c in aggs.items()])
    base = materialize(base, "group-aggregates")
    large = base.where(F.col("__rows") > SMALL_GROUP).select(*by)
    some = not large.isEmpty()
    small = join_on(df, large, by, "left_anti") if some else df
    middle = small.groupBy(*by).agg(*[F.median(F.col(v).cast("double")).alias(name) for name, v in medians.items()])
    if some:
        hot = join_on(df, large, by, "left_semi")
        ordered = large
        for name, v in medians.items():
            ordered = join_on(ordered, _median_in_order(hot, by, v, name), by, "left")
        middle = middle.unionByName(ordered)
    return join_on(base, middle, by, "left").select(*by, *aggs, *medians)


def average_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str = "avg_rank", weight: str | None = None
) -> DataFrame:
    """Rank of each distinct value per group, ties sharing the mean rank; a row counts ``weight`` times.

    Returns ``(by…, value, n_ties, out)``.
    """
    placed = running_in_order(_value_counts(df, by, value, weight), by, ["__v"], "__before", "__size", "__c")
    return placed.select(
        *by,
        F.col("__v").alias(value),
        F.col("__c").alias("n_ties"),
        (F.col("__before") + (F.col("__c") + 1) / 2).alias(out),
    )


def rows_with_average_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str = "avg_rank"
) -> DataFrame:
    ranks = average_rank(df, by, value, out).drop("n_ties")
    return join_on(df, ranks, [*by, value], "left")
