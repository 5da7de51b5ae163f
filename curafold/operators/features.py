"""Hashed token features, descriptors and train-only preprocessing in long form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curafold.functions.measurement import finite, sanitize
from curafold.operators.ranking import exact_median, join_on
from curafold.session import join_parameters, materialize

DEFAULT_BITS = 2048
#: Tokens that are counted together, unless a row has more.
COUNTED_TOKENS = 1 << 19
#: Tokens whose bits a task keeps at a time.
KNOWN_TOKENS = 1 << 18


def words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def token_bit(token: Column, bits: int = DEFAULT_BITS) -> Column:
    """Bucket of a token: leading 32 bits of its MD5 modulo ``bits``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(bits)).cast("int")


def bit_set(tokens: Column, bits: int = DEFAULT_BITS) -> Column:
    """Sorted distinct set bits of one row: no shuffle, at most ``bits`` entries."""
    hashed = F.transform(F.array_distinct(tokens), lambda t: token_bit(t, bits))
    return F.array_sort(F.array_distinct(hashed))


def bit_sets(df: DataFrame, id_col: str, text: str, bits: int = DEFAULT_BITS) -> DataFrame:
    """``(id, bits)``: :func:`bit_set` of the :func:`words` of each text; a frequent token is hashed once in a task."""
    most = KNOWN_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            found = []
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                if value is None:
                    found.append(None)
                    continue
                value = value.strip(b" ")
                tokens = set(value.split())
                if not value or value[:1].isspace() or value[-1:].isspace():
                    tokens.add(b"")  # the empty token before or after other white space
                if len(known) > most:
                    known.clear()
                for token in tokens:
                    if token not in known:
                        known[token] = int.from_bytes(hashlib.md5(token).digest()[:4], "big") % bits
                found.append(sorted({known[token] for token in tokens}))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int32()))], ["id", "bits"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, bits array<int>").withColumnRenamed("id", id_col)


def _row_counts(rows: DataFrame, id_col: str, bits: int) -> DataFrame:
    """``(id, bit, cnt)`` of each row by itself; a token is hashed once for all rows that are counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, sizes = 0, batch.column("tokens").value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(sizes)
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + COUNTED_TOKENS, side="right")))
                part = batch.slice(start, stop - start)
                lists = part.column("tokens")
                words = lists.flatten().dictionary_encode(null_encoding="encode")
                tokens = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
                digests = b"".join([hashlib.md5(t or b"").digest() for t in tokens])
                at = np.frombuffer(digests, ">u4")[::4].astype(np.int64) % bits
                # A missing token has no bit; it gets a place after the last one.
                at[[t is None for t in tokens]] = bits
                keys = lists.value_parent_indices().to_numpy() * (bits + 1) + at[words.indices.to_numpy()]
                keys, counts = np.unique(keys, return_counts=True)
                row, place = np.divmod(keys, bits + 1)
                columns = [part.column("id").take(pa.array(row)), pa.array(place, pa.int32(), mask=place == bits), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "bit", "cnt"])
                start = stop

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, bit int, cnt bigint").withColumnRenamed("id", id_col)


def count_fingerprint(
    df: DataFrame, id_col: str, tokens: Column, bits: int = DEFAULT_BITS
) -> DataFrame:
    """Sparse hashed counts ``(id, bit, cnt, value)`` with ``value = log1p(cnt)``.

    A row's tokens are counted where it is read. Only rows that share their id are shuffled, to be added up.
    """
    rows = df.select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    repeated = df.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if repeated.isEmpty():
        counts = _row_counts(rows, id_col, bits)
    else:
        repeated = materialize(repeated, "repeated-ids")
        parts = _row_counts(join_on(rows, repeated, ["id"], "left_semi"), id_col, bits)
        added = parts.groupBy(id_col, "bit").agg(F.sum("cnt").alias("cnt"))
        counts = _row_counts(join_on(rows, repeated, ["id"], "left_anti"), id_col, bits).unionByName(added)
    return counts.withColumn("value", F.log1p("cnt"))


def binary_fingerprint(
    df: DataFrame, id_col: str, tokens: Column, bits: int = DEFAULT_BITS
) -> DataFrame:
    """Set bits as rows ``(id, bit)``."""
    return df.select(id_col, F.explode(bit_set(tokens, bits)).alias("bit"))


def descriptors(df: DataFrame, id_col: str, exprs: Mapping[str, Column | str]) -> DataFrame:
    """Numeric descriptor columns; anything undefined or out of float32 range is NULL."""
    cols = {n: F.expr(e) if isinstance(e, str) else e for n, e in exprs.items()}
    return df.select(id_col, *[sanitize(c).alias(n) for n, c in cols.items()])


def to_long(
    df: DataFrame, id_cols: Sequence[str], features: Sequence[str]
) -> DataFrame:
    """Dense long rows ``(id…, feature, value)``; NULL values are kept."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
            for f in features
        ]
    )
    return df.select(*id_cols, F.inline(pairs))


def assemble_long(counts: DataFrame, dense: DataFrame, id_col: str, prefix: str = "count_bit_") -> DataFrame:
    """Count block and descriptor block as one long table."""
    sparse = counts.select(id_col, F.concat(F.lit(prefix), F.col("bit")).alias("feature"), "value")
    return sparse.unionByName(dense.select(id_col, "feature", "value"))


def assemble_vector(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def name_features(df: DataFrame, id_col: str, vector: str, names: Sequence[str]) -> DataFrame:
    """A vector column as named long rows."""
    from pyspark.ml.functions import vector_to_array

    is_vector = dict(df.dtypes)[vector] == "vector"
    values = vector_to_array(F.col(vector)) if is_vector else F.col(vector)
    labels = F.array(*[F.lit(n) for n in names])
    return df.select(id_col, F.posexplode(values).alias("__i", "value")).select(
        id_col, F.element_at(labels, F.col("__i") + 1).alias("feature"), "value"
    )


def null_census(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Missing and non-finite values per feature (and partition)."""
    return long.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.count_if(F.col("value").isNotNull() & ~finite(F.col("value"))).alias("n_non_finite"),
    )


def drop_all_null(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Features with at least one value in the training rows."""
    return (
        train.groupBy(*by, "feature")
        .agg(F.count("value").alias("n_values"))
        .where(F.col("n_values") > 0)
        .select(*by, "feature")
    )


def fit_median(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return exact_median(train, [*by, "feature"], "value")


def apply_median(long: DataFrame, medians: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fill missing values from the fitted medians; features without a median drop out."""
    return join_parameters(long, medians, [*by, "feature"], "medians").withColumn(
        "value", F.coalesce("value", "median")
    ).drop("median")


def drop_constant(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Features that vary over the training rows."""
    return (
        train.groupBy(*by, "feature")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        .where(F.col("lo") < F.col("hi"))
        .select(*by, "feature")
    )


def fit_preprocess(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Parameter table ``(by…, feature, n_values, median, kept)`` from training rows only.

    Imputing with the median never widens a feature's range, so "varies after
    imputation" equals ``min < max`` over the present values.
    """
    keys = [*by, "feature"]
    stats = train.groupBy(*keys).agg(
        F.count("value").alias("n_values"), F.min("value").alias("__lo"), F.max("value").alias("__hi")
    )
    fitted = join_on(stats, exact_median(train, keys, "value"), keys, "left")
    return fitted.select(
        *keys,
        "n_values",
        "median",
        F.coalesce((F.col("n_values") > 0) & (F.col("__lo") < F.col("__hi")), F.lit(False)).alias("kept"),
    )


def transform_preprocess(long: DataFrame, params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Apply fitted parameters to any partition: impute, keep the fitted features."""
    keep = params.where("kept").select(*by, "feature", "median")
    return apply_median(long, keep, by)


def preprocess_dims(params: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Feature counts after each preprocessing step."""
    return params.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(F.col("n_values") > 0).alias("n_not_all_null"),
        F.count_if("kept").alias("n_kept"),
    )


def require_width(long: DataFrame, id_col: str, width: int) -> DataFrame:
    """Rows whose number of features differs from ``width``, as one report row."""
    per_row = long.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return per_row.agg(F.count_if(F.col("n") != width).alias("n_bad")).select(
        F.lit("feature_width").alias("check"),
        F.when(F.col("n_bad") == 0, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
        "n_bad",
        F.lit(f"rows without exactly {width} features").alias("detail"),
    )
