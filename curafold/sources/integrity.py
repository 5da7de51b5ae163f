"""File manifests and checksum verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curafold.operators.ranking import join_on
from curafold.session import materialize

MANIFEST_SCHEMA = "files array<struct<path string, bytes long, sha256 string>>"


def read_manifest(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Rows ``(path, bytes, sha256)`` of a nested JSON manifest.

    ``one_document`` reads a manifest kept as a single JSON document; otherwise each
    line is a record, which readers can split.
    """
    return (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("multiLine", one_document)
        .json(path)
        .select(F.inline("files"))
    )


#: Larger than any file: with it for a partition's bytes and for opening a file, no file is split and each is a task's own.
WHOLE_FILE = 1 << 44
#: Files that the line reader unpacks by their names.
PACKED_FILE = r"\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"


def _pieces_kernel():
    """Task body: the pieces between line feeds of a file in order in; path, size and SHA-256 out, NULL if bytes are missing."""
    mark = b"\xef\xbb\xbf"  # the reader leaves it out at the start of a file

    def result(path, size, length, plain, marked):
        sha256 = None
        for hashed, more in ((plain, 0), (marked, len(mark))):
            missing = size - length - more
            if missing in (0, 1):  # without or with a line feed at the end
                hashed.update(b"\n" * missing)
                sha256 = hashed.hexdigest()
                break
        return pa.RecordBatch.from_arrays(
            [pa.array([unquote(path)]), pa.array([size], pa.int64()), pa.array([sha256], pa.string())], ["path", "bytes", "sha256"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = None
        for batch in batches:
            paths, sizes, pieces = (batch.column(name) for name in ("path", "bytes", "piece"))
            starts = [0, *[k for k in range(1, batch.num_rows) if paths[k] != paths[k - 1]]] if paths[0] != paths[batch.num_rows - 1] else [0]
            for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
                data = b"\n".join(pieces.slice(start, stop - start).to_pylist())
                if path == paths[start].as_py():
                    data = b"\n" + data
                else:
                    if path is not None:
                        yield result(path, size, length, plain, marked)
                    path, size, length, plain, marked = paths[start].as_py(), sizes[start].as_py(), 0, hashlib.sha256(), hashlib.sha256(mark)
                length += len(data)
                plain.update(data)
                marked.update(data)
        if path is not None:
            yield result(path, size, length, plain, marked)

    return run


def hash_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Relative path, size and SHA-256 of each file; hashed where the file is read, and written at once.

    A task reads a file of any size in order, in pieces that end with a line feed, and holds a few thousand of them. Only files
    that the line reader unpacks or shows in part are taken as one row each; these are limited to 2 GB.
    """
    root = folder.rstrip("/") + "/"

    def files(fmt: str, **options: str) -> DataFrame:
        reader = spark.read.format(fmt).options(recursiveFileLookup=True, pathGlobFilter=pattern, **options)
        return reader.load(folder)

    pieces = files("text", lineSep="\n").where(~F.col("_metadata.file_name").rlike(PACKED_FILE)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("value").cast("binary").alias("piece")
    )
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(key) for key in keys]
    try:
        for key in keys:
            spark.conf.set(key, str(WHOLE_FILE))
        hashed = materialize(pieces.mapInArrow(_pieces_kernel(), "path string, bytes long, sha256 string"), "file-hashes")
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)
    hashed = hashed.where(F.col("sha256").isNotNull())
    odd = files("binaryFile").select("path", "length").join(hashed, "path", "left_anti").collect()
    if odd:
        # The reader drops files of other sizes before it reads them.
        chosen = F.col("length").isin([x["length"] for x in odd]) & F.col("path").isin([x["path"] for x in odd])
        whole = files("binaryFile").where(chosen)
        hashed = hashed.unionByName(whole.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))
    return hashed.withColumn("path", F.substring_index("path", root, -1))


def whole_tables(files: DataFrame) -> DataFrame:
    """One entry for each file or folder at the top: a table may be one file or a folder of part files.

    A folder has the bytes of its files together and the SHA-256 of their paths and digests, in order of the paths.
    """
    top = F.substring_index("path", "/", 1)
    parts = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    listed = F.array_join(F.transform("parts", lambda p: F.concat_ws(" ", p["sha256"], p["path"])), "\n")
    single = F.col("parts")[0]
    return files.groupBy(top.alias("name")).agg(F.sum("bytes").alias("bytes"), parts.alias("parts")).select(
        F.col("name").alias("path"), "bytes",
        F.when(single["path"] == F.col("name"), single["sha256"]).otherwise(F.sha2(listed, 256)).alias("sha256"),
    )


def write_manifest(files: DataFrame, path: str) -> None:
    """Manifest of a file listing as JSON lines, one record per file."""
    entry = F.struct("path", "bytes", "sha256")
    files.select(F.array(entry).alias("files")).write.mode("overwrite").json(path)


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Each path as ``ok``, ``missing``, ``changed``, or ``unlisted`` if the manifest doesn't have it."""
    actual = files.select(
        "path", F.col("bytes").alias("actual_bytes"), F.col("sha256").alias("actual_sha256"), F.lit(True).alias("found")
    )
    listed = manifest.withColumn("listed", F.lit(True))
    same = (F.col("sha256") == F.col("actual_sha256")) & (F.col("bytes") == F.col("actual_bytes"))
    return listed.join(actual, "path", "full_outer").select(
        "path",
        F.when(F.col("listed").isNull(), F.lit("unlisted"))
        .when(F.col("found").isNull(), F.lit("missing"))
        .when(same, F.lit("ok"))
        .otherwise(F.lit("changed"))
        .alias("status"),
    )


def row_code(*columns: str) -> Column:
    """The text of some fields, each with its length in front, so different rows never read the same. NULL has no length."""
    parts = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("N:")) for p in parts])


# Hex digits of a digest that make up each of the two sums of a checksum.
SUM_DIGITS = 15


def _sums(code: Column) -> list[Column]:
    digest = F.md5(code)
    parts = [F.conv(F.substring(digest, at, SUM_DIGITS), 16, 10).cast("decimal(20,0)") for at in (1, 1 + SUM_DIGITS)]
    return [F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", *[F.sum(p).cast("string") for p in parts]).alias("checksum")]


def table_checksum(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row count and two sums of 60-bit row hashes, per partition column; for tables of any size.

    It depends on the rows alone, not on files or order. NULL differs from any text, and fields keep their borders.
    """
    return df.groupBy(*by).agg(*_sums(row_code(*df.columns)))


# --- a tree of checksums, to find what changed ------------------------------------------

BUCKETS = 256


def with_bucket(df: DataFrame, key: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``bucket``, a hash of the key."""
    number = F.conv(F.substring(F.md5(row_code(*key)), 1, 8), 16, 10).cast("long")
    return df.withColumn("bucket", F.pmod(number, F.lit(buckets)).cast("int"))


def checksum_tree(df: DataFrame, key: Sequence[str], part: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``level, part, bucket, n_rows, checksum`` of the table, of each value of ``part`` and of each hash bucket in it.

    One pass with partial sums. ``part`` is text here; NULL is a value of it like any other.
    """
    rows = with_bucket(df, key, buckets).select(
        "bucket", (F.lit(None) if part is None else F.col(f"`{part}`")).cast("string").alias("part"), row_code(*df.columns).alias("code")
    )
    levels = F.grouping_id()
    tree = rows.rollup("part", "bucket").agg(levels.alias("__level"), *_sums(F.col("code")))
    name = F.when(F.col("__level") == 0, "bucket").when(F.col("__level") == 1, "part").otherwise("table")
    return tree.select(name.alias("level"), "part", "bucket", "n_rows", "checksum")


def write_snapshot(df: DataFrame, key: Sequence[str], path: str, part: str | None = None, buckets: int = BUCKETS) -> None:
    """The rows in ``path/rows``, a folder for each hash bucket, and their checksums in ``path/tree``."""
    with_bucket(df, key, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    written = df.sparkSession.read.parquet(f"{path}/rows").drop("bucket").select(*[f"`{c}`" for c in df.columns])
    checksum_tree(written, key, part, buckets).write.mode("overwrite").parquet(f"{path}/tree")


def changed_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """``part, bucket`` of the buckets whose checksums differ, from two trees; nothing if the tables agree as a whole."""
    leaves = [t.where("level = 'bucket'").select("part", "bucket", F.struct("n_rows", "checksum").alias(n)) for t, n in ((a, "a"), (b, "b"))]
    both = join_on(*leaves, ["part", "bucket"], "full_outer_coalesced")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("part", "bucket")


def compare_stored(spark: SparkSession, old: str, new: str, key: Sequence[str]) -> DataFrame:
    """``key…, status``: rows ``added``, ``removed`` or ``changed`` between two snapshots of the same layout.

    Trees are compared first; of the rows only buckets that differ are read, whose numbers are at most as
    many as there are buckets. A key that repeats within a bucket is compared as the collection of its rows.
    """
    trees = [spark.read.parquet(f"{path}/tree") for path in (old, new)]
    wanted = [r["bucket"] for r in changed_buckets(*trees).select("bucket").distinct().collect()]
    sides = []
    for path, name in ((old, "a"), (new, "b")):
        rows = spark.read.parquet(f"{path}/rows").where(F.col("bucket").isin(wanted))
        code = row_code(*sorted(c for c in rows.columns if c != "bucket"))
        sides.append(rows.groupBy("bucket", *key).agg(*[x.alias(f"__{name}{i}") for i, x in enumerate(_sums(code))]))
    both = join_on(*sides, ["bucket", *key], "full_outer_coalesced")
    status = F.when(F.col("__a0").isNull(), "added").when(F.col("__b0").isNull(), "removed")
    same = (F.col("__a0") == F.col("__b0")) & (F.col("__a1") == F.col("__b1"))
    return both.withColumn("status", status.when(~same, "changed")).where("status IS NOT NULL").select(*key, "status")
