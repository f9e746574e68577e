"""Helpers shared by the operators of this package."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.sources.io import scratch_path

# FIXED VALUES: the characters of [\x20\x09-\x0D]
ASCII_SPACE = " \t\n\x0b\x0c\r"

# A key is hot when it has more than 1/HOT_SHARE of all rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str, partition_by: list | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for table in tables:
        for root in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            jvm = table.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_column(df: DataFrame, name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_rows(summary: DataFrame, count_col: str, total: int) -> DataFrame:
    """Keys of ``summary`` (one row per key) with more than ``total / HOT_SHARE`` rows.

    The counts of all keys sum to at most ``total``, so there are at most HOT_SHARE
    of them whatever the input: the broadcasts of this package rest on that bound.
    """
    return summary.filter(F.col(count_col) > F.lit(max(total // HOT_SHARE, HOT_SHARE)))


def attach(rows: DataFrame, summary: DataFrame, key: str, count_col: str, total: int, how: str = "left") -> DataFrame:
    """Join ``rows`` with a narrow ``summary`` of one row per ``key``.

    Rows of hot keys meet the at most HOT_SHARE hot summary rows by a broadcast and so
    never gather in one task; all other rows take an ordinary join by key.  ``rows`` is
    read twice, so pass a materialised table.
    """
    hot = F.broadcast(hot_rows(summary, count_col, total))
    hot_keys = hot.select(key)
    rest = rows.join(hot_keys, key, "left_anti").join(summary, key, how)
    return rows.join(hot, key, "inner").unionByName(rest)


def salted_join(rows: DataFrame, wide: DataFrame, counts: DataFrame, key: str, count_col: str, total: int,
                spread: list) -> DataFrame:
    """Inner join of ``rows`` with ``wide`` (one row per key, with texts) without gathering a hot key.

    A hot key (see hot_rows; at most HOT_SHARE) is dealt over 1 + its rows / (total / HOT_SHARE)
    salts: its wide row is repeated once per salt, its rows take a salt by a hash of ``spread``.
    """
    step = max(total // HOT_SHARE, HOT_SHARE)
    hot = F.broadcast(hot_rows(counts, count_col, total).select(
        F.col(key), (F.floor(F.col(count_col) / F.lit(step)) + 1).cast("int").alias("__salts")))
    n = F.coalesce(F.col("__salts"), F.lit(1))
    left = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), n).cast("int")).drop("__salts")
    right = wide.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def store(uri: str):
    """(file system, path) of a folder that executors share, for files that Spark has no writer for."""
    import re

    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri if ":" in uri else f"file://{uri}"))


def text_runs(texts, limit: int = 1 << 20):
    """Cut an Arrow array of texts into runs (start, end, [bytes]) of about ``limit`` bytes, whole texts
    each; null is empty.  Only one run at a time exists as Python objects."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    data = texts.cast(pa.binary())
    sizes = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(data):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield start, end, [t or b"" for t in data.slice(start, end - start).to_pylist()]
        start = end


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 1000):
    """Within the block Spark hands Python workers at most ``rows`` rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def thinned(rows: DataFrame, keys: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """Most rows whose ``column`` is not in ``keys`` taken out before an exact join shuffles the rest.

    A bitmap of 2 ** ``bits`` bits over hashes of the keys is broadcast as a table of at most
    2 ** (bits - 6) words, whatever the input; rows of keys always pass.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    word, mask = F.shiftright(bit, 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    words = keys.select(word, mask.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    hit = rows.withColumns({"__word": F.shiftright(bit, 6), "__mask": mask}).join(F.broadcast(words), "__word")
    return hit.filter(F.col("__bits").bitwiseAND(F.col("__mask")) != 0).select(*rows.columns)
