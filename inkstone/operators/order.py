"""Sort, shuffle, sample, shard and batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.operators.index import bounded_broadcast, ranked_value, with_global_index
from inkstone.sources.io import scratch_path


def shuffle_key(id_col: str, seed: int = K.SEED):
    """md5 of ``seed|id``: a deterministic pseudo-random order key (same digest in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def seeded_shuffle(df: DataFrame, id_col: str = "id", seed: int = K.SEED, name: str = "idx") -> DataFrame:
    """Whole-frame permutation; ``name`` holds the new position."""
    return with_global_index(df.withColumn("__key", shuffle_key(id_col, seed)), ["__key", id_col], name).drop("__key")


def seeded_sample(df: DataFrame, n: int, id_col: str = "id", seed: int = K.SEED) -> DataFrame:
    """N rows without replacement (top-n of the md5 order: TakeOrdered, no full sort)."""
    return df.withColumn("__key", shuffle_key(id_col, seed)).orderBy("__key", id_col).limit(n).drop("__key")


def length_sort(df: DataFrame, length_col: str, id_col: str = "id", name: str = "idx") -> DataFrame:
    """Rows ordered by length, ties by id; ``name`` is the position."""
    return with_global_index(df, [length_col, id_col], name)


def round_robin_shards(df: DataFrame, n_shards: int, order_cols: list, name: str = "shard") -> DataFrame:
    """Row i of the order goes to shard i mod N."""
    return with_global_index(df, order_cols, "__i").withColumn(name, (F.col("__i") % n_shards).cast("int")).drop("__i")


def fixed_batches(df: DataFrame, batch_size: int, order_cols: list, name: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows in the given order."""
    return (with_global_index(df, order_cols, "__i")
            .withColumn(name, F.floor(F.col("__i") / batch_size).cast("long")).drop("__i"))


def length_bucketed_batches(df: DataFrame, length_col: str, batch_size: int, id_col: str = "id",
                            name: str = "batch_id") -> DataFrame:
    """Batches of rows with similar length (consecutive in length order)."""
    return fixed_batches(df, batch_size, [length_col, id_col], name)


def spaced_positions(n, k):
    """``linspace(0, n-1, k)`` truncated to int, computed in doubles like NumPy.

    Returns an array column of positions (may repeat when k > n; callers dedupe).
    """
    n = F.lit(n) if isinstance(n, int) else n
    k = F.lit(k) if isinstance(k, int) else k
    step = (n - 1).cast("double") / (k - 1).cast("double")
    return F.when(k <= 0, F.array().cast("array<long>")).when(k == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), (k - 1).cast("long")),
                    lambda i: F.when(i == k - 1, (n - 1).cast("long")).otherwise(F.floor(i * step).cast("long"))))


def even_subsample(df: DataFrame, k: int, order_cols: list) -> DataFrame:
    """K evenly spaced rows of the ordered frame (positions as in NumPy linspace)."""
    indexed, n = with_global_index(df, order_cols, "__i", return_count=True)
    if n == 0 or k <= 0:
        return indexed.drop("__i").limit(0)
    pos = indexed.sparkSession.range(1).select(F.explode(F.array_distinct(spaced_positions(n, min(k, n)))).alias("__i"))
    return indexed.join(bounded_broadcast(pos, k, "sample positions"), "__i", "left_semi").drop("__i")


def longest_rows(df: DataFrame, length_col: str, id_col: str = "id", fraction: float = K.LONG_CONTEXT_FRACTION,
                 minimum: int = K.LONG_CONTEXT_MIN_EVAL) -> DataFrame:
    """The N longest rows, N = min(n, max(minimum, floor(fraction*n))), ties by id.

    The N-th length is selected by counting (:func:`ranked_value`) on a narrow table of id and length, then the rows
    are filtered where they lie: nothing wide is sorted or moved.  Rows of that very length are cut at an id, which a
    global index over their ids alone tells.  Null lengths come last, a null id first; ids must be unique.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "lengths")
    df.select(F.col(length_col).cast("long").alias("length"), F.col(id_col).alias("id")).write.parquet(path)
    narrow = spark.read.parquet(path)
    n = narrow.count()
    keep = min(n, max(minimum, int(n * fraction)))
    if keep == n:
        return df
    if keep <= 0:
        return df.filter(F.lit(False))
    last, longer, ties = ranked_value(narrow, "length", keep)
    length, row_id = F.col(length_col).cast("long"), F.col(id_col)
    over = length.isNotNull() if last is None else length > last
    at = length.isNull() if last is None else length == last
    if keep - longer == ties:
        return df.filter(over | at)
    same = narrow.filter(F.col("length").isNull() if last is None else F.col("length") == last).select("id")
    cut = with_global_index(same, ["id"], "__i").filter(F.col("__i") == keep - longer - 1).first()["id"]
    return df.filter(over | (at & (row_id.isNull() if cut is None else row_id.isNull() | (row_id <= F.lit(cut)))))
