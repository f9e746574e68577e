"""Distributed helpers: global row index (H1) and length histograms (H3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.session import checkpoint_dir


def sized_partitions(df: DataFrame, target_bytes: int = 128 << 20) -> int:
    """Partitions for a shuffle of about all that ``df`` reads: the known sizes of its inputs over
    ``target_bytes``, and at least ``spark.sql.shuffle.partitions``."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-sum(s for s in sizes if s < 1 << 60) // target_bytes))  # an unknown size is 2 ** 63 - 1


def with_global_index(df: DataFrame, order_cols: list, name: str = "idx", partitions: int | None = None,
                      return_count: bool = False):
    """H1: 0-based position of every row in the total order ``order_cols``.

    Range-partition + sort within partitions, count rows per partition, prefix-sum
    the (tiny) per-partition count table and add the offset to the in-partition row
    number.  No unpartitioned window touches row data: the only global window runs
    over one row per partition.  ``order_cols`` must make the order total (end with
    a unique key) for a deterministic index.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(partitions or sized_partitions(df))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                .withColumn("__pid", F.spark_partition_id())
                .withColumn("__mid", F.monotonically_increasing_id()))
    # Reliable checkpoint (shared folder): partition ids and in-partition positions
    # become stored values, so counts and rows agree even if AQE re-plans or an
    # executor is lost; it also cuts the lineage of the range shuffle.
    ranged = ranged.checkpoint(eager=True)
    # one scan: rows per partition (at most n rows, one per partition), prefix-summed
    # on the driver and broadcast back — bounded by the partition count, not the data
    counts = sorted((r["__pid"], r["__n"]) for r in
                    ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n")).collect())
    if len(counts) > n:
        raise ValueError(f"partition offsets: {len(counts)} rows exceed {n}")
    rows, run = [], 0
    for pid, cnt in counts:
        rows.append((int(pid), run))
        run += int(cnt)
    offsets = spark.createDataFrame(rows, "__pid int, __off long")
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    out = (ranged.join(F.broadcast(offsets), "__pid")
                 .withColumn(name, (F.col("__off") + local).cast("long"))
                 .drop("__pid", "__mid", "__off"))
    # the row count falls out of the per-partition counts: no extra scan
    return (out, run) if return_count else out


def ranked_value(df: DataFrame, col: str, rank: int, bins: int = 4096):
    """(value, rows above it, rows that hold it) of the ``rank``-th largest (from 1) of a long column; null comes last.

    Each pass counts the values of the open interval in at most ``bins`` bins and goes on in the bin that holds the
    rank, so passes grow with the logarithm of the values' range (two for lengths below 2 ** 24) and neither the
    driver nor a task ever holds more than ``bins`` rows, however many distinct values there are.
    """
    low, high, known = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if rank > known:
        return None, known, df.filter(F.col(col).isNull()).count()
    above = 0
    while True:
        step = -(-(high - low + 1) // bins)
        bin_of = F.expr(f"(`{col}` - {low}L) div {step}L").alias("bin")
        rows = df.filter(F.col(col).between(low, high)).groupBy(bin_of).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["n"] >= rank:
                break
            above += r["n"]
        if step == 1:
            return low + r["bin"], above, r["n"]
        low, high = low + r["bin"] * step, min(high, low + (r["bin"] + 1) * step - 1)


def length_histogram(df: DataFrame, length_col: str, group_cols: list | None = None) -> DataFrame:
    """H3: (groups, length, n).  Lengths are bounded, so this is small whatever the row count."""
    g = list(group_cols or [])
    return df.groupBy(*g, length_col).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantiles(hist: DataFrame, length_col: str, quantiles: list, group_cols: list | None = None,
                        prefix: str = "q") -> DataFrame:
    """Exact linearly interpolated quantiles (pandas / DuckDB ``quantile_cont``) from a histogram.

    Works on the small ``(groups, length, n)`` table only: cumulative counts by a
    window partitioned by group, then a grouped aggregate picks the order statistics.
    """
    g = list(group_cols or [])
    w = Window.partitionBy(*g).orderBy(length_col) if g else Window.orderBy(length_col)
    wall = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    h = (hist.withColumn("__end", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("__start", F.col("__end") - F.col("n"))
             .withColumn("__total", F.sum("n").over(wall)))
    aggs = []
    for i, q in enumerate(quantiles):
        pos = (F.col("__total") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)

        def pick(ix):
            return F.min(F.when((F.col("__start") <= ix) & (ix < F.col("__end")), F.col(length_col)))

        aggs += [pick(lo).alias(f"__lo{i}"), pick(hi).alias(f"__hi{i}"), F.first(pos - lo).alias(f"__fr{i}")]
    res = h.groupBy(*g).agg(*aggs)
    for i, q in enumerate(quantiles):
        lo, hi, fr = F.col(f"__lo{i}").cast("double"), F.col(f"__hi{i}").cast("double"), F.col(f"__fr{i}")
        res = res.withColumn(f"{prefix}{i}", lo + fr * (hi - lo))
    return res.drop(*[c for c in res.columns if c.startswith("__")])


def bounded_broadcast(df: DataFrame, max_rows: int, what: str = "table") -> DataFrame:
    """Broadcast ``df`` only after checking it holds at most ``max_rows`` rows.

    Used for tables whose size is bounded by a constant of the job (eval size,
    partition count, colour words), never by the data; the check turns a broken
    bound into an error instead of an executor running out of memory.
    """
    n = df.count()
    if n > max_rows:
        raise ValueError(f"{what}: {n} rows exceed the broadcast bound {max_rows}")
    return F.broadcast(df)


def combine_single_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put two one-row aggregates side by side (equi-join on a constant key)."""
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")
