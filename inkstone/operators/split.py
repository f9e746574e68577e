"""Stratified train/holdout split.

No window ever runs over a whole bucket of row data: positions inside a bucket
come from a global index (H1) minus the bucket's start offset, and all quota
arithmetic runs on the bucket-size table (at most 45 rows).  Everything that
is joined back to row data is bounded by the eval size (<= 1000 rows).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.functions import text as TX
from inkstone.operators.index import length_histogram, with_global_index
from inkstone.session import checkpoint_dir


def eval_size(n: int, fraction: float = K.EVAL_FRACTION, minimum: int = K.MIN_EVAL_ROWS,
              maximum: int = K.MAX_EVAL_ROWS) -> int:
    """min(maximum, max(minimum, floor(fraction*n)), n-1); fails below 1."""
    e = min(min(maximum, max(minimum, int(n * fraction))), n - 1)
    if e < 1:
        raise ValueError("Need at least 2 valid rows to create a train/eval split.")
    return e


def _lerp(a, b, t):
    """NumPy's linear interpolation (the two-sided form used by np.quantile)."""
    d = b - a
    return F.when(t >= 0.5, b - d * (1 - t)).otherwise(a + d * t)


def length_edges(df: DataFrame, length_col: str = "combined_chars", max_bins: int = 5) -> DataFrame:
    """W1 edges: one row, ``edges`` = distinct quantile edges (pandas qcut, duplicates dropped).

    q = min(max_bins, max(2, distinct lengths)); quantiles of linspace(0, 1, q+1)
    computed exactly (NumPy's virtual index and two-sided lerp) from the length
    histogram, which is small whatever the row count.
    """
    hist = length_histogram(df, length_col).cache()
    distinct = hist.count()
    q = min(max_bins, max(2, distinct))
    qs = [float(x) for x in np.linspace(0, 1, q + 1)]
    # pandas passes q*100 to NumPy, which divides by 100 again
    qs = [float(np.true_divide(np.float64(x) * 100.0, 100.0)) for x in qs]
    h = (hist.withColumn("__end", F.sum("n").over(Window.orderBy(length_col).rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("__start", F.col("__end") - F.col("n")))
    base = hist.agg(F.sum("n").alias("__n"))
    rows = []
    for i, qv in enumerate(qs):
        # virtual index (n-1)*q (NumPy 'linear' method); neighbours clipped to [0, n-1]
        vi = (F.col("__n") - 1).cast("double") * F.lit(qv)
        rows.append(base.select(F.lit(i).alias("k"), vi.alias("vi"), F.col("__n")))
    vis = rows[0]
    for r in rows[1:]:
        vis = vis.unionByName(r)
    vis = (vis.withColumn("lo", F.least(F.greatest(F.floor("vi"), F.lit(0)), F.col("__n") - 1))
              .withColumn("hi", F.least(F.greatest(F.floor("vi") + 1, F.lit(0)), F.col("__n") - 1))
              .withColumn("t", F.col("vi") - F.floor("vi")))
    # pick the order statistics from histogram ranges; the broadcast side is the
    # quantile table (at most max_bins + 1 rows)
    lo = h.select(F.col("__start").alias("s_lo"), F.col("__end").alias("e_lo"), F.col(length_col).alias("v_lo"))
    hi = h.select(F.col("__start").alias("s_hi"), F.col("__end").alias("e_hi"), F.col(length_col).alias("v_hi"))
    v = F.broadcast(vis)
    with_lo = lo.join(v, (F.col("lo") >= F.col("s_lo")) & (F.col("lo") < F.col("e_lo")))
    picked = hi.join(F.broadcast(with_lo), (F.col("hi") >= F.col("s_hi")) & (F.col("hi") < F.col("e_hi")))
    edges = picked.select("k", _lerp(F.col("v_lo").cast("double"), F.col("v_hi").cast("double"), F.col("t")).alias("edge"))
    return edges.agg(F.array_sort(F.array_distinct(F.collect_list("edge"))).alias("edges"))


def with_length_bin(df: DataFrame, edges: DataFrame, length_col: str = "combined_chars",
                    name: str = "length_bin") -> DataFrame:
    """W1 bin: right-closed, lowest value included: greatest(0, #edges below v - 1).

    ``edges`` is one row (at most 6 values): joined as a broadcast literal row.
    """
    rows = edges.collect()          # one row
    e = rows[0]["edges"] if rows and rows[0]["edges"] is not None else []
    arr = F.array(*[F.lit(float(x)) for x in e]) if e else F.array().cast("array<double>")
    v = F.col(length_col).cast("double")
    return df.withColumn(name, F.greatest(F.lit(0), F.size(F.filter(arr, lambda x: x < v)) - 1).cast("int"))


def with_split_bucket(df: DataFrame, prompt_col: str = "prompt", markup_col: str = "svg_norm") -> DataFrame:
    """Complexity bins and the bucket label ``L{len}_P{prompt}_S{markup}``."""
    return (df.withColumn("prompt_complexity_bin", TX.prompt_complexity(F.col(prompt_col)).cast("int"))
              .withColumn("svg_complexity_bin", TX.markup_complexity(F.col(markup_col)).cast("int"))
              .withColumn("split_bucket", F.format_string("L%d_P%d_S%d", "length_bin", "prompt_complexity_bin",
                                                         "svg_complexity_bin")))


def bucket_quota(sizes: DataFrame, e: int, bucket_col: str = "split_bucket") -> DataFrame:
    """Largest-remainder quota per bucket (floor 1 for buckets >= 20, cap size-1).

    Runs on the bucket-size table only (<= 45 rows), so its global windows are
    bounded.  The sequential walk of the reference (+1 / -1 once per bucket in
    remainder order while short / over) is a running count of eligible buckets.
    """
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    b = (sizes.withColumn("__total", total)
              .withColumn("desired", (F.col("n").cast("double") / F.col("__total").cast("double")) * F.lit(float(e)))
              .withColumn("minimum", F.when(F.col("n") >= 20, 1).otherwise(0))
              .withColumn("base", F.least(F.greatest(F.col("minimum"), F.floor("desired").cast("long")), F.col("n") - 1))
              .withColumn("remainder", F.col("desired") - F.floor("desired")))
    allocated = F.sum("base").over(Window.partitionBy(F.lit(1)))
    b = b.withColumn("__alloc", allocated)
    up = Window.orderBy(F.desc("remainder"), F.desc("n"), F.asc(bucket_col)).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.asc("remainder"), F.asc("n"), F.asc(bucket_col)).rowsBetween(Window.unboundedPreceding, 0)
    can_add = F.col("base") < F.col("n") - 1
    can_drop = F.col("base") - F.col("minimum") > 0
    b = (b.withColumn("__add_rank", F.sum(can_add.cast("int")).over(up))
          .withColumn("__drop_rank", F.sum(can_drop.cast("int")).over(down)))
    short = F.lit(e) - F.col("__alloc")
    over = F.col("__alloc") - F.lit(e)
    quota = (F.when((short > 0) & can_add & (F.col("__add_rank") <= short), F.col("base") + 1)
              .when((over > 0) & can_drop & (F.col("__drop_rank") <= over), F.col("base") - 1)
              .otherwise(F.col("base")))
    return b.select(bucket_col, "n", "desired", "remainder", "minimum", quota.cast("long").alias("quota"))


def stratified_split(prepared: DataFrame, id_col: str = "id", length_col: str = "combined_chars",
                     prompt_col: str = "prompt", markup_col: str = "svg_norm", e: int | None = None) -> DataFrame:
    """W1-W5 + J6: every row with ``split`` = 'eval' or 'train' (one pass, no anti-join).

    Frame order is (length, id) — the reference's unstable sort is made total by id.
    The wide input is written once: the length-order index (H1) checkpoints it, so
    the canonicaliser upstream runs once and every later read (count, edges,
    buckets) comes from the checkpoint.  The bucket-order index runs on a narrow
    projection (position, bucket, length, id).
    """
    spark = prepared.sparkSession
    checkpoint_dir(spark)
    # f: position in the length order (checkpointed, wide); n comes with it
    frame, n = with_global_index(prepared, [length_col, id_col], "__f", return_count=True)
    e = eval_size(n) if e is None else e
    edges = length_edges(frame, length_col)
    frame = with_split_bucket(with_length_bin(frame, edges, length_col), prompt_col, markup_col)
    # g: position in the (bucket, length) order, on four narrow columns only
    narrow = with_global_index(frame.select("__f", "split_bucket", length_col, id_col),
                               ["split_bucket", length_col, id_col], "__g").select("__f", "__g", "split_bucket")
    sizes = narrow.groupBy("split_bucket").agg(F.count(F.lit(1)).alias("n"))
    # W3 on the bucket table (<= 45 rows), read once
    quota = bucket_quota(sizes, e).collect()
    # Spaced positions inside each bucket, as global positions g (<= e + 45 values)
    start, picks = 0, []
    for q in sorted(quota, key=lambda r: r["split_bucket"]):
        if q["quota"] > 0:
            picks.extend(start + p for p in sorted(set(spaced_positions_list(q["n"], q["quota"]))))
        start += q["n"]
    if len(picks) > e + len(quota):
        raise ValueError("spaced picks exceed their bound")
    pick_df = spark.createDataFrame([(int(g),) for g in picks], "__g long")
    picked = sorted(r["__f"] for r in narrow.join(F.broadcast(pick_df), "__g", "left_semi").select("__f").collect())
    chosen = set(picked)
    if len(picked) < e:
        # Evenly spaced top-up over the unpicked rows in frame order; rank r among
        # unpicked rows maps to f = r + #(picked i with f_i - i <= r)
        need = e - len(picked)
        keys = [f - i for i, f in enumerate(picked)]
        j = 0
        for r in sorted(set(spaced_positions_list(n - len(picked), need))):
            while j < len(keys) and keys[j] <= r:
                j += 1
            chosen.add(r + j)
    # sort by frame position, cut to e (at most e rows are broadcast back)
    final = sorted(chosen)[:e]
    chosen_df = spark.createDataFrame([(int(f), True) for f in final], "__f long, __eval boolean")
    out = frame.join(F.broadcast(chosen_df), "__f", "left")
    out = out.withColumn("split", F.when(F.col("__eval"), F.lit("eval")).otherwise(F.lit("train")))
    return out.drop("__eval").withColumnRenamed("__f", "frame_pos")


def spaced_positions_list(n: int, k: int) -> list:
    """``linspace(0, n-1, k)`` truncated to int in doubles (as :func:`spaced_positions`)."""
    if k <= 0 or n <= 0:
        return []
    if k == 1:
        return [0]
    step = float(n - 1) / float(k - 1)
    return [n - 1 if i == k - 1 else int(i * step // 1) for i in range(k)]


def long_context_subset(split_df: DataFrame, length_col: str = "combined_chars", id_col: str = "id",
                        fraction: float = K.LONG_CONTEXT_FRACTION) -> DataFrame:
    """W13 per split: train keeps max(4096, 0.3n) longest rows, eval max(128, max(0.3, 0.25) n)."""
    from inkstone.operators.order import longest_rows
    tr = longest_rows(split_df.filter(F.col("split") == "train"), length_col, id_col, fraction, K.LONG_CONTEXT_MIN_TRAIN)
    ev = longest_rows(split_df.filter(F.col("split") == "eval"), length_col, id_col, max(fraction, 0.25),
                      K.LONG_CONTEXT_MIN_EVAL)
    return tr.unionByName(ev)
