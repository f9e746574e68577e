"""Incremental work: pending rows (F7), resumable batch runs (N1), coverage guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import text as TX


def pending_rows(todo: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """rows of ``todo`` whose id (as string) is not in ``done``.  A left-anti join:
    AQE broadcasts ``done`` when it is small, else both sides shuffle on the id."""
    key = F.col(id_col).cast("string")
    d = done.select(key.alias("__id"))  # an anti-join needs no distinct keys
    return todo.join(d, todo[id_col].cast("string") == d["__id"], "left_anti")


def latest_per_id(results: DataFrame, id_col: str = "id", order_col: str = "run_seq") -> DataFrame:
    """N1 read side: one row per id (string), the latest by ``order_col``.

    ``max_by`` is a partial aggregate, so a repeated id never piles up in one task.
    """
    cols = [c for c in results.columns]
    packed = F.struct(*[F.col(c) for c in cols])
    key = F.col(id_col).cast("string")
    return results.groupBy(key.alias("__id")).agg(F.max_by(packed, F.col(order_col)).alias("__r")).select("__r.*")


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder that holds at least one Parquet file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return False
    files = fs.listFiles(p, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def resume_batch(todo: DataFrame, job, results_path: str, id_col: str = "id", run_seq: int | None = None,
                 partition_col: str = "run_seq") -> DataFrame:
    """Run ``job`` on the rows not finished yet and append its output.

    Finished results live in a Parquet folder partitioned by ``run_seq``; each run
    writes only its own partition (``overwrite`` of that partition is idempotent
    if a run is repeated after a failure).  Returns all results, latest per id.
    """
    spark = todo.sparkSession
    # only a folder without data files means "no earlier results"; an unreadable file is an error
    done = spark.read.parquet(results_path) if has_data(spark, results_path) else None
    prev = done.agg(F.max(partition_col)).collect()[0][0] if done is not None else None
    seq = run_seq if run_seq is not None else (0 if prev is None else int(prev) + 1)
    if done is not None:
        # a repeated run rewrites its own partition: its earlier output is not "finished"
        done = done.filter(F.col(partition_col) != seq)
    rest = pending_rows(todo, done, id_col) if done is not None else todo
    out = job(rest).withColumn(partition_col, F.lit(seq))
    schema = out.schema if done is None else done.schema  # a first run without rows writes no file to infer from
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_col).parquet(results_path))
    return latest_per_id(spark.read.schema(schema).parquet(results_path), id_col, partition_col)


def coverage_guard(test: DataFrame, results: DataFrame, id_col: str = "id", prompt_col: str = "prompt",
                   markup_col: str = "svg") -> DataFrame:
    """Every test id gets exactly one result; missing ones get the prompt's fallback."""
    r = results.select(F.col(id_col).cast("string").alias("__id"), F.col(markup_col).alias("__m"))
    t = test.select(F.col(id_col), F.col(prompt_col))
    joined = t.join(r, t[id_col].cast("string") == r["__id"], "left")
    return joined.select(id_col, F.coalesce(F.col("__m"), TX.fallback_markup(F.col(prompt_col))).alias(markup_col),
                         F.col("__m").isNull().alias("used_fallback"))


def dedupe_in_batch(batch: DataFrame, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """Keep one row per id inside a micro-batch (first by ``order_col`` when given)."""
    if order_col is None:
        return batch.dropDuplicates([id_col])
    w = Window.partitionBy(id_col).orderBy(order_col)
    return batch.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
