"""Index of finished ids for incremental work: a micro-batch reads only the buckets that its ids fall into.

Ids are dealt by hash to 2 ** depth buckets of ``root/ids-<generation>-<depth>/bucket=/batch=``.  When the
buckets hold more than ``target`` ids on average, the next generation is written with twice as many (its older batches
merged), so a bucket stays about as large as it was and what a batch reads depends on its own ids, not on
how many are finished.  Each id is rewritten once per doubling, and a constant number of times in all on average.

A batch owns its partitions, so adding it again replaces what it added.  A generation counts from the moment its
``_FINISHED`` file exists (Spark writes no marker of its own when it overwrites single partitions); one that was broken off is written anew.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators.resume import pending_rows

TARGET = 1_000_000
MAX_DEPTH = 16
MERGED = -1


class FinishedIds:
    """The index under ``root``, opened anew or continued."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def current(self) -> tuple[int, int] | None:
        """(generation, depth) of the newest finished generation."""
        found = [(int(m[1]), int(m[2])) for m in (re.fullmatch(r"ids-(\d+)-(\d+)", n) for n in self._names(self.root)) if m]
        for generation, depth in sorted(found, reverse=True):
            if self._fs.exists(self._path(f"{self._folder(generation, depth)}/_FINISHED")):
                return generation, depth
        return None

    def _folder(self, generation: int, depth: int) -> str:
        return f"{self.root}/ids-{generation}-{depth}"

    @staticmethod
    def _bucket(depth: int):
        return F.pmod(F.xxhash64("id"), F.lit(1 << depth)).cast("int")

    def _read(self, folder: str, paths: list[str]) -> DataFrame:
        return (self.spark.read.schema("id string, bucket int, batch long").option("basePath", folder).parquet(*paths))

    def finished(self, ids: DataFrame, batch: int | None = None) -> DataFrame | None:
        """The finished ids in the buckets of ``ids`` (one string column ``id``), without those of ``batch``; None if
        there are none.  At most 2 ** MAX_DEPTH bucket numbers reach the driver."""
        now = self.current()
        if now is None:
            return None
        folder = self._folder(*now)
        touched = {r[0] for r in ids.select(self._bucket(now[1]).alias("b")).distinct().collect()}
        paths = [f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=") and int(n[7:]) in touched]
        if not paths:
            return None
        rows = self._read(folder, paths)
        return rows.filter(F.col("batch") != batch).select("id") if batch is not None else rows.select("id")

    def pending(self, rows: DataFrame, id_col: str = "id", batch: int | None = None) -> DataFrame:
        """``rows`` whose id (as string) is not finished, reading only their buckets."""
        done = self.finished(rows.select(F.col(id_col).cast("string").alias("id")), batch)
        return rows if done is None else pending_rows(rows, done.withColumnRenamed("id", id_col), id_col)

    def add(self, ids: DataFrame, batch: int) -> None:
        """Add the ids (one string column ``id``) of a batch, in place of what it added before."""
        generation, depth = self.current() or (0, 0)
        folder = self._folder(generation, depth)
        self._write(ids, F.lit(batch).cast("long"), depth, folder)
        size = self.spark.createDataFrame([(int(batch), self._size(folder, batch))], "batch long, rows long")
        size.coalesce(1).write.mode("overwrite").json(f"{self.root}/sizes/of-{int(batch)}")
        total = self.spark.read.schema("batch long, rows long").json(f"{self.root}/sizes/of-*").agg(F.sum("rows")).first()[0] or 0
        deeper = depth
        while total > self.target << deeper and deeper < MAX_DEPTH:
            deeper += 1
        if deeper > depth:
            old = self._read(folder, [folder])
            kept = F.when(F.col("batch") == batch, F.col("batch")).otherwise(F.lit(MERGED))
            self._write(old.select("id", kept.alias("batch")), F.col("batch"), deeper, self._folder(generation + 1, deeper))
            self._fs.delete(self._path(folder), True)

    def adopt(self, rows: DataFrame) -> None:
        """Start an index from the finished rows (id, batch) of a sink that has none."""
        total, depth = rows.count(), 0
        while total > self.target << depth and depth < MAX_DEPTH:
            depth += 1
        self._write(rows.select("id", F.col("batch").cast("long").alias("batch")), F.col("batch"), depth, self._folder(0, depth))
        size = self.spark.createDataFrame([(MERGED, total)], "batch long, rows long")
        size.coalesce(1).write.mode("overwrite").json(f"{self.root}/sizes/of-{MERGED}")

    def _size(self, folder: str, batch: int) -> int:
        return self._read(folder, [folder]).filter(F.col("batch") == batch).count()

    def _write(self, ids: DataFrame, batch, depth: int, folder: str) -> None:
        rows = ids.select("id", self._bucket(depth).alias("bucket"), batch.alias("batch"))
        # a bucket may be large: rows are dealt by id, and small buckets still gather in few files
        rows.repartition("bucket", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4))).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(folder)
        self._fs.create(self._path(f"{folder}/_FINISHED"), True).close()
