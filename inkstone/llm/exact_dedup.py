"""Operator 1: exact dedup against a persistent digest index.

The index is a table in the shared folder, bucketed and sorted by the SHA-256 of the
normalised text.  A batch is first reduced to its best row per digest (partial
aggregation, so a text held by a third of all rows leaves one row per map task) and
written bucketed and sorted like the index, then sort-merge anti-joined with the index
bucket by bucket, without a shuffle of either side.  What survives is appended.  An appended row with a digest that the index
already has supersedes the older one: it is only appended when it is better (more
code points, then smaller id).  Only digests, ids and lengths are ever shuffled.

Defined results: a null text counts as empty; all empty and blank texts are one
group; a null id loses every tie; rows that repeat an id with an equal text are all
flagged like the row that stays; an empty table gives no rows.  Only the id and the
text column are read, so other columns may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import ASCII_SPACE, attach, id_column, materialise
from inkstone.sources.io import scratch_path


def normal_text(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, text_sha256): one narrow row per row of ``df``."""
    text = id_column(df, text_col)
    return df.select(id_column(df, id_col).cast("long").alias("doc_id"),
                     F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"),
                     F.sha2(normal_text(text), 256).alias("text_sha256"))


def best_per_digest(rows: DataFrame) -> DataFrame:
    """Most code points, then smallest id.  ``~id`` falls as the id grows and cannot overflow."""
    top = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("neg"))).alias("top")
    return rows.groupBy("text_sha256").agg(top).select(
        "text_sha256", F.bitwise_not("top.neg").alias("keep_id"), F.col("top.n_chars").alias("keep_chars"))


class DigestIndex:
    """The persistent index: (text_sha256, keep_id, keep_chars), bucketed and sorted by text_sha256.

    ``path`` names a folder that all executors share; opening the path of an existing
    index in a later session continues it with the bucket number it was made with, whatever ``buckets`` says.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark = spark
        self.path = path or scratch_path(spark, "digest-index")
        self.buckets = self._made_with(buckets)
        self.table = self._open(self.path)

    def _made_with(self, buckets: int) -> int:
        """The bucket number that the index was made with, which is kept in a file name beside its data; ``buckets``
        for a new one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path
        files = folder(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(folder(self.path))] if files.exists(folder(self.path)) else []
        kept = [int(n[len("_buckets-"):]) for n in names if n.startswith("_buckets-")]
        if not kept:
            files.create(folder(f"{self.path}/_buckets-{buckets}"), True).close()
        return kept[0] if kept else buckets

    def _open(self, path: str) -> str:
        name = f"digests_{uuid.uuid4().hex}"
        self.spark.sql(f"""CREATE TABLE {name} (text_sha256 STRING, keep_id BIGINT, keep_chars BIGINT)
                           USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS
                           LOCATION '{path}'""")
        return name

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def current(self) -> DataFrame:
        """The row that stays, per digest; later appends supersede earlier ones."""
        return best_per_digest(self.rows().select("text_sha256", F.col("keep_id").alias("doc_id"),
                                                  F.col("keep_chars").alias("n_chars")))

    def stage(self, batch: DataFrame) -> DataFrame:
        """The best row of each digest of ``batch``, written bucketed and sorted like the index."""
        name = self._open(scratch_path(self.spark, "digest-batch"))
        bucket = F.pmod(F.hash("text_sha256"), F.lit(self.buckets))  # Spark's own bucket number: one file per bucket
        best = best_per_digest(batch).repartitionById(self.buckets, bucket).sortWithinPartitions("text_sha256")
        best.write.insertInto(name)
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def unseen(self, staged: DataFrame) -> DataFrame:
        """Staged rows whose digest the index lacks or has only a worse row for; neither side is shuffled."""
        best, old = staged.alias("b"), self.rows().alias("i")
        covers = (F.col("i.keep_chars") > F.col("b.keep_chars")) | (
            (F.col("i.keep_chars") == F.col("b.keep_chars"))
            & (F.col("b.keep_id").isNull() | (F.col("i.keep_id") <= F.col("b.keep_id"))))
        return best.join(old.hint("merge"), (F.col("b.text_sha256") == F.col("i.text_sha256")) & covers, "left_anti")

    def add(self, batch: DataFrame) -> None:
        """Deduplicate a batch of fingerprints against the index and append the survivors, bucket by bucket."""
        self.unseen(self.stage(batch)).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def exact_dedup(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text",
                loads: int = 1) -> DataFrame:
    """Add ``df`` to ``index`` in ``loads`` batches and say of each row which row stays for its text.

    Returns doc_id, n_chars, text_sha256, keep_id, group_size (rows of ``df`` with this
    text), kept.  A row whose text an earlier batch or session already brought in at
    least as good a form is not kept; its keep_id names the older row.
    """
    rows = materialise(fingerprints(df, id_col, text_col), "fingerprints")
    for k in range(loads):
        index.add(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(loads)) == k) if loads > 1 else rows)
    sizes = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    summary = materialise(sizes.join(index.current(), "text_sha256"), "digest-groups")
    out = attach(rows, summary, "text_sha256", "group_size", rows.count())
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
