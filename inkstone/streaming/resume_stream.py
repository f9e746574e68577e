"""The resumable job on arriving files, as Structured Streaming.

``readStream`` (file source) -> ``foreachBatch``: inside each micro-batch the rows
are de-duplicated by id and anti-joined against the ids already finished
(F7; an index by id hash, so that a batch reads only the buckets of its own ids),
the job runs, and the output goes to a folder named by the batch id with
``overwrite`` — a replayed batch rewrites exactly its own folder, so the sink is
exactly-once.  Progress lives in ``checkpointLocation`` on the shared checkpoint
directory; no state grows with the stream.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.operators.finished import FinishedIds
from inkstone.operators.resume import dedupe_in_batch, has_data, latest_per_id


def resume_stream(spark: SparkSession, source_dir: str, schema: T.StructType, job: Callable[[DataFrame], DataFrame],
                  sink_dir: str, checkpoint_location: str, id_col: str = "id",
                  max_files_per_trigger: int | None = None, order_col: str | None = None,
                  index_dir: str | None = None) -> DataFrame:
    """Run ``job`` over every file in ``source_dir`` not processed yet; return all results
    (latest per id).  ``trigger(availableNow=True)`` processes what is there and stops,
    so a restart resumes from the checkpoint without redoing finished rows.
    ``order_col`` says which row of an id a batch keeps (the first); without it the rows
    of an id must be equal.  ``max_files_per_trigger`` bounds a micro-batch (default: all files).
    ``index_dir`` holds the index of finished ids (default: beside the checkpoint); results that
    were written without one are indexed first.
    """
    index = FinishedIds(spark, index_dir or checkpoint_location.rstrip("/") + "-finished")
    key = F.col(id_col).cast("string").alias("id")
    if index.current() is None and has_data(spark, sink_dir):
        # each under its own batch number, since a first batch may have broken off before it was indexed
        index.adopt(spark.read.parquet(sink_dir).select(key, F.col("run_seq").alias("batch")))

    def process(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch must not count its own earlier (partial) output as
        # finished: that partition is about to be overwritten
        rows = index.pending(dedupe_in_batch(batch, id_col, order_col), id_col, int(batch_id))
        out = job(rows).withColumn("run_seq", F.lit(int(batch_id)))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_seq").parquet(sink_dir))
        written = f"{sink_dir.rstrip('/')}/run_seq={int(batch_id)}"
        if has_data(spark, written):
            index.add(spark.read.schema(out.drop("run_seq").schema).parquet(written).select(key), int(batch_id))

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    query = (stream.writeStream.foreachBatch(process)
             .option("checkpointLocation", checkpoint_location)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if not has_data(spark, sink_dir):  # nothing arrived yet
        return job(spark.createDataFrame([], schema)).limit(0)
    return latest_per_id(spark.read.parquet(sink_dir), id_col, "run_seq").drop("run_seq")
