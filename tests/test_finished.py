"""The index of finished ids: touched buckets only, doubling, replays; and the stream that uses it."""
from pyspark.sql import functions as F

from inkstone.operators.finished import FinishedIds
from inkstone.sources import io as IO
from inkstone.streaming.resume_stream import resume_stream


def ids(spark, numbers):
    return spark.createDataFrame([(str(i),) for i in numbers], "id string")


def test_batch_reads_only_its_buckets_whatever_is_finished(spark):
    index = FinishedIds(spark, IO.scratch_path(spark, "finished"), target=50)
    read = []
    for batch, (low, high) in enumerate([(0, 40), (40, 400), (400, 1600), (1600, 6400)]):
        index.add(ids(spark, range(low, high)), batch)
        done = index.finished(ids(spark, [3, 7, high - 1]))
        read.append(done.count())
        assert {r.id for r in done.collect()} >= {"3", "7", str(high - 1)}
        left = index.pending(ids(spark, [3, high - 1, high, 10 ** 6]))
        assert {r.id for r in left.collect()} == {str(high), str(10 ** 6)}
    assert index.current()[1] == 7 and max(read) <= 3 * 2 * 50 < 6400
    assert [n for n in index._names(index.root) if n.startswith("ids-")] == [index._folder(*index.current()).rsplit("/", 1)[1]]


def test_replayed_batch_replaces_its_own_ids(spark):
    root = IO.scratch_path(spark, "finished")
    FinishedIds(spark, root, target=10).add(ids(spark, range(8)), 0)
    index = FinishedIds(spark, root, target=10)
    index.add(ids(spark, range(8, 30)), 1)  # doubles the buckets
    index = FinishedIds(spark, root, target=10)  # a later session
    assert index.current() == (1, 2)
    assert {r.id for r in index.pending(ids(spark, range(32)), batch=1).collect()} == {str(i) for i in range(8, 32)}
    index.add(ids(spark, range(8, 30)), 1)
    everything = index.finished(ids(spark, range(100)))
    assert everything.count() == 30 and {r.id for r in index.pending(ids(spark, range(32))).collect()} == {"30", "31"}


def test_empty_batches_nulls_and_broken_generations(spark):
    index = FinishedIds(spark, IO.scratch_path(spark, "finished"), target=5)
    todo = spark.createDataFrame([(1, "a"), (None, "b")], "id long, x string")
    assert index.current() is None and index.pending(todo).count() == 2
    index.add(ids(spark, []), 0)
    assert index.pending(todo).count() == 2
    index.add(ids(spark, range(4)), 1)
    # a generation without its marker was broken off
    ids(spark, ["x"]).withColumns({"bucket": F.lit(0), "batch": F.lit(9)}).write.partitionBy("bucket", "batch").parquet(index._folder(7, 3))
    assert index.current() == (0, 0)
    assert [r.x for r in index.pending(todo).collect()] == ["b"]


def test_stream_resumes_with_and_without_an_index(spark):
    base = IO.scratch_path(spark, "stream")
    rows = lambda low, high: spark.range(low, high).select("id", F.concat(F.lit("v"), "id").alias("v"))
    done = []

    def job(df):
        done.append(df.count())
        return df.withColumn("out", F.upper("v"))
    rows(0, 30).coalesce(1).write.mode("append").parquet(base + "/in")
    args = (spark, base + "/in", spark.range(0).select("id", F.lit("").alias("v")).schema, job, base + "/out", base + "/ckpt")
    assert resume_stream(*args).count() == 30
    rows(20, 50).coalesce(1).write.mode("append").parquet(base + "/in")
    assert resume_stream(*args).count() == 50 and done == [30, 20]
    # the sink alone: its rows are indexed under their own batches, which a replay replaces
    rows(0, 50).coalesce(1).write.parquet(base + "/more")
    done.clear()
    again = resume_stream(spark, base + "/more", args[2], job, base + "/out", base + "/ckpt2")
    assert again.count() == 50 and done == [30]


def test_adopted_results_count_as_finished(spark):
    index = FinishedIds(spark, IO.scratch_path(spark, "finished"), target=10)
    index.adopt(ids(spark, range(35)).withColumn("batch", F.col("id").cast("long") % 2))
    assert index.current() == (0, 2)
    assert {r.id for r in index.pending(ids(spark, range(36)), batch=1).collect()} == {str(i) for i in range(36) if i % 2 or i == 35}
    index.add(ids(spark, range(35, 60)), 2)
    assert index.current() == (1, 3) and index.pending(ids(spark, range(60))).count() == 0
