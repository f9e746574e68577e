"""Sources and resume: NA words, quoted multi-line CSV, resumable runs."""

from pyspark.sql import functions as F

from inkstone.operators import resume as RS
from inkstone.sources import io as IO


def test_read_pairs_na_words_and_quotes(spark):
    rows = [("1", "None", "<svg>\n</svg>"), ("2", "NA", 'say "hi"'), ("3", "", "x"), ("4", "a, b", "line1\r\nline2")]
    df = spark.createDataFrame(rows, "id string, prompt string, svg string")
    path = IO.write_pairs(df, IO.scratch_path(spark, "t-pairs"))
    back = {r.id: r for r in IO.read_pairs(spark, path).collect()}
    assert back["1"].prompt is None and back["2"].prompt is None and back["3"].prompt is None
    assert back["1"].svg == "<svg>\n</svg>" and back["2"].svg == 'say "hi"' and back["4"].prompt == "a, b"
    assert back["4"].svg == "line1\r\nline2"


def test_resume_runs(spark):
    todo = spark.createDataFrame([(str(i), i) for i in range(10)], "id string, v long")
    path = IO.scratch_path(spark, "t-resume")
    calls = []

    def job(rows):
        calls.append(rows.count())
        return rows.select("id", (F.col("v") * 2).alias("w"))

    first = RS.resume_batch(todo.filter("v < 4"), job, path)     # no earlier file
    assert first.count() == 4
    again = RS.resume_batch(todo, job, path)                      # only the 6 missing rows run
    assert calls == [4, 6] and again.count() == 10
    assert sorted(r.w for r in again.collect()) == [i * 2 for i in range(10)]


def test_pending_rows_compare_as_strings(spark):
    todo = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = spark.createDataFrame([("1",), ("3",), ("3",)], "id string")
    assert [r.id for r in RS.pending_rows(todo, done).collect()] == [2]


def test_coverage_guard(spark):
    test = spark.createDataFrame([("a", "red circle"), ("b", "blue")], "id string, prompt string")
    res = spark.createDataFrame([("a", "<svg/>")], "id string, svg string")
    out = {r.id: r for r in RS.coverage_guard(test, res).collect()}
    assert not out["a"].used_fallback and out["b"].used_fallback and 'fill="#1e88e5"' in out["b"].svg


def test_stream_replay_keeps_rows(spark):
    """A micro-batch replayed after a partial write still produces all of its rows."""
    from inkstone.streaming.resume_stream import resume_stream
    src = IO.scratch_path(spark, "t-src")
    spark.createDataFrame([(str(i), i) for i in range(20)], "id string, v long").repartition(2).write.parquet(src)
    sink = IO.scratch_path(spark, "t-sink")
    # simulate a failed attempt of batch 0 that already wrote some rows
    spark.createDataFrame([(str(i), i * 2, 0) for i in range(5)], "id string, w long, run_seq int") \
        .write.partitionBy("run_seq").parquet(sink)

    def job(rows):
        return rows.select("id", (F.col("v") * 2).alias("w"))

    out = resume_stream(spark, src, "id string, v long", job, sink, IO.scratch_path(spark, "t-ck"), "id",
                        max_files_per_trigger=100)
    assert sorted(int(r.id) for r in out.collect()) == list(range(20))
