"""No task's share of the work grows with the table: dealt out rows, one run of the leaf, narrow shuffles."""

from pyspark.sql import functions as F

from inkstone.operators import evaluate as EV
from inkstone.operators import rank as RK
from inkstone.plans import registry as G
from inkstone.sources import standins as S

from paths import SF_SMALL


def nodes(plan):
    found, todo = [], [plan]
    while todo:
        found.append(node := todo.pop())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_rows_that_grow_into_documents_are_dealt_to_many_tasks(spark, tmp_path):
    n = 2 * S.ROWS_PER_TASK + 5_000
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("red lamp").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    cands = S.candidates(spark, str(tmp_path))
    rows = cands.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("prompt_id").alias("n")).collect()
    assert len(rows) >= 3 and max(r.n for r in rows) <= S.ROWS_PER_TASK
    assert cands.select("prompt_id", "seq").distinct().count() == sum(i % 4 + 1 for i in range(n))


def test_dedupe_shuffles_hashes_not_texts(spark):
    rows = [("a", 0, "x"), ("a", 1, "x"), ("a", 2, ""), ("a", 3, "y"), ("b", 0, ""), ("b", 1, None), ("b", 2, "")]
    df = spark.createDataFrame(rows, "prompt_id string, seq int, markup string")
    out = RK.dedupe_candidates(df, "prompt_id", "markup", "seq")
    assert sorted((r.prompt_id, r.seq) for r in out.collect()) == [("a", 0), ("a", 3), ("b", 0), ("b", 1), ("b", 2)]
    plan = out.select("prompt_id", "seq")._jdf.queryExecution().optimizedPlan()
    windows = [n for n in nodes(plan) if n.nodeName() == "Window"]
    assert windows and not any("markup#" in n.output().toString() for n in windows)


def test_buckets_run_the_leaf_once(spark):
    for name in ("split_bucket", "bucket_sizes", "bucket_quota", "distinct_count", "length_bins"):
        assert "MapInArrow" not in G.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_checkpoints_are_listed_without_the_leaf(spark, monkeypatch):
    listed, pair = [], EV.pred_vs_ref

    def watched(preds, refs, id_col="id", ckpt_col="checkpoint", checkpoints=None):
        listed.append(preds if checkpoints is None else checkpoints)
        return pair(preds, refs, id_col, ckpt_col, checkpoints)
    monkeypatch.setattr(EV, "pred_vs_ref", watched)
    G.QUERIES["tag_count_align"](spark, SF_SMALL)
    G.QUERIES["evaluate_predictions"](spark, SF_SMALL)
    assert len(listed) == 2 and not any("MapInArrow" in d._jdf.queryExecution().executedPlan().toString() for d in listed)


def test_stream_source_keeps_the_splits_of_its_table(spark, tmp_path, monkeypatch):
    from inkstone.streaming import resume_stream as N
    docs = spark.range(240).select(F.col("id").alias("doc_id"), F.lit("Some words").alias("text"))
    docs.repartition(24).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # one file a split
    sizes, run = [], N.resume_stream

    def watched(spark, src, *rest):
        sizes.extend(r.n for r in spark.read.parquet(src).groupBy(F.input_file_name().alias("f")).agg(F.count("id").alias("n")).collect())
        return run(spark, src, *rest)
    monkeypatch.setattr(N, "resume_stream", watched)
    try:
        assert G.QUERIES["resume_stream"](spark, str(tmp_path)).count() == 240
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(sizes) == 243 and max(sizes) <= 20
