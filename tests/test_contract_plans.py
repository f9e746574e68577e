"""Driver contract and plan shape checks."""

import __spark_entry__ as E
from inkstone.plans import registry as G

from paths import SF_CHECK, SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "mean_chars" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 80


def test_filter_below_python_leaf(spark):
    from inkstone.plans.corpus import prepare_corpus
    from inkstone.sources import standins as S
    p = prepare_corpus(S.markup_pairs(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    leaf = p.index("MapInArrow")
    assert p.index("Filter", leaf) > leaf        # the length filter sits below (after, in tree text) the leaf


def test_leaf_keeps_ids(spark):
    from inkstone.operators.markup import canonicalise
    big = 9007199254740993
    df = spark.createDataFrame([(big, "<svg><rect width='1' height='1' fill='red'/></svg>"), (None, "x")], "id bigint, t string")
    out = canonicalise(df, "t", "m")
    assert {r.id for r in out.collect()} == {big, None}  # a null beside it does not round the id


def test_markup_stats_has_no_shuffle(spark):
    txt = plan(G.QUERIES["markup_stats"](spark, SF_SMALL))
    assert "Exchange" not in txt


def test_pruned_read(spark):
    txt = plan(G.QUERIES["read_pruned"](spark, SF_SMALL))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in txt


def test_dedupe_is_partial_aggregate(spark):
    txt = plan(G.QUERIES["dedupe_documents"](spark, SF_SMALL))
    assert "partial_min_by" in txt.replace(" ", "") or "partial_min_by" in txt


def test_rank_runs_the_leaf_once_per_input(spark):
    txt = plan(G.QUERIES["rank_candidates"](spark, SF_SMALL))
    assert txt.count("MapInArrow") == 2          # generated candidates + retrieval corpus


def test_global_index_dense_and_ordered(spark):
    from pyspark.sql import functions as F
    from inkstone.operators.index import with_global_index
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id")).repartition(37)
    out, n = with_global_index(df, ["k", "id"], "i", partitions=23, return_count=True)
    rows = sorted((r.k, r.id, r.i) for r in out.collect())
    assert n == 5000 and [r[2] for r in rows] == list(range(5000))


def test_one_leaf_in_corpus_job(spark):
    assert plan(G.QUERIES["prepare_corpus"](spark, SF_SMALL)).count("MapInArrow") == 1


def test_positions_independent_of_partitioning(spark):
    from inkstone.operators.order import fixed_batches, seeded_shuffle
    d = spark.read.parquet(SF_SMALL + "/documents.parquet").select("doc_id", "n_chars")
    a = {r.doc_id: r.idx for r in seeded_shuffle(d.repartition(1), "doc_id").collect()}
    b = {r.doc_id: r.idx for r in seeded_shuffle(d.repartition(9), "doc_id").collect()}
    assert a == b and sorted(a.values()) == list(range(len(a)))
    x = {r.doc_id: r.batch_id for r in fixed_batches(d.repartition(3), 16, ["n_chars", "doc_id"]).collect()}
    y = {r.doc_id: r.batch_id for r in fixed_batches(d.repartition(5), 16, ["n_chars", "doc_id"]).collect()}
    assert x == y
