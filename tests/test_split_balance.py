"""Split and balance invariants on the built corpus."""

import pytest
from pyspark.sql import functions as F

from inkstone.operators.balance import allot_draws, weighted_oversample, with_rarity_weight
from inkstone.operators.split import bucket_quota, eval_size, stratified_split
from inkstone.plans.corpus import prepare_corpus
from inkstone.sources import standins as S

from paths import SF_CHECK


def test_eval_size_bounds():
    with pytest.raises(ValueError):
        eval_size(1)
    assert eval_size(2) == 1 and eval_size(500) == 128 and eval_size(10_000) == 200 and eval_size(10 ** 7) == 1000


def test_quota_sums(spark):
    sizes = spark.createDataFrame([("a", 19), ("b", 20), ("c", 500), ("d", 3)], "split_bucket string, n long")
    q = {r.split_bucket: r.quota for r in bucket_quota(sizes, 128).collect()}
    assert sum(q.values()) == 128 and q["b"] >= 1 and all(q[k] <= n - 1 for k, n in [("a", 19), ("b", 20), ("d", 3)])


@pytest.fixture(scope="module")
def prepared(spark):
    return prepare_corpus(S.markup_pairs(spark, SF_CHECK)).cache()


def test_split_is_a_partition(spark, prepared):
    sp = stratified_split(prepared).cache()
    ids = prepared.select("id")
    train = sp.filter("split = 'train'").select("id")
    ev = sp.filter("split = 'eval'").select("id")
    assert ev.count() == eval_size(prepared.count())
    assert train.intersect(ev).count() == 0
    assert ids.exceptAll(train.unionByName(ev)).count() == 0 and train.unionByName(ev).exceptAll(ids).count() == 0


def test_split_independent_of_partitioning(spark, prepared):
    a = stratified_split(prepared.repartition(1)).filter("split = 'eval'").select("id")
    b = stratified_split(prepared.repartition(7)).filter("split = 'eval'").select("id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_oversample_count_and_determinism(spark, prepared):
    w = with_rarity_weight(prepared, "prompt")
    n = prepared.count()
    extra = weighted_oversample(w, "weight", "id")
    assert extra.count() == int(n * 0.3)
    again = weighted_oversample(w.repartition(3), "weight", "id")
    assert extra.select("id").exceptAll(again.select("id")).count() == 0
    assert weighted_oversample(w, "weight", "id", factor=0.0).count() == 0


def test_allot_draws():
    # equal remainders: the heavier class gets the extra draw
    assert allot_draws([(1.0, 10), (2.0, 5)], 7) == [3, 4]
    assert sum(allot_draws([(1.0, 3), (1.5, 4), (3.0, 1)], 11)) == 11


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "id string, prompt string, svg_norm string, combined_chars long")


def test_two_rows_and_one_distinct_length(spark):
    two = stratified_split(_pairs(spark, [("a", "p", "<svg/>", 10), ("b", "q", "<svg/>", 10)]))
    got = {r.id: (r.split, r.length_bin) for r in two.collect()}
    assert sorted(s for s, _ in got.values()) == ["eval", "train"]      # eval size n - 1 = 1
    assert {b for _, b in got.values()} == {0}                          # one distinct length -> bin 0


def test_quota_surplus_and_shortfall(spark):
    # surplus: buckets of >= 20 rows keep their floor of 1 even above the eval size
    # (the final sorted cut trims the picks to e)
    sizes = spark.createDataFrame([(f"b{i}", 20) for i in range(6)], "split_bucket string, n long")
    assert [r.quota for r in bucket_quota(sizes, 3).collect()] == [1] * 6
    sizes = spark.createDataFrame([("a", 40), ("b", 30), ("c", 30)], "split_bucket string, n long")
    q = {r.split_bucket: r.quota for r in bucket_quota(sizes, 2).collect()}
    assert q == {"a": 1, "b": 1, "c": 1}     # 0.8, 0.6, 0.6 -> floors of 1, nothing removable
    # shortfall with remainder ties: +1 goes to larger buckets first, then by name
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "split_bucket string, n long")
    q = {r.split_bucket: r.quota for r in bucket_quota(sizes, 4).collect()}
    assert q == {"a": 2, "b": 1, "c": 1}


def test_topup_fills_short_buckets(spark):
    # one bucket of 3 rows cannot give more than 2; the top-up takes the rest evenly
    rows = [(f"{i:03d}", "p", "<svg/>", 100 + i) for i in range(3)] + \
           [(f"x{i:03d}", "icon set logo many", "<svg/>", 100 + i) for i in range(30)]
    sp = stratified_split(_pairs(spark, rows), e=20)
    assert sp.filter("split = 'eval'").count() == 20
