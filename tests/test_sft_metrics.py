"""Masking and metric edge cases."""

from pyspark.sql import functions as F

from inkstone.functions import image as IM
from inkstone.operators import sft as SFT
from inkstone.operators.evaluate import tag_similarity

M = [7, 8]


def masks(spark, rows, max_length=100):
    df = spark.createDataFrame([(i, r, 0) for i, r in enumerate(rows)], "k int, ids array<int>, b int")
    out = SFT.response_mask(df, "ids", M, max_length, "b").orderBy("k").collect()
    return out


def test_marker_positions(spark):
    out = masks(spark, [[7, 8, 1, 2], [1, 2, 7, 8], [7, 8, 7, 8, 3], [1, 2, 3], [1, 7, 8, 5, 6, 9]], max_length=5)
    assert [r.marker_start for r in out] == [0, 2, 0, -1, 1]
    assert out[0].labels == [-100, -100, 1, 2, -100]          # padded to the batch's longest row (5)
    assert out[2].labels == [-100, -100, 7, 8, 3]             # only the first marker counts
    assert out[3].labels == [-100] * 5 and out[3].attention_mask == [1, 1, 1, 0, 0]
    assert out[4].input_ids == [1, 7, 8, 5, 6]                # truncated to 5


def test_metrics_edge_cases(spark):
    blank = [1.0] * 64
    img = [float((i // 8 + i % 8) % 2) for i in range(64)]
    df = spark.createDataFrame([(blank, blank), (img, img)], "a array<double>, b array<double>")
    e = df.select(IM.ssim_global(F.col("a"), F.col("b")).alias("s"),
                  IM.edge_f1(IM.edge_map(F.col("a"), 8), IM.edge_map(F.col("b"), 8)).alias("f"),
                  IM.pixel_mae(F.col("a"), F.col("b")).alias("m")).collect()
    assert e[0].f == 0.0 and abs(e[1].f - 1.0) < 1e-5 and e[1].m == 0.0 and abs(e[1].s - 1.0) < 1e-9


def test_tag_similarity(spark):
    df = spark.createDataFrame([({"a": 1}, {"b": 1}), ({}, {}), ({"a": 2}, {"a": 2})],
                               "x map<string,int>, y map<string,int>")
    out = [r[0] for r in df.select(tag_similarity(F.col("x"), F.col("y"))).collect()]
    assert abs(out[0] - 2.718281828459045 ** -6) < 1e-12 and out[1] == 1.0 and out[2] == 1.0


def test_marker_at_end_and_inverse_images(spark):
    out = masks(spark, [[1, 2, 3, 7, 8]])
    assert out[0].marker_start == 3 and out[0].labels == [-100] * 5      # nothing after the marker
    img = [float((i // 8 + i % 8) % 2) for i in range(64)]
    inv = [1.0 - v for v in img]
    df = spark.createDataFrame([(img, inv)], "a array<double>, b array<double>")
    r = df.select(IM.ssim_global(F.col("a"), F.col("b")).alias("c"),
                  IM.ssim_global(F.col("a"), F.col("b"), clamp=False).alias("u")).collect()[0]
    assert r.c == 0.0 and r.u < 0                                         # evaluation clamps, inference does not


def test_eval_means_skip_missing_scores(spark):
    from inkstone.operators.evaluate import eval_means
    rows = spark.createDataFrame([("c", True, 0.5, 0.1), ("c", False, None, None), ("c", True, None, 0.3)],
                                 "checkpoint string, valid boolean, pdf_proxy_score double, render_mae double")
    r = eval_means(rows).collect()[0]
    assert r.mean_pdf_proxy_score == 0.5 and abs(r.mean_render_mae - 0.2) < 1e-12 and r.invalid_count == 1
