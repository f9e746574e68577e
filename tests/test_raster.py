"""Colour image kernels against plain NumPy on one image at a time, and the evaluation over colour images."""
import numpy as np
import pytest
from paths import SF_SMALL
from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.functions import raster as RA


def image(rng, w, h, alpha=True):
    a = rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
    a[rng.random((h, w)) < 0.4] = 255
    if not alpha:
        a[..., 3] = 255
    return a


def row(a):
    return {"width": a.shape[1], "height": a.shape[0], "rgba": a.tobytes()}


def opaque(a):
    a = a.astype(int)
    return np.concatenate([np.round((a[..., :3] * a[..., 3:] + 255 * (255 - a[..., 3:])) / 255) / 255, np.ones(a.shape[:2] + (1,))], axis=2)


def plain_pair(x, y):
    x, y = opaque(x), opaque(y)
    gray = [0.299 * i[..., 0] + 0.587 * i[..., 1] + 0.114 * i[..., 2] for i in (x, y)]
    a, b = gray
    cov = ((a - a.mean()) * (b - b.mean())).mean()
    ssim = ((2 * a.mean() * b.mean() + 1e-4) * (2 * cov + 9e-4)) / ((a.mean() ** 2 + b.mean() ** 2 + 1e-4) * (a.var() + b.var() + 9e-4))
    masks = []
    for g in gray:
        e = np.zeros_like(g)
        for i in range(g.shape[0]):
            for j in range(g.shape[1]):
                e[i, j] = np.hypot(abs(g[i, j] - g[i, j - 1]) if j else 0, abs(g[i, j] - g[i - 1, j]) if i else 0)
        masks.append(e > 0.08)
    tp, fp, fn = (masks[0] & masks[1]).sum(), (masks[0] & ~masks[1]).sum(), (~masks[0] & masks[1]).sum()
    p, r = tp / (tp + fp + 1e-6), tp / (tp + fn + 1e-6)
    return max(0.0, min(1.0, ssim)), 2 * p * r / (p + r) if p + r else 0.0, np.abs(x - y).mean()


def test_pairs_match_numpy_and_broken_images_are_null(spark):
    rng = np.random.default_rng(0)
    shapes = [(8, 8), (5, 3), (1, 1), (1, 7), (7, 1), (256, 256), (8, 8), (5, 3)]
    pairs = [(image(rng, w, h), image(rng, w, h, k % 2 == 0)) for k, (w, h) in enumerate(shapes)]
    pairs.append((pairs[0][0], pairs[0][0]))
    blank = np.zeros((4, 4, 4), np.uint8)
    pairs.append((blank, blank))
    rows = [(i, row(x), row(y)) for i, (x, y) in enumerate(pairs)]
    good = row(pairs[0][0])
    broken = [None, {**good, "width": 7}, {**good, "rgba": None}, {**good, "width": 0}, {**good, "width": -8, "height": -8}, {**good, "height": None},
              row(pairs[1][0]), {**good, "width": 16, "height": 4}]
    rows += [(100 + i, b, good) for i, b in enumerate(broken)] + [(200 + i, good, b) for i, b in enumerate(broken)]
    df = spark.createDataFrame(rows, f"id int, p {RA.IMAGE}, r {RA.IMAGE}").repartition(3)
    got = {r.id: r.m for r in df.select("id", RA.pair_metrics(F.col("p"), F.col("r")).alias("m")).collect()}
    for i, (x, y) in enumerate(pairs):
        np.testing.assert_allclose([got[i].ssim, got[i].edge_f1, got[i].mae], plain_pair(x, y), atol=1e-12)
    assert [i for i in got if i >= 100 and got[i] is not None] == []
    assert got[8].ssim == pytest.approx(1.0) and got[8].mae == 0.0 and got[9].edge_f1 == 0.0


def test_stacks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(RA, "PIXELS", 20)
    import pyarrow as pa
    rng = np.random.default_rng(1)
    images = [image(rng, 4, 2) for _ in range(7)] + [image(rng, 3, 3)]
    column = pa.array([row(a) for a in images] + [None], pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary())]))
    seen = [(at.tolist(), stack.shape) for at, (stack,) in RA._stacks(column)]
    assert sorted(i for at, _ in seen for i in at) == list(range(8)) and max(s[0] * s[1] * s[2] for _, s in seen) <= 20


def test_features_and_colours(spark):
    white, red = np.full((4, 4, 4), 255, np.uint8), np.tile(np.array([255, 0, 0, 255], np.uint8), (4, 4, 1))
    half = white.copy()
    half[:, 2:] = red[:, 2:]
    faint = red.copy()
    faint[..., 3] = 10  # nearly transparent red is nearly white
    rows = [(0, row(white), "a Red dot"), (1, row(red), "coloRED"), (2, row(half), "red and white"), (3, row(faint), "red white"), (4, row(half), ""),
            (5, None, "red"), (6, row(half), None)]
    df = spark.createDataFrame(rows, f"id int, image {RA.IMAGE}, prompt string")
    out = df.select("id", "prompt", RA.image_features(F.col("image")).alias("f")).select(
        "id", "f.*", RA.color_fidelity(F.col("prompt"), F.col("f.color_shares")).alias("fidelity"))
    got = {r.id: r for r in out.collect()}
    assert got[0].non_white == 0.0 and got[0].edge_density == 0.0 and got[0].fidelity == 0.0
    assert got[1].non_white == 1.0 and got[1].fidelity == 6.0 and got[1].edge_clarity == 0.0
    assert got[2].non_white == 0.5 and got[2].fidelity == 6.0  # half of it near each colour
    assert got[2].edge_density == pytest.approx(4 * (1 - 0.299) / 24) and got[2].edge_clarity == pytest.approx(4 / 24)
    assert got[3].fidelity == 6.0 and got[3].non_white == 0.0 and got[4].fidelity == 0.0
    assert got[5].non_white is None and got[5].fidelity == 0.0 and got[6].fidelity == 0.0
    assert len(got[1].color_shares) == len(K.COLOR_RGB)


def test_colour_evaluation_moves_each_image_once(spark):
    from inkstone.operators import evaluate as EV
    from inkstone.sources import standins as S
    refs, preds = S.color_images(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = EV.image_metrics(spark.createDataFrame(preds.rdd, preds.schema), spark.createDataFrame(refs.rdd, refs.schema))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ArrowEvalPython") == 1


def test_colour_queries_show_both_outcomes(spark):
    from inkstone.plans.registry import QUERIES
    m = QUERIES["rgba_pair_metrics"](spark, SF_SMALL)
    rows = m.agg(F.count_if(F.expr("ssim IS NULL")).alias("unlike"), F.count_if(F.expr("ssim = 1")).alias("same"), F.count_if(F.expr("ssim < 0.9")).alias("other")).first()
    assert min(rows) > 0
    f = QUERIES["rgba_render_features"](spark, SF_SMALL).agg(
        F.count_if(F.expr("non_white < 0.008")).alias("blank"), F.count_if(F.expr("non_white > 0.5")).alias("drawn"),
        F.count_if(F.expr("color_fidelity > 0")).alias("coloured"), F.count_if(F.expr("color_fidelity = 0")).alias("plain")).first()
    assert min(f) > 0
    e = QUERIES["evaluate_rgba"](spark, SF_SMALL).agg(F.count_if(F.expr("valid AND render_mae IS NULL")).alias("unlike"),
                                                     F.count_if(F.expr("NOT valid")).alias("invalid"), F.count("pdf_proxy_score").alias("scored")).first()
    assert min(e) > 0
