"""Long-form image metrics against the array forms at several tile sizes; the N longest rows by counting."""
import random

import pytest
from pyspark.sql import functions as F

from inkstone.functions import image as IM
from inkstone.operators import tiles as TI
from inkstone.operators.index import ranked_value
from inkstone.operators.order import longest_rows

WIDTH, HEIGHT = 13, 9


def images(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, [rnd.choice([0.0, 1.0, rnd.random()]) for _ in range(WIDTH * HEIGHT)], WIDTH) for k in range(4)]
    rows += [(4, [0.5] * WIDTH * HEIGHT, WIDTH), (5, None, WIDTH), (6, [], WIDTH), (7, [0.5] * 5, 3)]
    return spark.createDataFrame(rows, "id int, pixels array<double>, width int")


@pytest.mark.parametrize("tile", [(1, 1), (4, 3), (5, 100), (100, 2), (64, 64)])
def test_tiles_equal_arrays(spark, tile):
    a, b = images(spark, 1), images(spark, 2)
    ta, tb = (TI.cut_tiles(x, ["id"], tile_w=tile[0], tile_h=tile[1]) for x in (a, b))
    both = a.join(b.select("id", F.col("pixels").alias("ref")), "id").filter("id < 5")
    both = both.withColumn("ea", IM.edge_map(F.col("pixels"), WIDTH)).withColumn("eb", IM.edge_map(F.col("ref"), WIDTH))
    want = {r.id: r for r in both.select("id", IM.ssim_global(F.col("pixels"), F.col("ref"), False).alias("ssim"),
                                         IM.edge_f1(F.col("ea"), F.col("eb")).alias("f1"), "ea").collect()}
    ssim = {r.id: r.ssim for r in TI.ssim_tiles(ta, tb, ["id"], clamp=False).collect()}
    f1 = {r.id: r for r in TI.edge_f1_tiles(ta, tb, ["id"]).collect()}
    assert set(ssim) == set(f1) == set(want) == set(range(5))
    for k, w in want.items():
        assert ssim[k] == pytest.approx(w.ssim, abs=1e-12)
        assert f1[k].edge_f1 == pytest.approx(w.f1, abs=1e-12)
        assert f1[k].mean_edge == pytest.approx(sum(w.ea) / len(w.ea), abs=1e-12)
    edges = {}
    for t in TI.tile_edges(ta, ["id"]).collect():
        for i, v in enumerate(t.edges):
            edges[t.id, t.y0 + i // t.w, t.x0 + i % t.w] = v
    assert len(edges) == 5 * WIDTH * HEIGHT
    assert all(edges[k, i // WIDTH, i % WIDTH] == v for k, w in want.items() for i, v in enumerate(w.ea))


def test_no_tiles(spark):
    none = TI.cut_tiles(images(spark, 1).filter("id > 4"), ["id"])
    assert none.count() == TI.ssim_tiles(none, none, ["id"]).count() == TI.edge_f1_tiles(none, none, ["id"]).count() == 0


def test_ranked_value(spark):
    rnd = random.Random(3)
    values = [rnd.choice([0, 5, 5, rnd.randrange(100), rnd.randrange(1 << 40)]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "v long")
    order = sorted(values, reverse=True)
    for rank in (1, 2, 60, 150, 299, 300):
        v = order[rank - 1]
        assert ranked_value(df, "v", rank, bins=16) == (v, sum(x > v for x in order), order.count(v))
    assert ranked_value(df, "v", 302) == (None, 300, 3)


@pytest.mark.parametrize("ids", ["long", "string"])
def test_longest_rows(spark, ids):
    rnd = random.Random(4)
    rows = [(None if k == 7 else k, rnd.choice([None, 3, 3, 3, 900, rnd.randrange(50), rnd.randrange(1 << 33)]), "text") for k in range(200)]
    if ids == "string":
        rows = [(i if i is None else str(i), n, t) for i, n, t in rows]
    df = spark.createDataFrame(rows, f"id {ids}, n long, text string")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] if r[0] is not None else 0))
    for keep in (0, 1, 40, 90, 120, 180, 199, 200):
        got = longest_rows(df, "n", "id", 0.0, keep).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, order[:keep]))
    assert longest_rows(df.limit(0), "n", "id", 0.3, 5).count() == 0


def test_longest_rows_moves_nothing(spark, tmp_path):
    spark.range(500).select(F.col("id"), (F.col("id") % 20).alias("n"), F.repeat(F.lit("x"), 100).alias("text")).write.parquet(str(tmp_path / "t"))
    out = longest_rows(spark.read.parquet(str(tmp_path / "t")), "n", "id", 0.3, 10)
    assert out.count() == 150
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
