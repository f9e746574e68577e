"""Images of any size as tiles: X1, X3 and X4 in long form.

A tile is a rectangle of a gray image: ``x0, y0, w`` and ``pixels``, an ``array<double>`` in [0, 1], row by
row.  The tiles of an image form one grid and its last row and column of tiles may be smaller.  Only a tile has to fit a row,
so an image may be larger than any task's memory.  Results equal the array forms of
``functions.image`` at any tile size.

Halos: the differences of X3 look one pixel up and left, so a tile takes the last pixel row of the tile above and
the last pixel column of the tile to the left.  Only those borders travel, both on one partitioning
by image and place.  X1 is made of Spark's own mergeable moments (count, mean, M2, co-moment) and X4 of counts, so
a task hands on one row an image and a hot image gathers nowhere.

Defined results: a tile without pixels adds nothing; a pair counts where both images have a tile at a place, a pixel
where both tiles have one; an empty table gives no rows; a null pixel is left out of the moments and counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions.image import C1, C2, EDGE_THRESHOLD
from inkstone.functions.markup import let


def cut_tiles(df: DataFrame, keys: list, pixels: str = "pixels", width: str = "width", tile_w: int = 256, tile_h: int = 256) -> DataFrame:
    """Tiles of images in array form; an image whose pixels are null, empty or no whole rows has none."""
    height = F.expr(f"cast(size({pixels}) div {width} as int)")
    grid = lambda n, step: F.sequence(F.lit(0), n - 1, F.lit(step))
    whole = df.filter((F.col(width) > 0) & (F.size(pixels) > 0) & (F.size(pixels) % F.col(width) == 0))
    places = whole.select(*keys, F.col(pixels).alias("__all"), F.col(width).cast("int").alias("__width"), height.alias("__height"))
    places = places.withColumn("y0", F.explode(grid(F.col("__height"), tile_h)))
    # the rows of a band first, then its tiles: an image is not copied once a tile
    bands = places.withColumn("__all", F.slice("__all", F.col("y0") * F.col("__width") + 1, F.least(
        F.lit(tile_h), F.col("__height") - F.col("y0")) * F.col("__width")))
    cut = bands.withColumn("x0", F.explode(grid(F.col("__width"), tile_w))).withColumn(
        "w", F.least(F.lit(tile_w), F.col("__width") - F.col("x0")))
    rows = F.sequence(F.lit(0), F.expr("cast(size(__all) div __width as int)") - 1)
    return cut.select(*keys, "x0", "y0", "w", F.flatten(F.transform(
        rows, lambda r: F.slice(F.col("__all"), r * F.col("__width") + F.col("x0") + 1, F.col("w")))).alias("pixels"))


def with_halo(tiles: DataFrame, keys: list) -> DataFrame:
    """``tiles`` with ``above`` and ``left``: the neighbours' last pixel row and column, null at the image's border."""
    full = tiles.filter((F.col("w") > 0) & (F.size("pixels") > 0))
    h = F.expr("cast(size(pixels) div w as int)")
    above = full.select(*keys, "x0", (F.col("y0") + h).alias("y0"), F.slice("pixels", -F.col("w"), F.col("w")).alias("above"))
    left = full.select(*keys, (F.col("x0") + F.col("w")).alias("x0"), "y0", F.transform(
        F.sequence(F.lit(1), h), lambda r: F.get(F.col("pixels"), r * F.col("w") - 1)).alias("left"))
    at = [*keys, "x0", "y0"]
    return full.join(above, at, "left").join(left, at, "left")


def tile_edges(tiles: DataFrame, keys: list) -> DataFrame:
    """X3 by tiles: ``edges`` as the array form's edge map, for the pixels of each tile."""
    def edges(t):
        before = lambda i: F.when(i % t["w"] != 0, F.get(t["p"], i - 1)).otherwise(
            F.get(t["l"], F.floor(i / t["w"]).cast("int")))
        upper = lambda i: F.when(i >= t["w"], F.get(t["p"], i - t["w"])).otherwise(F.get(t["a"], i))
        step = lambda v, u: F.pow(F.coalesce(F.abs(v - u), F.lit(0.0)), 2)
        return F.transform(t["p"], lambda v, i: F.when(v.isNotNull(), F.sqrt(step(v, before(i)) + step(v, upper(i)))))
    tile = F.struct(F.col("pixels").alias("p"), F.col("w").alias("w"), F.col("above").alias("a"), F.col("left").alias("l"))
    return with_halo(tiles, keys).select(*keys, "x0", "y0", "w", "pixels", let(tile, edges).alias("edges"))


def _both(a: DataFrame, b: DataFrame, keys_a: list, keys_b: list, value: str) -> DataFrame:
    """One row a pixel of the tiles that both hold: the keys of ``a``, and columns a and b."""
    at = [*keys_b, "x0", "y0"]
    two = a.select(*keys_a, "x0", "y0", F.col(value).alias("__a")).join(b.select(*at, F.col(value).alias("__b")), at)
    pixels = two.select(*keys_a, F.explode(F.arrays_zip("__a", "__b")).alias("__p"))
    return pixels.select(*keys_a, F.col("__p.__a").alias("a"), F.col("__p.__b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")


def ssim_tiles(a: DataFrame, b: DataFrame, keys_a: list, keys_b: list | None = None, clamp: bool = True) -> DataFrame:
    """X1 of every image pair: the keys of ``a`` and ``ssim``.  ``b`` has the same grid and keys ``keys_b``, a part of ``keys_a``."""
    m = _both(a, b, keys_a, keys_a if keys_b is None else keys_b, "pixels").groupBy(*keys_a).agg(
        F.avg("a").alias("__ma"), F.avg("b").alias("__mb"), F.var_pop("a").alias("__va"), F.var_pop("b").alias("__vb"),
        F.covar_pop("a", "b").alias("__cov"))
    num = (2 * F.col("__ma") * F.col("__mb") + C1) * (2 * F.col("__cov") + C2)
    den = (F.col("__ma") * F.col("__ma") + F.col("__mb") * F.col("__mb") + C1) * (F.col("__va") + F.col("__vb") + C2)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / den)) if clamp else num / den
    return m.select(*keys_a, F.when(den <= (0.0 if clamp else 1e-12), F.lit(0.0)).otherwise(value).alias("ssim"))


def edge_f1_tiles(a: DataFrame, b: DataFrame, keys_a: list, keys_b: list | None = None, threshold: float = EDGE_THRESHOLD) -> DataFrame:
    """X4 of every image pair: the keys of ``a``, ``edge_f1`` and ``mean_edge`` (X3 of ``a``)."""
    keys_b = keys_a if keys_b is None else keys_b
    on_a, on_b = F.col("a") > threshold, F.col("b") > threshold
    n = _both(tile_edges(a, keys_a), tile_edges(b, keys_b), keys_a, keys_b, "edges").groupBy(*keys_a).agg(
        F.count_if(on_a & on_b).alias("__tp"), F.count_if(on_a & ~on_b).alias("__fp"), F.count_if(~on_a & on_b).alias("__fn"),
        F.avg("a").alias("mean_edge"))
    p = F.col("__tp") / (F.col("__tp") + F.col("__fp") + 1e-6)
    r = F.col("__tp") / (F.col("__tp") + F.col("__fn") + 1e-6)
    return n.select(*keys_a, F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("edge_f1"), "mean_edge")
