"""Image metrics on array columns.

An image is a row-major ``array<double>`` of gray values in [0, 1] plus its
width.  All metrics are array expressions on one row — an image pair never
leaves its row, so nothing shuffles and no pixel table is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.functions.markup import let

C1 = 0.01 ** 2
C2 = 0.03 ** 2
EDGE_THRESHOLD = 0.08


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(_sum(a), F.size(a))


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """0.299 r + 0.587 g + 0.114 b, element-wise over three channel arrays."""
    return F.zip_with(F.zip_with(r, g, lambda x, y: 0.299 * x + 0.587 * y), b, lambda s, z: s + 0.114 * z)


def ssim_global(a: Column, b: Column, clamp: bool = True) -> Column:
    """One-window SSIM from means, population variances and covariance."""
    def body(m):
        mu_a, mu_b = m["ma"], m["mb"]
        var_a = mean(F.transform(a, lambda x: (x - mu_a) * (x - mu_a)))
        var_b = mean(F.transform(b, lambda x: (x - mu_b) * (x - mu_b)))
        cov = mean(F.zip_with(a, b, lambda x, y: (x - mu_a) * (y - mu_b)))
        num = (2 * mu_a * mu_b + C1) * (2 * cov + C2)
        den = (mu_a * mu_a + mu_b * mu_b + C1) * (var_a + var_b + C2)
        raw = num / den
        val = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) if clamp else raw
        return F.when(den <= (0.0 if clamp else 1e-12), F.lit(0.0)).otherwise(val)
    return let(F.struct(mean(a).alias("ma"), mean(b).alias("mb")), body)


def edge_map(g: Column, width: int) -> Column:
    """Magnitude of absolute backward differences in x and y (first column/row zero)."""
    def at(i):
        return F.element_at(g, (i + 1).cast("int"))

    return F.transform(g, lambda v, i: F.sqrt(
        F.pow(F.when(i % width == 0, F.lit(0.0)).otherwise(F.abs(v - at(i - 1))), 2)
        + F.pow(F.when(i < width, F.lit(0.0)).otherwise(F.abs(v - at(i - width))), 2)))


def edge_f1(ea: Column, eb: Column, threshold: float = EDGE_THRESHOLD) -> Column:
    """F1 of the thresholded edge masks (eps 1e-6; 0 when both are empty)."""
    def body(c):
        p = c["tp"] / (c["tp"] + c["fp"] + 1e-6)
        r = c["tp"] / (c["tp"] + c["fn"] + 1e-6)
        return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))

    def counts(pairs):
        return F.struct(
            F.size(F.filter(pairs, lambda z: z["a"] & z["b"])).cast("double").alias("tp"),
            F.size(F.filter(pairs, lambda z: z["a"] & ~z["b"])).cast("double").alias("fp"),
            F.size(F.filter(pairs, lambda z: ~z["a"] & z["b"])).cast("double").alias("fn"))

    pairs = F.zip_with(ea, eb, lambda x, y: F.struct((x > threshold).alias("a"), (y > threshold).alias("b")))
    return let(let(pairs, counts), body)


def pixel_mae(a: Column, b: Column, channels: int = 4) -> Column:
    """Mean absolute difference over RGBA of opaque gray images: (3 |d| + 0) / 4 per pixel."""
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y))) * (3.0 / channels)


def render_quality(g: Column, width: int) -> Column:
    """struct(edge_density, non_white, edge_clarity) of one gray image.

    Differences along both axes (no zero padding), concatenated; clarity is the
    share of differences above four times their mean.
    """
    def at(i):
        return F.element_at(g, (i + 1).cast("int"))

    # vertical neighbours (axis 0) then horizontal neighbours (axis 1)
    down = F.transform(F.slice(g, width + 1, F.size(g)), lambda v, i: F.abs(v - at(i)))
    right = F.filter(F.transform(g, lambda v, i: F.when(i % width != 0, F.abs(v - at(i - 1)))),
                     lambda x: x.isNotNull())
    both = F.concat(down, right)

    def body(d):
        edge = mean(d)
        clarity = F.when(edge > 1e-6, F.try_divide(F.size(F.filter(d, lambda x: x > 4.0 * edge)), F.size(d))).otherwise(0.0)
        return F.struct(edge.alias("edge_density"),
                        F.try_divide(F.size(F.filter(g, lambda x: x < 0.95)), F.size(g)).alias("non_white"),
                        clarity.cast("double").alias("edge_clarity"))
    return let(both, body)


def color_fidelity(prompt: Column, g: Column) -> Column:
    """Per colour word in the prompt (substring), share of pixels within 0.22 of it, x6, capped at 8.

    Gray images carry r = g = b = value.
    """
    pl = F.lower(prompt)
    total = F.lit(0.0)
    for name, (r, gg, b) in K.COLOR_RGB:
        rr, g2, bb = r / 255.0, gg / 255.0, b / 255.0
        hits = F.size(F.filter(g, lambda v: F.sqrt((v - rr) * (v - rr) + (v - g2) * (v - g2) + (v - bb) * (v - bb)) < 0.22))
        share = F.coalesce(F.try_divide(hits, F.size(g)), F.lit(0.0))
        total = total + F.when(F.contains(pl, F.lit(name)), share * 6.0).otherwise(0.0)
    return F.least(total, F.lit(8.0))


def cosine(a: Column, b: Column) -> Column:
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    na = F.sqrt(_sum(F.transform(a, lambda x: x * x)))
    nb = F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return F.try_divide(dot, na * nb)  # null for a zero vector


def embedding_similarity(a: Column, b: Column, logit_scale: float = 100.0) -> Column:
    """X11: text-image similarity as a logit (scale x cosine); 0 when either side is absent."""
    return F.coalesce(cosine(a, b) * logit_scale, F.lit(0.0))
