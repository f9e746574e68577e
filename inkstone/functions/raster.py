"""Colour images: metrics on a binary RGBA column (X1-X4, X8-X10 on four channels).

An image is ``struct<width:int, height:int, rgba:binary>``: rows from the top, four bytes a
pixel, straight alpha.  Before anything is measured it is laid over white at 8 bits, as a
renderer hands it out, so alpha is 1 afterwards.  The kernels are NumPy in Arrow UDFs: images of
one size are stacked, at most PIXELS pixels at a time, and only the few numbers of a result return to
the JVM.  An image that is null, or whose bytes do not fit its size, and a pair of different sizes have null
metrics, as a failed render has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.functions.image import C1, C2, EDGE_THRESHOLD

IMAGE = "struct<width:int,height:int,rgba:binary>"
PIXELS = 1 << 20
PAIR = "struct<ssim:double,edge_f1:double,mae:double,mean_edge:double>"
FEATURES = "struct<edge_density:double,non_white:double,edge_clarity:double,color_shares:array<double>>"
NEAR_COLOR = 0.22


def _stacks(*images):
    """(positions, one uint8 array (n, height, width, 4) per image column) of rows whose images are whole and of one size."""
    import numpy as np

    parts = [[c.field(k).to_numpy(zero_copy_only=False) for k in range(2)] + [c.field(2), c.is_valid().to_numpy(zero_copy_only=False)] for c in images]
    width, height = parts[0][:2]
    ok = np.ones(len(width), bool)
    for w, h, data, valid in parts:
        size = pc.fill_null(pc.binary_length(data), -1).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            ok &= valid & (w > 0) & (h > 0) & (size == 4.0 * w * h) & (w == width) & (h == height)
    for w, h in sorted({(int(width[i]), int(height[i])) for i in np.flatnonzero(ok)}):
        at = np.flatnonzero(ok & (width == w) & (height == h))
        step = max(1, PIXELS // (w * h))
        for start in range(0, len(at), step):
            some = at[start:start + step]
            yield some, [np.stack([np.frombuffer(p[2][int(i)].as_buffer(), np.uint8) for i in some]).reshape(-1, h, w, 4) for p in parts]


def over_white(rgba):
    """RGB in [0, 1] of straight-alpha 8-bit images over white, rounded to 8 bits."""
    import numpy as np

    c, a = rgba[..., :3].astype(np.uint32), rgba[..., 3:].astype(np.uint32)
    return ((c * a + 255 * (255 - a) + 127) // 255) / 255.0


def gray_of(rgb):
    """X2."""
    return 0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]


def edges_of(gray):
    """Magnitude of the backward differences, 0 in the first column and row."""
    import numpy as np

    dx, dy = np.zeros_like(gray), np.zeros_like(gray)
    dx[:, :, 1:] = np.abs(np.diff(gray, axis=2))
    dy[:, 1:, :] = np.abs(np.diff(gray, axis=1))
    return np.sqrt(dx ** 2 + dy ** 2)


def _ssim(a, b, clamp: bool):
    """X1 over whole images."""
    import numpy as np

    axes = (1, 2)
    ma, mb = a.mean(axes), b.mean(axes)
    da, db = a - ma[:, None, None], b - mb[:, None, None]
    top = (2 * ma * mb + C1) * (2 * (da * db).mean(axes) + C2)
    low = (ma * ma + mb * mb + C1) * ((da * da).mean(axes) + (db * db).mean(axes) + C2)
    value = top / low  # low is above C1 * C2
    return np.clip(value, 0.0, 1.0) if clamp else value


def _f1(a, b):
    """X4 of two edge maps."""
    import numpy as np

    a, b = a > EDGE_THRESHOLD, b > EDGE_THRESHOLD
    tp, fp, fn = ((x & y).sum((1, 2)).astype(float) for x, y in ((a, b), (a, ~b), (~a, b)))
    p, r = tp / (tp + fp + 1e-6), tp / (tp + fn + 1e-6)
    return np.where(p + r == 0, 0.0, 2 * p * r / np.where(p + r == 0, 1.0, p + r))


def pair_metrics(pred: Column, ref: Column, clamp: bool = True) -> Column:
    """X1, X3, X4 and X8 of two image columns: struct<ssim, edge_f1, mae, mean_edge (of the first)>, null
    if either image has none or the sizes differ.  ``mae`` is over all four channels."""
    @F.arrow_udf(PAIR)
    def measure(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import numpy as np

        for left, right in batches:
            out, known = np.zeros((4, len(left))), np.zeros(len(left), bool)
            for at, (x, y) in _stacks(left, right):
                x, y = over_white(x), over_white(y)
                gx, gy = gray_of(x), gray_of(y)
                ex, ey = edges_of(gx), edges_of(gy)
                out[:, at] = _ssim(gx, gy, clamp), _f1(ex, ey), np.abs(x - y).mean((1, 2, 3)) * (3 / 4), ex.mean((1, 2))
                known[at] = True
            yield pa.StructArray.from_arrays([pa.array(v) for v in out], ["ssim", "edge_f1", "mae", "mean_edge"], mask=pa.array(~known))
    return measure(pred, ref)


def image_features(image: Column) -> Column:
    """X9 and the colour part of X10: struct<edge_density, non_white, edge_clarity, color_shares>, where
    ``color_shares`` holds for each colour of K.COLOR_RGB the share of pixels near it."""
    @F.arrow_udf(FEATURES)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        colors = np.array([rgb for _, rgb in K.COLOR_RGB]) / 255.0
        for column in batches:
            n = len(column)
            out, shares, known = np.zeros((3, n)), np.zeros((n, len(colors))), np.zeros(n, bool)
            for at, (rgba,) in _stacks(column):
                rgb = over_white(rgba)
                gray = gray_of(rgb)
                steps = np.concatenate([np.abs(np.diff(gray, axis=k)).reshape(len(at), -1) for k in (1, 2)], axis=1)
                edge = steps.mean(1) if steps.shape[1] else np.zeros(len(at))
                clear = (steps > 4.0 * edge[:, None]).mean(1) if steps.shape[1] else edge
                out[:, at] = edge, (gray < 0.95).mean((1, 2)), np.where(edge > 1e-6, clear, 0.0)
                for k, c in enumerate(colors):
                    near = np.sqrt((rgb[..., 0] - c[0]) ** 2 + (rgb[..., 1] - c[1]) ** 2 + (rgb[..., 2] - c[2]) ** 2) < NEAR_COLOR
                    shares[at, k] = near.mean((1, 2))
                known[at] = True
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * len(colors))
            lists = pa.ListArray.from_arrays(ends, pa.array(shares.ravel()))
            yield pa.StructArray.from_arrays([*(pa.array(v) for v in out), lists],
                                             ["edge_density", "non_white", "edge_clarity", "color_shares"], mask=pa.array(~known))
    return measure(image)


def color_fidelity(prompt: Column, shares: Column) -> Column:
    """Six times the share of each colour that the prompt names (as a substring), at most 8."""
    low, total = F.lower(prompt), F.lit(0.0)
    for k, (name, _) in enumerate(K.COLOR_RGB):
        total = total + F.when(F.contains(low, F.lit(name)), F.coalesce(shares[k], F.lit(0.0)) * 6.0).otherwise(0.0)
    return F.least(total, F.lit(8.0))


def gray_stats(image: Column) -> Column:
    """struct<mean, least, most> of the gray image."""
    @F.arrow_udf("struct<mean:double,least:double,most:double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for column in batches:
            out, known = np.zeros((3, len(column))), np.zeros(len(column), bool)
            for at, (rgba,) in _stacks(column):
                gray = gray_of(over_white(rgba))
                out[:, at], known[at] = (gray.mean((1, 2)), gray.min((1, 2)), gray.max((1, 2))), True
            yield pa.StructArray.from_arrays([pa.array(v) for v in out], ["mean", "least", "most"], mask=pa.array(~known))
    return measure(image)
