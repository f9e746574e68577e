"""Colour balancing: rarity weights (J1) and a weighted draw with replacement."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.functions import text as TX
from inkstone.operators.index import with_global_index
from inkstone.operators.profile import color_frequency


def _root(x, power: float):
    return F.sqrt(x) if power == 0.5 else F.pow(x, F.lit(power))


def with_rarity_weight(df: DataFrame, prompt_col: str = "prompt", power: float = K.BALANCE_POWER,
                       name: str = "weight") -> DataFrame:
    """weight = max(1, max over the prompt's colours of (max_n / n_c)^power); 1.0 without colours.

    The colour-count table has at most 14 rows (the fixed colour words), so it is
    read once and applied as a literal map: no join, no shuffle of row data.
    """
    counts = {r["color"]: r["n"] for r in color_frequency(df, prompt_col).collect()}
    toks = TX.color_tokens_literal(F.col(prompt_col))
    if not counts:
        return df.withColumn(name, F.lit(1.0))
    max_n = float(max(counts.values()))
    cmap = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(float(max(n, 1))))])
    boost = F.array_max(F.transform(toks, lambda t: _root(F.lit(max_n) / F.element_at(cmap, t), power)))
    return df.withColumn(name, F.when(F.size(toks) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), boost)))


def draw_key(seed: int, cls, j):
    """Row number hit by draw ``j`` of class ``cls``: first 60 bits of md5(seed|cls|j)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), cls.cast("string"), F.lit("|"), j.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def allot_draws(classes: list[tuple[float, int]], extra: int) -> list[int]:
    """Largest-remainder allotment of ``extra`` draws to classes by mass N_c * w_c.

    ``classes`` is the (weight, size) table — at most 15 rows (one per colour
    word plus the neutral weight), so this runs on the driver.
    """
    mass = [w * n for w, n in classes]
    total = sum(mass)
    share = [extra * m / total for m in mass]
    base = [int(math.floor(s)) for s in share]
    rest = extra - sum(base)
    order = sorted(range(len(classes)), key=lambda i: (-(share[i] - base[i]), -classes[i][0], i))
    for i in order[:rest]:
        base[i] += 1
    return base


def weighted_oversample(df: DataFrame, weight_col: str = "weight", id_col: str = "id",
                        factor: float = K.OVERSAMPLE_FACTOR, seed: int = K.SEED, prompt_col: str | None = None) -> DataFrame:
    """floor(factor * n) extra rows drawn with replacement, probability ~ weight.

    Exact count and deterministic: draws are allotted to weight classes by mass,
    and draw j of class c hits row ``md5(seed|c|j) mod N_c`` of that class.  The
    draw table is generated distributed (``range``) and equi-joined on the
    global index of a narrow (weight, id) projection, then the drawn ids are
    joined back to the rows (``id_col`` must be a key), so no group or task holds
    a whole class and the wide rows are never checkpointed.  A row drawn many
    times is a skewed join key, which AQE's skew-join handling splits.  Returns
    only the extra rows, each with its draw number ``draw``; union them with the
    input for the balanced frame.  With ``prompt_col`` given, a frame in which no
    prompt holds a colour word gets no extra rows.
    """
    # the weight-class table (<= 15 rows) also gives n: one pass, no separate count
    cls_rows = df.groupBy(weight_col).agg(F.count(F.lit(1)).alias("n")).orderBy(weight_col).collect()
    classes = [(float(r[weight_col]), int(r["n"])) for r in cls_rows]
    if prompt_col is not None and {w for w, _ in classes} <= {1.0}:  # perhaps no prompt has a colour
        if df.filter(F.size(TX.color_tokens_literal(F.col(prompt_col))) > 0).isEmpty():
            return df.limit(0).withColumn("draw", F.lit(None).cast("long"))
    n = sum(c for _, c in classes)
    extra = int(n * factor)
    if factor <= 0 or extra < 1:
        return df.limit(0).withColumn("draw", F.lit(None).cast("long"))
    alloc = allot_draws(classes, extra)
    starts, cum = [], 0
    for _, size in classes:
        starts.append(cum)
        cum += size
    indexed = with_global_index(df.select(weight_col, id_col), [weight_col, id_col], "__g")
    bound = 0
    bounds = []
    for a in alloc:
        bound += a
        bounds.append(bound)
    # draw number d belongs to class c when bounds[c-1] <= d < bounds[c]
    d = F.col("id")
    cls = F.lit(len(classes) - 1)
    first = F.lit(bounds[-1] - alloc[-1])
    size = F.lit(classes[-1][1])
    start = F.lit(starts[-1])
    for c in range(len(classes) - 2, -1, -1):
        cond = d < bounds[c]
        cls = F.when(cond, F.lit(c)).otherwise(cls)
        first = F.when(cond, F.lit(bounds[c] - alloc[c])).otherwise(first)
        size = F.when(cond, F.lit(classes[c][1])).otherwise(size)
        start = F.when(cond, F.lit(starts[c])).otherwise(start)
    draws = (df.sparkSession.range(extra)
             .select(d.alias("draw"), cls.alias("__c"), (d - first).alias("__j"), size.alias("__n"), start.alias("__s"))
             .select("draw", (F.col("__s") + draw_key(seed, F.col("__c"), F.col("__j")) % F.col("__n")).alias("__g")))
    drawn_ids = indexed.join(draws, "__g", "inner").select(id_col, "draw")
    return df.join(drawn_ids, id_col, "inner")
