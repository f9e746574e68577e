"""Prediction evaluation (X5-X8, X14, J4, J5) and checkpoint leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone import constants as K
from inkstone.functions import image as IM
from inkstone.functions import markup as MX
from inkstone.functions import raster as RA
from inkstone.functions.markup import let
from inkstone.functions import text as TX
from inkstone.operators import markup as M


def tag_similarity(a: F.Column, b: F.Column) -> F.Column:
    """X5 on two tag-count maps: exp(-6 * sum|a-b| / sum(a+b)); 1 when nothing to compare."""
    def cnt(m, k):
        return F.coalesce(F.try_element_at(m, k), F.lit(0)).cast("double")

    def body(ab):
        a_, b_ = ab["a"], ab["b"]
        keys = F.array_union(F.map_keys(a_), F.map_keys(b_))
        sums = F.aggregate(keys, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("t")), lambda acc, k: F.struct(
            (acc["d"] + F.abs(cnt(a_, k) - cnt(b_, k))).alias("d"), (acc["t"] + cnt(a_, k) + cnt(b_, k)).alias("t")))
        return let(sums, lambda s: F.when((F.size(keys) == 0) | (s["t"] == 0), F.lit(1.0)).otherwise(
            F.exp(-6.0 * s["d"] / s["t"])))

    return let(F.struct(a.alias("a"), b.alias("b")), body)


def compactness(len_pred: F.Column, len_ref: F.Column) -> F.Column:
    """exp(-|ln((len_p + 50) / (len_r + 50))|)."""
    return F.exp(-F.abs(F.log((len_pred + 50.0) / (len_ref + 50.0))))


def composite_score(visual: F.Column, structural: F.Column, compact: F.Column) -> F.Column:
    """visual^0.85 * structural^0.12 * compactness^0.03."""
    return F.pow(visual, 0.85) * F.pow(structural, 0.12) * F.pow(compact, 0.03)


def tag_count_align(a: DataFrame, b: DataFrame, key_cols: list) -> DataFrame:
    """J5 in long form: full outer alignment of two (keys, tag, n) tables, missing counts 0."""
    on = list(key_cols) + ["tag"]
    return (a.withColumnRenamed("n", "n_a").join(b.withColumnRenamed("n", "n_b"), on, "full_outer")
             .select(*on, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")))


def tag_count_align_maps(df: DataFrame, key_cols: list, a: str, b: str) -> DataFrame:
    """J5 per row: two tag-count maps of the same row aligned on the union of their tags
    (missing counts 0), exploded to (keys, tag, n_a, n_b).  No shuffle."""
    keys = F.array_union(F.map_keys(F.col(a)), F.map_keys(F.col(b)))
    out = df.select(*key_cols, a, b, F.explode(keys).alias("tag"))
    return out.select(*key_cols, "tag", F.coalesce(F.try_element_at(F.col(a), F.col("tag")), F.lit(0)).alias("n_a"),
                      F.coalesce(F.try_element_at(F.col(b), F.col("tag")), F.lit(0)).alias("n_b"))


def pred_vs_ref(preds: DataFrame, refs: DataFrame, id_col: str = "id", ckpt_col: str = "checkpoint",
                checkpoints: DataFrame | None = None) -> DataFrame:
    """One row per listed checkpoint and reference, with its prediction or nulls.

    ``checkpoints`` lists the checkpoints (by default those that predict anything): a
    short list, read to the driver and unfolded over the references, so the pairing is
    one equi-join on (checkpoint, id).
    """
    listed = (checkpoints if checkpoints is not None else preds).select(ckpt_col).distinct()
    names = listed.schema[0].dataType
    wanted = refs.withColumn(ckpt_col, F.explode(F.lit(sorted(r[0] for r in listed.filter(F.col(ckpt_col).isNotNull()).collect()))
                                                 .cast(T.ArrayType(names))))
    return wanted.join(preds, [ckpt_col, id_col], "left")


def image_metrics(pred_images: DataFrame, ref_images: DataFrame, id_col: str = "id", ckpt_col: str = "checkpoint") -> DataFrame:
    """(checkpoint, id, ssim, edge_f1, mae) of colour images: (checkpoint, id, image) against (id, image).

    An image moves once, to the other side's partition of its id; only the numbers go on from there."""
    both = pred_images.select(ckpt_col, id_col, F.col("image").alias("__p")).join(
        ref_images.select(id_col, F.col("image").alias("__r")), id_col)
    return both.select(ckpt_col, id_col, RA.pair_metrics(F.col("__p"), F.col("__r")).alias("m")).select(
        ckpt_col, id_col, "m.ssim", "m.edge_f1", "m.mae")


def evaluate_predictions(preds: DataFrame, refs: DataFrame, pred_images: DataFrame | None = None,
                         ref_images: DataFrame | None = None, width: int = 8,
                         id_col: str = "id", ckpt_col: str = "checkpoint", checkpoints: DataFrame | None = None) -> DataFrame:
    """Extract -> canonicalise -> validity -> metrics for valid rows (null otherwise).

    ``preds``: (checkpoint, id, raw_text); ``refs``: (id, prompt, reference_svg) with
    canonical reference markup; images: (checkpoint, id, image) and (id, image) with binary
    colour images (see functions.raster), or (checkpoint, id, pixels) and (id, pixels) with gray
    row-major arrays of ``width``.  A row without images keeps its markup metrics null, as a
    failed render does; a reference without a prediction is an invalid row with empty markup.
    """
    p = preds.withColumn("__x", TX.extract_markup("raw_text"))
    p = M.canonicalise(p, "__x", "svg", variant="train").drop("__x")
    p = MX.with_parsed(p, "svg", "__p_")
    # listed from the texts as given: listing the parsed ones would canonicalise them all for it
    j = pred_vs_ref(p, refs, id_col, ckpt_col, preds if checkpoints is None else checkpoints).withColumn("svg", F.coalesce("svg", F.lit("")))
    valid = F.coalesce(F.col("__p_valid"), F.lit(False))
    numbers = ("__ssim", "__edge", "__mae")
    if pred_images is None or ref_images is None:
        j = j.withColumns({c: F.lit(None).cast("double") for c in numbers})
    elif "image" in pred_images.columns:
        m = image_metrics(pred_images, ref_images, id_col, ckpt_col).toDF(ckpt_col, id_col, *numbers)
        j = j.join(m, [ckpt_col, id_col], "left")
    else:
        j = (j.join(pred_images.select(ckpt_col, id_col, F.col("pixels").alias("__pi")), [ckpt_col, id_col], "left")
              .join(ref_images.select(id_col, F.col("pixels").alias("__ri")), id_col, "left"))
        # per-row image metrics, each bound once
        j = j.withColumns({
            "__ssim": IM.ssim_global(F.col("__pi"), F.col("__ri"), clamp=True),
            "__edge": IM.edge_f1(IM.edge_map(F.col("__pi"), width), IM.edge_map(F.col("__ri"), width)),
            "__mae": IM.pixel_mae(F.col("__pi"), F.col("__ri")),
        })
    # without an image, or with images of different sizes, nothing was rendered
    have = F.col("__ssim") if "__pi" not in j.columns else F.when(F.col("__pi").isNotNull() & F.col("__ri").isNotNull(), F.lit(1.0))
    j = j.withColumns({
        "__ok": valid & have.isNotNull(),
        "__struct": tag_similarity(MX.tag_histogram("svg"), MX.tag_histogram("reference_svg")),
        "__compact": compactness(F.length("svg"), F.length("reference_svg")),
    })
    visual = 0.7 * F.col("__ssim") + 0.3 * F.col("__edge")
    j = j.withColumn("__visual", visual)

    def gated(c):
        return F.when(F.col("__ok"), c)

    return j.select(
        ckpt_col, id_col, "prompt", valid.alias("valid"), F.length("svg").alias("svg_chars"),
        TX.preview(F.coalesce("raw_text", F.lit("")), 240).alias("raw_preview"),
        gated(F.col("__visual")).alias("visual_proxy"), gated(F.col("__ssim")).alias("ssim_proxy"),
        gated(F.col("__edge")).alias("edge_f1_proxy"), gated(F.col("__struct")).alias("structural_proxy"),
        gated(F.col("__compact")).alias("compactness_proxy"), gated(F.col("__mae")).alias("render_mae"),
        gated(composite_score(F.col("__visual"), F.col("__struct"), F.col("__compact"))).alias("pdf_proxy_score"))


def eval_means(rows: DataFrame, ckpt_col: str = "checkpoint") -> DataFrame:
    """A6 per checkpoint: mean score and mean MAE over rows that have one; invalid count over all."""
    return rows.groupBy(ckpt_col).agg(
        F.avg("pdf_proxy_score").alias("mean_pdf_proxy_score"),
        F.avg("render_mae").alias("mean_render_mae"),
        F.count_if(~F.col("valid")).alias("invalid_count"))


def checkpoint_scores(checkpoints: DataFrame, rows: DataFrame, ckpt_col: str = "checkpoint") -> DataFrame:
    """Every listed checkpoint with its means; a checkpoint without rows is kept with null
    metrics and an ``error`` text."""
    means = eval_means(rows, ckpt_col)
    out = checkpoints.select(ckpt_col).distinct().join(means, ckpt_col, "left")
    return out.withColumn("error", F.when(F.col("invalid_count").isNull(), F.lit("no evaluation rows")))


def read_scores_defaults(scores: DataFrame) -> DataFrame:
    """Keep scored rows, default absent columns (invalid_count 0, mean_render_mae 1e9)."""
    out = scores
    if "invalid_count" not in out.columns:
        out = out.withColumn("invalid_count", F.lit(0).cast("long"))
    if "mean_render_mae" not in out.columns:
        out = out.withColumn("mean_render_mae", F.lit(K.MISSING_MAE))
    return out.filter(F.col("mean_pdf_proxy_score").isNotNull())


def best_checkpoint(scores: DataFrame, ckpt_col: str = "checkpoint") -> DataFrame:
    """Max of (mean score, -invalid, -MAE) with null invalid as 0 and null MAE as 1e9;
    full ties go to the first checkpoint in name order.  One row."""
    s = scores.filter(F.col("mean_pdf_proxy_score").isNotNull())
    key = F.struct(F.col("mean_pdf_proxy_score").alias("s"), (-F.coalesce(F.col("invalid_count"), F.lit(0))).alias("i"),
                   (-F.coalesce(F.col("mean_render_mae"), F.lit(K.MISSING_MAE))).alias("m"))
    # top-1 by key, then by name: a TakeOrdered, no global sort
    return s.withColumn("__k", key).orderBy(F.desc("__k"), F.asc(ckpt_col)).limit(1).select(
        F.col(ckpt_col).alias("selected"))


def rank_checkpoints(scores: DataFrame, k: int = K.LEADERBOARD_KEEP, ckpt_col: str = "checkpoint") -> DataFrame:
    """Order by score desc, invalid asc, MAE asc (after S7 defaults); first k."""
    s = read_scores_defaults(scores)
    return s.orderBy(F.desc("mean_pdf_proxy_score"), F.asc_nulls_last("invalid_count"),
                     F.asc_nulls_last("mean_render_mae"), F.asc(ckpt_col)).limit(k)


def last_n_versions(entries: DataFrame, n: int = K.LEADERBOARD_KEEP) -> DataFrame:
    """Per checkpoint name keep the path of the latest source; order by the numeric
    suffix and keep the last n, ascending.  ``entries``: (name, path, source_rank); names
    other than ``checkpoint-<number>`` are no checkpoints and are left out."""
    entries = entries.filter(F.col("name").rlike(r"^checkpoint-\d+$"))
    latest = entries.groupBy("name").agg(F.max_by("path", "source_rank").alias("path"))
    step = F.regexp_extract("name", r"-(\d+)$", 1).try_cast("long")
    return latest.withColumn("step", step).orderBy(F.desc("step")).limit(n).orderBy("step")
