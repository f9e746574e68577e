"""Dedupe and union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_pairs(df: DataFrame, key_cols: list, order_col: str = "id") -> DataFrame:
    """Keep the first row (smallest ``order_col``) of each distinct key.

    Grouped on a SHA-256 of the (long) key texts so the shuffle key is 32 bytes;
    ``min_by`` is a partial aggregate, so a hot key (say a third of all rows) is
    reduced to one row per map task before the shuffle.
    """
    cols = df.columns
    key = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in key_cols]), 256)
    packed = F.struct(*[F.col(c) for c in cols])
    kept = df.groupBy(key.alias("__k")).agg(F.min_by(packed, F.col(order_col)).alias("__row"))
    return kept.select("__row.*")


def dedupe_candidates(df: DataFrame, group_col: str = "prompt_id", markup_col: str = "markup",
                      seq_col: str = "seq", lane_col: str | None = None) -> DataFrame:
    """Drop empty markup, keep the first (by ``seq``) of each (group, markup);
    a group left with nothing keeps all its original rows.  Rows of different lanes of a
    group (``lane_col``) are deduplicated apart.

    One linear pass: a single shuffle by group, then two windows (the second's
    (group, hash) clustering is satisfied by the first's partitioning).  The input
    is read once, so an expensive upstream (the canonicaliser) runs once.  A group
    is one prompt's candidates, bounded by the generation budget plus retrieval.
    """
    lane = [lane_col] if lane_col else []
    # hashed before the shuffle: the text itself travels only if a later step reads it
    nonempty = F.length(F.coalesce(F.col(markup_col), F.lit(""))) > 0
    keyed = df.withColumn("__h", F.when(nonempty, F.sha2(F.col(markup_col), 256)))
    any_nonempty = F.max(F.col("__h").isNotNull().cast("int")).over(Window.partitionBy(group_col, *lane))
    first = F.row_number().over(Window.partitionBy(group_col, *lane, "__h").orderBy(seq_col))
    out = keyed.withColumn("__any", any_nonempty).withColumn("__rn", first)
    keep = F.when(F.col("__any") == 1, F.col("__h").isNotNull() & (F.col("__rn") == 1)).otherwise(F.lit(True))
    return out.filter(keep).drop("__h", "__any", "__rn")


def union_frames(*frames: DataFrame) -> DataFrame:
    """D3: union by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

