"""Markup corpus jobs (M1-M12, F2-F4, F8, F6 as table jobs).

Shred once, then stay relational: :func:`canonicalise` is the only Python leaf
(``mapInArrow``, Arrow batches, scan-parallel, no shuffle).  Everything after
it is Catalyst: per-document statistics are array expressions on one row
(:mod:`inkstone.functions.markup`), element tables come from ``posexplode``.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone import constants as K
from inkstone.functions import markup as MX
from inkstone.functions import text as TX
from inkstone.operators.canon import canonical_markup


def with_canonical(df: DataFrame, out: str, variant: str, col: str, otherwise: str | None = None) -> DataFrame:
    """M1: add ``out``, the canonical markup of ``col``, or of ``otherwise`` where that is unusable and
    ``col`` is not blank; "" when neither is usable.

    Other columns pass through as Arrow arrays, so no id or number changes on its way.
    """
    if variant not in ("train", "infer"):
        raise ValueError("variant must be 'train' or 'infer'")
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(col).to_pylist()
            made = [canonical_markup(x, variant) for x in texts]
            if otherwise is not None:
                spare = batch.column(otherwise).to_pylist()
                made = [m or (canonical_markup(y, variant) if x and x.strip() else "") for m, x, y in zip(made, texts, spare)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(made, pa.string())], [*names, out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType(), False)]))


def canonicalise(df: DataFrame, col: str, out: str = "markup_norm", variant: str = "train") -> DataFrame:
    """M1: canonical markup text of ``col`` in ``out`` ("" when unusable).

    Put cheap filters (e.g. :func:`length_filter`) *before* this call: Catalyst
    does not push a filter below ``mapInArrow``.
    """
    return with_canonical(df, out, variant, col)


def candidate_cleanup(df: DataFrame, col: str, out: str = "markup", rescale: bool = True) -> DataFrame:
    """Canonicalise the raw text; if that is empty, canonicalise the markup
    extracted from it; then rescale the viewBox (M10).  One Python pass."""
    from inkstone.operators.rank import clean_candidates
    cleaned = clean_candidates(df, col, mode="retrieved").drop("__c_stats", "__c_coverage", "__c_valid")
    keep = "markup" if rescale else "markup_canon"
    drop = "markup_canon" if rescale else "markup"
    return cleaned.drop(drop).withColumnRenamed(keep, out) if out != keep else cleaned.drop(drop)


def length_filter(df: DataFrame, markup_col: str, prompt_col: str | None = None,
                  lo: int = K.MIN_MARKUP_CHARS, hi: int = K.MAX_MARKUP_CHARS) -> DataFrame:
    """raw markup length in [lo, hi] and (optionally) a non-empty prompt."""
    n = F.length(F.coalesce(F.col(markup_col), F.lit("")))
    cond = (n >= lo) & (n <= hi)
    if prompt_col:
        cond = cond & (F.length(F.col(prompt_col)) > 0)
    return df.filter(cond)


def nonempty_norm(df: DataFrame, col: str = "markup_norm") -> DataFrame:
    """keep rows whose canonical text is non-empty."""
    return df.filter(F.length(F.col(col)) > 0)


def with_markup_stats(df: DataFrame, col: str = "markup_norm", prefix: str = "") -> DataFrame:
    """M4 + M7 + M8 + M9 as columns: stats struct, path count, bounds, coverage, valid."""
    return MX.with_parsed(df, col, prefix).drop(prefix + "els")


def valid_filter(df: DataFrame, col: str = "markup_norm") -> DataFrame:
    """keep rows whose canonical markup passes M7."""
    return MX.with_parsed(df, col, "__v_").filter(F.col("__v_valid")).drop(
        "__v_els", "__v_stats", "__v_bounds", "__v_path_count", "__v_coverage", "__v_valid")


def visually_rich(df: DataFrame, col: str = "markup_norm", enabled: bool = True) -> DataFrame:
    """at least two drawable elements and two distinct paints (off when ``enabled`` is false)."""
    if not enabled:
        return df
    rich = MX.rich_colors(MX.parse_elements(col))
    return df.filter((rich["drawables"] >= 2) & (rich["colors"] >= 2))


def shred_elements(df: DataFrame, key_cols: list[str], col: str = "markup_norm") -> DataFrame:
    """M2: one row per start tag: keys, pos (0-based), tag, attribute text."""
    exploded = df.select(*key_cols, F.posexplode(MX.start_tags(F.col(col))).alias("pos", "element"))
    return exploded.select(
        *key_cols, "pos",
        MX.tag_name(F.col("element")).alias("tag"),
        F.regexp_extract(F.col("element"), r"(?s)^<[A-Za-z]+\s*(.*?)\s*/?>$", 1).alias("attrs"))


def tag_counts(df: DataFrame, key_cols: list[str], col: str = "markup_norm") -> DataFrame:
    """M6: (keys, tag, n) — counted inside each row, then exploded: no shuffle."""
    return df.select(*key_cols, F.explode(MX.tag_histogram(F.col(col))).alias("tag", "n"))


def safety_pass(df: DataFrame, col: str = "markup", valid_col: str | None = None) -> DataFrame:
    """F8: replace markup that fails M7 by the fixed safety document; flag replaced rows."""
    if valid_col:
        flagged = df.withColumn("replaced", ~F.coalesce(F.col(valid_col), F.lit(False)))
    else:
        flagged = MX.with_parsed(df, col, "__s_").withColumn("replaced", ~F.coalesce(F.col("__s_valid"), F.lit(False)))
        flagged = flagged.drop("__s_els", "__s_stats", "__s_bounds", "__s_path_count", "__s_coverage", "__s_valid")
    return flagged.withColumn(col, F.when(F.col("replaced"), F.lit(K.SAFETY_MARKUP)).otherwise(F.col(col)))


def unsafe_audit(df: DataFrame, col: str) -> DataFrame:
    """F6 over whole texts: does the text contain any unsafe token."""
    return df.withColumn("unsafe", TX.unsafe_value(F.col(col)))
