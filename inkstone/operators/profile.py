"""Aggregations: length profile, colour frequencies, bucket sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as TX
from inkstone.operators.index import combine_single_rows, histogram_quantiles, length_histogram


def length_profile(df: DataFrame, length_col: str, group_cols: list | None = None) -> DataFrame:
    """A1: rows, mean, median, p90, p95, max of a length column (exact, linear interpolation).

    Lengths are bounded (markup <= 16000 chars after F1), so the (group, length)
    histogram is small whatever the row count; quantiles are read off it instead
    of sorting every row of a group in one task.
    """
    g = list(group_cols or [])
    hist = length_histogram(df, length_col, g).cache()
    q = histogram_quantiles(hist, length_col, [0.5, 0.9, 0.95], g)
    basic = hist.groupBy(*g).agg(
        F.sum("n").alias("rows"),
        (F.sum(F.col(length_col) * F.col("n")) / F.sum("n")).alias("mean_chars"),
        F.max(length_col).alias("max_chars"))
    out = basic.join(q, g, "inner") if g else combine_single_rows(basic, q)
    return out.select(*g, "rows", "mean_chars", F.col("q0").alias("median_chars"),
                      F.col("q1").alias("p90_chars"), F.col("q2").alias("p95_chars"), "max_chars")


def color_frequency(df: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """A2: prompts per colour word (whole-word match, one count per prompt and colour)."""
    return (df.select(F.explode(TX.color_tokens_literal(F.col(prompt_col))).alias("color"))
              .groupBy("color").agg(F.count(F.lit(1)).alias("n")))


def top_colors(freq: DataFrame, k: int = 8) -> DataFrame:
    """A3: the k most frequent colours (ties by name)."""
    return freq.orderBy(F.desc("n"), F.asc("color")).limit(k)


def max_color_count(freq: DataFrame) -> DataFrame:
    """Global maximum of the colour counts (one row)."""
    return freq.agg(F.max("n").alias("max_n"))


def bucket_sizes(df: DataFrame, bucket_col: str = "split_bucket") -> DataFrame:
    """A4: rows per split bucket."""
    return df.groupBy(bucket_col).agg(F.count(F.lit(1)).alias("n"))


def distinct_count(df: DataFrame, col: str, alias: str | None = None) -> DataFrame:
    """A5: number of distinct values of a column (one row)."""
    return df.agg(F.countDistinct(col).alias(alias or f"distinct_{col}"))
