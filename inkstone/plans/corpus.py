"""Job A: corpus preparation — (id, prompt, svg) pairs to clean, valid, unique pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.functions import markup as MX
from inkstone.functions import text as TX
from inkstone.operators import markup as M
from inkstone.operators.dedupe import dedupe_pairs


def clean_pairs(pairs: DataFrame, id_col: str = "id", prompt_col: str = "prompt", svg_col: str = "svg") -> DataFrame:
    """P1 + P2: stripped prompt (null -> ""), markup null -> "", normalised prompt."""
    return (pairs.withColumn(prompt_col, TX.clean_prompt(F.col(prompt_col)))
                 .withColumn(svg_col, F.coalesce(F.col(svg_col).cast("string"), F.lit("")))
                 .withColumn("prompt_norm", TX.prompt_norm(F.col(prompt_col))))


def prepare_corpus(pairs: DataFrame, id_col: str = "id", prompt_col: str = "prompt", svg_col: str = "svg",
                   min_chars: int = K.MIN_MARKUP_CHARS, max_chars: int = K.MAX_MARKUP_CHARS,
                   quality_filter: bool = False, dedupe: bool = True, keep_raw: bool = True) -> DataFrame:
    """Job A: clean -> length filter (before the Python leaf) -> canonicalise -> non-empty
    -> valid -> optional richness filter -> dedupe -> combined length.

    Output columns: id, prompt, svg, prompt_norm, svg_norm, valid, combined_chars.
    ``keep_raw=False`` drops the raw markup before the dedupe shuffle (downstream
    jobs only use the canonical text), halving the bytes that shuffle.
    """
    df = clean_pairs(pairs.select(id_col, prompt_col, svg_col), id_col, prompt_col, svg_col)
    df = M.length_filter(df, svg_col, prompt_col, min_chars, max_chars)          # F1, cheap, first
    df = M.canonicalise(df, svg_col, "svg_norm", variant="train")                # M1, the Python leaf
    df = M.nonempty_norm(df, "svg_norm")                                         # F2
    df = MX.with_parsed(df, "svg_norm", "__")                                    # M2/M4/M7, per row
    df = df.filter(F.col("__valid")).withColumnRenamed("__valid", "valid")       # F3
    df = df.drop("__els", "__stats", "__bounds", "__path_count", "__coverage")
    df = M.visually_rich(df, "svg_norm", enabled=quality_filter)                 # F4
    if not keep_raw:
        df = df.drop(svg_col)
    if dedupe:
        df = dedupe_pairs(df, ["prompt_norm", "svg_norm"], id_col)              # D1
    return df.withColumn("combined_chars", (F.length(prompt_col) + F.length("svg_norm")).cast("long"))
