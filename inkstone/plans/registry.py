"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver tables (or data Spark derives from them) whole.
Numeric outputs are rounded to 6 decimals and integers widened to BIGINT on
both sides so the engines' hashes compare values, not float noise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone import constants as K
from inkstone.functions import markup as MX
from inkstone.functions import text as TX
from inkstone.operators import markup as M
from inkstone.operators import order as O
from inkstone.operators import profile as P
from inkstone.operators.balance import weighted_oversample, with_rarity_weight
from inkstone.operators.dedupe import dedupe_pairs, union_frames
from inkstone.operators.split import bucket_quota, eval_size, length_edges, stratified_split, with_length_bin, with_split_bucket
from inkstone.plans import sqlref as R
from inkstone.plans.corpus import prepare_corpus
from inkstone.session import checkpoint_dir
from inkstone.sources import standins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Round doubles to 6 decimals, widen integers to BIGINT."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("long").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def docs(spark, sf):
    return S.load(spark, sf, "documents")


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# ===================================================================== documents: text
_DOC_CLEAN = f"""
SELECT doc_id, lang, {R.clean('text')} AS t FROM documents"""

_DOC_DEDUPED = f"""
WITH c AS ({_DOC_CLEAN}),
k AS (SELECT *, row_number() OVER (PARTITION BY {R.norm('t')} ORDER BY doc_id) AS rn FROM c)
SELECT doc_id, lang, t FROM k WHERE rn = 1"""


def _doc_deduped(spark, sf):
    """Clean, then D1 on the normalised text.  Only (id, lang, length, text hash)
    travel through the dedupe shuffle, never the text itself."""
    d = docs(spark, sf).select("doc_id", "lang", TX.clean_prompt("text").alias("t"))
    d = d.select("doc_id", "lang", F.length("t").cast("long").alias("len"),
                 F.sha2(TX.prompt_norm("t"), 256).alias("t_hash"))
    return dedupe_pairs(d, ["t_hash"], "doc_id").drop("t_hash")


@query("corpus_profile", f"""
WITH d AS ({_DOC_DEDUPED})
SELECT lang, count(*) AS rows, {r6('avg(length(t))')} AS mean_chars,
       {r6('quantile_cont(length(t), 0.5)')} AS median_chars, {r6('quantile_cont(length(t), 0.9)')} AS p90_chars,
       {r6('quantile_cont(length(t), 0.95)')} AS p95_chars, {big('max(length(t))')} AS max_chars
FROM d GROUP BY lang""")
def corpus_profile(spark, sf):
    """P1 clean -> P2 + D1 dedupe -> P3 lengths -> A1 profile per language."""
    return finish(P.length_profile(_doc_deduped(spark, sf), "len", ["lang"]))


@query("clean_text", f"""
WITH c AS (SELECT doc_id, {R.clean('text')} AS t FROM documents)
SELECT doc_id, {big('length(t)')} AS prompt_chars, {big(f'length({R.norm("t")})')} AS norm_chars,
       md5({R.norm('t')}) AS norm_md5 FROM c""")
def clean_text(spark, sf):
    """P1 clean, P2 normalise, P3 code-point lengths."""
    d = docs(spark, sf).select("doc_id", TX.clean_prompt("text").alias("t"))
    n = TX.prompt_norm("t")
    return finish(d.select("doc_id", F.length("t").alias("prompt_chars"), F.length(n).alias("norm_chars"),
                           F.md5(n).alias("norm_md5")))


def _csv_safe_sql(x):
    t = f"replace(replace(replace({x}, chr(13), ' '), chr(10), ' '), chr(9), ' ')"
    t = f"regexp_replace({t}, {R.q(TX.WS + '{2,}')}, ' ', 'g')"
    return f"replace({R.strip(t)}, '\"', '''')"


@query("csv_safe_text", f"""
SELECT doc_id, {big(f'length({_csv_safe_sql("text")})')} AS safe_chars, md5({_csv_safe_sql('text')}) AS safe_md5
FROM documents""")
def csv_safe_text(spark, sf):
    """Single-line, quote-safe text."""
    s = TX.csv_safe_text("text")
    return finish(docs(spark, sf).select("doc_id", F.length(s).alias("safe_chars"), F.md5(s).alias("safe_md5")))


def _trunc_sql(x, n=K.MAX_PROMPT_CHARS):
    return f"(CASE WHEN length({x}) > {n} THEN regexp_replace(substr({x}, 1, {n}), ' [^ ]*$', '') ELSE {x} END)"


@query("truncate_prompt", f"""
SELECT doc_id, {big(f'length({_trunc_sql("text")})')} AS trunc_chars, md5({_trunc_sql('text')}) AS trunc_md5
FROM documents""")
def truncate_prompt(spark, sf):
    """P5: cut to 700 characters without a partial last word."""
    t = TX.truncate_prompt("text")
    return finish(docs(spark, sf).select("doc_id", F.length(t).alias("trunc_chars"), F.md5(t).alias("trunc_md5")))


@query("prompt_complexity", f"""
SELECT doc_id, {big(R.prompt_complexity('text'))} AS complexity, {R.prompt_is_complex('text')} AS is_complex
FROM documents""")
def prompt_complexity(spark, sf):
    """P8 bin (0-2) and P9 flag over whole document texts."""
    d = docs(spark, sf)
    return finish(d.select("doc_id", TX.prompt_complexity("text").alias("complexity"),
                           TX.prompt_is_complex("text").alias("is_complex")))


@query("dedupe_documents", f"""
WITH d AS ({_DOC_DEDUPED}) SELECT doc_id, lang FROM d""")
def dedupe_documents(spark, sf):
    """First document (by id) per normalised text, after clean + F1."""
    return finish(_doc_deduped(spark, sf).select("doc_id", "lang"))


@query("length_sort", """
SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS idx FROM documents""")
def length_sort(spark, sf):
    """D9 + H1: position of every document in (length, id) order."""
    d = docs(spark, sf).select("doc_id", "n_chars")
    return finish(O.length_sort(d, "n_chars", "doc_id", "idx"))


@query("fixed_batches", """
SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_id FROM documents""")
def fixed_batches(spark, sf):
    """Consecutive batches of 64 rows in id order."""
    return finish(O.fixed_batches(docs(spark, sf).select("doc_id"), 64, ["doc_id"]))


@query("round_robin_shards", """
SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 8 AS shard FROM documents""")
def round_robin_shards(spark, sf):
    """Row i (id order) -> shard i mod 8."""
    return finish(O.round_robin_shards(docs(spark, sf).select("doc_id"), 8, ["doc_id"]))


@query("length_bucketed_batches", """
SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32 AS batch_id FROM documents""")
def length_bucketed_batches(spark, sf):
    """Batches of 32 documents of similar length."""
    d = docs(spark, sf).select("doc_id", "n_chars")
    return finish(O.length_bucketed_batches(d, "n_chars", 32, "doc_id").select("doc_id", "batch_id"))


@query("seeded_shuffle", """
SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx FROM documents""")
def seeded_shuffle(spark, sf):
    """Deterministic permutation (seed 42)."""
    return finish(O.seeded_shuffle(docs(spark, sf).select("doc_id"), "doc_id", K.SEED, "idx"))


@query("seeded_sample", """
SELECT doc_id, lang FROM documents ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 64""")
def seeded_sample(spark, sf):
    """64 rows without replacement (the audit sample)."""
    return finish(O.seeded_sample(docs(spark, sf).select("doc_id", "lang"), 64, "doc_id", K.SEED))


@query("even_subsample", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
p AS (SELECT DISTINCT CASE WHEN k = least(64, n) - 1 THEN n - 1
                            ELSE CAST(floor(k * ((n - 1) / (least(64, n) - 1))) AS BIGINT) END AS i
      FROM (SELECT DISTINCT n FROM o) s, LATERAL (SELECT unnest(range(0, least(64, n))) AS k) r)
SELECT doc_id FROM o WHERE i IN (SELECT i FROM p)""")
def even_subsample(spark, sf):
    """64 evenly spaced documents of the (length, id) order."""
    d = docs(spark, sf).select("doc_id", "n_chars")
    return finish(O.even_subsample(d, 64, ["n_chars", "doc_id"]).select("doc_id"))


@query("longest_rows", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM o WHERE i < least(n, greatest(128, CAST(floor(n * 0.3) AS BIGINT)))""")
def longest_rows(spark, sf):
    """min(n, max(128, 0.3 n)) longest documents, ties by id."""
    d = docs(spark, sf).select("doc_id", "n_chars")
    return finish(O.longest_rows(d, "n_chars", "doc_id", 0.3, 128).select("doc_id"))


@query("pending_rows", """
SELECT CAST(doc_id AS VARCHAR) AS id FROM documents
WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""")
def pending_rows(spark, sf):
    """ids not finished yet (finished = present in ``labels``), compared as strings."""
    from inkstone.operators.resume import pending_rows as pending
    todo = docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"))
    done = S.load(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return finish(pending(todo, done, "id"))


@query("lookup_prompt", """
SELECT l.doc_id, l.quality, substr(d.text, 1, 120) AS prompt_preview
FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id""")
def lookup_prompt(spark, sf):
    """J7 + P15: prompt preview (120 chars) for each result id."""
    lab = S.load(spark, sf, "labels").select("doc_id", "quality")
    d = docs(spark, sf).select("doc_id", TX.preview("text", 120).alias("prompt_preview"))
    return finish(lab.join(d, "doc_id", "left"))


# ===================================================================== pages
@query("extract_markup", f"""
SELECT page_id, {big(f'length({R.extract_markup("html", "article")})')} AS extracted_chars,
       md5({R.extract_markup('html', 'article')}) AS extracted_md5 FROM pages""")
def extract_markup(spark, sf):
    """P14 on raw web pages with root tag ``article`` (complete match, else salvage)."""
    x = TX.extract_markup(F.col("html"), "article")
    return finish(S.load(spark, sf, "pages").select("page_id", F.length(x).alias("extracted_chars"),
                                                    F.md5(x).alias("extracted_md5")))


@query("unsafe_value_flag", f"""
SELECT page_id, {R.contains_any('lower(html)', K.UNSAFE_TOKENS)} AS unsafe,
       {big(R.count_sub('lower(html)', '<script'))} AS script_tags FROM pages""")
def unsafe_value_flag(spark, sf):
    """F6 as a corpus audit over whole pages."""
    p = M.unsafe_audit(S.load(spark, sf, "pages"), "html")
    return finish(p.select("page_id", "unsafe", TX.count_sub(F.lower("html"), "<script").alias("script_tags")))


_ROOT = r"^\s*(?:<\?[^>]*\?>\s*)?(?:<!--.*?-->\s*)*(?:<!DOCTYPE[^>]*>\s*)?<([A-Za-z_][-\w:.]*)"


@query("canonicalise_pages", f"""
WITH r AS (SELECT page_id, regexp_extract(html, {R.q("(?s)" + _ROOT)}, 1) AS root FROM pages)
SELECT page_id, CASE WHEN regexp_replace(root, '^.*:', '') <> 'svg' THEN '' END AS markup_norm FROM r""")
def canonicalise_pages(spark, sf):
    """M1 on whole web pages: the root is not ``svg`` so every page canonicalises to ""."""
    p = S.load(spark, sf, "pages").select("page_id", "html")
    return finish(M.canonicalise(p, "html", "markup_norm").select("page_id", "markup_norm"))


# ===================================================================== built markup corpus
_PAIRS = S.markup_pairs_sql(expected=True)


def _pairs(spark, sf):
    return S.markup_pairs(spark, sf)


def _canon(spark, sf, variant="train"):
    return M.canonicalise(_pairs(spark, sf), "svg", "markup_norm", variant)


@query("canonicalise_corpus", f"""
WITH p AS ({_PAIRS}) SELECT id, expected_norm AS markup_norm FROM p""")
def canonicalise_corpus(spark, sf):
    """M1 (train variant) over every built document."""
    return finish(_canon(spark, sf).select("id", "markup_norm"))


_STATS_SQL = f"""
WITH p AS ({_PAIRS}),
b AS (SELECT id, expected_norm AS m, {R.bounds_lists('expected_norm')[0]} AS xs, {R.bounds_lists('expected_norm')[1]} AS ys FROM p),
s AS (SELECT id, m, {R.paint_stats_cols('m')},
             CASE WHEN len(xs) > 0 AND len(ys) > 0 THEN list_min(xs) END AS min_x,
             CASE WHEN len(xs) > 0 AND len(ys) > 0 THEN list_min(ys) END AS min_y,
             CASE WHEN len(xs) > 0 AND len(ys) > 0 THEN list_max(xs) END AS max_x,
             CASE WHEN len(xs) > 0 AND len(ys) > 0 THEN list_max(ys) END AS max_y,
             {R.path_count('m')} AS path_count FROM b)"""


@query("markup_stats", f"""
{_STATS_SQL}
SELECT id, {big('drawable_count')} AS drawable_count, {big('painted_count')} AS painted_count,
       {big('visible_paint_count')} AS visible_paint_count, {big('distinct_colors')} AS distinct_colors,
       {big('path_count')} AS path_count, {r6('min_x')} AS min_x, {r6('min_y')} AS min_y, {r6('max_x')} AS max_x,
       {r6('max_y')} AS max_y, {r6(R.coverage('min_x', 'min_y', 'max_x', 'max_y'))} AS coverage,
       {R.validity('m', 'drawable_count', 'visible_paint_count')} AS valid
FROM s""")
def markup_stats(spark, sf):
    """M4 paint stats, M8 bounds, M9 coverage, M7 validity on canonical text (no shuffle)."""
    d = M.with_markup_stats(_canon(spark, sf), "markup_norm")  # parsed once per row
    return finish(d.select("id", "stats.drawable_count", "stats.painted_count", "stats.visible_paint_count",
                           "stats.distinct_colors", "path_count", "bounds.min_x", "bounds.min_y", "bounds.max_x",
                           "bounds.max_y", "coverage", "valid"))


@query("shred_elements", f"""
WITH p AS ({_PAIRS}),
e AS (SELECT id, unnest({R.start_tags('expected_norm')}) AS el,
             unnest(range(0, len({R.start_tags('expected_norm')}))) AS pos FROM p)
SELECT id, pos, {R.tag_name('el')} AS tag, regexp_extract(el, '(?s)^<[A-Za-z]+\\s*(.*?)\\s*/?>$', 1) AS attrs FROM e""")
def shred_elements(spark, sf):
    """M2: one row per element with position, tag and attribute text."""
    return finish(M.shred_elements(_canon(spark, sf), ["id"], "markup_norm"))


@query("tag_counts", f"""
WITH p AS ({_PAIRS}), e AS (SELECT id, unnest({R.start_tags('expected_norm')}) AS el FROM p)
SELECT id, {R.tag_name('el')} AS tag, count(*) AS n FROM e GROUP BY ALL""")
def tag_counts(spark, sf):
    """M6: element count per tag per document."""
    return finish(M.tag_counts(_canon(spark, sf), ["id"], "markup_norm"))


@query("paint_colors", f"""
WITH p AS ({_PAIRS}), e AS (SELECT id, unnest({R.start_tags('expected_norm')}) AS el FROM p),
v AS (SELECT id, unnest([{R.attr('el', 'fill')}, {R.attr('el', 'stroke')}]) AS paint FROM e)
SELECT paint, {R.visible_paint('paint')} AS visible, count(*) AS n FROM v WHERE paint <> '' GROUP BY ALL""")
def paint_colors(spark, sf):
    """M3 + M5: every fill/stroke value of the corpus with its visibility, counted."""
    el = M.shred_elements(_canon(spark, sf), ["id"], "markup_norm")
    e = F.concat(F.lit("<x "), F.col("attrs"), F.lit(">"))
    v = el.select(F.explode(F.array(MX.attr(e, "fill"), MX.attr(e, "stroke"))).alias("paint")).filter("paint <> ''")
    out = v.groupBy("paint").agg(F.count(F.lit(1)).alias("n"))
    return finish(out.select("paint", MX.is_visible_paint(F.col("paint")).alias("visible"), "n"))


@query("internal_refs", f"""
WITH p AS ({_PAIRS}), e AS (SELECT id, unnest({R.start_tags('expected_norm')}) AS el FROM p),
v AS (SELECT id, unnest([{R.attr('el', 'fill')}, {R.attr('el', 'stroke')}, {R.attr('el', 'href')}]) AS value FROM e)
SELECT id, value, (length(regexp_replace(value, {R.q(TX.WS + '+')}, '', 'g')) > 0 AND
   (starts_with(regexp_replace(value, {R.q(TX.WS + '+')}, '', 'g'), '#') OR
    regexp_matches(regexp_replace(value, {R.q(TX.WS + '+')}, '', 'g'), '^url\\(#[-\\w:.]+\\)$'))) AS is_internal
FROM v WHERE contains(value, 'url(') OR contains(value, '#')""")
def internal_refs(spark, sf):
    """Is each reference-like value (href, url(...), #...) a local reference."""
    el = M.shred_elements(_canon(spark, sf), ["id"], "markup_norm")
    e = F.concat(F.lit("<x "), F.col("attrs"), F.lit(">"))
    v = el.select("id", F.explode(F.array(MX.attr(e, "fill"), MX.attr(e, "stroke"), MX.attr(e, "href"))).alias("value"))
    v = v.filter(F.contains("value", F.lit("url(")) | F.contains("value", F.lit("#")))
    return finish(v.select("id", "value", MX.is_internal_reference(F.col("value")).alias("is_internal")))


@query("markup_complexity", f"""
WITH p AS ({_PAIRS}) SELECT id, {big(R.markup_complexity('expected_norm'))} AS svg_complexity FROM p""")
def markup_complexity(spark, sf):
    """P10 on canonical markup."""
    return finish(_canon(spark, sf).select("id", TX.markup_complexity("markup_norm").alias("svg_complexity")))


@query("structural_score", f"""
WITH p AS ({_PAIRS})
SELECT id, {r6(R.structural_score('expected_norm'))} AS structural, {r6(R.prompt_bonus('prompt', 'expected_norm'))} AS bonus
FROM p""")
def structural_score(spark, sf):
    """P13 structure score and P12 prompt bonus of canonical markup."""
    d = _canon(spark, sf)
    return finish(d.select("id", TX.structural_score("markup_norm").alias("structural"),
                           TX.prompt_bonus("prompt", "markup_norm").alias("bonus")))


@query("fallback_markup", f"""
SELECT CAST(p_partkey AS VARCHAR) AS id, {R.fallback_markup('p_name')} AS fallback FROM part""")
def fallback_markup(spark, sf):
    """Prompt-aligned fallback document for every part name."""
    p = S.load(spark, sf, "part")
    return finish(p.select(F.col("p_partkey").cast("string").alias("id"), TX.fallback_markup("p_name").alias("fallback")))


_RICH = R.rich_counts("expected_norm")


@query("visually_rich", f"""
WITH p AS ({_PAIRS})
SELECT id FROM p WHERE length(expected_norm) > 0 AND {_RICH[0]} >= 2 AND {_RICH[1]} >= 2""")
def visually_rich(spark, sf):
    """F4 richness filter (>= 2 drawables, >= 2 paints) on the canonical corpus."""
    return finish(M.visually_rich(_canon(spark, sf), "markup_norm").select("id"))


# ===================================================================== colours
@query("color_tokens", f"""
SELECT CAST(p_partkey AS VARCHAR) AS id, array_to_string({R.color_tokens('p_name')}, ',') AS colors FROM part""")
def color_tokens(spark, sf):
    """Whole-word colour words of each prompt, fixed order."""
    p = S.load(spark, sf, "part")
    return finish(p.select(F.col("p_partkey").cast("string").alias("id"),
                           F.array_join(TX.color_tokens_literal("p_name"), ",").alias("colors")))


_COLOR_FREQ = f"""
SELECT color, count(*) AS n FROM (SELECT unnest({R.color_tokens('p_name')}) AS color FROM part) t GROUP BY color"""


@query("color_frequency", _COLOR_FREQ)
def color_frequency(spark, sf):
    """A2: prompts per colour word."""
    return finish(P.color_frequency(S.load(spark, sf, "part"), "p_name"))


@query("top_colors", f"WITH f AS ({_COLOR_FREQ}) SELECT color, n FROM f ORDER BY n DESC, color LIMIT 8")
def top_colors(spark, sf):
    """A3: the 8 most frequent colours."""
    return finish(P.top_colors(P.color_frequency(S.load(spark, sf, "part"), "p_name"), 8))


@query("max_color_count", f"WITH f AS ({_COLOR_FREQ}) SELECT max(n) AS max_n FROM f")
def max_color_count(spark, sf):
    """Largest colour count."""
    return finish(P.max_color_count(P.color_frequency(S.load(spark, sf, "part"), "p_name")))


# ===================================================================== job A / job B: prepare, split, balance
import numpy as _np  # noqa: E402

_QTABLE = ", ".join(
    f"({qn}, {k}, {float(_np.true_divide(_np.float64(v) * 100.0, 100.0))!r})"
    for qn in range(2, 6) for k, v in enumerate(_np.linspace(0, 1, qn + 1)))

_PREPARED = f"""
pairs AS ({_PAIRS}),
c AS (SELECT id, {R.clean('prompt')} AS prompt, coalesce(svg, '') AS svg, expected_norm AS svg_norm FROM pairs),
f AS (SELECT * FROM c WHERE length(svg) BETWEEN {K.MIN_MARKUP_CHARS} AND {K.MAX_MARKUP_CHARS} AND length(prompt) > 0
                          AND length(svg_norm) > 0),
st AS (SELECT *, {R.paint_stats_cols('svg_norm')} FROM f),
v AS (SELECT * FROM st WHERE {R.validity('svg_norm', 'drawable_count', 'visible_paint_count')}),
dd AS (SELECT *, row_number() OVER (PARTITION BY {R.norm('prompt')}, svg_norm ORDER BY id) AS rn FROM v),
prepared AS (SELECT id, prompt, svg, {R.norm('prompt')} AS prompt_norm, svg_norm,
                    CAST(length(prompt) + length(svg_norm) AS BIGINT) AS combined_chars FROM dd WHERE rn = 1)"""

_SPLIT = f"""
{_PREPARED},
nn AS (SELECT count(*) AS n, count(DISTINCT combined_chars) AS nd FROM prepared),
ee AS (SELECT n, least(least({K.MAX_EVAL_ROWS}, greatest({K.MIN_EVAL_ROWS}, CAST(floor(n * {K.EVAL_FRACTION}) AS BIGINT))), n - 1) AS e,
              least(5, greatest(2, nd)) AS qn FROM nn),
qt AS (SELECT * FROM (VALUES {_QTABLE}) t(qn, k, qv)),
sorted AS (SELECT combined_chars AS v, row_number() OVER (ORDER BY combined_chars) - 1 AS pos FROM prepared),
vi AS (SELECT qt.k, (ee.n - 1) * qt.qv AS vi, ee.n FROM qt JOIN ee ON qt.qn = ee.qn),
vx AS (SELECT k, vi, least(greatest(floor(vi), 0), n - 1) AS lo, least(greatest(floor(vi) + 1, 0), n - 1) AS hi,
              vi - floor(vi) AS t FROM vi),
ed AS (SELECT DISTINCT CASE WHEN t >= 0.5 THEN b.v - (b.v - a.v) * (1 - t) ELSE a.v + (b.v - a.v) * t END AS edge
       FROM vx JOIN sorted a ON a.pos = vx.lo JOIN sorted b ON b.pos = vx.hi),
binned AS (SELECT p.*, CAST(greatest(0, (SELECT count(*) FROM ed WHERE ed.edge < p.combined_chars) - 1) AS INTEGER) AS length_bin
           FROM prepared p),
bucketed AS (SELECT *, CAST({R.prompt_complexity('prompt')} AS INTEGER) AS prompt_complexity_bin,
                    CAST({R.markup_complexity('svg_norm')} AS INTEGER) AS svg_complexity_bin FROM binned),
framed AS (SELECT *, 'L' || length_bin || '_P' || prompt_complexity_bin || '_S' || svg_complexity_bin AS split_bucket,
                  row_number() OVER (ORDER BY combined_chars, id) - 1 AS f FROM bucketed),
sizes AS (SELECT split_bucket, count(*) AS n FROM framed GROUP BY split_bucket),
qa AS (SELECT s.*, (CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE)) * (SELECT e FROM ee) AS desired,
              CASE WHEN n >= 20 THEN 1 ELSE 0 END AS minimum FROM sizes s),
qb AS (SELECT *, least(greatest(minimum, CAST(floor(desired) AS BIGINT)), n - 1) AS base, desired - floor(desired) AS remainder
       FROM qa),
qc AS (SELECT *, sum(base) OVER () AS alloc,
              sum(CASE WHEN base < n - 1 THEN 1 ELSE 0 END) OVER (ORDER BY remainder DESC, n DESC, split_bucket
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS add_rank,
              sum(CASE WHEN base - minimum > 0 THEN 1 ELSE 0 END) OVER (ORDER BY remainder, n, split_bucket
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS drop_rank FROM qb),
quota AS (SELECT split_bucket, n, minimum, remainder,
                 CASE WHEN (SELECT e FROM ee) - alloc > 0 AND base < n - 1 AND add_rank <= (SELECT e FROM ee) - alloc THEN base + 1
                      WHEN alloc - (SELECT e FROM ee) > 0 AND base - minimum > 0 AND drop_rank <= alloc - (SELECT e FROM ee)
                      THEN base - 1 ELSE base END AS quota FROM qc),
pos AS (SELECT DISTINCT split_bucket,
               CASE WHEN quota = 1 THEN 0 WHEN i = quota - 1 THEN n - 1
                    ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / CAST(quota - 1 AS DOUBLE))) AS BIGINT) END AS p
        FROM quota, LATERAL (SELECT unnest(range(0, quota)) AS i) r WHERE quota > 0),
inb AS (SELECT *, row_number() OVER (PARTITION BY split_bucket ORDER BY combined_chars, id) - 1 AS bpos FROM framed),
picked AS (SELECT f FROM inb JOIN pos ON inb.split_bucket = pos.split_bucket AND inb.bpos = pos.p),
mm AS (SELECT count(*) AS m FROM picked),
rest AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS r FROM framed WHERE f NOT IN (SELECT f FROM picked)),
need AS (SELECT (SELECT e FROM ee) - m AS k, (SELECT count(*) FROM rest) AS rn FROM mm),
tpos AS (SELECT DISTINCT CASE WHEN k = 1 THEN 0 WHEN i = k - 1 THEN rn - 1
                              ELSE CAST(floor(i * (CAST(rn - 1 AS DOUBLE) / CAST(k - 1 AS DOUBLE))) AS BIGINT) END AS r
         FROM need, LATERAL (SELECT unnest(range(0, k)) AS i) x WHERE k > 0),
topup AS (SELECT f FROM rest WHERE r IN (SELECT r FROM tpos)),
chosen AS (SELECT f FROM (SELECT f, row_number() OVER (ORDER BY f) AS rk FROM (SELECT f FROM picked UNION SELECT f FROM topup) u)
           WHERE rk <= (SELECT e FROM ee)),
split AS (SELECT framed.*, CASE WHEN f IN (SELECT f FROM chosen) THEN 'eval' ELSE 'train' END AS split FROM framed)"""


def _prepared(spark, sf):
    return prepare_corpus(_pairs(spark, sf))


def _split(spark, sf):
    return stratified_split(_prepared(spark, sf), "id", "combined_chars", "prompt", "svg_norm")


@query("prepare_corpus", f"""
WITH {_PREPARED}
SELECT id, prompt_norm, md5(svg_norm) AS svg_md5, combined_chars FROM prepared""")
def prepare_corpus_q(spark, sf):
    """Job A: clean, F1, canonicalise (leaf), F2, M7 valid, D1 dedupe, combined length."""
    d = _prepared(spark, sf)
    return finish(d.select("id", "prompt_norm", F.md5("svg_norm").alias("svg_md5"), "combined_chars"))


@query("eval_size", f"""
WITH {_SPLIT} SELECT n AS rows, e AS eval_rows FROM ee""")
def eval_size_q(spark, sf):
    """Eval size for the prepared corpus."""
    n = _prepared(spark, sf).count()
    return finish(spark.createDataFrame([(n, eval_size(n))], "rows long, eval_rows long"))


def _kept(spark, sf):
    """The prepared rows that the bins and buckets read several times, canonicalised and deduplicated once."""
    checkpoint_dir(spark)
    return _prepared(spark, sf).select("id", "prompt", "svg_norm", "combined_chars").checkpoint()


def _bucketed(spark, sf):
    d = _kept(spark, sf)
    return with_split_bucket(with_length_bin(d, length_edges(d)), "prompt", "svg_norm")


@query("length_bins", f"""
WITH {_SPLIT} SELECT id, combined_chars, length_bin FROM binned""")
def length_bins(spark, sf):
    """Quantile length bins (pandas qcut rules, edges from the length histogram)."""
    d = _kept(spark, sf)
    return finish(with_length_bin(d, length_edges(d)).select("id", "combined_chars", "length_bin"))


@query("split_bucket", f"""
WITH {_SPLIT} SELECT id, prompt_complexity_bin, svg_complexity_bin, split_bucket FROM framed""")
def split_bucket(spark, sf):
    """Complexity bins and bucket label."""
    d = _bucketed(spark, sf)
    return finish(d.select("id", "prompt_complexity_bin", "svg_complexity_bin", "split_bucket"))


@query("bucket_sizes", f"WITH {_SPLIT} SELECT split_bucket, n FROM sizes")
def bucket_sizes(spark, sf):
    """A4: rows per split bucket."""
    d = _bucketed(spark, sf)
    return finish(P.bucket_sizes(d))


@query("distinct_count", f"""
WITH {_SPLIT} SELECT (SELECT count(DISTINCT combined_chars) FROM framed) AS distinct_lengths,
                     (SELECT count(DISTINCT split_bucket) FROM framed) AS distinct_buckets""")
def distinct_count(spark, sf):
    """A5: distinct lengths and distinct buckets."""
    d = _bucketed(spark, sf)
    return finish(d.agg(F.countDistinct("combined_chars").alias("distinct_lengths"),
                        F.countDistinct("split_bucket").alias("distinct_buckets")))


@query("bucket_quota", f"WITH {_SPLIT} SELECT split_bucket, n, quota FROM quota")
def bucket_quota_q(spark, sf):
    """Largest-remainder eval quota per bucket."""
    d = _bucketed(spark, sf)
    return finish(bucket_quota(P.bucket_sizes(d), eval_size(d.count())).select("split_bucket", "n", "quota"))


@query("stratified_split", f"WITH {_SPLIT} SELECT id, split_bucket, split FROM split")
def stratified_split_q(spark, sf):
    """W4 spaced picks + W5 top-up + J6 complement: every row labelled eval or train."""
    return finish(_split(spark, sf).select("id", "split_bucket", "split"))


_TRAIN_W = f"""
{_SPLIT},
train AS (SELECT * FROM split WHERE split = 'train'),
tc AS (SELECT id, {R.color_tokens('prompt')} AS colors FROM train),
cf AS (SELECT color, count(*) AS n FROM (SELECT unnest(colors) AS color FROM tc) x GROUP BY color),
mx AS (SELECT max(n) AS max_n FROM cf),
u AS (SELECT id, unnest(colors) AS color FROM tc),
uw AS (SELECT u.id, sqrt(CAST(mx.max_n AS DOUBLE) / CAST(greatest(cf.n, 1) AS DOUBLE)) AS boost
       FROM u JOIN cf ON cf.color = u.color, mx),
w AS (SELECT tc.id, coalesce(greatest(1.0, max(uw.boost)), 1.0) AS weight FROM tc LEFT JOIN uw ON uw.id = tc.id GROUP BY tc.id)"""


@query("rarity_weight", f"WITH {_TRAIN_W} SELECT id, {r6('weight')} AS weight FROM w")
def rarity_weight(spark, sf):
    """Colour-rarity weight of every train row."""
    train = _split(spark, sf).filter(F.col("split") == "train")
    return finish(with_rarity_weight(train, "prompt").select("id", "weight"))


_OVERSAMPLE = f"""
tot AS (SELECT count(*) AS n, CAST(floor(count(*) * {K.OVERSAMPLE_FACTOR}) AS BIGINT) AS extra FROM w),
cls AS (SELECT weight, count(*) AS nc, row_number() OVER (ORDER BY weight) - 1 AS c FROM w GROUP BY weight),
cm AS (SELECT *, weight * nc AS mass, sum(weight * nc) OVER () AS total,
              sum(nc) OVER (ORDER BY weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start0 FROM cls),
sh AS (SELECT *, (SELECT extra FROM tot) * mass / total AS share, coalesce(start0, 0) AS start FROM cm),
fl AS (SELECT *, CAST(floor(share) AS BIGINT) AS base, share - floor(share) AS rem FROM sh),
al AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, weight DESC, c) <=
                               (SELECT extra FROM tot) - sum(base) OVER () THEN 1 ELSE 0 END AS draws FROM fl),
dr AS (SELECT c, nc, start, unnest(range(0, draws)) AS j FROM al WHERE draws > 0),
hit AS (SELECT start + CAST(('0x' || substr(md5('{K.SEED}|' || c || '|' || j), 1, 15)) AS BIGINT) % nc AS g FROM dr),
idx AS (SELECT id, row_number() OVER (ORDER BY weight, id) - 1 AS g FROM w)
"""


@query("weighted_oversample", f"""
WITH {_TRAIN_W}, {_OVERSAMPLE}
SELECT idx.id, count(*) AS copies FROM hit JOIN idx ON hit.g = idx.g GROUP BY idx.id""")
def weighted_oversample_q(spark, sf):
    """floor(0.3 n) extra train rows drawn by rarity weight; copies per id."""
    train = _split(spark, sf).filter(F.col("split") == "train")
    w = with_rarity_weight(train, "prompt")
    extra = weighted_oversample(w, "weight", "id", prompt_col="prompt")
    return finish(extra.groupBy("id").agg(F.count(F.lit(1)).alias("copies")))


@query("long_context_subset", f"""
WITH {_SPLIT},
o AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY combined_chars DESC, id) - 1 AS i,
             count(*) OVER (PARTITION BY split) AS n FROM split)
SELECT id, split FROM o
WHERE i < least(n, greatest(CASE WHEN split = 'train' THEN {K.LONG_CONTEXT_MIN_TRAIN} ELSE {K.LONG_CONTEXT_MIN_EVAL} END,
                            CAST(floor(n * {K.LONG_CONTEXT_FRACTION}) AS BIGINT)))""")
def long_context_subset_q(spark, sf):
    """W13 per split: longest train rows (>= 4096) and eval rows (>= 128)."""
    from inkstone.operators.split import long_context_subset
    return finish(long_context_subset(_split(spark, sf)).select("id", "split"))


# ===================================================================== job D: candidate ranking
from inkstone.operators import rank as RK  # noqa: E402


def _scored_sql(src: str, text_col: str, keep: str) -> str:
    """SQL CTE chain: canonical text -> bounds -> rescaled markup -> stats -> validity -> score."""
    return f"""
s1_{src} AS (SELECT {keep}, {text_col} AS canon, {R.bounds_cols(text_col, 'c_')} FROM {src}),
s2_{src} AS (SELECT *, {R.rescaled('canon', 'c_min_x', 'c_min_y', 'c_max_x', 'c_max_y')} AS markup FROM s1_{src}),
s3_{src} AS (SELECT *, {R.paint_stats_cols('canon', 'v_')}, {R.paint_stats_cols('markup')}, {R.bounds_cols('markup', 'm_')}
             FROM s2_{src}),
s4_{src} AS (SELECT *, coalesce({R.validity('canon', 'v_drawable_count', 'v_visible_paint_count')}, false) AS valid,
                    {R.coverage('m_min_x', 'm_min_y', 'm_max_x', 'm_max_y')} AS cov0 FROM s3_{src}),
s5_{src} AS (SELECT *, CASE WHEN valid THEN drawable_count ELSE 0 END AS drawables,
                    CASE WHEN valid THEN visible_paint_count ELSE 0 END AS visible,
                    CASE WHEN valid THEN distinct_colors ELSE 0 END AS colors,
                    CASE WHEN valid THEN cov0 ELSE {R.D(0.0)} END AS cov FROM s4_{src}),
sc_{src} AS (SELECT *, {R.candidate_score('prompt', 'markup', 'valid', 'visible', 'colors', 'cov')} AS score FROM s5_{src})"""


_CANDS = f"""
cand AS ({S.candidates_sql('duckdb', expected=True)}),
{_scored_sql('cand', 'expected_canon', 'prompt_id, prompt, seq, source')},
gen AS (SELECT prompt_id, seq, source, source || ':' || seq AS idx, markup, valid, score, drawables, colors, cov
        FROM sc_cand)"""

_RETRIEVAL = f"""
tpr AS ({S.test_prompts_sql()}),
tp AS (SELECT DISTINCT {R.clean('prompt')} AS prompt FROM tpr WHERE length({R.clean('prompt')}) > 0),
trp AS ({S.train_pairs_sql(expected=True)}),
trm AS (SELECT id AS tid, {R.clean('prompt')} AS prompt, expected_canon FROM trp
        WHERE {R.clean('prompt')} IN (SELECT prompt FROM tp)),
{_scored_sql('trm', 'expected_canon', 'tid, prompt')},
rv AS (SELECT * FROM sc_trm WHERE valid AND length(markup) > 0),
rf AS (SELECT *, row_number() OVER (PARTITION BY prompt, markup ORDER BY tid) AS fr FROM rv),
rk AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, tid) AS rk FROM rf WHERE fr = 1),
ret AS (SELECT prompt, markup, valid, score, drawables, colors, cov, 'train_exact:' || (rk - 1) AS idx, rk - 1 AS ord
        FROM rk WHERE rk <= {K.RETRIEVAL_TOP_K})"""

_RANKED = f"""
{_CANDS},
{_RETRIEVAL},
att AS (SELECT t.prompt_id, CAST({RK.RETRIEVAL_SEQ_BASE} + ord AS INTEGER) AS seq, 'train-exact' AS source, idx, markup,
               valid, score, drawables, colors, cov
        FROM tpr t JOIN ret ON {R.clean('t.prompt')} = ret.prompt),
allc AS (SELECT * FROM gen UNION ALL SELECT * FROM att),
ne AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, markup ORDER BY seq) AS fr FROM allc WHERE length(markup) > 0),
dd AS (SELECT * EXCLUDE (fr) FROM ne WHERE fr = 1
       UNION ALL SELECT * FROM allc WHERE prompt_id NOT IN (SELECT prompt_id FROM ne)),
bb AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, seq) AS br,
              count(*) OVER (PARTITION BY prompt_id) AS num FROM dd),
best AS (SELECT * FROM bb WHERE br = 1),
fin AS (SELECT t.prompt_id AS id, t.prompt, b.*, NOT coalesce(b.valid, false) AS fb, {R.fallback_markup('t.prompt')} AS fbm
        FROM tpr t LEFT JOIN best b ON t.prompt_id = b.prompt_id),
fst AS (SELECT *, {R.paint_stats_cols('fbm', 'f_')}, {R.bounds_cols('fbm', 'f_')} FROM fin)"""

_RANK_SELECT = f"""
SELECT id, CASE WHEN fb THEN '-1' ELSE idx END AS best_idx,
       round(CASE WHEN fb THEN -1.0 ELSE score END, 2) AS best_score, fb AS used_fallback,
       CAST(coalesce(num, 0) AS BIGINT) AS num_candidates,
       CAST(length(CASE WHEN fb THEN fbm ELSE markup END) AS BIGINT) AS svg_chars,
       round(CASE WHEN fb THEN {R.coverage('f_min_x', 'f_min_y', 'f_max_x', 'f_max_y')} ELSE cov END, 5) AS best_coverage,
       CAST(CASE WHEN fb THEN f_drawable_count ELSE drawables END AS BIGINT) AS best_drawables,
       CAST(CASE WHEN fb THEN f_distinct_colors ELSE colors END AS BIGINT) AS best_colors,
       CASE WHEN fb THEN 'fallback' ELSE source END AS best_model,
       md5(CASE WHEN fb THEN fbm ELSE markup END) AS svg_md5
FROM fst"""


def _cands(spark, sf):
    return S.candidates(spark, sf)


def _test(spark, sf):
    return S.test_prompts(spark, sf)


def _retrieved(spark, sf):
    return RK.exact_retrieval(S.train_pairs(spark, sf), _test(spark, sf))


def _ranked(spark, sf):
    return RK.rank_candidates(_cands(spark, sf), _test(spark, sf), _retrieved(spark, sf))


@query("candidate_cleanup", f"""
WITH trp AS ({S.train_pairs_sql(expected=True)}),
b AS (SELECT id, expected_canon AS canon, {R.bounds_cols('expected_canon', 'c_')} FROM trp)
SELECT id, md5(canon) AS canon_md5, md5({R.rescaled('canon', 'c_min_x', 'c_min_y', 'c_max_x', 'c_max_y')}) AS markup_md5
FROM b""")
def candidate_cleanup(spark, sf):
    """Canonicalise raw text, else its extracted block; M10 rescale (retrieval corpus)."""
    c = RK.clean_candidates(S.train_pairs(spark, sf), "svg", mode="retrieved")
    return finish(c.select("id", F.md5("markup_canon").alias("canon_md5"), F.md5("markup").alias("markup_md5")))


@query("rescale_viewbox", f"""
WITH cand AS ({S.candidates_sql('duckdb', expected=True)}),
b AS (SELECT prompt_id, seq, expected_canon AS canon, {R.bounds_cols('expected_canon', 'c_')} FROM cand)
SELECT prompt_id, seq, regexp_extract({R.rescaled('canon', 'c_min_x', 'c_min_y', 'c_max_x', 'c_max_y')},
       'viewBox="([^"]*)"', 1) AS view_box FROM b""")
def rescale_viewbox(spark, sf):
    """viewBox after rescaling every generated candidate (extract -> canonicalise -> rescale)."""
    c = RK.clean_candidates(_cands(spark, sf), "raw_text", mode="generated")
    return finish(c.select("prompt_id", "seq", F.regexp_extract("markup", r'viewBox="([^"]*)"', 1).alias("view_box")))


@query("candidate_score", f"""
WITH {_CANDS}
SELECT prompt_id, seq, valid, {r6('score')} AS score, {r6('cov')} AS coverage FROM gen""")
def candidate_score(spark, sf):
    """Validity and pre-render score of every generated candidate."""
    c = RK.score_candidates(RK.clean_candidates(_cands(spark, sf), "raw_text"), "prompt")
    return finish(c.select("prompt_id", "seq", "valid", "score", F.col("stats.coverage").alias("coverage")))


@query("exact_retrieval", f"""
WITH {_RETRIEVAL}
SELECT prompt, idx, {r6('score')} AS score, md5(markup) AS markup_md5 FROM ret""")
def exact_retrieval(spark, sf):
    """J2 + W6: up to 4 distinct valid train documents per exactly matching test prompt."""
    r = _retrieved(spark, sf)
    return finish(r.select("prompt", "idx", "score", F.md5("markup").alias("markup_md5")))


@query("retrieval_totals", f"""
WITH {_RETRIEVAL}
SELECT (SELECT count(*) FROM trm) AS matched_rows, (SELECT count(DISTINCT prompt) FROM ret) AS prompts,
       (SELECT count(*) FROM ret) AS candidates""")
def retrieval_totals(spark, sf):
    """A10: matched train rows, prompts with retrieval candidates, candidates."""
    return finish(RK.retrieval_totals(S.train_pairs(spark, sf), _test(spark, sf), _retrieved(spark, sf)))


@query("dedupe_candidates", f"""
WITH {_CANDS},
ne AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, markup ORDER BY seq) AS fr FROM gen WHERE length(markup) > 0)
SELECT prompt_id, seq FROM ne WHERE fr = 1
UNION ALL SELECT prompt_id, seq FROM gen WHERE prompt_id NOT IN (SELECT prompt_id FROM ne)""")
def dedupe_candidates_q(spark, sf):
    """First candidate per (prompt, markup); a prompt with only empty markup keeps all."""
    c = RK.clean_candidates(_cands(spark, sf), "raw_text")
    return finish(RK.dedupe_candidates(c, "prompt_id", "markup", "seq").select("prompt_id", "seq"))


@query("best_candidate", f"""
WITH {_CANDS},
b AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, seq) AS br FROM gen)
SELECT prompt_id, seq, {r6('score')} AS score FROM b WHERE br = 1""")
def best_candidate(spark, sf):
    """Highest-scoring generated candidate per prompt, first wins ties."""
    c = RK.score_candidates(RK.clean_candidates(_cands(spark, sf), "raw_text"), "prompt")
    return finish(RK.best_candidate(c.select("prompt_id", "seq", "score"), "prompt_id").select("prompt_id", "seq", "score"))


@query("rerank_window", f"""
WITH {_CANDS},
b AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, valid ORDER BY score DESC, seq) AS br FROM gen)
SELECT prompt_id, seq, valid AND br <= {K.RERANK_TOP_K} AS rerank FROM b""")
def rerank_window(spark, sf):
    """Top-3 valid candidates per prompt flagged for the render stage."""
    c = RK.score_candidates(RK.clean_candidates(_cands(spark, sf), "raw_text"), "prompt")
    return finish(RK.rerank_window(c, "prompt_id").select("prompt_id", "seq", "rerank"))


@query("rank_candidates", f"WITH {_RANKED} {_RANK_SELECT}")
def rank_candidates(spark, sf):
    """Generated + retrieved candidates -> score -> dedupe -> best -> fallback -> audit row."""
    r = _ranked(spark, sf)
    return finish(r.select("id", "best_idx", "best_score", "used_fallback", "num_candidates", "svg_chars",
                           "best_coverage", "best_drawables", "best_colors", "best_model", F.md5("svg").alias("svg_md5")))


@query("result_summary", f"""
WITH {_RANKED}
SELECT count(*) AS rows, count(*) AS valid_rows, count(*) FILTER (WHERE fb) AS fallback_rows FROM fst""")
def result_summary(spark, sf):
    """Rows, valid rows, fallback rows of the ranking result."""
    return finish(RK.result_summary(_ranked(spark, sf)))


@query("generation_plan", f"""
WITH {_CANDS},
g AS (SELECT c.prompt_id, c.prompt, gen.score, gen.cov, gen.visible FROM cand c
      JOIN (SELECT prompt_id, seq, score, cov, CASE WHEN valid THEN visible_paint_count ELSE 0 END AS visible FROM sc_cand) gen
      ON c.prompt_id = gen.prompt_id AND c.seq = gen.seq WHERE c.seq = 0),
p AS (SELECT prompt_id,
             CASE WHEN {R.prompt_is_complex('prompt')} THEN {K.COMPLEX_CANDIDATES} ELSE {K.EASY_CANDIDATES} END AS t0,
             score < {R.D(K.WEAK_GREEDY_SCORE)} OR cov < {R.D(K.WEAK_GREEDY_COVERAGE)} OR visible < 1 AS weak,
             CASE WHEN {R.prompt_is_complex('prompt')} THEN {R.D(K.BASE_TEMPERATURE)} ELSE {R.D(max(0.52, K.BASE_TEMPERATURE - 0.12))} END AS bt,
             CASE WHEN {R.prompt_is_complex('prompt')} THEN {K.SAMPLE_TOKENS[1]} ELSE {K.SAMPLE_TOKENS[0]} END AS max_tokens,
             score FROM g),
q AS (SELECT prompt_id, max_tokens,
             greatest(1, CAST(ceil(CASE WHEN weak THEN greatest(t0, {K.WEAK_GREEDY_CANDIDATES}) ELSE t0 END / 1.0) AS INTEGER)) AS budget,
             CASE WHEN score >= 1050 THEN greatest({R.D(0.40)}, bt - {R.D(0.14)})
                  WHEN score <= 950 THEN least({R.D(0.95)}, bt + {R.D(0.18)}) ELSE bt END AS t FROM p),
b AS (SELECT *, unnest(range(0, CAST(ceil(greatest(budget - 1, 0) / {R.D(float(K.SAMPLING_BATCH))}) AS BIGINT))) AS batch FROM q)
SELECT prompt_id, batch, least({K.SAMPLING_BATCH}, greatest(budget - 1, 0) - batch * {K.SAMPLING_BATCH}) AS batch_size,
       {r6(f't + CASE WHEN batch % 2 = 1 THEN {R.D(0.08)} ELSE {R.D(0.0)} END')} AS temperature, max_tokens, budget FROM b""")
def generation_plan(spark, sf):
    """Sampling batches per prompt from the greedy candidate's score and stats."""
    c = RK.score_candidates(RK.clean_candidates(_cands(spark, sf), "raw_text"), "prompt")
    plan = RK.generation_plan(c.filter(F.col("seq") == 0), 1, "prompt")
    return finish(plan.select("prompt_id", "batch", "batch_size", "temperature", "max_tokens", "budget"))


# ===================================================================== job C: evaluation and leaderboard
from inkstone.functions import image as IM  # noqa: E402
from inkstone.operators import evaluate as EV  # noqa: E402

_W = 8  # image width of the stand-in images
_IMG_REF_SQL, _IMG_PRED_SQL = S.images_sql("duckdb")


def _img(spark, sf):
    return S.images(spark, sf)


def _mean_sql(a):
    return f"(list_sum({a}) / len({a}))"


def _ssim_sql(a, b):
    ma, mb = _mean_sql(a), _mean_sql(b)
    va = _mean_sql(f"list_transform({a}, lambda x: (x - {ma}) * (x - {ma}))")
    vb = _mean_sql(f"list_transform({b}, lambda x: (x - {mb}) * (x - {mb}))")
    cov = _mean_sql(f"list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {ma}) * ({b}[i] - {mb}))")
    num = f"((2 * {ma} * {mb} + {IM.C1!r}) * (2 * {cov} + {IM.C2!r}))"
    den = f"(({ma} * {ma} + {mb} * {mb} + {IM.C1!r}) * ({va} + {vb} + {IM.C2!r}))"
    return f"(CASE WHEN {den} <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, {num} / {den})) END)"


def _edge_sql(g, w=_W):
    return (f"list_transform(range(0, len({g})), lambda i: sqrt("
            f"pow(CASE WHEN i % {w} = 0 THEN 0.0 ELSE abs({g}[i + 1] - {g}[i]) END, 2) + "
            f"pow(CASE WHEN i < {w} THEN 0.0 ELSE abs({g}[i + 1] - {g}[i + 1 - {w}]) END, 2)))")


def _edge_f1_sql(ea, eb, t=IM.EDGE_THRESHOLD):
    rng = f"range(1, len({ea}) + 1)"
    tp = f"CAST(len(list_filter({rng}, lambda i: {ea}[i] > {t} AND {eb}[i] > {t})) AS DOUBLE)"
    fp = f"CAST(len(list_filter({rng}, lambda i: {ea}[i] > {t} AND NOT ({eb}[i] > {t}))) AS DOUBLE)"
    fn = f"CAST(len(list_filter({rng}, lambda i: NOT ({ea}[i] > {t}) AND {eb}[i] > {t})) AS DOUBLE)"
    p = f"({tp} / ({tp} + {fp} + 1e-6))"
    r = f"({tp} / ({tp} + {fn} + 1e-6))"
    return f"(CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END)"


def _mae_sql(a, b):
    return f"({_mean_sql(f'list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i]))')} * (3.0 / 4))"


_PAIRS_IMG = f"""
r AS ({_IMG_REF_SQL}), p AS ({_IMG_PRED_SQL}),
pr AS (SELECT p.checkpoint, p.id, p.pixels AS a, r.pixels AS b FROM p JOIN r ON p.id = r.id)"""


@query("ssim_global", f"WITH {_PAIRS_IMG} SELECT checkpoint, id, {r6(_ssim_sql('a', 'b'))} AS ssim FROM pr")
def ssim_global(spark, sf):
    """X1 (+ X2 on gray images): clamped one-window SSIM of every predicted/reference image pair."""
    refs, preds = _img(spark, sf)
    j = preds.join(refs.withColumnRenamed("pixels", "ref"), "id")
    return finish(j.select("checkpoint", "id", IM.ssim_global(F.col("pixels"), F.col("ref")).alias("ssim")))


@query("edge_f1", f"""WITH {_PAIRS_IMG},
e AS (SELECT checkpoint, id, {_edge_sql('a')} AS ea, {_edge_sql('b')} AS eb FROM pr)
SELECT checkpoint, id, {r6(_edge_f1_sql('ea', 'eb'))} AS edge_f1, {r6(_mean_sql('ea'))} AS mean_edge FROM e""")
def edge_f1(spark, sf):
    """X3 edge maps and X4 edge F1 of every image pair."""
    refs, preds = _img(spark, sf)
    j = preds.join(refs.withColumnRenamed("pixels", "ref"), "id")
    j = j.withColumn("ea", IM.edge_map(F.col("pixels"), _W)).withColumn("eb", IM.edge_map(F.col("ref"), _W))
    return finish(j.select("checkpoint", "id", IM.edge_f1(F.col("ea"), F.col("eb")).alias("edge_f1"),
                           IM.mean(F.col("ea")).alias("mean_edge")))


@query("pixel_mae", f"WITH {_PAIRS_IMG} SELECT checkpoint, id, {r6(_mae_sql('a', 'b'))} AS render_mae FROM pr")
def pixel_mae(spark, sf):
    """RGBA mean absolute error of every image pair."""
    refs, preds = _img(spark, sf)
    j = preds.join(refs.withColumnRenamed("pixels", "ref"), "id")
    return finish(j.select("checkpoint", "id", IM.pixel_mae(F.col("pixels"), F.col("ref")).alias("render_mae")))


def _render_quality_sql(g, w=_W):
    down = f"list_transform(range({w} + 1, len({g}) + 1), lambda i: abs({g}[i] - {g}[i - {w}]))"
    right = f"list_transform(list_filter(range(1, len({g}) + 1), lambda i: (i - 1) % {w} <> 0), lambda i: abs({g}[i] - {g}[i - 1]))"
    return f"list_concat({down}, {right})"


@query("render_quality", f"""WITH r AS ({_IMG_REF_SQL}),
d AS (SELECT id, pixels AS g, {_render_quality_sql('pixels')} AS d FROM r),
m AS (SELECT id, g, d, {_mean_sql('d')} AS edge FROM d)
SELECT id, {r6('edge')} AS edge_density,
       {r6('CAST(len(list_filter(g, lambda x: x < 0.95)) AS DOUBLE) / len(g)')} AS non_white,
       {r6('CASE WHEN edge > 1e-6 THEN CAST(len(list_filter(d, lambda x: x > 4.0 * edge)) AS DOUBLE) / len(d) ELSE 0.0 END')}
       AS edge_clarity FROM m""")
def render_quality(spark, sf):
    """Edge density, non-white share and edge clarity of every image."""
    refs, _ = _img(spark, sf)
    q = refs.select("id", IM.render_quality(F.col("pixels"), _W).alias("q"))
    return finish(q.select("id", "q.edge_density", "q.non_white", "q.edge_clarity"))


def _fidelity_sql(prompt, g):
    parts = []
    for name, (r_, g_, b_) in K.COLOR_RGB:
        rr, gg, bb = r_ / 255.0, g_ / 255.0, b_ / 255.0
        share = (f"CAST(len(list_filter({g}, lambda v: sqrt((v - {rr!r}) * (v - {rr!r}) + (v - {gg!r}) * (v - {gg!r}) "
                 f"+ (v - {bb!r}) * (v - {bb!r})) < 0.22)) AS DOUBLE) / len({g})")
        parts.append(f"CASE WHEN contains(lower({prompt}), {R.q(name)}) THEN {share} * 6.0 ELSE 0.0 END")
    return f"least(0.0 + {' + '.join(parts)}, 8.0)"


@query("color_fidelity", f"""WITH r AS ({_IMG_REF_SQL}),
j AS (SELECT r.id, p.p_name, r.pixels FROM r JOIN part p ON CAST(p.p_partkey AS VARCHAR) = r.id)
SELECT id, {r6(_fidelity_sql('p_name', 'pixels'))} AS color_fidelity FROM j""")
def color_fidelity(spark, sf):
    """Share of pixels near each colour named in the prompt (x6, capped at 8)."""
    refs, _ = _img(spark, sf)
    part = S.load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name")
    j = refs.join(part, "id")
    return finish(j.select("id", IM.color_fidelity(F.col("p_name"), F.col("pixels")).alias("color_fidelity")))


@query("embedding_rerank", """
WITH e AS (SELECT vec_id, label, embedding FROM embeddings),
j AS (SELECT a.vec_id AS id, a.embedding AS x, b.embedding AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT id, round(CAST(100.0 * list_sum(list_transform(range(1, len(x) + 1), lambda i: CAST(x[i] AS DOUBLE) * CAST(y[i] AS DOUBLE)))
       / (sqrt(list_sum(list_transform(x, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))
          * sqrt(list_sum(list_transform(y, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))) AS DOUBLE), 6) AS clip_score
FROM j""")
def embedding_rerank(spark, sf):
    """X11: text-image similarity logit (100 x cosine) between neighbouring embeddings."""
    e = S.load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return finish(j.select(F.col("vec_id").alias("id"), IM.embedding_similarity(F.col("x"), F.col("y")).alias("clip_score")))


_EVAL_SQL = f"""
pr0 AS ({S.predictions_sql(expected=True)}),
refp AS ({_PAIRS}),
ref AS (SELECT id, prompt, expected_norm AS reference_svg FROM refp WHERE length(expected_norm) > 0),
st AS (SELECT pr0.checkpoint, pr0.id, pr0.raw_text, pr0.expected_svg AS svg, {R.paint_stats_cols('pr0.expected_svg')}
       FROM pr0),
va AS (SELECT *, coalesce({R.validity('svg', 'drawable_count', 'visible_paint_count')}, false) AS valid FROM st),
ck AS (SELECT DISTINCT checkpoint FROM pr0),
jr AS (SELECT ck.checkpoint, ref.id, coalesce(va.svg, '') AS svg, coalesce(va.valid, false) AS valid, ref.prompt, ref.reference_svg
       FROM ref CROSS JOIN ck LEFT JOIN va ON va.id = ref.id AND va.checkpoint = ck.checkpoint),
{_PAIRS_IMG},
ji AS (SELECT jr.*, pr.a, pr.b FROM jr LEFT JOIN pr ON pr.checkpoint = jr.checkpoint AND pr.id = jr.id),
tg AS (SELECT *, list_transform({R.start_tags('svg')}, lambda e: {R.tag_name('e')}) AS ta,
              list_transform({R.start_tags('reference_svg')}, lambda e: {R.tag_name('e')}) AS tb FROM ji),
mt AS (SELECT *, valid AND a IS NOT NULL AND b IS NOT NULL AS ok,
              {_ssim_sql('a', 'b')} AS ssim, {_edge_f1_sql(_edge_sql('a'), _edge_sql('b'))} AS edge, {_mae_sql('a', 'b')} AS mae,
              CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 OR len(ta) + len(tb) = 0 THEN 1.0
                   ELSE exp(-6.0 * list_sum(list_transform(list_distinct(list_concat(ta, tb)), lambda k:
                        CAST(abs(len(list_filter(ta, lambda x: x = k)) - len(list_filter(tb, lambda x: x = k))) AS DOUBLE)))
                        / CAST(len(ta) + len(tb) AS DOUBLE)) END AS struct_sim,
              exp(-abs(ln((length(svg) + 50.0) / (length(reference_svg) + 50.0)))) AS compact FROM tg),
ev AS (SELECT checkpoint, id, valid, CAST(length(svg) AS BIGINT) AS svg_chars,
              CASE WHEN ok THEN 0.7 * ssim + 0.3 * edge END AS visual_proxy, CASE WHEN ok THEN ssim END AS ssim_proxy,
              CASE WHEN ok THEN edge END AS edge_f1_proxy, CASE WHEN ok THEN struct_sim END AS structural_proxy,
              CASE WHEN ok THEN compact END AS compactness_proxy, CASE WHEN ok THEN mae END AS render_mae,
              CASE WHEN ok THEN pow(0.7 * ssim + 0.3 * edge, 0.85) * pow(struct_sim, 0.12) * pow(compact, 0.03) END
              AS pdf_proxy_score FROM mt)"""


def _evaluated(spark, sf):
    refs = M.canonicalise(_pairs(spark, sf), "svg", "reference_svg").filter(F.length("reference_svg") > 0)
    refs = refs.select("id", "prompt", "reference_svg")
    ref_img, pred_img = _img(spark, sf)
    return EV.evaluate_predictions(S.predictions(spark, sf), refs, pred_img, ref_img, _W)


@query("evaluate_predictions", f"""WITH {_EVAL_SQL}
SELECT checkpoint, id, valid, svg_chars, {r6('visual_proxy')} AS visual_proxy, {r6('ssim_proxy')} AS ssim_proxy,
       {r6('edge_f1_proxy')} AS edge_f1_proxy, {r6('structural_proxy')} AS structural_proxy,
       {r6('compactness_proxy')} AS compactness_proxy, {r6('render_mae')} AS render_mae,
       {r6('pdf_proxy_score')} AS pdf_proxy_score FROM ev""")
def evaluate_predictions(spark, sf):
    """X14 + J4: extract -> canonicalise -> valid -> SSIM, edge F1, tag similarity, compactness,
    MAE and composite score for every prediction of every checkpoint."""
    e = _evaluated(spark, sf)
    return finish(e.select("checkpoint", "id", "valid", "svg_chars", "visual_proxy", "ssim_proxy", "edge_f1_proxy",
                           "structural_proxy", "compactness_proxy", "render_mae", "pdf_proxy_score"))


@query("checkpoint_eval_means", f"""WITH {_EVAL_SQL}
SELECT checkpoint, {r6('avg(pdf_proxy_score)')} AS mean_pdf_proxy_score, {r6('avg(render_mae)')} AS mean_render_mae,
       count(*) FILTER (WHERE NOT valid) AS invalid_count FROM ev GROUP BY checkpoint""")
def checkpoint_eval_means(spark, sf):
    """A6 on the evaluation above: per-checkpoint means and invalid count."""
    return finish(EV.eval_means(_evaluated(spark, sf)))


@query("tag_count_align", f"""
WITH p AS ({S.predictions_sql(expected=True)}), refp AS ({_PAIRS}),
a AS (SELECT checkpoint, id, {R.tag_name('el')} AS tag, count(*) AS n
      FROM (SELECT checkpoint, id, unnest({R.start_tags('expected_svg')}) AS el FROM p) x GROUP BY ALL),
rf AS (SELECT id, {R.tag_name('el')} AS tag, count(*) AS n
       FROM (SELECT id, unnest({R.start_tags('expected_norm')}) AS el FROM refp) x GROUP BY ALL),
b AS (SELECT p.checkpoint, rf.* FROM rf JOIN (SELECT DISTINCT checkpoint, id FROM p) p ON p.id = rf.id)
SELECT coalesce(a.checkpoint, b.checkpoint) AS checkpoint, coalesce(a.id, b.id) AS id, coalesce(a.tag, b.tag) AS tag,
       coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b
FROM a FULL OUTER JOIN b ON a.checkpoint = b.checkpoint AND a.id = b.id AND a.tag = b.tag""")
def tag_count_align(spark, sf):
    """Full outer alignment of predicted and reference tag counts per (checkpoint, id, tag)."""
    raw = S.predictions(spark, sf)
    preds = M.canonicalise(raw.withColumn("__x", TX.extract_markup("raw_text")), "__x", "svg").select("checkpoint", "id", MX.tag_histogram("svg").alias("ha"))
    refs = M.canonicalise(_pairs(spark, sf), "svg", "markup_norm").select("id", MX.tag_histogram("markup_norm").alias("hb"))
    pairs = EV.pred_vs_ref(preds, refs, "id", checkpoints=raw)  # J4; listed before the leaf, which would run for the list
    return finish(EV.tag_count_align_maps(pairs, ["checkpoint", "id"], "ha", "hb"))


# leaderboard on ``events``: user_id = checkpoint, value = score, event_type 'error' = invalid,
# props.k / 100 = render MAE
def _eval_rows(spark, sf):
    e = S.load(spark, sf, "events")
    valid = F.col("event_type") != "error"
    return e.select(F.concat(F.lit("ckpt-"), F.col("user_id").cast("string")).alias("checkpoint"),
                    valid.alias("valid"),
                    F.when(valid, F.col("value")).alias("pdf_proxy_score"),
                    F.when(valid, F.get_json_object("props", "$.k").cast("double") / 100.0).alias("render_mae"))


_EVAL_ROWS = """
rows AS (SELECT 'ckpt-' || CAST(user_id AS VARCHAR) AS checkpoint, event_type <> 'error' AS valid,
                CASE WHEN event_type <> 'error' THEN value END AS pdf_proxy_score,
                CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 END AS render_mae
         FROM events),
means AS (SELECT checkpoint, avg(pdf_proxy_score) AS mean_pdf_proxy_score, avg(render_mae) AS mean_render_mae,
                 count(*) FILTER (WHERE NOT valid) AS invalid_count FROM rows GROUP BY checkpoint),
listing AS (SELECT DISTINCT 'ckpt-' || CAST(s_suppkey AS VARCHAR) AS checkpoint FROM supplier),
scores AS (SELECT l.checkpoint, m.mean_pdf_proxy_score, m.mean_render_mae, m.invalid_count,
                  CASE WHEN m.invalid_count IS NULL THEN 'no evaluation rows' END AS error
           FROM listing l LEFT JOIN means m ON l.checkpoint = m.checkpoint)"""


def _listing(spark, sf):
    return S.load(spark, sf, "supplier").select(F.concat(F.lit("ckpt-"), F.col("s_suppkey").cast("string")).alias("checkpoint"))


@query("eval_means", f"WITH {_EVAL_ROWS} SELECT checkpoint, {r6('mean_pdf_proxy_score')} AS mean_pdf_proxy_score, "
                     f"{r6('mean_render_mae')} AS mean_render_mae, invalid_count FROM means")
def eval_means(spark, sf):
    """Mean score and MAE over scored rows, invalid count over all rows, per checkpoint."""
    return finish(EV.eval_means(_eval_rows(spark, sf)))


@query("checkpoint_scores", f"WITH {_EVAL_ROWS} SELECT checkpoint, {r6('mean_pdf_proxy_score')} AS mean_pdf_proxy_score, "
                            f"{r6('mean_render_mae')} AS mean_render_mae, invalid_count, error FROM scores")
def checkpoint_scores(spark, sf):
    """Every listed checkpoint with its means; unevaluated ones keep null metrics and an error."""
    return finish(EV.checkpoint_scores(_listing(spark, sf), _eval_rows(spark, sf)))


@query("best_checkpoint", f"""WITH {_EVAL_ROWS}
SELECT checkpoint AS selected FROM scores WHERE mean_pdf_proxy_score IS NOT NULL
ORDER BY mean_pdf_proxy_score DESC, coalesce(invalid_count, 0) ASC, coalesce(mean_render_mae, 1e9) ASC, checkpoint LIMIT 1""")
def best_checkpoint(spark, sf):
    """Selected checkpoint by (score, -invalid, -MAE)."""
    return finish(EV.best_checkpoint(EV.checkpoint_scores(_listing(spark, sf), _eval_rows(spark, sf))))


@query("rank_checkpoints", f"""WITH {_EVAL_ROWS}
SELECT checkpoint, {r6('mean_pdf_proxy_score')} AS mean_pdf_proxy_score FROM scores WHERE mean_pdf_proxy_score IS NOT NULL
ORDER BY mean_pdf_proxy_score DESC, invalid_count ASC NULLS LAST, mean_render_mae ASC NULLS LAST, checkpoint LIMIT 8""")
def rank_checkpoints(spark, sf):
    """Best 8 checkpoints by score desc, invalid asc, MAE asc."""
    r = EV.rank_checkpoints(EV.checkpoint_scores(_listing(spark, sf), _eval_rows(spark, sf)), 8)
    return finish(r.select("checkpoint", "mean_pdf_proxy_score"))


@query("read_scores_defaults", f"""WITH {_EVAL_ROWS}
SELECT checkpoint, {r6('mean_pdf_proxy_score')} AS mean_pdf_proxy_score, CAST(0 AS BIGINT) AS invalid_count,
       1e9 AS mean_render_mae FROM scores WHERE mean_pdf_proxy_score IS NOT NULL""")
def read_scores_defaults(spark, sf):
    """A score table without invalid/MAE columns gets the defaults (0, 1e9); unscored rows dropped."""
    sc = EV.checkpoint_scores(_listing(spark, sf), _eval_rows(spark, sf)).select("checkpoint", "mean_pdf_proxy_score")
    return finish(EV.read_scores_defaults(sc))


@query("last_n_versions", """
WITH ent AS (SELECT DISTINCT 'checkpoint-' || CAST(user_id * 50 AS VARCHAR) AS name, event_id % 3 AS source_rank FROM events),
e2 AS (SELECT name, source_rank, 'src' || CAST(source_rank AS VARCHAR) || '/' || name AS path FROM ent),
l AS (SELECT name, arg_max(path, source_rank) AS path FROM e2 GROUP BY name)
SELECT name, path, CAST(regexp_extract(name, '-(\\d+)$', 1) AS BIGINT) AS step FROM l ORDER BY step DESC LIMIT 8""")
def last_n_versions(spark, sf):
    """Per checkpoint name the latest source's path; the 8 highest steps."""
    e = S.load(spark, sf, "events")
    ent = e.select(F.concat(F.lit("checkpoint-"), (F.col("user_id") * 50).cast("string")).alias("name"),
                   (F.col("event_id") % 3).alias("source_rank")).distinct()
    ent = ent.withColumn("path", F.concat(F.lit("src"), F.col("source_rank").cast("string"), F.lit("/"), F.col("name")))
    return finish(EV.last_n_versions(ent, 8))


# ===================================================================== training rows
from inkstone.operators import sft as SFT  # noqa: E402

_MARKER = [ord(c) for c in SFT.RESPONSE_MARKER]
_MAXLEN = 1 << 20   # above the longest row: nothing is cut
_SHORT = 256         # the same job with a limit that cuts most rows
_SYS = R.q(K.SYSTEM_PROMPT)
_SFT_SQL_OF = f"""
pp AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer
       FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant'),
tx AS (SELECT *, '<|im_start|>system' || chr(10) || {_SYS} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)
                 || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || answer || '<|im_end|>' || chr(10)
                 AS text FROM pp),
tk AS (SELECT *, list_transform(string_split(text, ''), lambda c: unicode(c)) AS toks,
              (row_number() OVER (ORDER BY conv_id, turn) - 1) // 8 AS batch_id FROM tx),
tr AS (SELECT *, toks[1:@LIMIT@] AS ids FROM tk),
ln AS (SELECT *, len(ids) AS seq_len, max(len(ids)) OVER (PARTITION BY batch_id) AS padded_len,
              coalesce(list_filter(range(0, greatest(len(ids) - {len(_MARKER)} + 1, 0)),
                  lambda i: ids[i + 1] = {_MARKER[0]} AND ids[i + 1:i + {len(_MARKER)}] = {_MARKER})[1], -1) AS marker_start
       FROM tr),
lb AS (SELECT *, list_transform(range(0, seq_len), lambda i: CASE WHEN marker_start < 0 OR i < marker_start + {len(_MARKER)}
              THEN {K.IGNORE_INDEX} ELSE ids[i + 1] END) AS labels FROM ln)"""
_SFT_SQL = _SFT_SQL_OF.replace("@LIMIT@", str(_MAXLEN))
_SFT_SHORT_SQL = _SFT_SQL_OF.replace("@LIMIT@", str(_SHORT))
_ROW_ARRAYS = f"""SELECT conv_id, turn, seq_len, padded_len, marker_start,
       md5(array_to_string(ids, ',') || repeat(',0', CAST(padded_len - seq_len AS BIGINT))) AS input_md5,
       md5(substr(repeat(',1', CAST(seq_len AS BIGINT)) || repeat(',0', CAST(padded_len - seq_len AS BIGINT)), 2)) AS mask_md5,
       md5(array_to_string(labels, ',') || repeat(',{K.IGNORE_INDEX}', CAST(padded_len - seq_len AS BIGINT))) AS labels_md5 FROM lb"""


def _sft_rows(spark, sf):
    conv = S.load(spark, sf, "conversations")
    pairs = SFT.conversation_pairs(conv)
    t = pairs.withColumn("text", SFT.sft_text(SFT.chat_messages(F.col("prompt"), F.col("answer"))))
    t = t.withColumn("toks", SFT.code_points(F.col("text")))
    return O.fixed_batches(t, 8, ["conv_id", "turn"], "batch_id")


@query("sft_text", f"""WITH {_SFT_SQL}
SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS text_length, md5(text) AS text_md5 FROM tx""")
def sft_text(spark, sf):
    """P6 chat messages + P7 chat text and length for each (user, assistant) turn pair."""
    t = _sft_rows(spark, sf)
    return finish(t.select("conv_id", "turn", F.length("text").alias("text_length"), F.md5("text").alias("text_md5")))


@query("response_mask", f"""WITH {_SFT_SQL}
SELECT conv_id, turn, batch_id, seq_len, padded_len, marker_start,
       CAST(len(list_filter(labels, lambda x: x <> {K.IGNORE_INDEX})) AS BIGINT) AS n_labels,
       md5(array_to_string(labels, ',')) AS labels_md5 FROM lb""")
def response_mask(spark, sf):
    """L1 marker search, L2 response-only labels, L3 batch padding over whole rows."""
    t = _sft_rows(spark, sf)
    m = SFT.response_mask(t, "toks", _MARKER, _MAXLEN, "batch_id")
    lab = F.slice("labels", 1, F.col("seq_len"))
    return finish(m.select("conv_id", "turn", "batch_id", "seq_len", "padded_len", "marker_start",
                           F.size(F.filter(lab, lambda x: x != K.IGNORE_INDEX)).alias("n_labels"),
                           F.md5(F.array_join(lab, ",")).alias("labels_md5")))


def _row_arrays(spark, sf, limit):
    m = SFT.response_mask(_sft_rows(spark, sf), "toks", _MARKER, limit, "batch_id")
    joined = lambda c: F.md5(F.array_join(c, ","))
    return finish(m.select("conv_id", "turn", "seq_len", "padded_len", "marker_start", joined("input_ids").alias("input_md5"),
                           joined("attention_mask").alias("mask_md5"), joined("labels").alias("labels_md5")))


@query("training_arrays", f"WITH {_SFT_SQL} {_ROW_ARRAYS}")
def training_arrays(spark, sf):
    """L2 + L3: padded input_ids, attention_mask and labels of whole rows."""
    return _row_arrays(spark, sf, _MAXLEN)


@query("training_arrays_short", f"WITH {_SFT_SHORT_SQL} {_ROW_ARRAYS}")
def training_arrays_short(spark, sf):
    """L3: the same arrays with a limit of 256 tokens, which cuts rows (some before the marker)."""
    return _row_arrays(spark, sf, _SHORT)


# ===================================================================== sources, sinks, delivery, resume
from inkstone.sources import csv_split as CS  # noqa: E402
from inkstone.sources import io as IO  # noqa: E402
from inkstone.operators import resume as RS  # noqa: E402


@query("read_pairs_csv", f"""WITH p AS ({_PAIRS}) SELECT id, prompt, md5(raw_text) AS svg_md5 FROM p""")
def read_pairs_csv(spark, sf):
    """Pairs written as a quoted multi-line CSV (the raw text holds newlines and quotes) and read back."""
    pairs = S.markup_pairs(spark, sf, expected=True).select("id", "prompt", F.col("raw_text").alias("svg"))
    path = IO.write_pairs(pairs, IO.scratch_path(spark, "pairs-csv"))
    back = IO.read_pairs(spark, path)
    return finish(back.select("id", "prompt", F.md5("svg").alias("svg_md5")))


@query("csv_ingest", f"""WITH p AS ({_PAIRS})
SELECT id, prompt, md5(raw_text) AS svg_md5, false AS corrupt, CAST(NULL AS VARCHAR) AS record FROM p
UNION ALL SELECT id, prompt, NULL, true, '"' || id || '","' || replace(prompt, '"', '""') || '"' FROM p""")
def csv_ingest(spark, sf):
    """Quoted multi-line CSV read by byte ranges into Parquet; rows of a second file lack a field and are quarantined."""
    pairs = S.markup_pairs(spark, sf, expected=True).select("id", "prompt", F.col("raw_text").alias("svg"))
    root = IO.scratch_path(spark, "csv-ingest")
    IO.write_pairs(pairs, f"{root}/whole")
    pairs.select("id", "prompt").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{root}/short")
    good, bad, _ = CS.pairs_to_parquet(spark, [f"{root}/whole", f"{root}/short"], f"{root}/rows", split_bytes=1 << 20)
    rows = good.withColumn(CS.CORRUPT, F.lit(None).cast("string")).unionByName(bad)
    return finish(rows.select("id", "prompt", F.md5("svg").alias("svg_md5"), F.col(CS.CORRUPT).isNotNull().alias("corrupt"),
                              F.col(CS.CORRUPT).alias("record")))


@query("read_pruned", "SELECT p_partkey, p_name FROM part")
def read_pruned(spark, sf):
    """Two named columns only (pruned at the Parquet scan)."""
    return finish(IO.read_pruned(spark, f"{sf}/part.parquet", ["p_partkey", "p_name"]))


@query("holdout_export", f"WITH {_SPLIT} SELECT id, prompt, md5(svg_norm) AS reference_md5 FROM split WHERE split = 'eval'")
def holdout_export(spark, sf):
    """Eval rows as (id, prompt, reference_svg)."""
    ev = IO.holdout_export(_split(spark, sf).filter(F.col("split") == "eval"))
    return finish(ev.select("id", "prompt", F.md5("reference_svg").alias("reference_md5")))


@query("run_summary", f"""WITH {_EVAL_SQL}
SELECT {K.SEED} AS seed, 'main' AS training_stage, count(*) AS holdout_audit_rows,
       count(*) FILTER (WHERE NOT valid) AS invalid_generations, {r6('avg(pdf_proxy_score)')} AS mean_pdf_proxy_score,
       {r6('avg(render_mae)')} AS mean_render_mae FROM ev""")
def run_summary(spark, sf):
    """One summary row over the evaluated predictions."""
    sm = IO.run_summary(_evaluated(spark, sf), K.SEED, "main")
    return finish(sm.select("seed", "training_stage", "holdout_audit_rows", "invalid_generations",
                            "mean_pdf_proxy_score", "mean_render_mae"))


@query("membership_filter", f"WITH {_RETRIEVAL} SELECT tid AS id FROM trm")
def membership_filter(spark, sf):
    """train rows whose stripped prompt is one of the test prompts (left-semi join)."""
    tp = _test(spark, sf).select(TX.clean_prompt("prompt").alias("p")).filter(F.length("p") > 0)
    tr = S.train_pairs(spark, sf).withColumn("p", TX.clean_prompt("prompt"))
    return finish(tr.join(tp, "p", "left_semi").select("id"))


@query("coverage_guard", f"""WITH {_RANKED}, {_RANK_SELECT.replace('SELECT id,', 'out AS (SELECT id,', 1).replace('FROM fst', 'FROM fst)')}
SELECT CAST(p.p_partkey AS VARCHAR) AS id, o.id IS NULL AS used_fallback,
       md5(coalesce(CASE WHEN o.id IS NOT NULL THEN o.svg_md5 END, md5({R.fallback_markup('p.p_name')}))) AS svg_md5
FROM part p LEFT JOIN out o ON CAST(p.p_partkey AS VARCHAR) = o.id""")
def coverage_guard(spark, sf):
    """Every part row gets one result; rows without a ranked result get the fallback."""
    ranked = _ranked(spark, sf).select("id", "svg")
    test = S.load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("prompt"))
    g = RS.coverage_guard(test, ranked, "id", "prompt", "svg")
    return finish(g.select("id", "used_fallback", F.md5(F.md5("svg")).alias("svg_md5")))


@query("delivery", f"""WITH {_RANKED},
fo AS (SELECT id, CASE WHEN fb THEN fbm ELSE markup END AS svg FROM fst),
st2 AS (SELECT id, svg, {R.paint_stats_cols('svg')} FROM fo),
vd AS (SELECT id, svg, coalesce({R.validity('svg', 'drawable_count', 'visible_paint_count')}, false) AS valid FROM st2)
SELECT id, NOT valid AS replaced,
       md5({_csv_safe_sql(f"replace(CASE WHEN valid THEN svg ELSE {R.q(K.SAFETY_MARKUP)} END, chr(39), '&apos;')")}) AS svg_md5 FROM vd""")
def delivery(spark, sf):
    """Job E: ranked results -> M10 rescale -> F8 safety pass (validity before quoting) -> P4 CSV-safe text."""
    res = _ranked(spark, sf).select("id", "svg")
    res = res.withColumn("__els", MX.parse_elements("svg")).withColumn("svg", MX.rescaled_from("svg", "__els")).drop("__els")
    safe = M.safety_pass(res, "svg")
    return finish(safe.select("id", "replaced", F.md5(TX.csv_safe_markup("svg")).alias("svg_md5")))


@query("resume_batch", f"""
WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, {R.clean('text')} AS t FROM documents)
SELECT id, CAST(length(t) AS BIGINT) AS prompt_chars, md5({R.norm('t')}) AS norm_md5 FROM c""")
def resume_batch(spark, sf):
    """A first run finished the labelled documents; the resumed run does only the rest.
    The union of both runs (latest per id) covers every document exactly once."""
    todo = docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text")

    def job(rows):
        t = TX.clean_prompt("text")
        return rows.select("id", F.length(t).alias("prompt_chars"), F.md5(TX.prompt_norm(t)).alias("norm_md5"))

    path = IO.scratch_path(spark, "resume")
    done_ids = S.load(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    RS.resume_batch(todo.join(done_ids, "id", "left_semi"), job, path, "id")   # the earlier, partial run
    out = RS.resume_batch(todo, job, path, "id")                               # the resumed run
    return finish(out.select("id", "prompt_chars", "norm_md5"))


@query("resume_stream", ORACLES["resume_batch"])
def resume_stream(spark, sf):
    """The resume job as a Structured Streaming query over document files (availableNow);
    every document is processed exactly once even though the source holds a repeated file."""
    from inkstone.streaming.resume_stream import resume_stream as run_stream
    src = IO.scratch_path(spark, "stream-src")
    d = docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text")
    # several files; a table of more splits keeps them, so that no task's share grows with the table
    (d if d.rdd.getNumPartitions() >= 4 else d.repartition(4)).write.parquet(src)
    # a second copy of part of the input arrives later: its ids are skipped as finished
    d.join(S.load(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi") \
        .write.mode("append").parquet(src)

    def job(rows):
        t = TX.clean_prompt("text")
        return rows.select("id", F.length(t).alias("prompt_chars"), F.md5(TX.prompt_norm(t)).alias("norm_md5"))

    out = run_stream(spark, src, d.schema, job, IO.scratch_path(spark, "stream-sink"),
                     IO.scratch_path(spark, "stream-ckpt"), "id")
    return finish(out.select("id", "prompt_chars", "norm_md5"))


@query("balanced_corpus", f"""
WITH {_TRAIN_W}, {_OVERSAMPLE},
bal AS (SELECT id FROM w UNION ALL SELECT idx.id FROM hit JOIN idx ON hit.g = idx.g)
SELECT id, count(*) AS n FROM bal GROUP BY id""")
def balanced_corpus(spark, sf):
    """D3 + D4: train rows united with their weighted extra copies; rows per id."""
    train = _split(spark, sf).filter(F.col("split") == "train")
    w = with_rarity_weight(train, "prompt")
    bal = union_frames(w.select("id"), weighted_oversample(w, "weight", "id").select("id"))
    return finish(bal.groupBy("id").agg(F.count(F.lit(1)).alias("n")))


_CIMG = S.candidate_images_sql("duckdb")


@query("render_rerank", f"""
WITH {_CANDS},
img AS ({_CIMG}),
fq0 AS (SELECT prompt_id, seq, pixels AS g, {_render_quality_sql('pixels')} AS d, image_vec AS x, text_vec AS y FROM img),
fq AS (SELECT f.prompt_id, f.seq, {_mean_sql('d')} AS edge, CAST(len(list_filter(g, lambda v: v < 0.95)) AS DOUBLE) / len(g) AS nw,
              d, g, x, y, c.prompt FROM fq0 f JOIN cand c ON c.prompt_id = f.prompt_id AND c.seq = f.seq),
ft AS (SELECT prompt_id, seq, edge, nw,
              CASE WHEN edge > 1e-6 THEN CAST(len(list_filter(d, lambda v: v > 4.0 * edge)) AS DOUBLE) / len(d) ELSE 0.0 END AS clarity,
              {_fidelity_sql('prompt', 'g')} AS fid,
              100.0 * list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i]))
                / (sqrt(list_sum(list_transform(x, lambda v: v * v))) * sqrt(list_sum(list_transform(y, lambda v: v * v)))) AS clip,
              {R.prompt_is_complex('prompt')} AS cx FROM fq),
rw AS (SELECT gen.*, valid AND row_number() OVER (PARTITION BY prompt_id, valid ORDER BY score DESC, seq) <= {K.RERANK_TOP_K} AS rr
       FROM gen),
j AS (SELECT rw.*, ft.edge, ft.nw, ft.clarity, ft.fid, ft.clip, ft.cx FROM rw LEFT JOIN ft ON rw.prompt_id = ft.prompt_id AND rw.seq = ft.seq),
a AS (SELECT *, rr AND nw IS NOT NULL AS act,
             CASE WHEN cx THEN 0.22 ELSE 0.14 END AS t1, CASE WHEN cx THEN 0.045 ELSE 0.020 END AS t2 FROM j),
s2 AS (SELECT *, CASE WHEN act THEN score + CASE WHEN nw < 0.008 THEN -700.0 ELSE
                   edge * 120.0 + greatest(0.0, 1 - abs(nw - t1) / greatest(t1, 1e-6)) * 35.0
                   + greatest(0.0, 1 - abs(edge - t2) / greatest(t2, 1e-6)) * 18.0 + coalesce(clarity, 0.0) * 22.0
                   + coalesce(fid, 0.0) + coalesce(clip, 0.0) * {K.EMBEDDING_WEIGHT} END ELSE score END AS new_score FROM a),
b AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY new_score DESC, seq) AS br FROM s2)
SELECT prompt_id, seq, {r6('new_score')} AS score, round(CASE WHEN act THEN nw END, 5) AS render_non_white FROM b WHERE br = 1""")
def render_rerank(spark, sf):
    """X13 (with X9-X11 features): top-3 valid candidates re-scored from their images; best per prompt."""
    c = RK.score_candidates(RK.clean_candidates(_cands(spark, sf), "raw_text"), "prompt")
    c = RK.rerank_window(c.select("prompt_id", "seq", "valid", "score"), "prompt_id")
    img = S.candidate_images(spark, sf).join(_cands(spark, sf).select("prompt_id", "seq", "prompt"), ["prompt_id", "seq"])
    q = IM.render_quality(F.col("pixels"), _W)
    feats = img.select("prompt_id", "seq", q["edge_density"].alias("edge_density"), q["non_white"].alias("non_white"),
                       q["edge_clarity"].alias("edge_clarity"),
                       IM.color_fidelity(F.col("prompt"), F.col("pixels")).alias("color_fidelity"),
                       IM.embedding_similarity(F.col("image_vec"), F.col("text_vec")).alias("clip_score"))
    rr = RK.render_rerank(c, feats, _test(spark, sf))
    best = RK.best_candidate(rr.select("prompt_id", "seq", "score", "render_non_white"), "prompt_id")
    return finish(best.select("prompt_id", "seq", "score", "render_non_white"))


@query("grayscale", f"""
WITH rgb AS ({S.rgb_images_sql('duckdb')}),
gr AS (SELECT id, list_transform(range(1, len(r) + 1), lambda i: 0.299 * r[i] + 0.587 * g[i] + 0.114 * b[i]) AS gray FROM rgb)
SELECT id, {r6(_mean_sql('gray'))} AS mean_gray, {r6('list_min(gray)')} AS min_gray, {r6('list_max(gray)')} AS max_gray FROM gr""")
def grayscale(spark, sf):
    """Luminance 0.299 r + 0.587 g + 0.114 b of colour images; mean, min, max per image."""
    S.register(spark, sf, ["embeddings"])
    rgb = spark.sql(S.rgb_images_sql("spark"))
    g = rgb.select("id", IM.grayscale(F.col("r"), F.col("g"), F.col("b")).alias("gray"))
    return finish(g.select("id", IM.mean(F.col("gray")).alias("mean_gray"), F.array_min("gray").alias("min_gray"),
                           F.array_max("gray").alias("max_gray")))


# Oracle columns DuckDB types as INTEGER while the Spark side widens every
# integer to BIGINT: cast them so both schemas are identical.
_WIDEN = {
    "lookup_prompt": ["quality"], "length_bins": ["length_bin"],
    "split_bucket": ["prompt_complexity_bin", "svg_complexity_bin"], "rescale_viewbox": ["seq"],
    "candidate_score": ["seq"], "dedupe_candidates": ["seq"], "best_candidate": ["seq"], "rerank_window": ["seq"],
    "generation_plan": ["max_tokens", "budget"], "run_summary": ["seed"], "render_rerank": ["seq"],
}
for _name, _cols in _WIDEN.items():
    _casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _cols)
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]}) AS _o"


def registry() -> tuple[dict, dict]:
    return QUERIES, ORACLES


# ===================================================================== sinks written and read back
@query("submission_roundtrip", f"""WITH p AS ({_PAIRS})
SELECT id, md5({_csv_safe_sql('raw_text')}) AS svg_md5 FROM p""")
def submission_roundtrip(spark, sf):
    """S3: the submission CSV of every pair, single-line and quote-safe (P4), written and read back."""
    rows = S.markup_pairs(spark, sf, expected=True).select("id", TX.csv_safe_text("raw_text").alias("svg"))
    path = IO.write_submission(rows, IO.scratch_path(spark, "submission"))
    back = spark.read.schema("id string, svg string").option("header", True).option("escape", '"').csv(path)
    return finish(back.select("id", F.md5("svg").alias("svg_md5")))


@query("audit_roundtrip", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def audit_roundtrip(spark, sf):
    """Audit rows (whole texts with quotes and newlines) written as CSV and JSON lines; the JSON copy read back."""
    path = IO.write_audit(docs(spark, sf).select("doc_id", "lang", "source", "n_chars", "text"), IO.scratch_path(spark, "audit"))
    back = spark.read.schema("doc_id long, lang string, source string, n_chars long, text string").json(path + "/json")
    return finish(back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5")))


@query("dataset_cache_reuse", "SELECT doc_id, CASE WHEN quality = 1 THEN 'train' ELSE 'eval' END AS split FROM labels")
def dataset_cache_reuse(spark, sf):
    """The first call builds and writes the dataset by split; the second finds it finished and builds nothing."""
    root = IO.scratch_path(spark, "dataset-cache")
    rows = S.load(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("eval").alias("split"))
    IO.dataset_cache(spark, lambda: rows, root, "main")
    return finish(IO.dataset_cache(spark, lambda: rows.limit(0), root, "main").select("doc_id", "split"))


@query("resplit_union", f"""WITH {_SPLIT}
SELECT id, split, CAST(1 AS BIGINT) AS n_before, CAST(1 AS BIGINT) AS n_after FROM split""")
def resplit_union(spark, sf):
    """Train and eval together hold each prepared row exactly once (rows counted on both sides, per id)."""
    before = prepare_corpus(_pairs(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).alias("n_before"))
    split = _split(spark, sf)
    after = union_frames(*[split.filter(F.col("split") == s) for s in ("train", "eval")]).groupBy("id").agg(
        F.max("split").alias("split"), F.count(F.lit(1)).alias("n_after"))
    both = before.join(after, "id", "full")
    return finish(both.select("id", "split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_before", "n_after")]))


# the queries over colour images and fallback levels register themselves
from inkstone.plans import registry_images  # noqa: E402,F401
