"""Registered queries over colour images (X2, X1 + X4 + X8, X9 + X10, X14) and fallback levels (X15), with DuckDB oracle SQL.

The oracle works on lists of channel values and pure SQL; nothing of the kernels is shared."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.functions import raster as RA
from inkstone.operators import evaluate as EV
from inkstone.operators import markup as M
from inkstone.operators import rank as RK
from inkstone.operators import tiles as TI
from inkstone.plans import registry as B
from inkstone.plans import sqlref as R
from inkstone.sources import standins as S

_REFS, _PREDS = S.color_images_sql("duckdb")
_PIX = "range(1, len(r) + 1)"


def _flat(source: str, keys: str) -> str:
    """CTE body: keys, width, planes over white in [0, 1] and the gray image."""
    over = ", ".join(f"list_transform({_PIX}, lambda i: (({c}[i] * a[i] + 255 * (255 - a[i]) + 127) // 255) / 255.0) AS {c}{c}"
                     for c in "rgb")
    return f"""(SELECT {keys}, width, rr, gg, bb,
                       list_transform(range(1, len(rr) + 1), lambda i: 0.299 * rr[i] + 0.587 * gg[i] + 0.114 * bb[i]) AS gray
                FROM (SELECT {keys}, width, {over} FROM ({source})))"""


def _pairs_sql() -> str:
    mae = " + ".join(f"abs(p.{c}[i] - f.{c}[i])" for c in ("rr", "gg", "bb"))
    return f"""
fr AS {_flat(_REFS, 'id')}, fp AS {_flat(_PREDS, 'checkpoint, id')},
im AS (SELECT p.checkpoint, p.id, p.width = f.width AS same, p.gray AS a, f.gray AS b,
              {B._edge_sql('p.gray', 'p.width')} AS ea, {B._edge_sql('f.gray', 'f.width')} AS eb,
              list_sum(list_transform(range(1, len(p.rr) + 1), lambda i: {mae})) / (4 * len(p.rr)) AS mae
       FROM fp p JOIN fr f ON p.id = f.id),
pm AS (SELECT checkpoint, id, {B._ssim_sql('a', 'b')} AS ssim, {B._edge_f1_sql('ea', 'eb')} AS edge_f1, mae FROM im WHERE same)"""


@B.query("rgba_pair_metrics", f"""WITH {_pairs_sql()}
SELECT p.checkpoint, p.id, {B.r6('pm.ssim')} AS ssim, {B.r6('pm.edge_f1')} AS edge_f1, {B.r6('pm.mae')} AS mae
FROM fp p LEFT JOIN pm ON pm.checkpoint = p.checkpoint AND pm.id = p.id""")
def rgba_pair_metrics(spark, sf):
    """X1, X2, X3, X4 and X8 over RGBA: every predicted colour image against its reference; null where sizes differ."""
    refs, preds = S.color_images(spark, sf)
    return B.finish(EV.image_metrics(preds, refs))


@B.query("rgba_grayscale", f"""WITH fr AS {_flat(_REFS, 'id')}
SELECT id, {B.r6(B._mean_sql('gray'))} AS mean_gray, {B.r6('list_min(gray)')} AS min_gray, {B.r6('list_max(gray)')} AS max_gray FROM fr""")
def rgba_grayscale(spark, sf):
    """X2 on RGBA images over white: mean, least and most luminance of every image."""
    refs, _ = S.color_images(spark, sf)
    g = refs.select("id", RA.gray_stats(F.col("image")).alias("g"))
    return B.finish(g.select("id", F.col("g.mean").alias("mean_gray"), F.col("g.least").alias("min_gray"), F.col("g.most").alias("max_gray")))


def _fidelity_sql(prompt: str) -> str:
    parts = []
    for name, rgb in K.COLOR_RGB:
        square = " + ".join(f"({c}[i] - {v / 255.0!r}) * ({c}[i] - {v / 255.0!r})" for c, v in zip(("rr", "gg", "bb"), rgb))
        share = f"CAST(len(list_filter(range(1, len(rr) + 1), lambda i: sqrt({square}) < {RA.NEAR_COLOR})) AS DOUBLE) / len(rr)"
        parts.append(f"CASE WHEN contains(lower({prompt}), {R.q(name)}) THEN {share} * 6.0 ELSE 0.0 END")
    return f"least(0.0 + {' + '.join(parts)}, 8.0)"


_DOWN = "list_transform(range(width + 1, len(gray) + 1), lambda i: abs(gray[i] - gray[i - width]))"
_RIGHT = "list_transform(list_filter(range(1, len(gray) + 1), lambda i: (i - 1) % width <> 0), lambda i: abs(gray[i] - gray[i - 1]))"


@B.query("rgba_render_features", f"""
WITH fr AS {_flat(_REFS, 'id')},
d AS (SELECT fr.*, p.p_name, list_concat({_DOWN}, {_RIGHT}) AS d FROM fr JOIN part p ON CAST(p.p_partkey AS VARCHAR) = fr.id),
m AS (SELECT *, {B._mean_sql('d')} AS edge FROM d)
SELECT id, {B.r6('edge')} AS edge_density, {B.r6('CAST(len(list_filter(gray, lambda x: x < 0.95)) AS DOUBLE) / len(gray)')} AS non_white,
       {B.r6('CASE WHEN edge > 1e-6 THEN CAST(len(list_filter(d, lambda x: x > 4.0 * edge)) AS DOUBLE) / len(d) ELSE 0.0 END')} AS edge_clarity,
       {B.r6(_fidelity_sql('p_name'))} AS color_fidelity FROM m""")
def rgba_render_features(spark, sf):
    """X9 and X10 over RGBA: features of every reference image and its fidelity to the colours the prompt names."""
    refs, _ = S.color_images(spark, sf)
    part = S.load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name")
    f = refs.select("id", RA.image_features(F.col("image")).alias("f")).join(part, "id")
    return B.finish(f.select("id", "f.edge_density", "f.non_white", "f.edge_clarity",
                             RA.color_fidelity(F.col("p_name"), F.col("f.color_shares")).alias("color_fidelity")))


_EVAL = B._EVAL_SQL.replace(B._PAIRS_IMG, _pairs_sql()).replace(
    "ji AS (SELECT jr.*, pr.a, pr.b FROM jr LEFT JOIN pr ON pr.checkpoint = jr.checkpoint AND pr.id = jr.id)",
    "ji AS (SELECT jr.*, pm.ssim, pm.edge_f1 AS edge, pm.mae FROM jr LEFT JOIN pm ON pm.checkpoint = jr.checkpoint AND pm.id = jr.id)").replace(
    f"""valid AND a IS NOT NULL AND b IS NOT NULL AS ok,
              {B._ssim_sql('a', 'b')} AS ssim, {B._edge_f1_sql(B._edge_sql('a'), B._edge_sql('b'))} AS edge, {B._mae_sql('a', 'b')} AS mae,""",
    "valid AND ssim IS NOT NULL AS ok,")


@B.query("evaluate_rgba", f"""WITH {_EVAL}
SELECT checkpoint, id, valid, {B.r6('visual_proxy')} AS visual_proxy, {B.r6('ssim_proxy')} AS ssim_proxy,
       {B.r6('edge_f1_proxy')} AS edge_f1_proxy, {B.r6('render_mae')} AS render_mae, {B.r6('pdf_proxy_score')} AS pdf_proxy_score FROM ev""")
def evaluate_rgba(spark, sf):
    """X14 with colour images for every prediction: a valid prediction whose image has another size has null metrics."""
    refs = M.canonicalise(B._pairs(spark, sf), "svg", "reference_svg").filter(F.length("reference_svg") > 0)
    ref_img, pred_img = S.color_images(spark, sf)
    e = EV.evaluate_predictions(S.predictions(spark, sf), refs.select("id", "prompt", "reference_svg"), pred_img, ref_img)
    return B.finish(e.select("checkpoint", "id", "valid", "visual_proxy", "ssim_proxy", "edge_f1_proxy", "render_mae", "pdf_proxy_score"))


_LEVELS = f"""
cand AS ({S.level_candidates_sql('duckdb', expected=True)}),
{B._scored_sql('cand', 'expected_canon', 'prompt_id, prompt, seq, source, model, model_label, model_path, n, temperature, raw_text')},
{B._RETRIEVAL.replace(S.train_pairs_sql(expected=True), S.level_train_sql(expected=True))},
gen AS (SELECT prompt_id, seq, source, CASE WHEN source = 'retry' THEN 'retry:' || temperature ELSE 'm' || model || ':' || n END AS idx,
               markup, valid, score, CASE WHEN source = 'retry' THEN 'retry@' || temperature ELSE model_label END AS label,
               model_path AS path, raw_text IS NULL AS failed FROM sc_cand),
att AS (SELECT t.prompt_id, CAST({RK.RETRIEVAL_SEQ_BASE} + ord AS INTEGER) AS seq, 'train-exact' AS source, idx, markup, valid, score,
               'train-exact' AS label, CAST(NULL AS VARCHAR) AS path, false AS failed
        FROM tpr t JOIN ret ON {R.clean('t.prompt')} = ret.prompt),
snd AS (SELECT prompt_id, NOT bool_or(failed) AS sound FROM gen WHERE source <> 'retry' GROUP BY prompt_id),
nrm AS (SELECT g.* FROM (SELECT * FROM gen WHERE source <> 'retry' UNION ALL SELECT * FROM att) g JOIN snd USING (prompt_id)
        WHERE sound OR source <> 'train-exact'),
ne AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, markup ORDER BY seq) AS fr FROM nrm WHERE length(markup) > 0),
dd AS (SELECT * EXCLUDE (fr) FROM ne WHERE fr = 1
       UNION ALL SELECT * FROM nrm WHERE prompt_id NOT IN (SELECT prompt_id FROM ne)),
num AS (SELECT prompt_id, count(*) AS num FROM dd GROUP BY prompt_id),
b0 AS (SELECT d.*, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, seq) AS br FROM dd d JOIN snd USING (prompt_id) WHERE sound),
b1 AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY seq) AS br FROM gen WHERE source = 'retry' AND valid),
b2 AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, seq) AS br, count(*) OVER (PARTITION BY prompt_id) AS num FROM att),
lv AS (SELECT t.prompt_id, t.prompt, num.num, b2.num AS rescue,
              CASE WHEN b0.valid THEN 'normal' WHEN b1.valid THEN 'retry' WHEN b2.valid THEN 'retrieval' ELSE 'fallback' END AS level,
              CASE WHEN b0.valid THEN b0 ELSE NULL END AS s0, b1 AS s1, b2 AS s2
       FROM tpr t LEFT JOIN num USING (prompt_id) LEFT JOIN (SELECT * FROM b0 WHERE br = 1) b0 ON b0.prompt_id = t.prompt_id
       LEFT JOIN (SELECT * FROM b1 WHERE br = 1) b1 ON b1.prompt_id = t.prompt_id
       LEFT JOIN (SELECT * FROM b2 WHERE br = 1) b2 ON b2.prompt_id = t.prompt_id)"""


def _pick(field: str, fallback: str) -> str:
    return f"CASE level WHEN 'normal' THEN s0.{field} WHEN 'retry' THEN s1.{field} WHEN 'retrieval' THEN s2.{field} ELSE {fallback} END"


@B.query("rank_levels", f"""WITH {_LEVELS}
SELECT prompt_id AS id, level, {_pick('idx', "'-1'")} AS best_idx, round({_pick('score', '-1.0')}, 2) AS best_score,
       {_pick('label', "'fallback'")} AS best_model, {_pick('path', "'fallback'")} AS best_model_path,
       CAST(CASE WHEN level = 'retrieval' THEN rescue ELSE coalesce(num, 0) END AS BIGINT) AS num_candidates,
       md5({_pick('markup', R.fallback_markup('prompt'))}) AS svg_md5 FROM lv""")
def rank_levels(spark, sf):
    """X15 with two models and retries: normal best, first valid retry, retrieval rescue, fallback."""
    cands, train = S.level_candidates(spark, sf)
    tests = S.test_prompts(spark, sf)
    r = RK.rank_candidates(cands, tests, RK.exact_retrieval(train, tests))
    return B.finish(r.select("id", "level", "best_idx", "best_score", "best_model", "best_model_path", "num_candidates", F.md5("svg").alias("svg_md5")))


# One large image of all 8 x 8 images, 16 side by side: it grows with the table, its tiles are the images.
_ACROSS = 16


def _mosaic(df, keys):
    n = F.col("id").cast("long")
    return df.select(*keys, (n % _ACROSS * B._W).alias("x0"), (F.floor(n / _ACROSS) * B._W).alias("y0"), F.lit(B._W).alias("w"), "pixels")


def _pixels_sql(source: str, keys: str) -> str:
    """CTE body: one row a pixel of the mosaic with its edge magnitude."""
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    return f"""(SELECT *, sqrt(pow(coalesce(abs(v - lag(v) OVER (PARTITION BY {lead}y ORDER BY x)), 0), 2)
                        + pow(coalesce(abs(v - lag(v) OVER ({part}x ORDER BY y)), 0), 2)) AS e
                FROM (SELECT {lead}k % {_ACROSS} * {B._W} + i % {B._W} AS x, k // {_ACROSS} * {B._W} + i // {B._W} AS y, v
                      FROM (SELECT {lead}CAST(id AS BIGINT) AS k, unnest(pixels) AS v, unnest(range(len(pixels))) AS i FROM ({source}))))"""


@B.query("mosaic_metrics", f"""
WITH r AS {_pixels_sql(B._IMG_REF_SQL, '')}, p AS {_pixels_sql(B._IMG_PRED_SQL, 'checkpoint')},
m AS (SELECT p.checkpoint, avg(p.v) AS ma, avg(r.v) AS mb, var_pop(p.v) AS va, var_pop(r.v) AS vb, covar_pop(p.v, r.v) AS cov,
             avg(p.e) AS mean_edge, CAST(count(*) FILTER (WHERE p.e > {B.IM.EDGE_THRESHOLD} AND r.e > {B.IM.EDGE_THRESHOLD}) AS DOUBLE) AS tp,
             count(*) FILTER (WHERE p.e > {B.IM.EDGE_THRESHOLD}) AS np, count(*) FILTER (WHERE r.e > {B.IM.EDGE_THRESHOLD}) AS nr
      FROM p JOIN r ON p.x = r.x AND p.y = r.y GROUP BY p.checkpoint)
SELECT checkpoint, {B.r6(f'(2 * ma * mb + {B.IM.C1!r}) * (2 * cov + {B.IM.C2!r}) / ((ma * ma + mb * mb + {B.IM.C1!r}) * (va + vb + {B.IM.C2!r}))')} AS ssim,
       {B.r6('CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (np + 1e-6)) * (tp / (nr + 1e-6)) / (tp / (np + 1e-6) + tp / (nr + 1e-6)) END')} AS edge_f1,
       {B.r6('mean_edge')} AS mean_edge FROM m""")
def mosaic_metrics(spark, sf):
    """X1, X3 and X4 in long form: every checkpoint's mosaic of all its images against the references' mosaic, by tiles."""
    refs, preds = B._img(spark, sf)
    a, b = _mosaic(preds, ["checkpoint"]), _mosaic(refs, [])
    ssim = TI.ssim_tiles(a, b, ["checkpoint"], [], clamp=False)
    return B.finish(ssim.join(TI.edge_f1_tiles(a, b, ["checkpoint"], []), "checkpoint"))
