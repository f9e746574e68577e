"""Candidate ranking.

Candidates are a long table, one row per candidate:
``(prompt_id, prompt, seq, source, raw_text)``.  ``seq`` is the generation
order (greedy first, then sampled, then retrieved) and breaks score ties, so
the first candidate wins exactly as in a sequential argmax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.functions import image as IM
from inkstone.functions import markup as MX
from inkstone.functions import raster as RA
from inkstone.functions import text as TX
from inkstone.operators import markup as M
from inkstone.operators.dedupe import dedupe_candidates

RETRIEVAL_SEQ_BASE = 1_000_000


def clean_candidates(df: DataFrame, raw_col: str = "raw_text", mode: str = "generated") -> DataFrame:
    """Candidate text -> ``markup_canon`` (canonical, infer variant) and ``markup`` (rescaled).

    ``generated``: extract the first markup block, then canonicalise (as for model
    output).  ``retrieved``: M12 — canonicalise the raw text, else the extracted
    block.  One ``mapInArrow`` pass; extraction and rescale are Catalyst.
    """
    staged = df.withColumn("__ext", TX.extract_markup(raw_col))
    first = ("__ext", None) if mode == "generated" else (raw_col, "__ext")
    canon = M.with_canonical(staged, "markup_canon", "infer", *first).drop("__ext")
    # parse the canonical text once: the bounds drive the rescale here and the
    # statistics are reused by score_candidates (rescaling only rewrites the root
    # viewBox, which holds no shape coordinates and no paint)
    cleaned = MX.with_parsed(canon, "markup_canon", "__c_")
    cleaned = cleaned.withColumn("markup", MX.rescale_markup(F.col("markup_canon"), F.col("__c_bounds")))
    return cleaned.drop("__c_els", "__c_bounds", "__c_path_count")


def score_candidates(df: DataFrame, prompt_col: str = "prompt", markup_col: str = "markup",
                     canon_col: str = "markup_canon") -> DataFrame:
    """Pre-render score (validity bonus, structure, prompt bonus, paint, coverage, length fit).

    Validity is judged on the canonical text; statistics, length and the structure
    score use the text as delivered (rescaled), as the reference does.
    """
    m = F.col(markup_col)
    # rescaling only rewrites the root viewBox, which is neither drawable nor painted
    # and holds no shape coordinates: statistics of the canonical and the delivered
    # text are equal, so the text is parsed once (by clean_candidates when it ran)
    if "__c_valid" not in df.columns:
        df = MX.with_parsed(df, canon_col, "__c_").drop("__c_els", "__c_bounds", "__c_path_count")
    out = df.withColumn("valid", F.coalesce(F.col("__c_valid"), F.lit(False)))
    out = out.withColumnRenamed("__c_stats", "__stats").withColumnRenamed("__c_coverage", "__cov")
    out = out.drop("__c_valid")
    zero = F.struct(F.lit(0).alias("drawable_count"), F.lit(0).alias("painted_count"),
                    F.lit(0).alias("visible_paint_count"), F.lit(0).alias("distinct_colors"), F.lit(0.0).alias("coverage"))
    stats = F.struct(F.col("__stats.drawable_count"), F.col("__stats.painted_count"),
                     F.col("__stats.visible_paint_count"), F.col("__stats.distinct_colors"),
                     F.col("__cov").alias("coverage"))
    out = out.withColumn("stats", F.when(F.col("valid"), stats).otherwise(zero)).drop("__stats", "__cov")
    cov = F.col("stats.coverage")
    target = F.when(TX.prompt_is_complex(prompt_col), 4200.0).otherwise(1400.0)
    fit = F.exp(-F.abs(F.log((F.length(m) + 50.0) / (target + 50.0))))
    pen = F.when(cov < 0.01, 250.0).when(cov < 0.03, 120.0).when(cov < 0.08, 40.0).otherwise(0.0)

    def g(x):
        return F.when(F.col("valid"), x).otherwise(0.0)

    # terms are added one by one in the reference's order (float sums are not associative)
    score = (F.when(F.col("valid"), 1000.0).otherwise(-400.0) + TX.structural_score(markup_col)
             + TX.prompt_bonus(prompt_col, markup_col)
             + g(F.least(F.col("stats.visible_paint_count"), F.lit(8)) * 1.5)
             + g(F.least(F.col("stats.distinct_colors"), F.lit(6)) * 0.15)
             + g(F.least(cov, F.lit(0.35)) * 95.0)
             - g(pen)
             + g(fit * 3.0))
    return out.withColumn("score", score)


def topk_per_group(df: DataFrame, group_col: str, k: int, order_cols: list, name: str = "rank") -> DataFrame:
    """First k rows per group (1-based ``rank``); Spark plans ``row_number <= k`` as a
    partial + final WindowGroupLimit, so a hot group is cut to k rows per map task
    before the shuffle."""
    w = Window.partitionBy(group_col).orderBy(*order_cols)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def exact_retrieval(train: DataFrame, test_prompts: DataFrame, k: int = K.RETRIEVAL_TOP_K,
                    id_col: str = "id", prompt_col: str = "prompt", svg_col: str = "svg") -> DataFrame:
    """Train rows whose stripped prompt equals a test prompt -> M12 cleanup -> score ->
    valid only -> distinct markup (first in train order) -> best k per prompt.

    Output: prompt, markup, markup_canon, valid, score, stats, idx (``train_exact:{i}``), ord.
    A left-semi join keeps only matching train rows; empty prompts never match.
    """
    tp = test_prompts.select(TX.clean_prompt(F.col(prompt_col)).alias("prompt")).filter(F.length("prompt") > 0).distinct()
    tr = train.select(F.col(id_col).alias("__tid"), TX.clean_prompt(F.col(prompt_col)).alias("prompt"),
                      F.coalesce(F.col(svg_col).cast("string"), F.lit("")).alias("raw_text"))
    matched = tr.join(tp, "prompt", "left_semi")
    cleaned = clean_candidates(matched, "raw_text", mode="retrieved").filter(F.length("markup") > 0)
    scored = score_candidates(cleaned, "prompt").filter(F.col("valid"))
    # first occurrence (train order) of each distinct markup per prompt; partial aggregate
    packed = F.struct(*[F.col(c) for c in scored.columns])
    firsts = (scored.groupBy("prompt", F.sha2(F.col("markup"), 256).alias("__h"))
                    .agg(F.min_by(packed, F.col("__tid")).alias("__r")).select("__r.*"))
    ranked = topk_per_group(firsts, "prompt", k, [F.desc("score"), F.asc("__tid")], "__rk")
    return ranked.select("prompt", "markup", "markup_canon", "valid", "score", "stats",
                         F.format_string("train_exact:%d", F.col("__rk") - 1).alias("idx"),
                         (F.col("__rk") - 1).alias("ord"))


def attach_retrieval(cands: DataFrame, retrieved: DataFrame, prompts: DataFrame,
                     group_col: str = "prompt_id", prompt_col: str = "prompt") -> DataFrame:
    """Append each prompt's retrieval candidates after its generated ones."""
    base = cands.select(group_col, "seq", "source", "idx", "markup", "markup_canon", "valid", "score", "stats")
    return base.unionByName(retrieved_candidates(retrieved, prompts, group_col, prompt_col))


def retrieved_candidates(retrieved: DataFrame, prompts: DataFrame, group_col: str = "prompt_id", prompt_col: str = "prompt") -> DataFrame:
    """The retrieval candidates of each prompt as candidate rows."""
    per_prompt = prompts.select(F.col(group_col), TX.clean_prompt(F.col(prompt_col)).alias("__p"))
    r = per_prompt.join(retrieved.withColumnRenamed("prompt", "__p"), "__p", "inner")
    return r.select(F.col(group_col), (F.lit(RETRIEVAL_SEQ_BASE) + F.col("ord")).cast("int").alias("seq"),
                    F.lit("train-exact").alias("source"), "idx", "markup", "markup_canon", "valid", "score", "stats")


def rerank_window(df: DataFrame, group_col: str = "prompt_id", k: int = K.RERANK_TOP_K, lane_col: str | None = None) -> DataFrame:
    """Flag the top-k valid candidates per prompt, and lane if given (they go to the expensive stage)."""
    w = Window.partitionBy(group_col, *([lane_col] if lane_col else []), "valid").orderBy(F.desc("score"), F.asc("seq"))
    return df.withColumn("rerank", F.col("valid") & (F.row_number().over(w) <= k))


def render_features(images: DataFrame, prompts: DataFrame, group_col: str = "prompt_id", prompt_col: str = "prompt") -> DataFrame:
    """Features for :func:`render_rerank` from rendered colour images: (prompt_id, seq, image[, image_vec, text_vec]).

    Images are measured where they lie; only the numbers meet the prompts.  Without embeddings the similarity is 0."""
    near = (IM.embedding_similarity(F.col("image_vec"), F.col("text_vec")) if "image_vec" in images.columns else F.lit(0.0)).alias("clip_score")
    measured = images.select(group_col, "seq", RA.image_features(F.col("image")).alias("f"), near)
    words = prompts.select(group_col, F.col(prompt_col).alias("__p"))
    return measured.join(words, group_col).select(
        group_col, "seq", "f.edge_density", "f.non_white", "f.edge_clarity",
        RA.color_fidelity(F.col("__p"), F.col("f.color_shares")).alias("color_fidelity"), "clip_score")


def render_rerank(df: DataFrame, features: DataFrame, prompts: DataFrame, group_col: str = "prompt_id",
                  prompt_col: str = "prompt", weight: float = K.EMBEDDING_WEIGHT) -> DataFrame:
    """Adjust the score of flagged candidates by image features.

    ``features``: (group, seq, edge_density, non_white, edge_clarity, color_fidelity, clip_score)
    from an image table (X9-X11).  Near-blank images get -700; others gain
    120*edge + 35*coverage fit + 18*edge fit + 22*clarity + colour fidelity + w*clip.
    """
    f = features.select(group_col, "seq", "edge_density", "non_white", "edge_clarity", "color_fidelity", "clip_score")
    p = prompts.select(group_col, TX.prompt_is_complex(F.col(prompt_col)).alias("__cx"))
    j = df.join(f, [group_col, "seq"], "left").join(p, group_col, "left")
    t1 = F.when(F.col("__cx"), 0.22).otherwise(0.14)
    t2 = F.when(F.col("__cx"), 0.045).otherwise(0.020)
    cov_fit = F.greatest(F.lit(0.0), 1 - F.abs(F.col("non_white") - t1) / F.greatest(t1, F.lit(1e-6)))
    edge_fit = F.greatest(F.lit(0.0), 1 - F.abs(F.col("edge_density") - t2) / F.greatest(t2, F.lit(1e-6)))
    gain = (F.col("edge_density") * 120.0 + cov_fit * 35.0 + edge_fit * 18.0 + F.coalesce(F.col("edge_clarity"), F.lit(0.0)) * 22.0
            + F.coalesce(F.col("color_fidelity"), F.lit(0.0)) + F.coalesce(F.col("clip_score"), F.lit(0.0)) * weight)
    adj = F.when(F.col("non_white") < 0.008, F.lit(-700.0)).otherwise(gain)
    active = F.col("rerank") & F.col("non_white").isNotNull()
    return (j.withColumn("score", F.when(active, F.col("score") + adj).otherwise(F.col("score")))
             .withColumn("render_non_white", F.when(active, F.round("non_white", 5)))
             .withColumn("render_edge_density", F.when(active, F.round("edge_density", 5)))
             .withColumn("clip_score", F.when(active & (F.col("non_white") >= 0.008), F.round("clip_score", 4)))
             .drop("edge_density", "non_white", "edge_clarity", "color_fidelity", "__cx"))


def best_candidate(df: DataFrame, group_col: str = "prompt_id") -> DataFrame:
    """Highest score per prompt; the first (lowest seq) wins ties.  One partial aggregate."""
    cols = [c for c in df.columns if c != group_col]
    packed = F.struct(*[F.col(c) for c in cols])
    key = F.struct(F.col("score"), (-F.col("seq")).alias("neg_seq"))
    n = F.count(F.lit(1)).alias("num_candidates")
    return df.groupBy(group_col).agg(F.max_by(packed, key).alias("__b"), n).select(group_col, "__b.*", "num_candidates")


def generation_plan(greedy: DataFrame, n_models: int = 1, prompt_col: str = "prompt") -> DataFrame:
    """Per prompt and its greedy result: candidate budget, temperature and token caps,
    exploded into sampling batches of at most 4 with +0.08 on odd batches.

    Input columns: prompt_id, prompt, score, stats (visible_paint_count, coverage).
    Output: one row per sampling batch (prompt_id, batch, batch_size, temperature, max_tokens, budget).
    """
    cx = TX.prompt_is_complex(F.col(prompt_col))
    weak = ((F.col("score") < K.WEAK_GREEDY_SCORE) | (F.coalesce(F.col("stats.coverage"), F.lit(0.0)) < K.WEAK_GREEDY_COVERAGE)
            | (F.coalesce(F.col("stats.visible_paint_count"), F.lit(0)) < 1))
    total = F.when(cx, K.COMPLEX_CANDIDATES).otherwise(K.EASY_CANDIDATES)
    total = F.when(weak, F.greatest(total, F.lit(K.WEAK_GREEDY_CANDIDATES))).otherwise(total)
    budget = F.greatest(F.lit(1), F.ceil(total / F.lit(max(1, n_models))).cast("int"))
    base_t = F.when(cx, F.lit(K.BASE_TEMPERATURE)).otherwise(F.lit(max(0.52, K.BASE_TEMPERATURE - 0.12)))
    temp = (F.when(F.col("score") >= 1050, F.greatest(F.lit(0.40), base_t - 0.14))
             .when(F.col("score") <= 950, F.least(F.lit(0.95), base_t + 0.18)).otherwise(base_t))
    plan = greedy.select("prompt_id", budget.alias("budget"), temp.alias("__t"),
                         F.when(cx, K.SAMPLE_TOKENS[1]).otherwise(K.SAMPLE_TOKENS[0]).alias("max_tokens"),
                         F.when(cx, K.GREEDY_TOKENS[1]).otherwise(K.GREEDY_TOKENS[0]).alias("greedy_tokens"))
    sampled = F.greatest(F.col("budget") - 1, F.lit(0))
    n_batches = F.ceil(sampled / F.lit(float(K.SAMPLING_BATCH))).cast("int")
    plan = plan.withColumn("__nb", n_batches).filter(F.col("__nb") > 0)
    plan = plan.select("*", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)).alias("batch"))
    size = F.least(F.lit(K.SAMPLING_BATCH), sampled - F.col("batch") * K.SAMPLING_BATCH)
    return plan.select("prompt_id", "batch", size.alias("batch_size"),
                       (F.col("__t") + F.when(F.col("batch") % 2 == 1, 0.08).otherwise(0.0)).alias("temperature"),
                       "max_tokens", "greedy_tokens", "budget")


# FIXED VALUES: levels of a result, the first that has a valid candidate wins
LEVELS = ("normal", "retry", "retrieval", "fallback")


def best_by_level(df: DataFrame, group_col: str = "prompt_id") -> DataFrame:
    """The winner of each prompt over the ordered levels, in one partial aggregate.

    ``df``: candidates with valid, score, seq, source, ``lane`` ("" for those that compete for the normal level) and
    ``sound`` (the prompt has generated candidates and none of its generations broke off).  normal: the best score of
    generated and retrieved candidates of a sound prompt; retry: the first valid retry in order; retrieval: the best
    retrieved candidate; fallback: none of them (the row then holds some invalid candidate).  An invalid
    candidate never outscores a valid one (at most about -350 against at least 50, near-blank penalty
    included), so the best valid candidate of a sound prompt is its best.  ``num_candidates`` counts those of the
    normal level, or the retrieved ones where they come to the rescue; retries never.

    The windows sit on the partitioning by prompt that the dedupe made; a prompt's candidates are bounded by its budget.
    """
    w = Window.partitionBy(group_col)
    retry, retrieved = F.col("source") == "retry", F.col("source") == "train-exact"
    normal = F.col("sound") & (F.col("lane") == "")

    def any_valid(which):
        return F.max((F.coalesce(F.col("valid"), F.lit(False)) & which).cast("int")).over(w) == 1

    level = F.when(any_valid(normal), 0).when(any_valid(retry), 1).when(any_valid(retrieved), 2).otherwise(3)
    j = df.withColumns({"__level": level, "__normal": F.count_if(F.col("lane") == "").over(w), "__rescue": F.count_if(retrieved).over(w)})
    fits = F.when(F.col("__level") == 1, retry).when(F.col("__level") == 2, retrieved).otherwise(F.col("lane") == "")
    j = j.withColumns({"level": F.element_at(F.lit(list(LEVELS)), F.col("__level") + 1),
                       "num_candidates": F.when(F.col("__level") == 2, F.col("__rescue")).otherwise(F.col("__normal"))})
    cols = [c for c in j.columns if not c.startswith("__") and c not in (group_col, "lane", "sound")]
    key = F.struct(fits.alias("fits"), F.col("valid").alias("valid"),
                   F.when(F.col("__level") == 1, F.lit(0.0)).otherwise(F.col("score")).alias("score"), (-F.col("seq")).alias("neg_seq"))
    return j.groupBy(group_col).agg(F.max_by(F.struct(*cols), key).alias("__b")).select(group_col, "__b.*")


def candidate_index(df: DataFrame) -> F.Column:
    """``best_idx``: ``m{model}:{n}`` where the table names models, ``retry:{temperature}`` for retries that name
    theirs, else ``source:seq``."""
    idx = F.format_string("%s:%d", F.col("source"), F.col("seq"))
    if "model" in df.columns:
        n = F.col("n") if "n" in df.columns else F.col("seq")
        idx = F.when(F.col("model").isNotNull(), F.format_string("m%d:%d", F.col("model"), n)).otherwise(idx)
    if "temperature" in df.columns:
        warm = (F.col("source") == "retry") & F.col("temperature").isNotNull()
        idx = F.when(warm, F.concat(F.lit("retry:"), F.col("temperature").cast("string"))).otherwise(idx)
    return idx


def model_name(df: DataFrame) -> F.Column:
    """``best_model``: the label of the candidate's model, ``retry@{temperature}`` for retries, else its source."""
    name = F.col("source")
    if "model_label" in df.columns:
        name = F.coalesce(F.col("model_label"), name)
    if "temperature" in df.columns:
        warm = (F.col("source") == "retry") & F.col("temperature").isNotNull()
        name = F.when(warm, F.concat(F.lit("retry@"), F.col("temperature").cast("string"))).otherwise(name)
    return name


def rank_candidates(cands: DataFrame, prompts: DataFrame, retrieved: DataFrame | None = None,
                    features: DataFrame | None = None, group_col: str = "prompt_id",
                    prompt_col: str = "prompt") -> DataFrame:
    """Clean -> score -> attach retrieval -> dedupe -> (rerank) -> best by level -> fallback.

    ``cands``: (prompt_id, prompt, seq, source, raw_text), and where several models generate: model (number),
    model_label, model_path, n (candidate number of that model); retries have source "retry" and their temperature, in
    the order of ``seq``.  A null ``raw_text`` says that the generation broke off.  ``prompts``: (prompt_id, prompt).
    Returns one row per prompt with the chosen markup, the audit fields and ``level`` (see best_by_level).
    Prompts without a valid candidate get the prompt-aligned fallback (P17).
    """
    c = clean_candidates(cands, "raw_text", mode="generated")
    c = score_candidates(c, prompt_col)
    path = F.col("model_path") if "model_path" in cands.columns else F.lit(None)
    c = c.withColumns({"idx": candidate_index(c), "label": model_name(c), "path": path.cast("string"), "failed": F.col("raw_text").isNull()})
    c = c.select(group_col, "seq", "source", "idx", "markup", "markup_canon", "valid", "score", "stats", "label", "path", "failed")
    if retrieved is not None:
        found = retrieved_candidates(retrieved, prompts, group_col, prompt_col)
        c = c.unionByName(found.withColumns({"label": F.col("source"), "path": F.lit(None).cast("string"), "failed": F.lit(False)}))
    # retries, and retrieved candidates that can only come to the rescue, take no part in dedupe and rerank of the others
    retry, rescue = F.col("source") == "retry", F.col("source") == "train-exact"
    broken = F.max(F.when(~retry & ~rescue, F.col("failed").cast("int"))).over(Window.partitionBy(group_col))
    c = c.withColumn("sound", F.coalesce(broken == 0, F.lit(False))).drop("failed")
    c = c.withColumn("lane", F.when(retry, F.concat(F.lit("retry"), F.col("seq"))).when(rescue & ~F.col("sound"), F.lit("rescue")).otherwise(F.lit("")))
    c = rerank_window(dedupe_candidates(c, group_col, "markup", "seq", "lane"), group_col, lane_col="lane")
    c = c.withColumn("rerank", F.col("rerank") & ~retry)
    if features is not None:
        c = render_rerank(c, features, prompts, group_col, prompt_col)
    else:
        c = (c.withColumn("render_non_white", F.lit(None).cast("double"))
              .withColumn("render_edge_density", F.lit(None).cast("double"))
              .withColumn("clip_score", F.lit(None).cast("double")))
    best = best_by_level(c.drop("rerank"), group_col)
    p = prompts.select(F.col(group_col), F.col(prompt_col).alias("__prompt"))
    out = p.join(best, group_col, "left")
    use_fb = F.coalesce(F.col("level") == "fallback", F.lit(True))
    out = out.withColumn("__fb", TX.fallback_markup("__prompt"))
    out = MX.with_parsed(out, "__fb", "__f_")
    fb = F.col("__fb")
    fb_stats = F.col("__f_stats")
    fb_cov = F.col("__f_coverage")
    return out.select(
        F.col(group_col).alias("id"),
        F.when(use_fb, fb).otherwise(F.col("markup")).alias("svg"),
        TX.preview(F.col("__prompt"), 120).alias("prompt"),
        F.when(use_fb, F.lit("-1")).otherwise(F.col("idx")).alias("best_idx"),
        F.round(F.when(use_fb, F.lit(-1.0)).otherwise(F.col("score")), 2).alias("best_score"),
        F.lit(True).alias("best_valid"),
        use_fb.alias("used_fallback"),
        F.coalesce(F.col("num_candidates"), F.lit(0)).alias("num_candidates"),
        F.length(F.when(use_fb, fb).otherwise(F.col("markup"))).alias("svg_chars"),
        F.round(F.when(use_fb, fb_cov).otherwise(F.col("stats.coverage")), 5).alias("best_coverage"),
        F.when(use_fb, fb_stats["drawable_count"]).otherwise(F.col("stats.drawable_count")).alias("best_drawables"),
        F.when(use_fb, fb_stats["distinct_colors"]).otherwise(F.col("stats.distinct_colors")).alias("best_colors"),
        F.when(use_fb, F.lit("fallback")).otherwise(F.col("label")).alias("best_model"),
        F.when(use_fb, F.lit(None).cast("double")).otherwise(F.col("render_non_white")).alias("render_non_white"),
        F.when(use_fb, F.lit(None).cast("double")).otherwise(F.col("render_edge_density")).alias("render_edge_density"),
        F.when(use_fb, F.lit(None).cast("double")).otherwise(F.col("clip_score")).alias("best_clip_score"),
        F.when(use_fb, F.lit("fallback")).otherwise(F.col("path")).alias("best_model_path"),
        F.coalesce(F.col("level"), F.lit("fallback")).alias("level"))


def result_summary(audit: DataFrame) -> DataFrame:
    """Rows, valid rows, fallback rows."""
    return audit.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("best_valid")).alias("valid_rows"),
                     F.count_if(F.col("used_fallback")).alias("fallback_rows"))


def retrieval_totals(train: DataFrame, test_prompts: DataFrame, retrieved: DataFrame,
                     prompt_col: str = "prompt") -> DataFrame:
    """A10: matched train rows, prompts with candidates, candidates."""
    tp = test_prompts.select(TX.clean_prompt(F.col(prompt_col)).alias("prompt")).filter(F.length("prompt") > 0).distinct()
    matched = train.select(TX.clean_prompt(F.col(prompt_col)).alias("prompt")).join(tp, "prompt", "left_semi")
    m = matched.agg(F.count(F.lit(1)).alias("matched_rows"))
    r = retrieved.agg(F.countDistinct("prompt").alias("prompts"), F.count(F.lit(1)).alias("candidates"))
    from inkstone.operators.index import combine_single_rows
    return combine_single_rows(m, r)
