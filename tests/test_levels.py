"""Fallback levels, several models, images and resume in the ranking."""
import numpy as np
from paths import SF_SMALL
from pyspark.sql import functions as F

from inkstone.functions import raster as RA
from inkstone.operators import rank as RK
from inkstone.plans.jobs import ranking_job
from inkstone.sources import io as IO
from inkstone.sources import standins as S

GOOD = '<svg viewBox="0 0 256 256"><rect x="10" y="10" width="{w}" height="200" fill="red"/></svg>'
SCHEMA = ("prompt_id string, prompt string, seq int, source string, model int, model_label string, model_path string, n int, "
          "temperature double, raw_text string")


def cand(p, seq, text, model=0, n=None):
    return (p, f"prompt {p}", seq, "greedy" if seq == 0 else "sampled", model, "ab"[model], f"/m/{model}", seq if n is None else n, None, text)


def retry(p, k, text):
    return (p, f"prompt {p}", 100 + k, "retry", None, None, None, None, (0.9, 0.96, 1.05)[k], text)


def ranked(spark, rows, prompts, train=(), features=None):
    cands = spark.createDataFrame(rows, SCHEMA).repartition(3)
    tests = spark.createDataFrame([(p, f"prompt {p}") for p in prompts], "prompt_id string, prompt string")
    found = None
    if train:
        pairs = spark.createDataFrame([(str(i), f"prompt {p}", t) for i, (p, t) in enumerate(train)], "id string, prompt string, svg string")
        found = RK.exact_retrieval(pairs, tests)
    return {r.id: r for r in RK.rank_candidates(cands, tests, found, features).collect()}


def test_each_level_wins_in_order(spark):
    bad, good = "no markup", GOOD.format
    rows = [cand("n", 0, bad), cand("n", 2, good(w=150), 1, 1), retry("n", 0, good(w=240)),
            # all generated invalid: the first valid retry, not the best one
            cand("r", 0, bad), cand("r", 1, ""), retry("r", 2, good(w=240)), retry("r", 1, good(w=20)), retry("r", 0, bad),
            # a broken generation voids the prompt's other candidates; retries come before retrieval
            cand("b", 0, None), cand("b", 1, good(w=200)), retry("b", 1, good(w=30)),
            cand("t", 0, None), cand("t", 1, good(w=77)), retry("t", 0, bad),
            cand("f", 0, bad), retry("f", 0, None), retry("o", 0, good(w=99)),
            # empty but unbroken generation: retrieval is a normal candidate
            cand("e", 0, bad), retry("e", 0, good(w=50))]
    train = [("t", good(w=77)), ("t", good(w=120)), ("b", good(w=120)), ("e", good(w=60))]
    out = ranked(spark, rows, "nrbtfeox", train)
    assert {p: r.level for p, r in out.items()} == {"n": "normal", "r": "retry", "b": "retry", "t": "retrieval", "f": "fallback",
                                                    "e": "normal", "o": "retry", "x": "fallback"}
    assert (out["n"].best_idx, out["n"].best_model, out["n"].best_model_path, out["n"].num_candidates) == ("m1:1", "b", "/m/1", 1)
    assert (out["r"].best_idx, out["r"].best_model) == ("retry:0.96", "retry@0.96") and 'width="20"' in out["r"].svg
    assert out["b"].best_idx == "retry:0.96" and out["o"].best_idx == "retry:0.9" and out["o"].num_candidates == 0
    # the rescue keeps a retrieved document that equals a voided candidate
    assert out["t"].best_idx.startswith("train_exact:") and out["t"].num_candidates == 2 and out["t"].best_model == "train-exact"
    assert out["e"].best_model == "train-exact" and out["f"].best_idx == "-1" and out["f"].best_model_path == "fallback"
    assert all(r.used_fallback == (r.level == "fallback") for r in out.values())


def test_levels_share_one_partitioning_and_one_leaf(spark):
    cands, _ = S.level_candidates(spark, SF_SMALL)
    tests = S.test_prompts(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = RK.rank_candidates(cands, tests)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("MapInArrow") == 1
    assert plan.count("Exchange hashpartitioning") == 2  # candidates and prompts, each once by prompt_id


def test_near_blank_images_lose(spark):
    white, drawn = np.full((8, 8, 4), 255, np.uint8), np.full((8, 8, 4), 255, np.uint8)
    drawn[2:6, 2:6, :3] = 0
    rows = [cand("p", 0, GOOD.format(w=200)), cand("p", 1, GOOD.format(w=30))]
    images = spark.createDataFrame([("p", 0, (8, 8, white.tobytes())), ("p", 1, (8, 8, drawn.tobytes()))], f"prompt_id string, seq int, image {RA.IMAGE}")
    tests = spark.createDataFrame([("p", "prompt p")], "prompt_id string, prompt string")
    plain = ranked(spark, rows, "p")["p"]
    seen = ranked(spark, rows, "p", features=RK.render_features(images, tests))["p"]
    assert plain.best_idx == "m0:0" and seen.best_idx == "m0:1" and seen.render_non_white == 0.25


def test_ranking_job_resumes(spark):
    base = IO.scratch_path(spark, "job-levels")
    cands, train = S.level_candidates(spark, SF_SMALL)
    tests = S.test_prompts(spark, SF_SMALL)
    first = tests.filter(F.crc32("prompt_id") % 2 == 0)
    ranking_job(spark, cands, first, base + "/a", train, results=base + "/results")
    summary = ranking_job(spark, cands, tests, base + "/b", train, results=base + "/results")
    runs = {r.run_seq: r["count"] for r in spark.read.parquet(base + "/results").groupBy("run_seq").count().collect()}
    assert runs == {0: first.count(), 1: tests.count() - first.count()} and summary["rows"] == tests.count()
    whole = ranking_job(spark, cands, tests, base + "/c", train)
    assert whole == summary
    levels = {r.level for r in spark.read.json(base + "/b/audit/json").select("level", "best_model_path").collect()}
    assert levels == set(RK.LEVELS)
    side = lambda d: {tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(f"{base}/{d}/submission").collect()}
    assert side("b") == side("c")
