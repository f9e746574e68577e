"""Ranking edge cases: empty candidates, ties, only invalid, fallback words."""

from pyspark.sql import functions as F

from inkstone.operators import rank as RK
from inkstone.functions import text as TX

GOOD = '<svg><rect x="10" y="10" width="200" height="200" fill="red"/></svg>'
OTHER = '<svg><rect x="10" y="10" width="200" height="200" fill="blue"/></svg>'
BAD = '<svg><rect x="1" y="1" width="2" height="2" fill="none"/></svg>'


def run(spark, rows, prompts):
    c = spark.createDataFrame(rows, "prompt_id string, prompt string, seq int, source string, raw_text string")
    p = spark.createDataFrame(prompts, "prompt_id string, prompt string")
    return {r.id: r for r in RK.rank_candidates(c, p).collect()}


def test_tie_goes_to_first_and_dedupe(spark):
    res = run(spark, [("a", "red box", 0, "m0", GOOD), ("a", "red box", 1, "m0", GOOD), ("a", "red box", 2, "m0", OTHER)],
              [("a", "red box")])
    assert res["a"].best_idx == "m0:0" and res["a"].num_candidates == 2 and not res["a"].used_fallback


def test_only_invalid_and_empty_use_fallback(spark):
    res = run(spark, [("b", "a colored string", 0, "m0", BAD), ("c", "menu", 0, "m0", "")],
              [("b", "a colored string"), ("c", "menu")])
    # 'colored' contains 'red', 'string' contains 'ring' -> circle
    assert res["b"].used_fallback and 'fill="#e53935"' in res["b"].svg and "<circle" in res["b"].svg
    assert res["c"].used_fallback and res["c"].svg.count("<rect") == 4 and res["c"].num_candidates == 1


def test_prompt_without_candidates_gets_fallback(spark):
    res = run(spark, [("a", "x", 0, "m0", GOOD)], [("a", "x"), ("z", "star")])
    assert res["z"].used_fallback and res["z"].num_candidates == 0 and "polygon" in res["z"].svg


def test_fallback_markup_words(spark):
    df = spark.createDataFrame([("outline",), ("white list",), ("",)], "p string")
    out = [r[0] for r in df.select(TX.fallback_markup("p")).collect()]
    # substring rule: "outline" contains "line" -> three bars
    assert out[0].count("<rect") == 4 and 'rx="20"' not in out[0]
    assert '<rect width="256" height="256" fill="#212121" />' in out[1] and out[1].count('fill="#f5f5f5"') == 3
    assert 'rx="20"' in out[2]


def test_candidate_cleanup_rescues_and_rescales(spark):
    from inkstone.operators import markup as M
    cut = 'Here: <svg width="24"><g><rect x="2" y="2" width="20" height="20" fill="red"/></g>'
    df = spark.createDataFrame([("1", cut), ("2", "   "), ("3", GOOD)], "id string, raw string")
    out = {r.id: r.markup for r in M.candidate_cleanup(df, "raw").collect()}
    assert out["2"] == "" and out["1"].startswith('<svg xmlns="http://www.w3.org/2000/svg" width="256"')
    assert 'viewBox="0.2353 0.2353 23.5294 23.5294"' in out["1"]           # small content: rescaled
    assert 'viewBox="0 0 256 256"' in out["3"]                             # fills the canvas: unchanged
