"""End-to-end jobs on the sf0.001 stand-ins."""

from pyspark.sql import functions as F

from inkstone.operators import markup as M
from inkstone.plans.jobs import evaluation_job, ranking_job, training_rows_job
from inkstone.sources import io as IO
from inkstone.sources import standins as S

from paths import SF_SMALL


def test_training_rows_job(spark):
    out = IO.scratch_path(spark, "job-train")
    paths = training_rows_job(spark, S.markup_pairs(spark, SF_SMALL), out)
    rows = spark.read.parquet(paths["sft"])
    n_eval = rows.filter("split = 'eval'").count()
    assert n_eval >= 1 and rows.filter("split = 'train'").count() > 0
    assert rows.filter(~F.col("text").contains("<|im_start|>assistant\n")).count() == 0
    assert spark.read.parquet(paths["holdout"]).count() == n_eval


def test_ranking_job(spark):
    out = IO.scratch_path(spark, "job-rank")
    s = ranking_job(spark, S.candidates(spark, SF_SMALL), S.test_prompts(spark, SF_SMALL), out, S.train_pairs(spark, SF_SMALL))
    sub = spark.read.option("header", True).option("escape", '"').csv(out + "/submission")
    assert sub.count() == S.test_prompts(spark, SF_SMALL).count() == s["rows"]
    assert sub.filter(F.col("svg").contains('"')).count() == 0           # CSV-safe text


def test_evaluation_job(spark):
    out = IO.scratch_path(spark, "job-eval")
    refs = M.canonicalise(S.markup_pairs(spark, SF_SMALL), "svg", "reference_svg").select("id", "prompt", "reference_svg")
    ref_img, pred_img = S.images(spark, SF_SMALL)
    res = evaluation_job(spark, S.predictions(spark, SF_SMALL), refs, out, pred_img, ref_img, width=8)
    assert res["selected"] in ("ckpt-100", "ckpt-200")
    assert spark.read.json(out + "/run_summary").collect()[0].selected_checkpoint == res["selected"]


def test_cli_rank(spark, capsys):
    from inkstone.plans.jobs import main
    base = IO.scratch_path(spark, "cli")
    S.candidates(spark, SF_SMALL).write.parquet(base + "/cands")
    S.test_prompts(spark, SF_SMALL).write.parquet(base + "/test")
    main(["rank", "--candidates", base + "/cands", "--test", base + "/test", "--out", base + "/out"])
    assert "fallback_rows" in capsys.readouterr().out
    assert spark.read.option("header", True).csv(base + "/out/submission").count() == \
        S.test_prompts(spark, SF_SMALL).count()


def test_evaluation_audit_preview_length(spark):
    out = IO.scratch_path(spark, "job-eval2")
    refs = M.canonicalise(S.markup_pairs(spark, SF_SMALL), "svg", "reference_svg").select("id", "prompt", "reference_svg")
    evaluation_job(spark, S.predictions(spark, SF_SMALL), refs, out)
    aud = spark.read.json(out + "/eval_generation_audit/json")
    assert aud.agg(F.max(F.length("raw_preview"))).collect()[0][0] > 240
