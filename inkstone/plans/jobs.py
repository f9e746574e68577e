"""End-to-end jobs: what a user runs instead of the reference's scripts.

* :func:`training_rows_job` — Jobs A + B: pairs -> prepared corpus -> stratified
  split -> (long-context subset) -> colour-balanced, shuffled train rows -> chat
  text -> dataset cache partitioned by split, plus the holdout export.
* :func:`evaluation_job` — Job C: predictions x references -> metrics ->
  leaderboard -> selected checkpoint -> audit sample and run summary.
* :func:`ranking_job` — Jobs D + E: candidates (+ exact retrieval) -> best per
  prompt -> rescale, safety pass, CSV-safe text -> every test id covered ->
  submission and audit files.

Each job reads and writes tables; the heavy lifting is in :mod:`inkstone.operators`.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.functions import markup as MX
from inkstone.functions import text as TX
from inkstone.operators import evaluate as EV
from inkstone.operators import markup as M
from inkstone.operators import rank as RK
from inkstone.operators import resume as RS
from inkstone.operators.balance import weighted_oversample, with_rarity_weight
from inkstone.operators.order import seeded_sample, seeded_shuffle
from inkstone.operators.sft import chat_messages, sft_text
from inkstone.operators.split import long_context_subset, stratified_split
from inkstone.plans.corpus import prepare_corpus
from inkstone.sources import csv_split as CS
from inkstone.sources import io as IO


def training_rows_job(spark: SparkSession, pairs: DataFrame, out_dir: str, stage: str = "main",
                      oversample_factor: float = K.OVERSAMPLE_FACTOR, quality_filter: bool = False) -> dict:
    """Jobs A + B.  Returns the written paths."""
    prepared = prepare_corpus(pairs, quality_filter=quality_filter, keep_raw=False)
    split = stratified_split(prepared)
    if stage == "long_context":
        split = long_context_subset(split)
    train = split.filter(F.col("split") == "train")
    evals = split.filter(F.col("split") == "eval")
    weighted = with_rarity_weight(train, "prompt")
    extra = weighted_oversample(weighted, "weight", "id", factor=oversample_factor, prompt_col="prompt")
    balanced = weighted.withColumn("draw", F.lit(-1).cast("long")).unionByName(extra)   # D3
    # Whole-frame shuffle; the draw number keeps repeated ids distinct and the order reproducible
    keyed = balanced.withColumn("__key", F.concat_ws("|", "id", F.col("draw").cast("string")))
    train_rows = seeded_shuffle(keyed, "__key").withColumn("split", F.lit("train"))
    # the shuffled position is written with each row: readers restore the order by it
    rows = train_rows.select("id", "prompt", "svg_norm", "split", F.col("idx").alias("position")).unionByName(
        evals.select("id", "prompt", "svg_norm", "split", F.lit(None).cast("long").alias("position")))
    rows = rows.repartitionByRange("split", "position", "id").sortWithinPartitions("split", "position", "id")

    def build():
        msgs = chat_messages(F.col("prompt"), F.col("svg_norm"))
        return rows.select("id", "split", "position", sft_text(msgs).alias("text")).withColumn("text_length", F.length("text"))

    cache_root = f"{out_dir.rstrip('/')}/sft"
    IO.dataset_cache(spark, build, cache_root, stage)
    holdout = f"{out_dir.rstrip('/')}/holdout_eval_prompts"
    export = IO.holdout_export(evals)
    export.write.mode("overwrite").parquet(holdout)
    IO.write_csv(export, holdout + "_csv")
    return {"sft": f"{cache_root}/{stage}", "holdout": holdout}


def evaluation_job(spark: SparkSession, predictions: DataFrame, references: DataFrame, out_dir: str,
                   pred_images: DataFrame | None = None, ref_images: DataFrame | None = None, width: int = 256,
                   checkpoints: DataFrame | None = None, audit_rows: int = 64) -> dict:
    """Job C.  ``references``: (id, prompt, reference_svg) canonical markup."""
    import time
    started = time.time()
    rows = EV.evaluate_predictions(predictions, references, pred_images, ref_images, width, checkpoints=checkpoints)
    rows = rows.checkpoint(eager=True)                       # reused three times below
    listed = checkpoints if checkpoints is not None else predictions.select("checkpoint").distinct()
    scores = EV.checkpoint_scores(listed, rows)
    best = EV.best_checkpoint(scores)
    selected = best.collect()
    chosen = selected[0]["selected"] if selected else None
    audit = seeded_sample(rows.filter(F.col("checkpoint") == chosen) if chosen else rows, audit_rows, "id")
    # the final audit shows 400 characters of raw output (the per-checkpoint rows 240)
    long_preview = predictions.select("checkpoint", "id", TX.preview(F.col("raw_text"), 400).alias("raw_preview"))
    audit = audit.drop("raw_preview").join(long_preview, ["checkpoint", "id"], "left")
    base = out_dir.rstrip("/")
    scores.write.mode("overwrite").parquet(f"{base}/checkpoint_proxy_scores")
    IO.write_csv(scores, f"{base}/checkpoint_proxy_scores_csv")
    IO.write_audit(audit, f"{base}/eval_generation_audit")
    minutes = (time.time() - started) / 60.0
    IO.write_summary(IO.run_summary(audit, K.SEED, "main", chosen, runtime_minutes=minutes), f"{base}/run_summary")
    return {"selected": chosen, "scores": f"{base}/checkpoint_proxy_scores"}


def ranking_job(spark: SparkSession, candidates: DataFrame, test: DataFrame, out_dir: str,
                train_pairs: DataFrame | None = None, features: DataFrame | None = None, images: DataFrame | None = None,
                results: str | None = None) -> dict:
    """Jobs D + E.  ``test``: (prompt_id, prompt); ``candidates``: (prompt_id, prompt, seq, source, raw_text), with the
    columns of rank_candidates for several models and retries.

    ``images``: rendered candidates (prompt_id, seq, image[, image_vec, text_vec]) to measure, or ``features`` measured
    already.  ``results``: a folder of finished results; prompts that are in it are not ranked again, new
    results are added to it."""
    if images is not None:
        features = RK.render_features(images, test)

    def rank(rows: DataFrame) -> DataFrame:
        prompts = rows.withColumnRenamed("id", "prompt_id")
        found = RK.exact_retrieval(train_pairs, rows) if train_pairs is not None else None
        own = candidates if results is None else candidates.join(prompts.select("prompt_id"), "prompt_id", "left_semi")
        return RK.rank_candidates(own, prompts, found, features)

    todo = test.withColumnRenamed("prompt_id", "id")
    if results is None:
        audit = rank(todo)
    else:
        audit = RS.resume_batch(todo, rank, results).drop("run_seq").join(todo.select("id"), "id", "left_semi")
    audit = audit.checkpoint(eager=True)
    res = audit.select("id", "svg")
    res = (res.withColumn("__els", MX.parse_elements("svg")).withColumn("svg", MX.rescaled_from("svg", "__els"))
              .drop("__els"))                                                    # M10
    safe = M.safety_pass(res, "svg")                                             # F8, before quoting
    covered = RS.coverage_guard(test.withColumnRenamed("prompt_id", "id"), safe, "id", "prompt", "svg")  # J8
    covered = covered.withColumn("svg", TX.csv_safe_markup("svg"))               # P4, fallback rows too
    base = out_dir.rstrip("/")
    IO.write_submission(covered, f"{base}/submission")
    IO.write_audit(audit.drop("svg"), f"{base}/audit")
    summary = RK.result_summary(audit).collect()[0].asDict()
    summary["replaced"] = safe.filter(F.col("replaced")).count()
    return summary


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="inkstone")
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("training-rows", help="pairs CSV or Parquet -> SFT rows + holdout")
    a.add_argument("--pairs", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--stage", default="main", choices=["main", "long_context"])
    r = sub.add_parser("rank", help="candidates + test prompts (+ train pairs) -> submission + audit")
    r.add_argument("--candidates", required=True)
    r.add_argument("--test", required=True)
    r.add_argument("--train")
    r.add_argument("--images", help="(prompt_id, seq, image[, image_vec, text_vec])")
    r.add_argument("--features", help="(prompt_id, seq, edge_density, non_white, edge_clarity, color_fidelity, clip_score)")
    r.add_argument("--results", help="folder of finished results to resume from")
    r.add_argument("--out", required=True)
    v = sub.add_parser("evaluate", help="predictions + references (+ images) -> leaderboard, audit, summary")
    v.add_argument("--predictions", required=True, help="(checkpoint, id, raw_text)")
    v.add_argument("--references", required=True, help="(id, prompt, reference_svg)")
    v.add_argument("--pred-images", help="(checkpoint, id, image) or (checkpoint, id, pixels)")
    v.add_argument("--ref-images", help="(id, image) or (id, pixels)")
    v.add_argument("--width", type=int, default=256)
    v.add_argument("--out", required=True)
    args = p.parse_args(argv)
    from inkstone import get_spark
    spark = get_spark()

    def load(path):
        if not path.endswith(".csv"):
            return spark.read.parquet(path)
        good, _, n = CS.pairs_to_parquet(spark, path, IO.scratch_path(spark, "pairs"))
        print(f"{path}: {n} corrupt rows left out")
        return good

    if args.job == "training-rows":
        print(training_rows_job(spark, load(args.pairs), args.out, args.stage))
    elif args.job == "evaluate":
        pi = spark.read.parquet(args.pred_images) if args.pred_images else None
        ri = spark.read.parquet(args.ref_images) if args.ref_images else None
        print(evaluation_job(spark, spark.read.parquet(args.predictions), spark.read.parquet(args.references),
                             args.out, pi, ri, args.width))
    else:
        train = load(args.train) if args.train else None
        feats, images = (spark.read.parquet(p) if p else None for p in (args.features, args.images))
        print(ranking_job(spark, spark.read.parquet(args.candidates), spark.read.parquet(args.test), args.out, train, feats, images,
                          args.results))


if __name__ == "__main__":
    main()
