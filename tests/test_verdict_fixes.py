"""Defects that once sat outside what the oracles reach."""
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from inkstone.functions import image as IM
from inkstone.functions import text as TX
from inkstone.operators import evaluate as EV
from inkstone.operators import resume as RS
from inkstone.operators.balance import weighted_oversample, with_rarity_weight
from inkstone.operators.index import sized_partitions


def ident(rows):
    return rows.select("id", F.upper("t").alias("t"))


def test_unreadable_results_raise_and_stay(spark, tmp_path):
    todo = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, t string")
    path = str(tmp_path / "out")
    RS.resume_batch(todo, ident, path)
    bad = tmp_path / "out" / "run_seq=0" / "part-00000-bad.parquet"
    bad.write_bytes(b"not parquet")
    before = sorted(p.name for p in (tmp_path / "out").rglob("*.parquet"))
    with pytest.raises(Exception):
        RS.resume_batch(todo, ident, path)
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.parquet")) == before


def test_first_run_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "id string, t string")
    path = str(tmp_path / "out")
    assert RS.resume_batch(none, ident, path).count() == 0
    assert RS.resume_batch(spark.createDataFrame([("1", "a")], "id string, t string"), ident, path).count() == 1


def test_stream_with_an_empty_first_file_and_none_at_all(spark, tmp_path):
    from inkstone.streaming.resume_stream import resume_stream
    schema = spark.createDataFrame([], "id string, t string").schema
    for name, rows in (("none", None), ("empty", []), ("some", [("1", "a"), ("1", "a"), ("2", "b")])):
        source = tmp_path / f"in-{name}"
        source.mkdir()
        if rows is not None:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        out = resume_stream(spark, str(source), schema, ident, str(tmp_path / f"out-{name}"), str(tmp_path / f"ckpt-{name}"), order_col="t")
        assert sorted(tuple(r) for r in out.collect()) == ([("1", "A"), ("2", "B")] if name == "some" else [])


def test_delivered_markup_still_parses(spark):
    texts = ["<svg><text font-family=\"'Arial'\">it's</text></svg>", "<svg a=\"x 'y' &quot;z&quot;\"/>", '<svg a="b"/>']
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for before, r in zip(texts, df.select(TX.csv_safe_markup("s").alias("s")).collect()):
        assert '"' not in r.s
        a, b = ET.fromstring(before), ET.fromstring(r.s)
        assert [(e.tag, e.attrib, e.text) for e in a.iter()] == [(e.tag, e.attrib, e.text) for e in b.iter()]


def test_no_colour_means_no_extra_rows(spark):
    df = spark.createDataFrame([(str(i), "plain prompt") for i in range(100)], "id string, prompt string")
    w = with_rarity_weight(df, "prompt")
    assert weighted_oversample(w, "weight", "id", prompt_col="prompt").count() == 0
    some = with_rarity_weight(df.withColumn("prompt", F.lit("a red one")), "prompt")
    assert weighted_oversample(some, "weight", "id", prompt_col="prompt").count() == 30


def test_empty_images_and_zero_vectors_give_no_error(spark):
    df = spark.createDataFrame([([], [0.0, 0.0], [1.0, 0.0])], "e array<double>, z array<double>, v array<double>")
    row = df.select(IM.embedding_similarity(F.col("z"), F.col("v")).alias("sim"), IM.mean(F.col("e")).alias("mean"),
                    IM.pixel_mae(F.col("e"), F.col("e")).alias("mae"), IM.color_fidelity(F.lit("red"), F.col("e")).alias("cf")).first()
    assert (row.sim, row["mean"], row.mae, row.cf) == (0.0, None, None, 0.0)


def test_last_versions_skip_other_names_and_ascend(spark):
    entries = [("checkpoint-100", "a", 0), ("checkpoint-20", "b", 0), ("checkpoint-20", "c", 1), ("final", "d", 0), ("checkpoint-x", "e", 0),
               ("checkpoint-3", "f", 0), ("checkpoint-99999999999999999999999", "g", 0)]
    out = EV.last_n_versions(spark.createDataFrame(entries, "name string, path string, source_rank int"), 2)
    assert [(r.name, r.path) for r in out.filter("step IS NOT NULL").collect()] == [("checkpoint-20", "c"), ("checkpoint-100", "a")]


def test_partitions_follow_the_input_size(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sized_partitions(df) == least and sized_partitions(df, 1 << 10) > 1000
    assert sized_partitions(df.join(df.withColumnRenamed("text", "t"), "doc_id"), 1 << 30) == least
    assert sized_partitions(spark.createDataFrame([(1,)], "a int")) == least


def test_references_without_predictions_are_invalid_rows(spark):
    svg = "<svg width='10' height='10'><rect width='9' height='9' fill='red'/><circle r='3' fill='blue'/></svg>"
    refs = spark.createDataFrame([(i, "red square", svg) for i in "abc"], "id string, prompt string, reference_svg string")
    preds = spark.createDataFrame([("c1", "a", svg), ("c2", "b", svg), ("c2", "zz", svg)], "checkpoint string, id string, raw_text string")
    listed = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "checkpoint string")
    out = {(r.checkpoint, r.id): r for r in EV.evaluate_predictions(preds, refs, checkpoints=listed).collect()}
    assert set(out) == {(c, i) for c in ("c1", "c2", "c3") for i in "abc"}
    assert {k for k, r in out.items() if r.valid} == {("c1", "a"), ("c2", "b")}
    assert out["c3", "a"].svg_chars == 0 and out["c3", "a"].pdf_proxy_score is None
    means = {r.checkpoint: r.invalid_count for r in EV.eval_means(EV.evaluate_predictions(preds, refs, checkpoints=listed)).collect()}
    assert means == {"c1": 2, "c2": 2, "c3": 3}
