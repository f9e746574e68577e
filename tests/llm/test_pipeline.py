"""corpus_pipeline against brute-force versions of its stages, each on the stage's own input."""
import math
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_jaccard_join import brute as components
from test_line_dedup import brute as without_chunks
from test_quality import base, jsd

import corpus_pipeline as cp
from inkstone.llm import bpe, mixing, quality
from inkstone.llm.common import load, materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """[(name, rows before, rows after)] of one run over the stages."""
    docs, out = load(spark, SF, "documents"), []
    for name, stage in cp.STAGES:
        after = materialise(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stage_names_and_columns(spark, stages):
    columns = load(spark, SF, "documents").columns
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mix", "encode"]
    assert all(stages[n][1].columns == columns for n in list(stages)[:-1])


def test_quality_rules(stages):
    before, after = stages["quality_rules"]
    rows = [(r.doc_id, r.text, r.lang) for r in before.collect()]
    refs, table = quality.fit_references(before), quality.byte_classes()
    keep = set()
    for i, t, lang in rows:
        counts = base(t)
        if counts[5]:
            continue
        bad = False
        if lang in refs:
            chars, words, counted, total = refs[lang]
            own = t.lower().encode().split() if t.isascii() else [w.lower() for w in t.encode().split()]
            hist = [own.count(w) for w in words]
            wd = jsd(hist + [len(own) - sum(hist)], counted + [total - sum(counted)])
            cls = [sum(table[b] == c for b in t.encode()) for c in range(quality.CLASSES)]
            cd = jsd(cls, chars)
            bad = len(own) >= quality.MIN_WORDS and wd > quality.WORD_LIMIT + quality.WORD_SLOPE / math.sqrt(len(own))
            bad |= sum(cls) >= quality.MIN_CHARS and cd > quality.CHAR_LIMIT + quality.CHAR_SLOPE / math.sqrt(sum(cls))
        if not bad:
            keep.add(i)
    assert set(texts(after)) == keep and 0 < len(keep) < len(rows)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    want = {i: t for i, t, n, _ in without_chunks(list(texts(before).items())) if not n or t.split()}
    assert texts(after) == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    assert set(texts(after)) == {c for _, _, c in components(list(texts(before).items()), 5, 80, 100)}


def test_mix(spark, stages):
    before, after = stages["mix"]
    model, table = mixing.fit_model(before.select("doc_id", "text"), load(spark, SF, "labels")), quality.byte_classes()
    rows = sorted(texts(before).items())
    p = model.posteriors([model.features(t.encode(), table) for _, t in rows])
    words = np.array([len(t.encode().split()) for _, t in rows])
    available = words @ p
    target = np.array([available[i] if d == "q1t0" else 0.0 for i, d in enumerate(model.domains)])
    rate = np.ones(len(rows))
    for _ in range(mixing.STEPS):
        old = (words * rate) @ p
        rate = np.clip(rate - p @ ((old - target) / np.maximum(available, 1e-12)), 0, 1)
        new = (words * rate) @ p
        if np.abs(new - target).max() <= mixing.TOLERANCE * target.sum() or np.abs(new - old).max() <= mixing.TOLERANCE / 100 * target.sum():
            break
    want = {i for (i, _), r in zip(rows, rate) if r >= 0.5}
    assert len(set(texts(after)) ^ want) <= 1  # one document may sit on the rounding limit
    labels = {r.doc_id: (r.quality, r.toxic) for r in load(spark, SF, "labels").collect()}
    clean = [i for i, _ in rows if labels.get(i) == (1, 0)]
    assert len(set(clean) & set(texts(after))) >= 0.97 * len(clean)


def test_encode(stages):
    before, after = stages["encode"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(ranks)}, special_tokens={})
    rows, own = after.collect(), texts(before)
    assert {r.doc_id for r in rows} == set(own)
    for r in rows:
        ids = reference.encode_ordinary(own[r.doc_id])
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids) and r.round_trip


def test_stages_take_an_empty_table(spark):
    docs = load(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_and_registration(spark, stages):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is cp.run and "pipeline" not in entry.oracle_sql()
    want = {r.doc_id: r.n_tokens for r in stages["encode"][1].collect()}
    assert {r.doc_id: r.n_tokens for r in cp.run(spark, SF).collect()} == want


def test_near_duplicates_of_repeated_and_null_ids(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("sea", "sky", "sun"))
    rows = [(1, one), (1, one), (1, two), (2, one), (3, ""), (3, ""), (None, one), (None, three), (None, three), (None, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect()), key=repr)
    assert out == sorted([(1, one), (1, two), (3, ""), (None, three), (None, ""), (None, None), (None, None)], key=repr)


def test_stages_keep_columns_with_odd_names(spark, docs):
    """A column ``a.b`` and names of the operators' own pass every stage but the last."""
    rows = docs([(i, " ".join(f"{w}{i % 7}" for w in ("plain", "words", "of", "a", "clean", "text", "that", "goes", "on", "for", "long"))) for i in range(12)])
    rows = rows.withColumn("lang", quality.F.lit("en")).withColumn("`x", quality.F.lit(1))
    for name, stage in cp.STAGES[:3]:
        after = materialise(stage(spark, rows, SF), f"odd-{name}")
        assert after.columns == rows.columns and after.count() > 0, name
        rows = after
