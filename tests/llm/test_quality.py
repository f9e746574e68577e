import collections
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import quality as q

WORD = re.compile("[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    n, covered, seen, dup = collections.Counter(grams), set(), set(), 0
    for k, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(k, k + 5))
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab #|<\n\t\x0b\x1c\x85 é漢", max_size=80) | st.lists(st.sampled_from(["a ", "b ", "c\n"]), max_size=40).map("".join), max_size=6))
def test_counts_match_brute_force(texts):
    found = q.Scorer({}).score([t.encode() for t in texts], [None] * len(texts))
    assert [tuple(c[i] for c in found[:6]) for i in range(len(texts))] == [base(t) for t in texts]


def jsd(p, r):
    p, r = [x / sum(p) for x in p], [x / sum(r) for x in r]
    m = [(a + b) / 2 for a, b in zip(p, r)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    return math.sqrt(max(0, (kl(p) + kl(r)) / 2))


def test_distance_and_verdict_match_brute_force(spark):
    good = ["The cat and the dog of the house went to it in a car, and so on the way to the sea they saw it all again %d." % i for i in range(200)]
    odd = ["#### ZZZ9 $$ QQQ7 || WWW8 %% " + " ".join(f"XK{i}{j}!" for j in range(60)) for i in range(5)]
    rows = [(i, t, "en") for i, t in enumerate(good + odd)] + [(900, None, "en"), (901, "", None), (902, "only few words", "xx"), (903, odd[0], "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = q.fit_references(df)
    assert set(refs) == {"en"}  # the other languages are too small for a reference
    words, chars, total = collections.Counter(), [0] * q.CLASSES, 0
    table = q.byte_classes()
    for _, t, lang in rows:
        if lang == "en":
            w = WORD.findall((t or "").lower())
            total += len(w)
            words.update(x for x in w if len(x) <= q.SHORT_WORD and re.search(r"[^\W\d_]", x))
            for b in (t or "").encode():
                if table[b] < q.CLASSES:
                    chars[table[b]] += 1
    top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:q.COMMON_WORDS]
    assert refs["en"] == (chars, [w.encode() for w, _ in top], [n for _, n in top], total)
    ref_words = [n for _, n in top] + [total - sum(n for _, n in top)]
    out = {r.doc_id: r.quality for r in q.quality_rules(df).collect()}
    for i, t, lang in rows:
        got = out[i]
        assert tuple(got[:6]) == base(t)
        if lang == "en" and t:
            w = WORD.findall(t.lower())
            own = [sum(x == k for x in w) for k, _ in top]
            wd = jsd(own + [len(w) - sum(own)], ref_words)
            cls = [sum(table[b] == c for b in t.encode()) for c in range(q.CLASSES)]
            cd = jsd(cls, chars)
            assert abs(got.word_distance - wd) < 1e-9 and abs(got.char_distance - cd) < 1e-9
            bad = len(w) >= q.MIN_WORDS and wd > q.WORD_LIMIT + q.WORD_SLOPE / math.sqrt(len(w))
            bad |= sum(cls) >= q.MIN_CHARS and cd > q.CHAR_LIMIT + q.CHAR_SLOPE / math.sqrt(sum(cls))
            assert got.kept == (not base(t)[5] and not bad)
    assert all(out[i].kept for i in range(200)) and not any(out[200 + i].kept for i in range(5))
    assert not out[900].kept and not out[901].kept and out[903].kept and out[903].word_distance is None


def test_empty_table_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, quality string, n_words long, `a.b` string"
    assert q.quality_rules(spark.createDataFrame([], schema), name="q").count() == 0
    out = q.quality_rules(spark.createDataFrame([(1, "a b", "en", "mine", 5, "x")] * 2, schema), name="q").collect()
    assert [(r.quality, r.n_words, r.q.n_words) for r in out] == [("mine", 5, 2)] * 2


def test_labelled_documents(spark):
    """On the labelled rows of the test tables no good document falls to the divergence test, and most junk falls."""
    sf = "/root/testdata/sf0.01"
    out = q.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "quality.base_failed", "quality.kept")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) == 0 and n[(0, False)] > 1.5 * n[(0, True)]


def test_word_limit_follows_the_spread_of_the_language(spark):
    """Junk whose word distance stays under the fixed limit falls where the language is tight; no good document does."""
    sf = "/root/testdata/sf0.1"
    out = q.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "quality.base_failed", "quality.kept")
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    print("labelled junk kept, rejected, clean kept, lost", n.get((0, True), 0), n[0, False], n[1, True], n.get((1, False), 0))
    assert n.get((1, False), 0) == 0 and n[0, False] > 4 * n.get((0, True), 0)


def test_small_language_beside_a_hot_one(spark, monkeypatch):
    """A language under a thousandth of all words and rows is judged as it would be alone."""
    from pyspark.sql import functions as F
    good = "the cat and the dog of the house went to it in a car and so on the way to the sea they saw it all again"
    odd = "#### ZZZ9 $$ QQQ7 || WWW8 %% " + " ".join(f"XK{j}!" for j in range(60))
    rare = spark.createDataFrame([(i, f"{good} {i}", lang) for i in range(100) for lang in ("xx", None)] +
                                 [(900, odd, "xx"), (901, odd, None)], "doc_id long, text string, lang string")
    alone = {(r.doc_id, r.lang): tuple(r.quality) for r in q.quality_rules(rare).collect()}
    assert not alone[900, "xx"][-1] and not alone[901, None][-1] and alone[5, "xx"][-1]
    hot = spark.range(110_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join([good] * 3)), F.lit(" "), F.col("id")).alias("text"),
                                      F.lit("en").alias("lang"))
    out = q.quality_rules(rare.unionByName(hot))
    got = {(r.doc_id, r.lang): tuple(r.quality) for r in out.filter("lang IS NULL OR lang = 'xx'").collect()}
    assert got.keys() == alone.keys()
    assert all(a[:6] == b[:6] and a[8] == b[8] and abs(a[7] - b[7]) < 1e-9 for a, b in ((alone[k], got[k]) for k in alone))


def test_long_words_and_capitals_of_other_scripts_are_common_words(spark):
    words = ["ΚΑΛΗΜΕΡΑ", "καλημερα", "Θάλασσα", "θάλασσα", "zusammen"]
    rows = [(i, " ".join(words * 5), "el") for i in range(100)]
    ref = q.fit_references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["el"]
    assert dict(zip(ref[1], ref[2])) == {"καλημερα".encode(): 1000, "θάλασσα".encode(): 1000, b"zusammen": 500}
    found = q.Scorer({"el": ref}).score([rows[0][1].encode()], ["el"])
    assert found[7][0] < 1e-6
