import hashlib
import re

from inkstone.llm.exact_dedup import DigestIndex, exact_dedup, fingerprints


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, group in groups.items():
        best = min(group, key=lambda x: (-len(x[1]), x[0] is None, x[0]))
        for i, t in group:
            out.append((i, best[0], len(group), i == best[0] and len(t) == len(best[1]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


ROWS = [(3, "a b"), (1, "ab"), (2, "a  b"), (9, None), (8, ""), (7, " \t\n\x0b\x0c\r"), (5, " x"), (6, "x"), (None, "a b"),
        (4, "é" * 3000), (10, "é" * 3000), (11, "ab "), (11, "ab "), (None, None)]


def test_matches_brute_force_for_any_number_of_loads(spark, docs):
    for loads in (1, 3):
        assert got(exact_dedup(docs(ROWS), DigestIndex(spark, buckets=4), loads=loads)) == brute(ROWS)


def test_hot_group_of_copies(spark, docs):
    rows = [(i, "the same text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 4500)]
    assert got(exact_dedup(docs(rows), DigestIndex(spark, buckets=4), loads=2)) == brute(rows)


def test_empty_table(spark, docs):
    assert exact_dedup(docs([]), DigestIndex(spark, buckets=2)).count() == 0


def test_index_persists_and_supersedes(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    first = DigestIndex(spark, path, buckets=4)
    exact_dedup(docs([(5, "old"), (6, "new  text")]), first)
    again = DigestIndex(spark, path, buckets=4)  # as a later session opens it
    out = {r.doc_id: (r.kept, r.keep_id) for r in exact_dedup(docs([(7, "old"), (8, "o  l  d"), (9, "newtext"), (4, "fresh")]), again).collect()}
    assert out == {7: (False, 8), 8: (True, 8), 9: (False, 6), 4: (True, 4)}
    assert again.rows().count() == 4  # old, its better form, new text, fresh


def test_anti_join_shuffles_neither_side(spark, docs):
    index = DigestIndex(spark, buckets=4)
    index.add(fingerprints(docs(ROWS)))
    new = index.unseen(index.stage(fingerprints(docs(ROWS))))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan
    assert new.count() == 0


def test_reopened_index_keeps_its_bucket_number(spark, docs):
    first = DigestIndex(spark, buckets=16)
    exact_dedup(docs([(1, "known text"), (2, "other")]), first).collect()
    again = DigestIndex(spark, first.path, buckets=8)
    assert again.buckets == 16
    out = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(docs([(11, "known  text"), (12, "other"), (13, "new")]), again).collect()}
    assert out == {11: (11, True), 12: (2, False), 13: (13, True)} and again.rows().count() == 4
