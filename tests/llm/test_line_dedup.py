import hashlib
import random
import re
from collections import Counter

import pytest

from inkstone.llm import line_dedup as ld


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def neighbours(rows):
    """Pairs of neighbouring lines that stand at two places; equal (id, text) rows are one document."""
    found = Counter()
    for _, t in {(i, t) for i, t in rows if t is not None}:
        lines = t.split("\n")
        found.update(zip(lines, lines[1:]))
    return {pair for pair, n in found.items() if n > 1}


def chunks(text, repeated):
    lines = text.split("\n")
    n = len(lines)
    words = [len(WORD.findall(x)) for x in lines]
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    pair = [p in repeated for p in zip(lines, lines[1:])]
    out, start = [], 0
    for i in range(n):
        end = i == n - 1 or not pair[i] or max(words[i], words[i + 1]) >= ld.LONG_LINE
        if not end and i >= 1 and pair[i - 1] and i + 1 < n - 1 and pair[i + 1]:
            rolls = [(h[k] + ld.HASH_BASE * h[k - 1]) % ld.CHUNK_LINES == 0 for k in range(1, i + 1)]
            end = rolls[-1] and not (i >= 2 and pair[i - 2] and rolls[-2])
        if end:
            out.append((start, i + 1 - start, sum(words[start:i + 1])))
            start = i + 1
    return lines, out


def brute(rows):
    """Texts by (id, text) without chunks that an earlier document or place holds."""
    first, out, repeated = {}, {}, neighbours(rows)
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(
        f"{'-' if x[0] is None else x[0]} {x[1]}".encode()).hexdigest()))
    for i, t in docs:
        lines, found = chunks(t, repeated)
        kept, removed, gone = [], 0, 0
        for start, n, w in found:
            body = "\n".join(lines[start:start + n])
            can = (n >= ld.MIN_LINES and w >= ld.MIN_WORDS) or w >= ld.LONG_LINE
            if can and body in first:
                removed, gone = removed + 1, gone + n
            else:
                kept += lines[start:start + n]
                if can:
                    first[body] = True
        out[i, t] = ("\n".join(kept), removed, gone)
    return sorted(((i, *(out[i, t] if t is not None else (None, 0, 0))) for i, t in rows), key=repr)


def got(df):
    return sorted(((r.row.doc_id, r.row.text, r.removed_chunks, r.removed_lines) for r in df.collect()), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choice("the of and a sea sky dog runs far home".split()) + str(rnd.randrange(40)) for _ in range(rnd.randrange(0, 14)))
    passages = [[line() for _ in range(rnd.randrange(3, 12))] for _ in range(6)] + [[" ".join(f"p{j}" for j in range(60))]]
    rows = []
    for i in range(60):
        lines = [line() for _ in range(rnd.randrange(0, 8))]
        for _ in range(rnd.randrange(0, 3)):
            at = rnd.randrange(len(lines) + 1)
            lines[at:at] = rnd.choice(passages)
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(docs, seed):
    rows = corpus(seed)
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (None, rows[3][1]), (None, rows[4][1] + "\nx"), (103, rows[5][1]), (103, rows[5][1]), (104, "a\n" * 3000)]
    out = got(ld.dedup_lines(docs(rows)))
    assert out == brute(rows)
    assert sum(r[2] for r in out) > 10


def test_extra_columns_pass_through(docs):
    out = ld.dedup_lines(docs([(1, "a b"), (2, None)])).select("row.*")
    assert out.columns == ["doc_id", "text", "key", "n", "hash", "row", "a.b"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "a b", "k", 1, "h", "r", "d"), (2, None, "k", 1, "h", "r", "d")]


def test_hot_passage_and_shift(docs):
    passage = "\n".join(f"line {i} of a passage that many documents hold in common" for i in range(12))
    rows = [(i, f"own first line {i}\n" * (i % 3) + passage + f"\nown last line {i}") for i in range(1500)]
    out = got(ld.dedup_lines(docs(rows)))
    assert out == brute(rows)
    assert all(r[3] >= 3 for r in out[9:])  # whatever stands before, chunks inside the passage go


def test_short_passages_between_foreign_lines(docs):
    """Passages of 2 to 8 short lines between lines found once: nine tenths of their words go, foreign lines stay."""
    rnd = random.Random(5)
    line = lambda: " ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(6, 14)))
    passages = [[line() for _ in range(2 + k % 7)] for k in range(35)]
    rows, inside, foreign = [], [], []
    for i in range(350):
        before, after = [[line() for _ in range(rnd.randrange(1, 5))] for _ in range(2)]
        passage = passages[i % 35]
        rows.append((i, "\n".join(before + passage + after)))
        inside.append(passage if i >= 35 else [])
        foreign.append(before + after)
    out = got(ld.dedup_lines(docs(rows)))
    assert out == brute(rows)
    kept = [t.split("\n") for _, t, _, _ in sorted(out)]
    left = sum(len(x.split()) for k, p in zip(kept, inside) for x in k if x in p)
    assert left <= 0.1 * sum(len(x.split()) for p in inside for x in p)
    assert all(set(f) <= set(k) for k, f in zip(kept, foreign))
    assert [t for _, t, _, _ in sorted(out)[:35]] == [t for _, t in rows[:35]]


def test_nested_passages_and_spaces(docs):
    """A part of a passage elsewhere, indented lines (spaces are no words) and tab-separated ones (60 words)."""
    lines = [f"line {k} of the passage that is held in common by these" for k in range(9)]
    tabs = "\t".join(f"v{k}" for k in range(60))
    rows = [(1, "\n".join(["a", *lines, "b"])), (2, "\n".join(["c", *lines, "d"])), (3, "\n".join(["e", *lines[3:7], "f"])),
            (4, "x\n            }\n            }\ny"), (5, "z\n            }\n            }\nu"), (6, "one\n" + tabs), (7, tabs + "\ntwo")]
    out = got(ld.dedup_lines(docs(rows)))
    assert out == brute(rows)
    assert out[1] == (2, "c\nd", out[1][2], 9)
    assert out[3:5] == [(4, rows[3][1], 0, 0), (5, rows[4][1], 0, 0)]
    assert out[5:] == [(6, rows[5][1], 0, 0), (7, "two", 1, 1)]


def test_long_single_line(docs):
    passage = " ".join(f"word{i}" for i in range(55))
    rows = [(1, "intro one\n" + passage + "\nend one"), (2, passage), (3, "x y z\nq r\n" + passage)]
    assert got(ld.dedup_lines(docs(rows))) == [(1, rows[0][1], 0, 0), (2, "", 1, 1), (3, "x y z\nq r", 1, 1)]


def test_bytes_decide(docs, monkeypatch):
    """With a hash that makes all chunks equal only chunks with the keeper's bytes go."""
    from pyspark.sql import functions as F
    one, two = " ".join(["a"] * 55), " ".join(["b"] * 55)
    real = ld.F.sha2
    monkeypatch.setattr(ld.F, "sha2", lambda c, n: F.lit("same") if "array_join" in str(c) else real(c, n))
    out = got(ld.dedup_lines(docs([(1, one), (2, two), (3, one), (4, two)])))
    assert out == [(1, one, 0, 0), (2, two, 0, 0), (3, "", 1, 1), (4, two, 0, 0)]


def test_empty_table_and_native_plan(spark, docs):
    out = ld.dedup_lines(docs([]))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
