import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import jaccard_join as jj
from inkstone.llm.components import components

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(t, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def corpus(seed, docs=60):
    """Families of near copies at many distances, chains, short texts and strangers with common phrases."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for family in range(docs // 10):
        text = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 8, 12, 25, 60, 150]))]
        for _ in range(10):
            rows.append((n, " ".join(text)))
            n += 1
            base = text if rnd.random() < 0.5 else rows[rnd.randrange(len(rows))][1].split()
            text = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                if rnd.random() < 0.4:
                    text.insert(rnd.randrange(len(text) + 1), rnd.choice(vocabulary))
                elif rnd.random() < 0.5 and len(text) > 1:
                    text.pop(rnd.randrange(len(text)))
                else:
                    text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "One  two"), (None, "one two"),
         (1007, "É b c d"), (1008, "é b c d"), (1009, "rep rep rep rep rep rep"), (1010, "rep rep rep rep"), (1011, "x" * 5000), (1011, "x" * 5000)]


@pytest.mark.parametrize("k,num,den,merged", [(3, 90, 100, None), (5, 80, 100, None), (3, 80, 100, 1000), (2, 70, 100, 1)])
def test_components_match_brute_force(docs, k, num, den, merged):
    rows = corpus(k * 100 + num) + EDGES
    assert got(jj.jaccard_components(docs(rows), k, num, den, merged=merged)) == brute(rows, k, num, den)


def test_large_family_of_near_copies(docs):
    rnd = random.Random(1)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(150):
        text = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3, 6])):
            text[rnd.randrange(len(text))] = f"x{rnd.randrange(50)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    assert got(jj.jaccard_components(docs(rows), 3, 90, 100)) == brute(rows, 3, 90, 100)


def test_empty_table(docs):
    assert jj.jaccard_components(docs([]), 3, 90, 100).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2 ** 32), st.sampled_from([(90, 100), (80, 100), (60, 100)]), st.sampled_from([0, 1, 3, 1000]))
def test_linked_sets_always_share_a_key_and_pass_the_sketch(seed, ratio, merged):
    """The pigeonhole itself, on sets at the limit: full meets full, or full meets a deletion."""
    import numpy as np
    num, den = ratio
    rnd = random.Random(seed)
    schemes = {k: jj.scheme(lo, hi, num, den, 10, merged) for k, (lo, hi) in enumerate(jj.bands(400, num, den))}
    signer = jj.Signer(num, den, schemes)
    n = rnd.randrange(1, 200)
    a = {rnd.getrandbits(64) for _ in range(n)}
    b = set(a)
    while True:  # walk b away from a while they stay linked
        c = set(b)
        if rnd.random() < 0.5 and c:
            c.discard(rnd.choice(sorted(c)))
        else:
            c.add(rnd.getrandbits(64))
        if not c or den * len(a & c) < num * len(a | c):
            break
        b = c
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    (fx, dx), (fy, dy) = signer.keys(x), signer.keys(y)
    fx, dx, fy, dy = map(set, (fx.tolist(), dx.tolist(), fy.tolist(), dy.tolist()))
    assert fx & fy or fx & dy or dx & fy
    kx, ky = signer.band_of(len(x)), signer.band_of(len(y))
    assert abs(kx - ky) <= 1
    sx, sy = signer.sketch(x, min(kx, ky)), signer.sketch(y, min(kx, ky))
    s = len(x) + len(y)
    assert sum(bin(int(u) & (2 ** 64 - 1)).count("1") for u in (sx ^ sy)) <= s - 2 * -(-num * s // (num + den))


def test_components_of_chains_stars_and_cliques(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 900)] + list(itertools.combinations(range(1000, 1020), 2))
    links += [(5, 5), (2000, 2001), (2001, 2000)]
    out = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {**{i: 0 for i in range(1, 101)}, **{i: 500 for i in range(501, 900)}, **{i: 1000 for i in range(1001, 1020)}, 2001: 2000}
    assert {k: v for k, v in out.items() if k != v} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
