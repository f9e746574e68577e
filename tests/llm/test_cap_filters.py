"""Operator 12 against all pairs by brute force."""
import numpy as np
import pytest

from inkstone.llm import cap_filters as cf

SCHEMA = "vec_id bigint, embedding array<double>, label int, row string, key string, `a.b` string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], s, "r", "k", "d")
                                  for i, v, s in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)


def brute(rows, threshold):
    n = len(rows)
    seen = list(range(n))
    links = [[] for _ in range(n)]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() if usable(v) else None for _, v, _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] \
                    and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].append(j)
    part = [-1] * n
    for i in range(n):
        stack = [i] if part[i] < 0 else []
        while stack:
            k = stack.pop()
            if part[k] < 0:
                part[k] = i
                stack += links[k]
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[part[i]] = min(rows[i][0], least.get(part[i], rows[i][0]))
    return sorted(((rows[i][0], len(links[i]), least.get(part[i]), rows[i][0] == least.get(part[i])) for i in seen), key=repr)


def run(spark, rows, threshold=0.98):
    return sorted(map(tuple, cf.near_duplicates(table(spark, rows), threshold).collect()), key=repr)


def family(rng, d, n, noise):
    centre = rng.standard_normal(d)
    centre /= np.linalg.norm(centre)
    return [centre + noise * rng.standard_normal(d) / np.sqrt(d) for _ in range(n)]


def test_families_copies_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    vectors = family(rng, 32, 60, 0.15) + family(rng, 32, 30, 0.3) + family(rng, 32, 40, 0.2) + [rng.standard_normal(32) for _ in range(80)]
    rows = [(1000 - i, v, i % 3 if i % 11 else None) for i, v in enumerate(vectors)]
    rows += [(2000 + i, vectors[0], 1) for i in range(15)] + [(2100, vectors[0] * 1e200, 1), (2101, vectors[0] * 1e-200, 1), (2102, -vectors[0], 1)]
    rows += [(7, vectors[1], 1), (7, vectors[1], 1), (None, vectors[1], 1), (None, vectors[1], None), (None, rng.standard_normal(32), 2),
             (8, None, 1), (9, [], 1), (10, [0.0] * 32, 1), (11, [None] + [1.0] * 31, 1), (12, [float("nan")] * 32, 1), (13, [float("inf")] * 32, 1),
             (14, vectors[0][:31], 1), (15, vectors[0][:31], 1)]
    got = run(spark, rows)
    assert got == brute(rows, 0.98) and sum(g[1] for g in got) > 1000


def test_open_filters_and_blocks(spark, monkeypatch):
    """Many near vectors below the threshold, a chain, and groups cut into blocks."""
    monkeypatch.setattr(cf, "BLOCK", 16)
    monkeypatch.setattr(cf, "CHUNK", 7)
    rng = np.random.default_rng(1)
    vectors = family(rng, 24, 120, 0.22) + family(rng, 24, 70, 0.1)
    a, b = np.eye(24)[:2]
    vectors += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 1.5, 0.15)]
    rows = [(int(i), v, 5) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    assert run(spark, rows) == brute(rows, 0.98)


def test_links_of_blocks_connect_what_is_linked():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    vectors = family(rng, 8, 40, 0.15) + family(rng, 8, 9, 0.05)
    rows = rng.permutation(100)[:49]
    out = cf._linker(0.98)(pa.table({"row": rows, "vector": pa.array([v.tolist() for v in vectors])})).to_pylist()
    want = {r[2] for r in brute([(int(r), v, 1) for r, v in zip(rows, vectors)], 0.98)}
    assert set(map(int, rows)) - {e["u"] for e in out} == want and all(e["v"] < e["u"] for e in out)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 1)], [(1, None, None)], [(1, [1.0], 1), (2, [3.0], 1), (3, [-1.0], 1)]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows, 0.98)


@pytest.mark.parametrize("d,n", [(64, 10 ** 4), (64, 10 ** 8), (256, 10 ** 6), (32, 10 ** 5), (16, 10 ** 4), (8, 10 ** 4), (3, 10 ** 4), (2, 10 ** 4)])
def test_recall_at_the_threshold(d, n):
    """Pairs exactly at the threshold share a filter: fewer than 1 in 1000 are missed."""
    rng = np.random.default_rng(d)
    u, w = rng.standard_normal((2, 4000, d))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = 0.98 * u + np.sqrt(1 - 0.98 ** 2) * w
    missed = np.ones(len(u), bool)
    for k in range(cf.CODES):
        code = cf.Code(d, k, 8 * n, 0.98)
        x, y = code.decode(u), code.decode(v)
        missed &= ~(x[:, :, None] == y[:, None, :]).any((1, 2))
    assert missed.mean() < 0.001


def test_list_decoding_finds_the_best_directions():
    rng = np.random.default_rng(3)
    code = cf.Code(32, 0, 16 ** 4, 0.98)
    x = rng.standard_normal((20, 32))
    sums = sum(np.expand_dims((x @ b), tuple(k + 1 for k in range(4) if k != j)) for j, b in enumerate(code.blocks)).reshape(20, -1)
    best = np.argsort(-sums, axis=1)[:, :cf.LIST]
    assert [set(r) for r in code.decode(x).tolist()] == [set(r) for r in best.tolist()]
