"""Operator 13 against numpy on the whole table and exact integer arithmetic."""
import numpy as np
import pytest

from inkstone.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, whitened string, `a.b` string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, "x", "w", "d") for i, v in zip(ids, vectors)], SCHEMA)


def brute(vectors, components=32):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(v) for v in ((n * x - s) ** 2).sum(1)]
    centred = ((n * x - s) / n).astype(float)
    cov = centred.T @ centred / n
    values, vec = np.linalg.eigh(cov)
    values, vec = values[::-1][:components], vec[:, ::-1][:, :components]
    return n, deviation, centred @ vec / np.sqrt(values), values / np.trace(cov)


def check(spark, vectors, components=32, ids=None, kept=None, tolerance=1e-7):
    rows = wh.whitened_rows(table(spark, vectors, ids), components).collect()
    kept = vectors if kept is None else kept
    n, deviation, whitened, explained = brute(kept, components)
    k = len(explained)
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    got = np.full((len(vectors), k), np.nan)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
    place = {tuple(v): i for i, v in enumerate(kept)}
    for r in rows:
        assert r.deviation == deviation[place[tuple(vectors[r.vec_id])]]
    got = got[[i for i, v in enumerate(vectors) if v is not None and tuple(v) in place]]
    signs = np.sign((got * whitened).sum(0))
    np.testing.assert_allclose(got * signs, whitened, atol=tolerance)


@pytest.mark.parametrize("d,components", [(40, 32), (6, 32), (2, 1), (1, 32)])
def test_matches_numpy(spark, d, components):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((300, d)) @ rng.standard_normal((d, d))).astype(np.float32).tolist()
    check(spark, vectors, components)


def test_unusable_vectors_are_left_out(spark):
    good = np.random.default_rng(1).standard_normal((50, 3)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [None, None, None]]
    vectors = good[:20] + bad + good[20:]
    check(spark, vectors, kept=good)


def test_ragged_far_and_wide_vectors_raise(spark):
    for vectors in ([[1.0], [1.0, 2.0]], [[1e20], [1.0]], [[0.0] * (wh.MAX_DIM + 1)]):
        with pytest.raises(Exception, match="different lengths|beyond|more than"):
            wh.whiten(table(spark, vectors))


def test_degenerate_tables(spark):
    for vectors in ([], [None, []], [[1.0, 2.0]] * 5, [[1.0, 2.0]]):
        assert wh.whitened_rows(table(spark, vectors)).collect() == []
    # a dimension that never varies: one component fewer
    rows = wh.whitened_rows(table(spark, [[float(i), 7.0, float(i * i % 11)] for i in range(30)])).collect()
    assert {r.component for r in rows} == {1, 2} and max(r.identity_error for r in rows) < 1e-9


def test_repeated_rows_and_null_ids(spark):
    vectors = np.random.default_rng(2).standard_normal((9, 2)).astype(np.float32).tolist()
    rows = wh.whitened_rows(table(spark, vectors + vectors[:3], [None, None, *range(7), 0, 0, 0])).collect()
    assert len(rows) == 24 and sum(r.vec_id is None for r in rows) == 4 and {r.n for r in rows} == {12}


def test_deviation_is_exact_beyond_64_bit_squares(spark):
    vectors = [[float(1 << 20), 0.0], [-float(1 << 20), 1.0], [3.0, 5.0]]
    found = wh.whiten(table(spark, vectors), scale=1 << 12)[0].collect()
    x = [[int(c * (1 << 12)) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    assert {r.id: int(r.deviation) for r in found} == {i: sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}


@pytest.mark.parametrize("values", [[5.0, 5.0, 5.0, 1.0], [1.0] * 12, [9.0, 8.999999, 8.9999989, 2.0, 2.0, 1e-9], [3.0, 0.0, 0.0]])
def test_clusters_of_eigenvalues(values):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((len(values),) * 2))
    matrix = q @ np.diag(values) @ q.T
    found, vectors = wh.leading_components((matrix + matrix.T) / 2, len(values))
    positive = [v for v in values if v]
    np.testing.assert_allclose(found, positive, atol=1e-14 * 9 * 4)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(positive)), atol=1e-13)
    np.testing.assert_allclose(matrix @ vectors, vectors * found, atol=1e-13 * max(values))


@pytest.mark.parametrize("d", [1, 2, 3, 30, 120])
def test_decomposition_matches_numpy(d):
    rng = np.random.default_rng(d)
    m = rng.standard_normal((d, 2 * d))
    m = m @ m.T
    values, vectors = wh.leading_components(m, d)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(m)[::-1], rtol=1e-10)
    np.testing.assert_allclose(m @ vectors, vectors * values, atol=1e-11 * values[0])
    diagonal, off, _ = wh.tridiagonal(m)
    points = np.sort(np.concatenate([values * 1.0001, values * 0.9999]))
    assert wh.sturm_counts(diagonal, off, points).tolist() == [(values < p).sum() for p in points]
