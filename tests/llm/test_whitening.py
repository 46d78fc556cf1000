"""op11 against whole-number and double-precision brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tenderlens.llm import whitening


def frame(spark, vectors, parts=3):
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(parts)


def brute(vectors):
    """Fit list, deviations by vec_id and the whitened rows, in Python integers and numpy doubles."""
    kept = {
        i: tuple(math.floor(256 * float(np.float32(c))) for c in v)
        for i, v in enumerate(vectors)
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    fit = sorted(set(kept.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in kept.items()}
    x = np.array(fit, float)
    centred = x - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    white = {i: ((np.array(v, float) - np.array(sums) / n) @ axes / np.sqrt(np.maximum(values, 1e-300))) for i, v in kept.items()}
    return n, deviation, white, values / values.sum()


def test_matches_brute_force_with_nulls_copies_and_non_finite_entries(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(c) for c in v] for v in rng.normal(size=(300, 6)) * [3, 2.5, 1, 0.7, 0.5, 0.1] + 0.3]
    vectors += vectors[:3] * 60 + [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [0.0] * 6]
    n, deviation, white, explained = brute(vectors)
    got = {}
    for parts in (1, 5):
        x = whitening.whole_vectors(frame(spark, vectors, parts))
        rows = whitening.whiten(x, whitening.fit_whitening(x)).collect()
        assert len(rows) == 4 * len(deviation) and all(r["n"] == n and r["identity_error"] < 1e-9 for r in rows)
        assert {(r["vec_id"], r["deviation"]) for r in rows} == set(deviation.items())
        for k in range(4):
            mine = np.array([r["whitened"] for r in sorted(rows, key=lambda r: r["vec_id"]) if r["component"] == k + 1])
            theirs = np.array([white[i][k] for i in sorted(white)])
            assert np.abs(mine - np.sign(mine @ theirs) * theirs).max() < 1e-9
            assert all(r["explained"] == pytest.approx(explained[k], rel=1e-9) for r in rows if r["component"] == k + 1)
        got[parts] = sorted(map(tuple, rows))
    assert all(a[:4] == b[:4] for a, b in zip(got[1], got[5]))


def test_few_directions_single_vector_ragged_and_empty(spark):
    flat = whitening.whole_vectors(frame(spark, [[float(i), 2.0 * i, 0.0] for i in range(20)]))
    rows = whitening.whiten(flat, whitening.fit_whitening(flat)).collect()
    assert {r["component"] for r in rows} == {1} and len(rows) == 20 and rows[0]["explained"] == pytest.approx(1)
    for vectors in ([[1.0, 2.0]] * 4, [], [[]], [None]):
        x = whitening.whole_vectors(frame(spark, vectors))
        assert whitening.whiten(x, whitening.fit_whitening(x)).collect() == []
    x = whitening.whole_vectors(frame(spark, [[1.0], [1.0, 2.0], [], [0.5, -2.0]]))
    padded = whitening.whole_vectors(frame(spark, [[1.0, 0.0], [1.0, 2.0], [0.0, 0.0], [0.5, -2.0]]))
    a, b = (sorted(map(tuple, whitening.whiten(v, whitening.fit_whitening(v)).collect())) for v in (x, padded))
    assert a == b and len(a) == 8


def test_large_entries_are_exact_and_absurd_ones_left_out(spark):
    x = whitening.whole_vectors(frame(spark, [[2.0**31, 1.0], [-(2.0**31), 2.0], [5.0, 3.0], [1e30, 0.0]]))
    rows = whitening.whiten(x, whitening.fit_whitening(x)).collect()
    assert {r["vec_id"] for r in rows} == {0, 1, 2} and {r["deviation"] for r in rows if r["vec_id"] < 2} == {None}
    assert [r["deviation"] for r in rows if r["vec_id"] == 2][0] == sum((3 * c - s) ** 2 for c, s in ((5 * 256, 5 * 256), (768, 6 * 256)))


@pytest.mark.parametrize("values", [
    np.arange(1, 25.0), np.r_[5 + np.arange(6) * 1e-10, np.arange(1, 4.0)], np.r_[np.full(6, 5.0), 1.0, 9.0], 4.0 ** -np.arange(12),
])
def test_refinement_beats_double_precision(values):
    """Residuals and orthogonality below double precision, also in clusters; separate vectors to the last bit of a double."""
    size = len(values)
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(size, size)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + whitening.product(q, (np.eye(size) - whitening.product(q.T, q)) / 2)
    v = whitening.product(q * values.astype(np.longdouble), q.T)
    v = (v + v.T) / 2
    found, x = whitening.eigenpairs(v)
    assert np.abs(whitening.product(v, x) - x * found).max() < 1e-17 * values.max()
    assert np.abs(whitening.product(x.T, x) - np.eye(size)).max() < 1e-17
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-16 * values.max()
    gaps = np.abs(values[:, None] - values[None, :]) + np.eye(size)
    if gaps.min() > 1e-9:
        along = np.abs(np.diag(whitening.product(x.T, q[:, np.argsort(-values)])))
        assert np.abs(along - 1).max() < 1e-15


def test_product_is_exact_to_long_double():
    rng = np.random.default_rng(9)
    a, b = (rng.normal(size=(20, 20)) * 10.0 ** rng.integers(-6, 6, (20, 1)) for _ in range(2))
    exact = [[sum(Fraction(x) * Fraction(y) for x, y in zip(row, col)) for col in b.T] for row in a]
    got = whitening.product(a, b)
    error = [[abs(Fraction(float(g)) + Fraction(float(g - np.longdouble(float(g)))) - e) for g, e in zip(x, y)] for x, y in zip(got, exact)]
    scale = (np.abs(a).max(axis=1)[:, None] * np.abs(b).max(axis=0)[None, :]) * 20
    assert max(float(e) / s for r, t in zip(error, scale) for e, s in zip(r, t)) < 2.0**-60
