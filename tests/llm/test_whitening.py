"""Whitening against floating-point eigenvectors and against exact properties."""

from fractions import Fraction

import numpy as np
import pytest

from docloom.llm import whitening


def scatter(y):
    sums = y.sum(0).astype(object)
    return len(y) * whitening.products(y) - np.multiply.outer(sums, sums)


def exact_polynomial(matrix):
    """Faddeev and LeVerrier, in whole numbers."""
    n, out, m = len(matrix), [1], np.zeros(matrix.shape, object)
    for k in range(1, n + 1):
        m = matrix.dot(m) + out[-1] * np.eye(n, dtype=int).astype(object)
        out.append(-int(np.trace(matrix.dot(m))) // k)
    return out


@pytest.mark.parametrize("shape", [(40, 1), (40, 5), (9, 12), (200, 17)])
def test_polynomial(spark, shape):
    matrix = scatter(np.random.default_rng(shape[1]).integers(-90, 90, shape))
    assert whitening.characteristic_polynomial(spark, matrix)[0] == exact_polynomial(matrix)


def test_polynomial_with_swaps():
    matrix = np.array([[0, 0, 0, 2], [0, 1, 0, 0], [0, 0, 3, 0], [2, 0, 0, 5]], object)
    for p in whitening.primes(3):
        assert whitening.hessenberg_polynomial(matrix, p) == [c % p for c in exact_polynomial(matrix)]


def test_roots_with_multiplicity():
    roots = [7, 7, 7, 3, 1, 1, 0]
    f = [1]
    for r in roots:
        f = [a - r * b for a, b in zip([*f, 0], [0, *f], strict=True)]
    plain = whitening.square_free(f, whitening.primes(20))
    assert len(plain) == 5
    assert [whitening.above(f, t, 0) for t in (0, 1, 3, 6, 7)] == [6, 4, 3, 3, 0]
    found, scale = whitening.roots(plain, f, 22, 16)
    assert [m for _, m in found] == [3, 1, 2]
    assert all(abs(Fraction(r, 1 << scale) - want) < Fraction(2, 1 << scale) for (r, _), want in zip(found, (7, 3, 1), strict=True))


def test_close_roots():
    """Two roots that agree in their first 30 digits are told apart."""
    big = 10**30
    f = [1, -(2 * big + 1), big * (big + 1)]
    found, scale = whitening.roots(f, f, 2 * big + 1, 2)
    assert all(abs(Fraction(r, 1 << scale) - want) < Fraction(2, 1 << scale) for (r, _), want in zip(found, (big + 1, big), strict=True))


@pytest.mark.parametrize("many", [1, 3])
def test_null_vectors(many):
    base = np.random.default_rng(2).integers(-4, 5, (6, 6 - many)).astype(object)
    matrix = base.dot(base.T)  # its null space has ``many`` dimensions
    rows = np.array(whitening.null_vectors(matrix, 0, 256, many))
    assert np.abs(rows @ rows.T - np.eye(many)).max() < 1e-14 and np.abs(matrix.astype(float) @ rows.T).max() < 1e-12


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, y int, component string")


def test_vectors(spark):
    rng = np.random.default_rng(1)
    e = (rng.normal(size=(300, 6)) * np.array([5, 3, 2, 1, 0.5, 0.2])).astype(np.float32)
    rows = [(i, [float(x) for x in v], "a", 1, "b") for i, v in enumerate(e)] + [(7, [float(x) for x in e[0]], "a", 1, "b"), (None, [float(x) for x in e[1]], "a", 1, "b")]
    bad = [(900, None, "a", 1, "b"), (901, [1.0, None] + [0.0] * 4, "a", 1, "b"), (902, [float("nan")] + [0.0] * 5, "a", 1, "b"), (903, [float("inf")] * 6, "a", 1, "b"), (904, [], "a", 1, "b"), (905, [1.0, 2.0], "a", 1, "b")]
    got = whitening.whitened(table(spark, rows + bad), count=4).collect()
    assert len(got) == 4 * len(rows)
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    want = (x - sums / n) @ vector[:, :4] / np.sqrt(value[:4])
    at = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(value[r["component"] - 1] / value.sum(), rel=1e-10)
        at.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
    signs = None
    for (i, *_), row, raw in zip(rows, want, x, strict=True):
        mine = at[(i, int(((n * raw - sums) ** 2).sum()))]
        mine = np.array([mine[c] for c in (1, 2, 3, 4)])
        signs = np.sign(mine * row) if signs is None else signs
        assert np.allclose(mine * signs, row, atol=1e-9)


def test_few_vectors(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0], "", 0, "")] * 3)).count() == 0
    two = whitening.whitened(table(spark, [(1, [1.0, 2.0], "", 0, ""), (2, [1.0, 3.0], "", 0, "")])).collect()
    assert sorted((r["vec_id"], r["component"], round(r["whitened"], 12), r["explained"]) for r in two) == [(1, 1, -1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_huge_entries(spark):
    rows = whitening.whitened(table(spark, [(i, [1e17 * (i % 5), float(i)], "", 0, "") for i in range(9)])).collect()
    assert len(rows) == 18 and all(r["deviation"] is None and np.isfinite(r["whitened"]) for r in rows)


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for most in (100, 1 << 27, 1 << 31, 1 << 61):
        y = rng.integers(-most, most, (50, 4))
        assert (whitening.products(y) == y.astype(object).T.dot(y.astype(object))).all()
