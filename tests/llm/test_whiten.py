"""Operator 13 against whole numbers and fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from docstrata.llm import whiten

VEC = "vec_id long, embedding array<double>, n long, component int, x string"


def plain(rows, scale=64, offset=1_000_000):
    """Kept ids and integers, n, deviations and the exact covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(max(-(2.0**52), min(2.0**52, scale * c))) + offset for c in v] + [offset] * (dim - len(v)) for _, v in kept]
    n = len(x)
    s = [sum(r[d] for r in x) for d in range(dim)]
    v = [[Fraction(sum(n * r[i] * r[j] for r in x) - s[i] * s[j], n * n) for j in range(dim)] for i in range(dim)]
    return [i for i, _ in kept], x, n, [min(sum((n * r[d] - s[d]) ** 2 for d in range(dim)), 2**63 - 1) for r in x], s, v


def check(spark, rows, most=32, at=1e-9):
    df = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], VEC).repartition(3)
    found = whiten.whiten(df, "vec_id", "embedding", most=most).collect()
    ids, x, n, deviations, sums, v = plain(rows)
    k = min(most, len(v))
    assert sorted((str(r["vec_id"]), r["component"], r["n"], r["deviation"]) for r in found) == sorted((str(i), c, n, d) for i, d in zip(ids, deviations) for c in range(1, k + 1))
    trace = sum(v[d][d] for d in range(len(v)))
    values = {r["component"]: r["explained"] * float(trace) for r in found}
    assert all(values[c] >= values[c + 1] for c in range(1, k))
    cov = np.array([[float(c) for c in row] for row in v])
    white = {(r["vec_id"], r["component"]): r["whitened"] for r in found}
    assert len({r["identity_error"] for r in found}) == 1
    # the covariance of x with a whitened component is sqrt(e) times its eigenvector
    centred = np.array([[float(Fraction(a * n - b, n)) for a, b in zip(r, sums)] for r in x])
    for c in range(1, k + 1):
        if values[c] > 0 and None not in ids and len(set(ids)) == len(ids):
            y = np.array([white[i, c] for i in ids])
            u = centred.T @ y / n / math.sqrt(values[c])
            assert abs(u @ u - 1) < at and abs(y @ y / n - 1) < at
            assert np.abs(cov @ u - values[c] * u).max() < at * values[1]
    return found, values


def test_whitening_matches_exact_sums(spark):
    rng = random.Random(2)
    mix = [[rng.gauss(0, 0.3) for _ in range(7)] for _ in range(7)]
    rows = [(i, [sum(a * b for a, b in zip(m, z)) for m in mix]) for i in range(300) for z in [[rng.gauss(0, 1) for _ in range(7)]]]
    found, _ = check(spark, rows)
    assert found[0]["identity_error"] < 1e-10
    odd = [(None, [0.5] * 7), (7, [0.0] * 7), (7, [0.0] * 7), (900, None), (901, [None] * 7), (902, [math.nan] * 7), (903, [-math.inf] * 7), (904, [1.0]), (905, [])]
    found, _ = check(spark, rows + odd, most=3)
    assert found[0]["identity_error"] < 1e-10


def test_uneven_and_huge_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1e9), rng.gauss(0, 1), rng.gauss(5e5, 0.1), -20_000 + rng.random()]) for i in range(200)]
    found, _ = check(spark, rows, at=1e-6)
    assert found[0]["identity_error"] < 1e-4
    assert {r["deviation"] for r in found} == {2**63 - 1} or len({r["deviation"] for r in found}) > 1


def test_no_variance_and_no_rows(spark):
    assert whiten.whiten(spark.createDataFrame([], VEC), "vec_id", "embedding").count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None, 1, 1, "x")], VEC), "vec_id", "embedding").count() == 0
    found, _ = check(spark, [(i, [i / 64, i / 32, 0.25]) for i in range(20)])  # rank one
    assert [r["whitened"] is None for r in sorted(found, key=lambda r: (r["component"], r["vec_id"]))] == [False] * 20 + [True] * 40
    assert found[0]["identity_error"] < 1e-10
    df = spark.createDataFrame([(1, [0.5, 0.5], 1, 1, "x")] * 2, VEC)
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in whiten.whiten(df, "vec_id", "embedding").collect()} == {(None, None, None, 0)}


@pytest.mark.parametrize("top", [1, 2**15, 2**20, 2**40, 2**53])
def test_products_are_exact(top):
    rng = np.random.default_rng(top)
    x = rng.integers(-top, top, (500, 4), endpoint=True)
    g = whiten.Gram(4)
    g.add(x[:123])
    g.add(x[123:])
    big = x.astype(object)
    assert (g.settle() == big.T @ big).all()
    for v in (0, -1, 2**48 - 1, 2**48, -(2**48) - 1, 12345 << 100, -(3**90)):
        assert sum(d << 48 * n for n, d in enumerate(whiten.digits(v))) == v and all(abs(d) <= 2**48 for d in whiten.digits(v))
