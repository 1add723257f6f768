"""Operator 11 against plain inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.llm import bitslice

VEC = "vec_id long, embedding array<double>, at long, x long, score string"


def plain(rows, step, k, scale=64):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        whole.append((i, [math.floor(max(-(2.0**52), min(2.0**52, scale * c))) for c in v]))
    out = {}
    for i, q in {(i, tuple(x)) for i, x in whole if i % step == 0}:
        out.setdefault(i, []).extend((-sum(a * b for a, b in zip(q, x)), j) for j, x in whole if j != i)
    return sorted((i, n, j, -s) for i, found in out.items() for n, (s, j) in enumerate(sorted(found)[:k], 1))


def run(spark, rows, step, k, **sizes):
    df = spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows], VEC).repartition(3)
    segments, known, dim = bitslice.build_index(df, "vec_id", "embedding", 64, sizes.get("segment", 64))
    found = bitslice.search(segments, known.where(F.col("vec_id") % step == 0), dim, k, sizes.get("group", 2), sizes.get("block", 8))
    return sorted(tuple(r) for r in found.collect())


def test_products_match_plain_ones(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(9)]) for i in range(400)]
    rows += [(400, None), (None, [1.0] * 9), (405, [None] * 9), (410, [math.nan] * 9), (415, [math.inf] + [0.0] * 8), (420, [0.0] * 9), (425, []), (430, [1.0, -1.0])]
    rows += [(500 + i, [0.5] * 9) for i in range(60)] + [(505, [0.5] * 9)] * 3 + [(510, [-0.25] * 9)]
    rows += [(600, [1e5, -3e4] + [0.1] * 7), (605, [-1e5] * 9)]
    for sizes in ({}, {"segment": 1000, "block": 1000}, {"segment": 16, "group": 1, "block": 3}):
        assert run(spark, rows, 5, 20, **sizes) == plain(rows, 5, 20)


def test_fewer_rows_than_wanted_and_none(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.25, -0.5]), (20, [-0.5, 0.1])]
    assert run(spark, rows, 20, 20) == plain(rows, 20, 20)
    assert run(spark, [(20, [1.0])], 20, 20) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])], 20, 20) == []
    assert run(spark, [], 20, 20) == []


def test_sums_beyond_a_long_are_cut_off():
    big = np.array([[2**53, 2**53], [-(2**53), -(2**53)], [3, 2**53]])
    s = bitslice.Segment.of(np.array([7, 8, 9]), big)
    scores, ids = s.best(1, np.array([2**53, 2**53]), 3)
    assert ids.tolist() == [7, 9, 8] and scores == [2**63 - 1, 2**63 - 1, -(2**63)]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_slices_of_a_segment(n):
    rng = np.random.default_rng(n)
    x = rng.integers(-100, 100, (n, 7))
    x[:, 3] = 5
    s = bitslice.Segment.of(np.arange(n), x)
    q = rng.integers(-90, 90, 7)
    slices, add = s.product(q)
    total = sum(np.unpackbits(p.view(np.uint8), bitorder="little")[:n].astype(np.int64) << j for j, p in enumerate(slices)) + np.full(n, add)
    assert np.array_equal(total, x @ q)
