"""Exact top-k inner products against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.inner_products import Pruned, products, top_inner_products, unpack

SCHEMA = "vec_id long, embedding array<double>, score string, length int, part int"


def brute(rows, is_query, k, scale=256):
    """{query: [(id, score)]} by plain Python integers."""
    width = max((len(v) for _, v in rows), default=0)
    whole = [(i, [int(np.floor(scale * x)) for x in v] + [0] * (width - len(v))) for i, v in rows]
    result = {}
    for q, v in sorted(whole, reverse=True):
        if is_query(q):
            scores = [(i, sum(a * b for a, b in zip(v, w, strict=True))) for i, w in whole if i != q]
            result[q] = sorted(scores, key=lambda s: (-s[1], s[0]))[:k]
    return result


def found(df):
    result = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        result.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(result[r["query_id"]])
    return result


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)


def test_equals_all_pairs_with_lengths_ties_and_odd_rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 12)) * rng.lognormal(0, 1, (700, 1)) * np.linspace(3, 0.1, 12)
    x[300:360] = x[300]  # copies: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, []), (2002, [0.0] * 12), (2004, [1.5, -2.0]), (-6, [0.001] * 12)]
    odd = [(3000, None), (3002, [None] * 12), (3004, [float("nan")] * 12), (3006, [float("inf")] * 12), (3008, [1e307] * 12), (None, [9.0] * 12)]
    df = frame(spark, rows + odd)
    for block, part, lead in ((2000, 16_000, 4096), (20, 60, 16), (7, 50, 1)):
        got = found(top_inner_products(df, F.col("vec_id") % 2 == 0, 5, block=block, part=part, lead=lead))
        assert got == brute(rows, lambda q: q % 2 == 0, 5)


def test_few_rows_repeated_rows_and_no_rows(spark):
    rows = [(1, [1.0, 0.5]), (2, [0.25, -1.0]), (2, [0.25, -1.0]), (3, [2.0, 2.0])]
    assert found(top_inner_products(frame(spark, rows), F.lit(True))) == brute(rows, lambda q: True, 5)
    assert top_inner_products(frame(spark, rows), F.lit(False)).count() == 0
    assert found(top_inner_products(frame(spark, rows[:1]), F.lit(True))) == {}
    assert top_inner_products(frame(spark, []), F.lit(True)).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(1, [1e12, 3.0]), (2, [12345.67, -1e5]), (3, [-1e12, 1.0]), (4, [1e15, 1e15])]
    got = found(top_inner_products(frame(spark, rows), F.lit(True), scale=1))
    expected = brute(rows, lambda q: True, 5, 1)
    limit = 2**63 - 1
    clipped = {q: [(i, max(-limit, min(limit, s))) for i, s in found] for q, found in expected.items()}
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in clipped.items()}


def test_bounds_prune_and_rows_far_too_short_end_the_search():
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    x = np.floor(256 * (rng.normal(size=(6000, 16)) * np.linspace(4, 0.01, 16)) @ basis * rng.lognormal(0, 1, (6000, 1)))
    pruned = Pruned(np.linalg.eigh(x.T @ x)[1][:, ::-1], 5)
    scored, inner = [], pruned._survivors

    def counted(*given):
        i, j = inner(*given)
        scored.append(len(i))
        return i, j

    pruned._survivors = counted
    q = x[rng.integers(0, 6000, 40)]
    i, ids, score = pruned.search(np.full(40, -1), q, np.full(40, -np.inf), np.arange(6000), x)
    assert sum(scored[1:]) < 0.02 * 40 * 6000
    assert len(scored) < 6
    for n in range(40):
        every = (x @ q[n]).astype(np.int64)
        assert ids[i == n].tolist() == np.lexsort((np.arange(6000), -every))[:5].tolist()
        assert score[i == n].tolist() == sorted(every.tolist(), reverse=True)[:5]


@pytest.mark.parametrize("width", [1, 3])
def test_products_of_few_components(width):
    q, x = np.array([[3.0] * width, [-1.0] * width]), np.array([[2.0] * width, [5.0] * width])
    assert products(q, x, np.array([0, 1]), np.array([0, 1])).tolist() == [6 * width, -5 * width]
    assert unpack([], width).shape == (0, width)
