import math

import numpy as np
from pyspark.sql import functions as F

from bytefacts.llm.topk import Index, top_k

from .helpers import got


def brute(rows, k=5, every=50):
    fine = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, x in fine:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q)[:k]
            out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -t))) for n, (t, i) in enumerate(s)]
    return sorted(out, key=repr)


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(16).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(top_k(frame, F.col("vec_id") % 50 == 0)) == brute(rows)


def test_top_k_of_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (1, [None, 1.0]), (2, [float("nan"), 0.0]), (3, [float("inf"), 0.0]), (None, [1.0, 1.0]), (4, [0.5, -0.5]), (4, [0.5, -0.5]), (100, [1.0]), (5, []), (6, [1e12, -1e12]), (150, [1e12, 3.0])]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, x string")
    assert got(top_k(frame, F.col("vec_id") % 50 == 0)) == brute(rows)
    assert got(top_k(frame.limit(0), F.col("vec_id") % 50 == 0)) == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert got(top_k(one, F.col("vec_id") % 50 == 0)) == []


def test_stops_on_proof():
    r = np.random.default_rng(2)
    near = r.standard_normal((40, 64))[r.integers(0, 40, 4000)] + 0.5 * r.standard_normal((4000, 64))
    for x in (r.standard_normal((4000, 8)) * np.exp(r.standard_normal((4000, 1))), near / np.linalg.norm(near, axis=1)[:, None]):
        x = np.floor(256 * x).astype(np.int64)
        index, q = Index(x), x[:3]
        for i, possible in index.candidates(q, 6):
            exact = index.x @ q[i]
            best = np.argsort(-exact, kind="stable")[:6]
            assert set(best) <= set(possible.tolist())
        assert all(taken < steps for taken, steps in index.taken)


def test_magnitudes_of_any_size():
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(-(2**62), 2**62, (200, 5)), r.integers(-9, 9, (200, 5)), [[-(2**63)] * 5, [2**63 - 1] * 5]])
    ids, q = np.arange(len(x)), x[[0, 250, 400, 401]]
    got_ = Index(x).top(q, np.array([0, 250, 400, 401]), ids, 5)
    want = []
    for i, v in zip((0, 250, 400, 401), q.tolist(), strict=True):
        s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, y)))), j) for j, y in enumerate(x.tolist()) if j != i)[:5]
        want += [(i, j, -t) for t, j in s]
    assert got_ == want


def test_many_blocks_equal_one(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(r.integers(1, 12)).tolist()) for i in range(500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(top_k(frame, F.col("vec_id") % 50 == 0, block=60)) == brute(rows)
    assert got(top_k(frame, F.col("vec_id") % 50 == 0, block=3)) == brute(rows)
