import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, key string, e int, score long, rn int"


def _brute(rows, every, positives=5, negatives=3):
    """rows: (vec_id, vector, label); all anchors against all rows."""
    ok = [r for r in {(i, None if v is None else tuple(v), y) for i, v, y in rows} if None not in r and all(x is not None and math.isfinite(x) for x in r[1])]
    ok = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), y) for i, v, y in ok]
    out = []
    for a, q, y in ok:
        if a % every:
            continue
        scored = sorted((-sum(p * x for p, x in zip(q, v)), i, z) for i, v, z in ok if len(v) == len(q))
        for ps, p, _ in [s for s in scored if s[2] == y and s[1] != a][:positives]:
            good = [s for s in scored if s[2] != y and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:negatives]
            out += [(a, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(good, 1)]
    return sorted(out)


def _run(spark, rows, every):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % every == 0).collect()))


@pytest.mark.parametrize("block", [2048, 40])
def test_against_every_row(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "BLOCK", block)
    rng = np.random.default_rng(block)
    x = (rng.normal(size=(8, 6))[rng.integers(0, 8, 700)] + 0.5 * rng.normal(size=(700, 6))).astype(np.float32)
    x[100:160] = x[50]  # a common vector, under several labels
    x[200] = 0
    rows = [(i, v.tolist(), int(i % 4 if i < 600 else i % 2)) for i, v in enumerate(x)]
    assert _run(spark, rows, 20) == _brute(rows, 20)


def test_edges(spark):
    bad = [(0, None, 1), (50, [1.0, None], 1), (100, [1.0, float("nan")], 1), (150, [float("inf"), 1.0], 1), (200, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    good = [(250, [1.0, 1.0], 1), (251, [1.0, 0.9], 1), (252, [1.0, 0.5], 2), (253, [0.7, 0.7], 3), (253, [0.7, 0.7], 3), (254, [-1.0, -1.0], 1), (300, [1.0, 1.0, 1.0], 1), (301, [1.0, 1.0, 0.9], 1), (302, [1.0, 0.7, 0.9], 2), (350, [], 1), (351, [], 1), (352, [], 2), (400, [0.0, 0.0], 7), (401, [0.0, 0.0], 7)]
    assert _run(spark, bad + good, 50) == _brute(bad + good, 50)
    assert _run(spark, bad, 50) == []
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(4000, 16)))
    keys = hn.Keys(x, float((x * x).sum(1).max()), 64 * hn.BLOCK)
    cell, far = keys.place(x)
    every = np.unique(cell)
    assert len(every) > 30
    low, high = np.array([far[cell == c].min() for c in every]), np.array([far[cell == c].max() for c in every])
    least, most = keys.bounds(x[:50], every, low, high)
    scores = x[:50] @ x.T
    for j, c in enumerate(every):
        assert (least[:, j] <= scores[:, cell == c].min(1)).all() and (scores[:, cell == c].max(1) <= most[:, j]).all()
