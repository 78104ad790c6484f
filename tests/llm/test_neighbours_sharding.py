import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.neighbours import Index, nearest, scan
from tessera.llm.sharding import _is_prime, fill, hot_keys, moved, place

from .helpers import SCHEMA, edge_texts, rows


def _vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))
    return x.astype(np.float32).astype(float)


def test_recall_order_and_scores(spark):
    x = _vectors(1500, 24, 1)
    x[700:760] = x[3]  # a common vector
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    out = nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    for q, got in by.items():
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in got)
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        d[q] = np.inf
        hits += len({r.vec_id for r in got} & set(np.lexsort((np.arange(len(x)), d))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(by)
    common = sorted(by[700], key=lambda r: r["rank"])
    assert [r.vec_id for r in common] == [3, *range(701, 710)] and {r.score for r in common} == {0.0}


def test_edges(spark):
    bad = [(0, None), (100, []), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(600, [1.0, 0.0]), (601, [1.0, 1.0]), (602, [1.0, 1.0]), (700, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(a, b, "x") for a, b in bad + good], "vec_id long, embedding array<double>, key string")
    out = sorted(map(tuple, nearest(df, F.col("vec_id") % 100 == 0).collect()))
    assert out == [(600, 1, 601, 1.0), (600, 2, 602, 1.0)]
    assert nearest(df.limit(0), F.lit(True)).count() == 0


def test_scan_gives_up_but_keeps_the_nearest():
    x = _vectors(3000, 64, 2)
    index = Index(x, len(x), 10)
    turned = x @ index.rotation
    blocks = [np.ascontiguousarray(turned[:, i : i + 16]) for i in range(0, 64, 16)]
    hits = 0
    for q in range(0, 3000, 100):
        at, d = scan(turned[q], x[q], blocks, x, 11)
        assert np.allclose(d, np.sqrt(((x[at] - x[q]) ** 2).sum(axis=1)), atol=0)
        true = np.argsort(((x - x[q]) ** 2).sum(axis=1))[:11]
        hits += len(set(at.tolist()) & set(true.tolist()))
    assert hits >= 0.97 * 11 * 30


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(17)]
    table = fill(names, 4099)
    count = np.bincount(table, minlength=17)
    assert count.max() - count.min() <= 1
    # by the definition, turn by turn
    import hashlib

    claimed, nxt = {}, [0] * 17
    pref = []
    for n in names:
        d = hashlib.md5(n.encode()).digest()
        pref.append((int.from_bytes(d[:8], "big") % 4099, int.from_bytes(d[8:], "big") % 4098 + 1))
    while len(claimed) < 4099:
        for i, (o, s) in enumerate(pref):
            while (slot := (o + nxt[i] * s) % 4099) in claimed:
                nxt[i] += 1
            claimed[slot] = i
            if len(claimed) == 4099:
                break
    assert table == [claimed[i] for i in range(4099)]
    fewer = fill(names[:-1], 4099)
    assert sum(a != b for a, b in zip(table, fewer)) < 4099 * 0.12
    for shards, size in (([], 7), (names, 4098), (names, 13)):
        with pytest.raises(ValueError):
            fill(shards, size)
    assert _is_prime(65_537)


def test_placing(spark):
    data = rows(edge_texts()) + [(None, "n", None, None, 1, 1, "", "", 1)] * 3
    df = spark.createDataFrame(data, SCHEMA).withColumn("shard", F.lit("old"))
    names = [f"s{i}" for i in range(5)]
    out = place(df, ["doc_id"], names).collect()
    assert len(out) == len(data) and len({r.shard for r in out if r.doc_id is None}) == 1
    assert all(0 <= r.shard < 5 for r in out)
    assert place(df.limit(0), ["doc_id"], names).count() == 0
    hot = hot_keys(df, ["source"], 0.2, df.count())
    spread = place(df, ["source"], names, hot=hot, spread_by=["doc_id"])
    assert spread.count() == len(data)
    a = {r.doc_id: r.shard for r in place(df, ["doc_id"], names).collect()}
    b = {r.doc_id: r.shard for r in place(df, ["doc_id"], names[:-1]).collect()}
    gone = {r.doc_id for r in moved(df.drop("shard"), ["doc_id"], names, names[:-1]).collect()}
    assert gone == {d for d in a if a[d] != b[d]}
