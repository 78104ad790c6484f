import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.functions.multiplicity import bh_q, with_bh_q
from tessera.functions.nulls import flag, nan_to_null, not_in, number, safe_corr
from tessera.functions.ranks import average_rank, bin_edges, ordinal_bin, percentile_rank, value_bin, with_group_rank


def test_tails_against_known_values():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880347707, rel=1e-10)
    assert special.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert special.pearson_p(0.5, 20) == pytest.approx(0.0247695588, rel=1e-8)
    assert special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert math.isnan(special.pearson_p(0.5, 2)) and special.pearson_p(1.0, 9) == 0
    exact = sum(math.comb(20, k) * math.comb(80, 12 - k) for k in range(8, 13)) / math.comb(100, 12)
    assert special.hypergeometric_tail(100, 20, 12, 8) == pytest.approx(exact, rel=1e-10)
    assert math.isnan(special.hypergeometric_tail(0, 1, 1, 1))
    assert special.binomial_two_sided(2, 10) == pytest.approx(2 * (1 + 10 + 45) / 1024)


def test_rank_sums_exact_and_normal():
    """Against the count of all choices of ranks, and the normal limit with ties."""
    from itertools import combinations

    for n, m in ((3, 4), (4, 3), (2, 9), (9, 2)):
        us = [sum(c) - n * (n - 1) / 2 for c in combinations(range(n + m), n)]
        for u in range(n * m + 1):
            want = min(1.0, 2 * sum(x >= max(u, n * m - u) for x in us) / len(us))
            assert special.rank_sum_p(u, n, m, 0) == pytest.approx(want)
    x, y = np.array([1.0, 2, 2, 3, 5, 5, 7, 8, 9, 10]), np.array([2.0, 4, 5, 6, 6, 8, 11, 12, 13])
    both = np.concatenate([x, y])
    u = special.rank_average(both)[:10].sum() - 55
    t = np.unique(both, return_counts=True)[1]
    sd = math.sqrt(90 / 12 * (20 - (t**3 - t).sum() / (19 * 18)))
    assert special.rank_sum_p(u, 10, 9, float((t**3 - t).sum())) == pytest.approx(math.erfc((abs(u - 45) - 0.5) / sd / math.sqrt(2)))
    assert special.binomial_two_sided(40, 100) == pytest.approx(0.0568879, abs=1e-6) and special.binomial_two_sided(480, 1001) == pytest.approx(0.2059, abs=1e-3)


def test_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0, float("nan")), ("b", None, 2.0), (None, 3.0, 3.0)], "g string, x double, y double")
    clean = nan_to_null(df)
    assert [r.y for r in clean.collect()] == [None, 2.0, 3.0]
    assert [r.g for r in df.filter(not_in("g", ["a"])).collect()] == ["b", None]
    t = spark.createDataFrame([("TRUE ",), ("1.0",), ("no",), (None,), ("x1",)], "s string")
    assert [r[0] for r in t.select(flag("s")).collect()] == [True, True, False, False, False]
    assert [r[0] for r in t.select(number("s")).collect()] == [None, 1.0, None, None, None]


def test_guarded_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 9.0), (4.0, None)], "x double, y double")
    assert df.agg(safe_corr("x", "y")).first()[0] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])
    assert df.agg(safe_corr("x", F.lit(1.0))).first()[0] is None


def test_ranks_and_bins(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0])], "i int, v double").withColumn("g", F.lit(1))
    assert [r.k for r in sorted(df.select("i", average_rank("v", "g").alias("k")).collect())] == [3.5, 1.0, 3.5, None, 2.0]
    assert [r.k for r in sorted(df.select("i", percentile_rank("v", "g").alias("k")).collect())] == [0.875, 0.25, 0.875, None, 0.5]
    for n in (20, 23, 101):
        got = [r.b for r in spark.range(n).select("id", ordinal_bin([F.asc("id")], 10).alias("b")).orderBy("id").collect()]
        edges = np.quantile(np.arange(n), np.linspace(0, 1, 11))
        want = [max(int(np.searchsorted(edges, i, side="left")) - 1, 0) for i in range(n)]
        assert got == want
    d = spark.createDataFrame([(v,) for v in [1.0, 1.0, 1.0, 2.0, 5.0, 9.0]], "v double")
    e = bin_edges(d, "v", 3)
    assert e == sorted(set(np.quantile([1, 1, 1, 2, 5, 9], [0, 1 / 3, 2 / 3, 1])))
    assert [r[0] for r in d.select(value_bin("v", e)).collect()] == [0, 0, 0, 0, 1, 1]


def test_bh_with_missing(spark):
    p = [0.001, 0.02, None, 0.04, 0.5]
    df = spark.createDataFrame([(i, v, "f") for i, v in enumerate(p)] + [(9, 0.03, "g")], "i int, p double, f string")
    got = {r.i: r.q for r in df.select("i", bh_q("p", "f").alias("q")).collect()}
    want = {0: 0.004, 1: 0.04, 2: None, 3: 0.04 * 4 / 3, 4: 0.5, 9: 0.03}
    assert {k: None if v is None else pytest.approx(v) for k, v in want.items()} == got


def test_large_groups_are_spread(spark):
    """Ranks and q-values of groups of any size are those of the windows, and no window takes a whole group."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("g"), F.when(F.col("id") % 50 > 0, (F.col("id") * 7919 % 401 + 1) / F.lit(402.0)).alias("p"))
    q, r = with_bh_q(df, "p", "q", "g"), with_group_rank(df, "p", "r", "g")
    want = {x.id: (x.q, x.r) for x in df.select("id", bh_q("p", "g").alias("q"), average_rank("p", "g").alias("r")).collect()}
    a, b = {x.id: x.q for x in q.collect()}, {x.id: x.r for x in r.collect()}
    assert len(a) == len(b) == 3000 and all(a[i] == pytest.approx(want[i][0]) and b[i] == want[i][1] for i in want)
    for made in (q, r):
        assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
