"""The aggregating models, nulls and bootstraps against numpy on whole matrices."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.ranks import numbered
from tessera.functions.special import t_two_sided
from tessera.functions.special import rank_sum_p
from tessera.operators import adjustment, components, draws, modelling, regression, scoring, set_tests
from tessera.plans import stages


def _combat(x, batch):
    """Genes x samples, by the definition: all values at hand, each gene's fixed point by itself."""
    names = sorted(set(batch))
    own = [x[:, batch == b] for b in names]
    n = np.array([o.shape[1] for o in own])
    grand = np.stack([o.mean(1) for o in own], 1) @ n / n.sum()
    sd = np.sqrt(sum(((o - o.mean(1, keepdims=True)) ** 2).sum(1) for o in own) / n.sum())
    out = x.copy()
    moves = np.array([all(np.ptp(o[i]) > 0 for o in own) for i in range(len(x))])
    for b, o in zip(names, own):
        z = (o[moves] - grand[moves, None]) / sd[moves, None]
        g, d = z.mean(1), z.var(1, ddof=1)
        t2, s2, m = g.var(ddof=1), d.var(ddof=1), d.mean()
        a, c = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2
        gs, ds = g.copy(), d.copy()
        for _ in range(2000):
            gs = (z.shape[1] * t2 * g + ds * g.mean()) / (z.shape[1] * t2 + ds)
            ds = (0.5 * ((z - gs[:, None]) ** 2).sum(1) + c) / (z.shape[1] / 2 + a - 1)
        out[np.ix_(moves, batch == b)] = (z - gs[:, None]) / np.sqrt(ds)[:, None] * sd[moves, None] + grand[moves, None]
    return out


def test_batches_by_definition(spark):
    rng = np.random.default_rng(1)
    batch = np.array(["a"] * 7 + ["b"] * 11 + ["c"] * 5)
    x = rng.normal(size=(30, 23)) * rng.uniform(0.5, 2, (30, 1)) + (batch == "b") * rng.normal(2, 1, (30, 1))
    x[4, batch == "c"] = 1.5  # constant in a batch: as it is
    rows = [(i, j, float(x[i, j])) for i in range(30) for j in range(23)] + [(99, 0, 1.0)]  # a gene that others miss
    long = spark.createDataFrame(rows, "g int, s int, v double")
    of = spark.createDataFrame([(j, b) for j, b in enumerate(batch.tolist())], "s int, batch string")
    got = {(r.g, r.s): r.v for r in adjustment.batch_adjusted(long, "g", "s", "v", of).collect()}
    want = _combat(x, batch)
    assert len(got) == 30 * 23
    assert max(abs(got[i, j] - want[i, j]) for i in range(30) for j in range(23)) < 1e-7
    single = adjustment.batch_adjusted(long.filter("s < 8"), "g", "s", "v", of)  # b has one sample: means only
    assert single.count() == 30 * 8 and single.filter("v IS NULL OR isnan(v)").count() == 0
    assert adjustment.batch_adjusted(long.limit(0), "g", "s", "v", of).count() == 0


def test_components_by_definition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 12)) * 2 + rng.normal(size=(40, 12))
    x[:, 11] = 3.0
    x[5, 3] = np.nan
    long = spark.createDataFrame([(i, f"f{j:02d}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(40) for j in range(12)], "s int, f string, v double")
    scores, share = components.pca(long, "s", "f", "v", top=8)
    got = {r.s: (r.PC1, r.PC2) for r in scores.collect()}
    top = np.sort(np.argsort(-np.nanvar(x, axis=0, ddof=1), kind="stable")[:8])
    z = np.nan_to_num((x[:, top] - np.nanmean(x[:, top], axis=0)) / np.nanstd(x[:, top], axis=0))
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    want = u[:, :2] * s[:2] * np.sign(vt[[0, 1], np.abs(vt[:2]).argmax(axis=1)])
    assert np.allclose([got[i] for i in range(40)], want, atol=1e-8) and np.allclose(share, (s**2 / (s**2).sum())[:2])
    empty, share = components.pca(long.limit(0), "s", "f", "v")
    assert empty.count() == 0 and not share.any()


def _newton(x, y):
    a, b = np.column_stack([np.ones(len(y)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        h = (a * (p * (1 - p))[:, None]).T @ a
        b = b + np.linalg.solve(h, a.T @ (y - p))
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


def test_logistic_models(spark):
    rng = np.random.default_rng(3)
    n = 240
    s, c, g = rng.normal(size=(n, 4)), rng.normal(size=n), rng.integers(0, 3, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.4 + s[:, 0] - 0.5 * c + (g == 1))))).astype(int)
    s[:, 2], s[:, 3] = y * 2.0 - 1 + 0.01 * rng.random(n), 7.0  # separated; constant
    scores = spark.createDataFrame([(i, f"s{j}", None if (i, j) == (5, 1) else float(s[i, j])) for i in range(n) for j in range(4)], "sample int, feature string, score double")
    lines = spark.createDataFrame([(i, int(y[i]), None if i == 7 else float(c[i]), "ABC"[g[i]], 1, "x") for i in range(n)], "sample int, y int, c double, g string, score int, feature string")
    got = {r.feature: r for r in regression.logistic(scores, lines, "y", ["c"], ["g"]).collect()}
    for j, gone in ((0, [7]), (1, [5, 7])):
        z = (s[:, j] - s[[i for i in range(n) if (i, j) != (5, 1)], j].mean()) / s[[i for i in range(n) if (i, j) != (5, 1)], j].std()
        keep = np.setdiff1d(np.arange(n), gone)
        b, se = _newton(np.column_stack([c, g == 1, g == 2, z])[keep].astype(float), y[keep])
        r = got[f"s{j}"]
        assert (r.status, r.n) == ("ok", len(keep)) and r.coef == pytest.approx(b[-1], abs=1e-8) and r.se == pytest.approx(se[-1], abs=1e-8)
        assert r.p == pytest.approx(math.erfc(abs(b[-1] / se[-1]) / math.sqrt(2))) and r.lo < r.odds < r.hi
    assert got["s2"].status == "separated" and got["s2"].coef is None and got["s3"].status == "constant"
    ones = regression.logistic(scores, lines.withColumn("y", F.lit(1)), "y").collect()
    assert {r.status for r in ones} == {"one class", "constant"}


def test_paired_random_sets(spark):
    rng = np.random.default_rng(4)
    n, genes = 120, 40
    y = rng.integers(0, 2, n)
    p = rng.random((n, genes))
    p[:, :5] += 0.06 * y[:, None]
    p[:, 5:9] -= 0.06 * y[:, None]
    ranks = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(n) for j in range(genes)], "sample int, feature int, p double")
    lines = spark.createDataFrame([(i, int(y[i])) for i in range(n)], "sample int, y int")
    up, down = list(range(5)), list(range(5, 9))
    got = draws.random_set_null(ranks, lines, "y", [up, down], draws=60).first()

    def z_of(sets):
        score = 0
        for sign, own in zip((1, -1), sets):
            se = np.sqrt(p.var(1, ddof=1) / len(own) * (genes - len(own)) / (genes - 1))
            score = score + sign * (p[:, own].mean(1) - p.mean(1)) / se
        b, se = _newton(((score - score.mean()) / score.std())[:, None], y)
        return b[1] / se[1]

    real, null = z_of([up, down]), []
    for d in range(1, 61):
        order = sorted(range(genes), key=lambda g: hashlib.md5(f"0:{d}:{g}".encode()).hexdigest())
        null.append(z_of([order[:5], order[5:9]]))
    assert got.z == pytest.approx(real, abs=1e-7) and got.n_valid == 60 and got.p_random == pytest.approx((1 + sum(abs(v) >= abs(real) for v in null)) / 61)
    assert draws.random_set_null(ranks, lines, "y", [[20, 21, 22]], draws=20).first().p_random > 0.1
    cov = lines.withColumnRenamed("y", "response")
    both = stages.clinical_null(ranks, cov, {"DTP": [up, down], "none": [[30, 31]]}, [], [], "sample", "feature", 20).collect()
    assert [r.feature for r in both] == ["DTP", "none"]


def test_random_sets_make_no_row_of_a_sample_and_a_draw(spark, monkeypatch):
    """Values as by definition where ranks are missing or null; what is written is far less than samples x draws."""
    rng = np.random.default_rng(8)
    n, genes, written = 90, 30, []
    y = rng.integers(0, 2, n)
    p = rng.random((n, genes))
    p[rng.random(p.shape) < 0.05] = np.nan
    rows = [(i, j, None if np.isnan(p[i, j]) else float(p[i, j])) for i in range(n) for j in range(genes) if j != i % 40]
    ranks, lines = spark.createDataFrame(rows, "sample int, feature int, p double"), spark.createDataFrame([(i, int(y[i])) for i in range(n)], "sample int, y int")
    for module in (draws, draws.regression):
        monkeypatch.setattr(module, "cut", lambda df, own=module.cut: written.append(own(df)) or written[-1])
    got = draws.random_set_null(ranks, lines, "y", [[0, 1, 2, 3], [7, 8]], draws=50).first()
    named = spark.createDataFrame([("0", g) for g in (0, 1, 2, 3)] + [("1", g) for g in (7, 8)], "set string, feature int")
    both = scoring.background_score(ranks, named, "sample", "feature")
    score = both.groupBy("sample").agg(F.lit("k").alias("feature"), F.sum(F.when(F.col("set") == "0", F.col("score")).otherwise(-F.col("score"))).alias("score"), F.count("score").alias("c")).filter("c = 2")
    assert got.z == pytest.approx(regression.logistic(score, lines, "y").first().z, abs=1e-7) and got.n_valid == 50
    assert max(df.count() for df in written) < n * 50 / 4


def _picks(seed, draw, slot, n):
    h = hashlib.md5(f"{seed}:{draw // 4}:{slot}".encode()).hexdigest()
    return int(h[8 * (draw % 4) : 8 * (draw % 4) + 8], 16) % n


def test_bootstraps_by_listing(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=90)
    y = x + rng.normal(size=90)
    g = np.array([None] * 30 + ["a"] * 58 + ["b"] * 2, object)
    rows = [(i, float(x[i]), float(y[i]) if i != 4 else None, g[i]) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, x double, y double, g string")
    got = {r.g: r for r in draws.bootstrap_r(df, "x", "y", "k", ["g"], 50, 3).collect()}
    for name in (None, "a"):
        own = [i for i in range(90) if g[i] == name and i != 4]
        drawn = []
        for d in range(50):
            i = [own[_picks(3, d, j, len(own))] for j in range(len(own))]
            drawn.append(np.corrcoef(x[i], y[i])[0, 1])
        r = got[name]
        assert (r.n, r.r) == (len(own), pytest.approx(np.corrcoef(x[own], y[own])[0, 1])) and [r.lo, r.hi] == pytest.approx(np.percentile(drawn, [2.5, 97.5]))
    assert got["b"].r is None and got["b"].lo is None
    d = draws.bootstrap_difference(df.withColumn("y", F.when(F.col("g") == "a", F.col("y")).otherwise(-F.col("y"))).fillna("c", ["g"]), "x", "y", "k", "g", "a", "c", 80).first()
    assert d.difference > 1 and 0.5 < d.lo < d.difference < d.hi < 2
    both = df.crossJoin(spark.range(3).withColumnRenamed("id", "rep")).filter("y IS NOT NULL")
    m = draws.bootstrap_lines(both, "k", "rep", "y", "x", 60).first()
    assert m.lo < m.r_mean < m.hi and m.r_mean == pytest.approx(np.corrcoef(np.delete(x, 4), np.delete(y, 4))[0, 1])


def test_picks_meet_values_in_blocks(spark):
    """A group of three blocks and one of ten rows, in two layers: the sums of listed picks, with no row made for a pick."""
    n, few = 2 * draws.PLACES + 7000, 10
    v = np.random.default_rng(8).normal(size=n)
    slots = spark.range(n).select(F.lit("a").alias("key"), F.col("id").cast("string").alias("slot"), F.lit(n).cast("long").alias("size"))
    slots = slots.unionByName(spark.range(few).select(F.lit("b").alias("key"), F.concat(F.lit("b"), F.col("id")).alias("slot"), F.lit(few).cast("long").alias("size")))
    rows = [("a", i, "p", [1.0, float(v[i])], [float(v[i])]) for i in range(n)] + [("b", i, k, [1.0, float(i * m)], [-float(i)]) for i in range(few) for k, m in (("p", 1), ("q", 2)) if (i, k) != (3, "q")]
    places = spark.createDataFrame(rows, "key string, place long, layer string, s array<double>, e array<double>")
    drawn = draws.drawn_sums(slots, places, 6, 1, 2, 1)
    assert "Generate" not in drawn._jdf.queryExecution().executedPlan().toString()
    got = {(r.key, r.layer, r._draw): r for r in drawn.collect()}
    assert len(got) == 18
    for d in range(6):
        i = np.array([_picks(1, d, j, n) for j in range(n)])
        r = got["a", "p", d]
        assert r.s0 == n and r.s1 == pytest.approx(v[i].sum()) and r.e0 == v[i].min()
        i = np.array([_picks(1, d, f"b{j}", few) for j in range(few)])
        assert (got["b", "p", d].s0, got["b", "p", d].s1, got["b", "p", d].e0) == (few, i.sum(), -i.max())
        i = i[i != 3]
        assert (got["b", "q", d].s0, got["b", "q", d].s1, got["b", "q", d].e0) == (len(i), 2 * i.sum(), -i.max() if len(i) else math.inf)


def test_picks_of_pairs_are_made_beside_the_values(spark, monkeypatch):
    """A group of three blocks and one of seven rows: the sums of listed picks, from segments in any order; nothing of a pick is shuffled."""
    monkeypatch.setattr(draws, "HELD", 64)
    monkeypatch.setattr(draws, "SEGMENT", 10)
    n, few, packs = 150, 7, 2
    v = np.random.default_rng(9).normal(size=(2, n))
    rows = [("a", "", n, i, v[0, i], v[1, i]) for i in range(n)] + [("b", "b:", few, i, v[0, i], v[1, i]) for i in range(few)]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    given = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "lead", "size", "place", "x", "y"])
    segments = [s | {"part": part} for b in draws._packed(iter([given])) for s in b.to_pylist() for part in range(2)]
    segments.sort(key=lambda s: (s["key"], s["block"], s["part"], s["at"][::-1]))
    got = {}
    for b in draws._summed(10, packs, 3)(pa.Table.from_pylist(segments).to_batches(max_chunksize=3)):
        for r in b.to_pylist():
            got.setdefault((r["key"], r["_draw"]), []).append(list(r.values())[2:])
    assert sorted(got) == [(k, d) for k in "ab" for d in range(10)] and {len(got["a", d]) for d in range(10)} == {3}
    for (key, d), found in got.items():
        i = np.array([_picks(3, d, j if key == "a" else f"b:{j}", n if key == "a" else few) for j in range(n if key == "a" else few)])
        x, y = v[:, i]
        found = np.array(found)
        assert found[:, :6].sum(axis=0) == pytest.approx([len(i), x.sum(), y.sum(), x @ x, y @ y, x @ y]) and found[:, 6:].min(axis=0).tolist() == [x.min(), -x.max(), y.min(), -y.max()]
    monkeypatch.undo()
    sc, n = spark.sparkContext._jsc.sc(), 5000
    shuffled = lambda: sc.listenerBus().waitUntilEmpty() or sc.statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = shuffled()
    draws.bootstrap_r(spark.range(n).select("id", F.sin("id").alias("x"), F.cos("id").alias("y")), "x", "y", "id", draws=2000).collect()
    assert shuffled() - before < 2000 * n


def test_numbers_run_on_over_tasks(spark):
    df = spark.range(0, 1000, 1, 7).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b").alias("g"), (-F.col("id")).alias("v"))
    got = numbered(df, ["v"], "g").collect()
    for name, n in (("hot", 800), ("b", 100), (None, 100)):
        own = sorted(r.v for r in got if r.g == name)
        assert {r.v: r._i for r in got if r.g == name} == {v: i for i, v in enumerate(own)} and {r._n for r in got if r.g == name} == {n}


def test_matched_permutation(spark):
    rng = np.random.default_rng(6)
    v, s = rng.normal(size=300), rng.integers(0, 4, 300)
    s[:30] = np.where(np.arange(30) < 10, 9, s[:30])  # a stratum of the set alone
    values = spark.createDataFrame([(i, None if i == 29 else float(v[i]), int(s[i])) for i in range(300)], "gene int, v double, s int")
    sets = spark.createDataFrame([("x", i) for i in range(30)] + [("few", i) for i in range(3)] + [("x", 5000)], "set string, gene int")
    got = draws.matched_permutation(values, sets, "gene", "v", "s", 40, 2).collect()
    assert [r.set for r in got] == ["x"]
    pool, null = list(range(30, 300)), []
    for d in range(40):
        means = []
        for i in range(29):
            here = [j for j in pool if s[j] == s[i]] or pool
            means.append(v[here[_picks(2, d, i, len(here))]])
        null.append(np.mean(means))
    r, obs = got[0], v[:29].mean()
    assert (r.n, r.n_missing) == (29, 1) and r.obs == pytest.approx(obs) and r.null_mean == pytest.approx(np.mean(null)) and r.null_sd == pytest.approx(np.std(null))
    assert r.p == pytest.approx((1 + sum(m >= obs for m in null)) / 41)
    table = values.withColumn("expr", F.col("gene") * 1.0).withColumn("length", F.col("gene") + 1)
    assert stages.matched_shift(table, sets, "v", n_perm=20).first().signature == "x"


def test_ridge_by_fold(spark):
    rng = np.random.default_rng(7)
    n, fold = 150, rng.integers(0, 4, 150)
    g = rng.integers(0, 6, n)
    g[:3] = 6  # a rare level
    x = np.column_stack([rng.normal(3, 2, n), rng.normal(size=n), *[(g == k) * 1.0 for k in range(7)]])
    y = x[:, 0] + (g == 2) * 2 + rng.normal(size=n)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i])) for i in range(n)], "id int, x array<double>, y double, fold int")
    alphas = [0.1, 3.0, 50.0]
    got = {r.line: r for r in regression.ridge_by_fold(df, "id", "x", "y", alphas, categories=range(2, 9)).collect()}
    assert len(got) == n
    for f in range(4):
        train = fold != f
        d = np.column_stack([x[:, :2], modelling.one_hot(g.astype(object), train, 5)])
        m = modelling.Ridge(np.array(alphas)).fit(d[train], y[train])
        want = m.predict(d)
        for i in np.flatnonzero(~train):
            assert (got[i].alpha, got[i].n_train) == (m.chosen, train.sum()) and got[i].pred == pytest.approx(want[i], abs=1e-8)
    one = regression.ridge_by_fold(df.withColumn("fold", F.lit(0)), "id", "x", "y", alphas)
    assert one.count() == 0 and regression.ridge_by_fold(df.limit(0), "id", "x", "y", alphas).count() == 0


def test_interaction_with_levels(spark):
    rng = np.random.default_rng(8)
    n = 200
    s, f, g = rng.normal(5, 1, n), rng.integers(0, 2, n), rng.integers(0, 5, n)
    y = s + f + 0.7 * s * f + g + rng.normal(size=n)
    df = spark.createDataFrame([(float(y[i]), float(s[i]), int(f[i]), None if g[i] == 4 else f"g{g[i]}") for i in range(n)], "y double, s double, f int, g string")
    for category in (None, "g"):
        a = np.column_stack([np.ones(n), s, f, s * f, *([(g == k) * 1.0 for k in range(1, 5)] if category else [])])
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        dof = n - a.shape[1]
        se = math.sqrt(((y - a @ b) ** 2).sum() / dof * np.linalg.inv(a.T @ a)[3, 3])
        r = regression.interaction(df, "y", "s", "f", category).first()
        assert r.n == n and r.estimate == pytest.approx(b[3], abs=1e-9) and r.se == pytest.approx(se) and r.p == pytest.approx(t_two_sided(b[3] / se, dof))
    assert regression.interaction(df.withColumn("f", F.lit(1)), "y", "s", "f").first().estimate is None
    assert regression.interaction(df.limit(0), "y", "s", "f").first().n == 0


def test_signs_and_ranks_of_sets(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=60), 1)
    v[:2] = 0
    rows = [(i, float(v[i])) for i in range(60)] + [(60, None), (61, float("nan"))]
    sets = {"big": list(range(0, 40, 2)) + [60, 61, 999], "few": [1, 3, 5], "gone": [60], "all": list(range(60))}
    df = spark.createDataFrame(rows, "f int, v double")
    named = spark.createDataFrame([(s, i) for s, own in sets.items() for i in own] + [("few", 1)], "set string, f int")
    got = {r.set: r for r in set_tests.signed_set_test(df, named, "f", "v").collect()}
    order = np.argsort(v, kind="stable")
    rank = np.empty(60)
    for x in set(v):
        rank[v == x] = (v < x).sum() + ((v == x).sum() + 1) / 2
    ties = sum(int((v == x).sum()) ** 3 - int((v == x).sum()) for x in set(v))
    for s in ("big", "few", "all"):
        own = [i for i in sets[s] if i < 60]
        u = rank[own].sum() - len(own) * (len(own) + 1) / 2
        r = got[s]
        assert (r.n, r.n_positive, r.mean_value) == (len(own), (v[own] > 0).sum(), pytest.approx(v[own].mean()))
        assert (r.u is None and r.p_rank is None) if s == "all" else (r.u == u and r.p_rank == pytest.approx(rank_sum_p(u, len(own), 60 - len(own), ties)))
    assert got["gone"].n == 0 and got["gone"].p_sign is None and len(order) == 60


def test_set_shift_by_every_correlation(spark):
    rng = np.random.default_rng(10)
    n, k = 60, 30
    y, g = rng.normal(size=n), np.array(["a", "b", None], object)[rng.integers(0, 3, n)]
    x = rng.normal(size=(n, k))
    x[:, :6] += 0.6 * y[:, None]
    x[:, 7] = 2.5  # constant
    sets = {"driven": list(range(6)) + [7], "other": [10, 11, 12, 500], "constant": [7]}
    stratum = {f: f % 2 for f in range(k - 1)}
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(k)] + [(99, 0, 1.0)], "s int, f int, v double")
    lines = spark.createDataFrame([(i, float(y[i]), g[i]) for i in range(n)] + [(98, None, "a")], "s int, y double, g string")
    named = spark.createDataFrame([(s, i) for s, own in sets.items() for i in own], "set string, f int")
    strata = spark.createDataFrame(list(stratum.items()), "f int, stratum int")
    got = {r.set: r for r in set_tests.set_shift(long, lines, named, strata, "s", "f", "v", "y", "g", 50, 4).collect()}
    assert set(got) == {"driven", "other"}
    moved = [y]
    for d in range(1, 51):
        own = y.copy()
        for level in ("a", "b", None):
            i = [j for j in range(n) if g[j] == level]
            own[i] = y[sorted(i, key=lambda s: hashlib.md5(f"4:{d}:{s}".encode()).hexdigest())]
        moved.append(own)
    with np.errstate(all="ignore"):
        r = np.array([[np.corrcoef(x[:, j], own)[0, 1] for own in moved] for j in range(k)])
    r[7] = np.nan
    for s in ("driven", "other"):
        own = [f for f in sets[s] if f < k]
        back = sum(sum(stratum.get(f) == b for f in own) / len(own) * np.nanmean(r[[f for f in stratum if stratum[f] == b]], axis=0) for b in (0, 1))
        gap = np.nanmean(r[own], axis=0) - back
        assert got[s].n == len(own) and got[s].mean_r == pytest.approx(np.nanmean(r[own, 0])) and got[s].background_r == pytest.approx(back[0])
        assert got[s].p == pytest.approx((1 + (np.abs(gap[1:]) >= abs(gap[0])).sum()) / 51)
    per = set_tests.permuted(lines, "s", "y", "g", 3, 0)
    assert per.filter("draw > 0").groupBy("draw").agg(F.sum("y").alias("t")).select(F.round("t", 9)).distinct().count() == 1


def test_directed_enrichment(spark):
    coef = spark.createDataFrame([(f"g{i}", float(i - 5) or 0.5) for i in range(12)], "gene string, coef double")
    sets = spark.createDataFrame([("up", "g9"), ("up", "g10"), ("up", "g11"), ("up", "g50"), ("none", "g60")], "set string, gene string")
    universe = spark.createDataFrame([(f"g{i}",) for i in range(100)], "gene string")
    got = {r.set: r for r in stages.directed_enrichment(coef, sets, universe).collect()}
    assert got["up"].observed == 3 and got["up"].coef_n == 3 and got["up"].coef_n_resistance == 3 and got["none"].observed == 0 and got["none"].coef_n is None


def test_elastic_nets_by_fold(spark):
    """Against coordinate descent on the rows, with the same inner folds."""
    rng = np.random.default_rng(11)
    n, p = 120, 12
    x = rng.normal(size=(n, p)) * rng.uniform(0.5, 3, p) + rng.normal(size=p)
    x[:, 5] = 2.0
    y = x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=n)
    fold, inner = rng.integers(0, 4, n), rng.integers(0, 3, n)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i]), int(inner[i])) for i in range(n)], "id int, x array<double>, y double, fold int, inner int")
    grid = np.array([0.5, 0.1, 0.02, 0.004])
    got = {r.line: r for r in regression.elastic_net_by_fold(df, "id", "x", "y", grid).collect()}
    assert len(got) == n
    for f in range(4):
        train = fold != f
        z, m, s = modelling.standardise(x[train])
        yt, g, loss = y[train], inner[train], np.zeros(len(grid))
        for k in range(3):
            a, b = z[g != k], yt[g != k]
            coef = modelling.elastic_net_path(a - a.mean(0), b - b.mean(), grid, tol=1e-7)
            loss += ((yt[g == k][:, None] - b.mean() - (z[g == k] - a.mean(0)) @ coef.T) ** 2).mean(0)
        best = grid[loss.argmin()]
        coef = modelling.elastic_net_path(z, yt - yt.mean(), np.array([best]), tol=1e-7)[0]
        for i in np.flatnonzero(~train):
            assert got[i].alpha == best and got[i].n_train == train.sum() and got[i].pred == pytest.approx(yt.mean() + ((x[i] - m) / s) @ coef, abs=1e-5)
    assert regression.elastic_net_by_fold(df.limit(0), "id", "x", "y", grid).count() == 0


def test_sums_on_the_same_folds(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 4))
    y = x[:, 0] + 0.3 * rng.normal(size=60)
    df = spark.createDataFrame([(f"l{i:02d}", x[i].tolist(), "abc"[i % 3], float(y[i])) for i in range(60)], "line string, features array<double>, g string, y double")
    for more in ({"repeats": 2}, {"group": "g", "by_group": True}):
        a = {(r.line, r.repeat): r for r in modelling.cross_validate(df, "line", "features", "y", modelling.Ridge, **more).collect()}
        b = {(r.line, r.repeat): r for r in regression.cross_validate_sums(df, "line", "features", "y", "ridge", **more).collect()}
        assert a.keys() == b.keys() and all((a[k].fold, a[k].alpha, a[k].n_train) == (b[k].fold, b[k].alpha, b[k].n_train) and a[k].pred == pytest.approx(b[k].pred, abs=1e-9) for k in a)
    t = regression.cross_validate_sums(df, "line", "features", "y", "tuned", repeats=1)
    assert t.agg(F.corr("truth", "pred")).first()[0] > 0.9 and t.columns == [c.split()[0] for c in modelling.OOF.split(", ")]
