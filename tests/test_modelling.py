import numpy as np
import pandas as pd
import pytest

from tessera.operators import modelling as m
from tessera.operators import resampling as rs
from tessera.plans import stages


def test_folds_are_balanced_and_seeded():
    f = m.kfold(23, 5, 3)
    assert sorted(np.bincount(f)) == [4, 4, 5, 5, 5] and (f == m.kfold(23, 5, 3)).all() and (f != m.kfold(23, 5, 4)).any()


def test_elastic_net_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 120)), rng.normal(size=80)
    x, y = m.standardise(x)[0], (y + x[:, 0] * 2 - x[:, 1]) - (y + x[:, 0] * 2 - x[:, 1]).mean()
    for a, b in zip([0.5, 0.1, 0.02], m.elastic_net_path(x, y, np.array([0.5, 0.1, 0.02]), 0.5)):
        g = x.T @ (y - x @ b) / 80 - a * 0.5 * b
        on = b != 0
        assert np.allclose(g[on], a * 0.5 * np.sign(b[on]), atol=2e-4) and (np.abs(g[~on]) <= a * 0.5 + 2e-4).all()


def test_ridge_by_definition():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 6)), rng.normal(size=40)
    r = m.Ridge(np.array([0.1, 10.0, 1000.0])).fit(x, y)
    z, c = m.standardise(x)[0], y - y.mean()
    assert np.allclose(r.coef, np.linalg.solve(z.T @ z + r.chosen * np.eye(6), z.T @ c))
    errors = []
    for a in r.alphas:  # leave one out, each centred column and mean kept
        aug = np.column_stack([np.ones(40), z])
        pen = np.diag([0.0] + [a] * 6)
        h = aug @ np.linalg.solve(aug.T @ aug + pen, aug.T)
        errors.append((((y - h @ y) / (1 - np.diag(h))) ** 2).mean())
    assert r.chosen == r.alphas[int(np.argmin(errors))]


def _matrix(spark, x, y, group):
    return spark.createDataFrame([(f"l{i:03d}", x[i].tolist(), group[i], float(y[i])) for i in range(len(y))], "line string, features array<double>, g string, y double")


def test_group_means_never_leak(spark):
    rng = np.random.default_rng(3)
    group = np.repeat([f"g{i}" for i in range(6)], 25)
    y = np.repeat(rng.normal(0, 2, 6), 25) + rng.normal(0, 0.5, 150)
    df = _matrix(spark, rng.normal(size=(150, 20)), y, group)
    oof = m.cross_validate(df, "line", "features", "y", m.fixed_model, "g", True, repeats=2)
    s = m.summarise(oof, "noise")
    assert abs(s["r_mean"]) < 0.2
    again = m.cross_validate(df, "line", "features", "y", m.fixed_model, "g", True, repeats=2)
    assert sorted(map(tuple, oof.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ValueError):
        m.cross_validate(df, "line", "features", "y", m.fixed_model, deconfound=True)


def test_signal_is_found_and_compared(spark):
    rng = np.random.default_rng(0)
    group = np.repeat(["a", "b", "c"], 20)
    x = rng.normal(size=(60, 40))
    y = 0.8 * x[:, 0] + np.repeat([0, 1, 2], 20) + 0.5 * rng.normal(size=60)
    df = _matrix(spark, x, y, group)
    summary, runs = stages.final_models(df, "y", "g", "line", repeats=2, factory=m.transcriptome_model)
    r = dict(zip(summary["model"], summary["r_mean"]))
    assert r["deconfounded"] > 0.5 and -1 <= r["raw"] <= 1
    row = stages.compare(runs["raw"], m.late_fusion(runs["raw"], runs["raw"]), "a", "b").first()
    assert row.n_splits == 10 and row.mean_diff == pytest.approx(0)
    assert m.per_repeat(runs["raw"]).count() == 2
    t = stages.transfer(df, "y", "g", "c", m.fixed_model, "line", 100)
    assert t["n"] == 20 and t["lo"] < t["r"] < t["hi"]


def test_screen_uses_training_rows_only(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(30, 12)), rng.normal(size=30)
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(30) for j in range(12)], "s int, f int, v double")
    target = spark.createDataFrame([(i, i, float(y[i])) for i in range(30)], "s int, row_ix long, y double")
    folds = m.fold_table(spark, 30, 3, 2, 0)
    got = {}
    for r in m.screen_by_fold(long, target, folds, "s", "f", "v", "y", 4).collect():
        got.setdefault((r.repeat, r.fold), set()).add(r.f)
    for rep in range(2):
        k = m.kfold(30, 3, rep)
        for f in range(3):
            c = [abs(np.corrcoef(x[k != f, j], y[k != f])[0, 1]) for j in range(12)]
            assert got[rep, f] == set(np.argsort(c)[-4:].tolist())


def test_tuning_prefers_less_penalty_for_signal():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 60))
    signal = m.TunedElasticNet().fit(x, x[:, :3] @ [1.0, -1.0, 1.0] + 0.3 * rng.normal(size=150))
    noise = m.TunedElasticNet().fit(x, rng.normal(size=150))
    assert signal.chosen < noise.chosen and np.count_nonzero(signal.coef) >= 3
    s = m.ScaledTarget(m.ElasticNet(), 2.0).fit(x, 100 + 5 * x[:, 0])
    assert abs(s.predict(x).mean() - 100) < 1


def test_bootstraps():
    rng = np.random.default_rng(7)
    x = rng.normal(size=60)
    y = x + rng.normal(size=60)
    a, b = rs.bootstrap_r(x, y, 300, 1), rs.bootstrap_r(x, y, 300, 1)
    assert a == b and a[2] < a[0] < a[3]
    assert np.isnan(rs.row_r(np.ones((1, 5)), np.arange(5.0)[None])[0])
    lo, hi = rs.bootstrap_lines(np.column_stack([x, x]), np.column_stack([y, y]), 200)
    assert lo < a[0] < hi
    assert rs.reproducible((0.1, 0.2), (0.12, 0.21)) and not rs.reproducible((0.1, 0.2), (0.2, 0.2))


def test_permutation_nulls():
    rng = np.random.default_rng(9)
    v = rng.normal(size=500)
    v[:20] += 2
    assert rs.random_split_null(lambda i: v[i].mean(), np.arange(100, 140), 20, 0.0, 200) == 1.0
    c = rs.compositional_null(lambda i: v[i].mean(), 500, {"s": 20}, {"s": 3.0}, 100)
    assert c.loc[0, "p_empirical"] == 0.0


def test_tripwire_and_one_hot():
    assert not m.tripwire(0.1, True) and m.tripwire(0.5, False)
    with pytest.raises(m.LeakError):
        m.tripwire(0.5, True)
    v = np.array(["a", "a", "b", "c", "d"], object)
    train = np.array([True, True, True, True, False])
    assert m.one_hot(v, train, 2).tolist() == [[1, 0], [1, 0], [0, 1], [0, 1], [0, 0]]


def test_stage_gates(spark):
    resp = spark.createDataFrame([(f"m{i}", f"c{i}", "T", 1 + i % 2, "5-Fluorouracil", 1.0, 0.8 + i / 1000, 0.1, 0.0, 1.0, 2.0, i) for i in range(40)], "SANGER_MODEL_ID string, CELL_LINE_NAME string, TCGA_DESC string, DRUG_ID int, DRUG_NAME string, LN_IC50 double, AUC double, RMSE double, Z_SCORE double, MIN_CONC double, MAX_CONC double, ordinal int")
    out, qc = stages.drug_targets(resp, "5-Fluorouracil")
    assert out.count() == qc["n"] == 40 and qc["pct_extrapolated"] == 100.0
    with pytest.raises(stages.StageError):
        stages.drug_targets(resp.limit(10), "5-Fluorouracil")
    with pytest.raises(stages.StageError):
        stages.require_overlap(resp, resp, "SANGER_MODEL_ID")
    assert [stages.outcome(k) for k in (0, 1, 2, 3)] == ["specific", "specific", "mixed", "general"]
    assert np.allclose(stages.adjusted(np.array([0.001, 0.02, np.nan, 0.04, 0.5])), [0.004, 0.04, np.nan, 0.16 / 3, 0.5], equal_nan=True)
    c = stages.calibrate(spark.createDataFrame([(i, 2.0 * i + 1, float(i)) for i in range(20)], "k int, t double, p double"), "t", "p", "k")
    assert c["a"] == pytest.approx(2) and c["calibrated"]["rmse"] == pytest.approx(0, abs=1e-9)


def test_baselines_flag_nothing_on_noise(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "y": rng.normal(size=400), "a": rng.normal(size=400), "g": rng.choice(list("abc"), 400)}))
    out = stages.baselines(df, "id", "y", ["a"], "g", stop=True)
    assert [r.baseline for r in out.collect()] == ["a", "g", "g + numbers", "permuted labels"]
