import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import stages
from tessera.operators import scoring


@pytest.fixture(scope="module")
def expression(spark):
    rng = np.random.default_rng(0)
    rows = [(f"m{i:02d}", f"G{j:02d}", float(rng.normal() + (i / 10 if j < 8 else 0))) for i in range(24) for j in range(30) if (i * 7 + j) % 29]
    return spark.createDataFrame(rows, "model_id string, gene_symbol string, value double").persist()


def test_tables_and_scores(spark, expression):
    resp = spark.createDataFrame([(f"m{i:02d}", "5-FluoroUracil (x)", float(i), 0.5, 1.0, i) for i in range(30)] + [("m00", "5-fluorouracil", 99.0, 0.1, 1.0, 40), ("m01", None, 0.0, 0.0, 1.0, 41)], "SANGER_MODEL_ID string, DRUG_NAME string, AUC double, LN_IC50 double, MAX_CONC double, ordinal int")
    models = spark.createDataFrame([("m00", "b", "LAML"), ("m00", "a", "COREAD"), ("m01", "c", None)], "model_id string, model_name string, TCGA_DESC string")
    t = stages.build_table(resp, "fluorouracil", models, expression)
    rows = {r.model_id: r for r in t.collect()}
    assert len(rows) == 24 and rows["m00"].AUC == 0.0 and rows["m00"].TCGA_DESC == "COREAD" and rows["m03"].row_ix == 3 and rows["m05"].ic50_extrapolated
    assert stages.solid(t.withColumn("TCGA_DESC", F.when(F.col("model_id") == "m02", "LAML"))).count() == 23
    full = stages.complete(expression)
    assert full.count() == 24 * 30 and full.filter("value IS NULL").count() == 0
    sets = spark.createDataFrame([("DTP_up", i, f"G{i:02d}") for i in range(8)] + [("DTP_down", i, f"G{20 + i}") for i in range(6)] + [("MYC", 0, "G10"), ("MYC", 1, "G11")], "set string, line_no int, gene string")
    al = spark.createDataFrame([], "alias string, symbol string, ordinal int")
    for method in ("background", "ssgsea"):
        score, rec = stages.score_table(full, sets, al, method=method)
        assert {r.set for r in score.select("set").distinct().collect()} == {"DTP", "MYC"} and rec.count() == 3
    a = stages.associations(score, t.withColumnRenamed("AUC", "y"), "y", n_boot=50)
    got = {r.set: r for r in a.collect()}
    assert got["DTP"].r > 0.5 and got["DTP"].lo < got["DTP"].r < got["DTP"].hi and got["DTP"].q < 0.05
    both = stages.replicated(a, a).first()
    assert both.same_sign and both.ci_overlap
    agree = stages.agreement_table(t, t, "d").collect()
    assert {(r.target, r.n) for r in agree} == {("AUC", 24), ("LN_IC50", 24)}


def test_confounds(spark):
    rng = np.random.default_rng(1)
    rows = [(f"m{i}", float(rng.normal()), i % 3 == 0, "AB"[i % 2]) for i in range(60)]
    t = spark.createDataFrame([(m, s, int(f), g, s * (2 if f else 0) + 0.1 * float(rng.normal())) for m, s, f, g in rows], "model_id string, score double, msi int, g string, y double")
    e = stages.interaction(t, "y", "score", "msi", "g")
    assert e["n"] == 60 and e["lo"] < 2 < e["hi"] and e["p"] < 1e-6
    s = {r.msi: r for r in stages.by_stratum(t, "score", "y", "msi").collect()}
    assert s[1].r > 0.9 and s[1].lo < s[1].r < s[1].hi
    f = stages.flag_correlations(t.select("model_id", F.col("msi").alias("TP53")), t, "y", ["TP53", "none"]).first()
    assert (f.gene, f.n, f.n_mutant) == ("TP53", 60, 20)
    spec = stages.specificity(t.select(F.lit("d").alias("drug"), F.col("y").alias("auc"), "score", "msi", F.col("score").alias("gen")), ["d", "x"], ["score"], "msi", "gen")
    assert [r.drug for r in spec.collect()] == ["d"] and "q_both_adj" in spec.columns
    long = spark.createDataFrame([(i, f"d{j}", float(rng.normal() + i)) for i in range(12) for j in range(4)], "line int, item string, v double")
    assert stages.specific_response(long, "line", "item", "v", "d0", 10).count() == 12


def test_methylation_and_architecture(spark):
    ann = spark.createDataFrame([("p1", "1", "A;B", "TSS200;Body", "Island", "TRUE"), ("p2", "X", "A", "TSS200", "Island", ""), ("p3", "1", "A;A", "TSS200;TSS200", "Shore", None)], "probe string, chr string, gene string, region string, relation_to_island string, enhancer string")
    long = spark.createDataFrame([("p1", "s", 0.5, 0.001), ("p2", "s", 0.9, 0.0), ("p3", "s", 0.1, None)], "probe string, sample string, beta double, pval double")
    none = spark.createDataFrame([], "probe string")
    m, n = stages.methylation(long, ann, ["TSS200"], none, none)
    assert [(r.gene, r.beta) for r in m.collect()] == [("A", pytest.approx(0.3))] and {r.filter: r.n for r in n.collect()}["kept"] == 2
    assert {(r.stratum, r.gene) for r in stages.promoter_strata(ann, ["TSS200"]).collect()} == {("promoter_Island", "A"), ("promoter_Shore", "A"), ("enhancer", "A"), ("enhancer", "B")}
    peaks = spark.createDataFrame([("k1", "1", 0, 10, "Distal"), ("k2", "1", 90, 110, "Promoter")], "name string, chrom string, start int, end int, annotation string")
    tss = spark.createDataFrame([("A", "1", 2), ("B", "1", 99)], "symbol string, chrom string, tss int")
    links = spark.createDataFrame([("k1", "Z", 0), ("k1", "B", 1)], "name string, gene string, ordinal int")
    got = {r.symbol: (r.n_distal, r.n_promoter) for r in stages.architecture(peaks, tss, links).collect()}
    assert got == {"B": (1, 1)}


def test_induction_and_display(spark):
    rng = np.random.default_rng(2)
    hours = [0, 0, 0, 6, 6, 6, 24, 24, 24, 48, 48, 48]
    rows = [(f"s{i}", h, f"G{j}", float(rng.normal() + (h / 10 if j < 5 else 0))) for i, h in enumerate(hours) for j in range(40)]
    long = spark.createDataFrame(rows, "sample string, hours int, gene string, v double")
    ranks = scoring.rank_matrix(long, "sample", "gene", "v").join(long.select("sample", "hours").distinct(), "sample")
    sets = {"DTP": [f"G{j}" for j in range(5)], "CellCycle": [f"G{j}" for j in range(20, 26)]}
    s = spark.createDataFrame([(k, g) for k, v in sets.items() for g in v], "set string, gene string")
    score = scoring.background_score(ranks, s, "sample", "gene").join(long.select("sample", "hours").distinct(), "sample")
    out = stages.induction(score, ranks, sets, draws=50)
    assert out["compositional"].set_index("feature").loc["DTP", "z"] > 1.5 and list(out["adjusted"]["feature"]) == ["DTP"]
    p = stages.with_trend_p(scoring.trend_stats(score, "set", "hours", "score")).filter("`set` = 'DTP'").first()
    assert p.trend_p < 0.01 and p.ttest_p < 0.05 and p.delta > 0
    lines = spark.createDataFrame([("a", "L", 1.0, 2.0), ("b", "L", 2.0, 4.0), ("c", "M", 9.0, 0.0)], "line string, lin string, x double, y double")
    _, fit = stages.view(lines, "lin", ["L"], "x", "y")
    assert fit["n"] == 2 and fit["slope"] == pytest.approx(2)
    r = stages.dashboard_results({"one": lines.select("line"), "two": lines.select("x")})
    assert r.count() == 6 and set(r.columns) == {"line", "table", "x"}


def test_clinical_and_batches(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=90)
    y = (rng.random(90) < 1 / (1 + np.exp(-1.5 * s))).astype(int)
    scores = spark.createDataFrame([(f"p{i}", "DTP", float(s[i])) for i in range(90)], "sample_id string, set string, score double")
    cov = spark.createDataFrame([(f"p{i}", int(y[i]), float(rng.random()) if i else None, "ABC"[i % 3]) for i in range(90)], "sample_id string, response int, purity double, cms string")
    out = {r.model: r for r in stages.clinical_tests(scores, cov, ["DTP"], ["purity"], ["cms"]).collect()}
    assert out["unadjusted"].n == 90 and out["adjusted"].n == 89 and out["unadjusted"].OR_per_SD > 1.5 and out["adjusted"].q == out["adjusted"].p
    probes = spark.createDataFrame([("a", "G1 /// G2"), ("b", "G1"), ("c", "")], "probe string, symbols string")
    long = spark.createDataFrame([("a", "s", 64.0), ("b", "s", 16.0), ("a", "t", None), ("b", "t", 4.0), ("c", "s", 9.0)], "probe string, sample string, v double")
    got = {(r.gene, r["sample"]): r.v for r in stages.collapse_probes(long, probes, "probe", "symbols", "sample", "v").collect()}
    assert got == {("G1", "s"): pytest.approx(5.0), ("G1", "t"): None}
    assert 0 < stages.difference_p(0.5, 50, 0.1, 60) < 0.05 and np.isnan(stages.difference_p(0.5, 3, 0.1, 60))


def test_grids(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(45, 6))
    y = x[:, 0] + 0.3 * rng.normal(size=45)
    t = spark.createDataFrame([(f"m{i}", "ABC"[i % 3], float(y[i]), x[i].tolist()) for i in range(45)], "model_id string, lineage string, y double, features array<double>")
    grid = stages.penalty_grid({"s": t.drop("features")}, {"all": t.select("model_id", "features")}, "y", "lineage")
    assert len(grid) == 8 and grid["r_mean"].min() > 0.5
    d = stages.module_discrepancy({"s": t}, {"all": t}, "y", "lineage")
    assert d.loc[0, "n"] == 45 and d.loc[0, "r_within_lineage"] > 0.5
    m = stages.multidrug_models({("d", "s"): t}, "y", "lineage", {("d", "s"): -0.5}, repeats=1, factory=__import__("tessera.operators.modelling", fromlist=["x"]).fixed_model)
    assert list(m["verdict"]) == ["yes", "yes"]
    assert stages.chosen_screen({"a": t, "b": t.withColumn("y", F.col("y") * 2)}, "y") == "b"


def test_matrix_verbs(spark):
    from tessera.operators import relational

    rng = np.random.default_rng(5)
    v = rng.normal(size=(9, 3))
    long = spark.createDataFrame([(i, f"f{j}", float(v[i, j])) for i in range(9) for j in range(3)], "s int, f string, v double")
    got = {(r.f_a, r.f_b): r.r for r in relational.correlation_matrix(long, "s", "f", "v").collect()}
    assert got == {(f"f{a}", f"f{b}"): pytest.approx(np.corrcoef(v[:, a], v[:, b])[0, 1]) for a in range(3) for b in range(a + 1, 3)}
    both = relational.suffixed_union({"prom": long, "body": long}, "f")
    assert both.count() == 54 and both.select("f").distinct().count() == 6
    assert {tuple(r) for r in relational.pairs_of(spark.createDataFrame([("b",), ("a",), ("c",)], "d string"), "d").collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_specificity_by_definition(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for d, n in (("a", 40), ("b", 30), ("few", 10)):
        msi, gen = rng.integers(0, 2, n), rng.normal(size=n)
        x = rng.normal(size=(n, 2)) + gen[:, None]
        y = x[:, 0] + msi + gen + rng.normal(size=n)
        if d == "b":
            msi[:] = 0  # a control that adjusts nothing
        rows += [(d, float(y[i]), float(x[i, 0]), None if (d, i) == ("a", 3) else float(x[i, 1]), int(msi[i]), float(gen[i])) for i in range(n)]
        for m in (0, 1):
            keep = np.arange(n) if (d, m) != ("a", 1) else np.delete(np.arange(n), 3)
            for name, controls in (("raw", []), ("msi_adj", [msi]), ("general_adj", [gen]), ("both_adj", [msi, gen])):
                c = np.column_stack([np.ones(len(keep)), *[k[keep] for k in controls]])
                left = [v[keep] - c @ np.linalg.lstsq(c, v[keep], rcond=None)[0] for v in (x[:, m], y)]
                want[d, f"m{m}", name] = np.corrcoef(*left)[0, 1]
    t = spark.createDataFrame(rows, "drug string, auc double, m0 double, m1 double, msi int, gen double")
    got = stages.specificity(t, ["a", "b", "few", "none"], ["m0", "m1"], "msi", "gen").collect()
    assert {(r.drug, r.module, r.n) for r in got} == {(d, m, n) for d, n in (("a", 40), ("b", 30)) for m in ("m0", "m1")}
    for r in got:
        for k in ("raw", "msi_adj", "general_adj", "both_adj"):
            assert r[f"r_{k}"] == pytest.approx(want[r.drug, r.module, k], abs=1e-9) and r[f"p_{k}"] <= r[f"q_{k}"]
