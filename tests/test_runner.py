"""The stages from small files to result tables, as the command runs them."""

import csv

import numpy as np
import pytest

from tessera.operators import modelling
from tessera.plans import runner, stages


def _files(folder):
    rng = np.random.default_rng(5)
    genes, models = [f"G{i:02d}" for i in range(30)], [f"m{i:02d}" for i in range(45)]
    level = rng.normal(size=len(models))
    (folder / "sets").mkdir(parents=True)
    for name, own in {"DTP_up": genes[:6], "DTP_down": genes[6:10], "CellCycle": genes[10:16], "MYC": genes[16:22]}.items():
        (folder / "sets" / f"{name}.txt").write_text("\n".join(own) + "\n")

    def table(name, head, rows):
        with open(folder / name, "w", newline="") as f:
            csv.writer(f).writerows([head, *rows])

    table("expression.csv", ["model_id", "gene_symbol", "rsem_tpm", "duplicate", "data_source"], [[m, g, round(float(rng.normal() + (2 * level[i] if j < 6 else 0)), 4), "False", "x"] for i, m in enumerate(models) for j, g in enumerate(genes) if (i * 7 + j) % 61])
    table("mutations.csv", ["model_id", "gene_symbol"], [[m, g] for i, m in enumerate(models) for j, g in enumerate(("TP53", "KRAS")) if (i + j) % 3])
    table("timecourse.csv", ["sample", "hours", "treatment"], [[f"t{h}_{k}", h, "drug"] for h in (0, 16, 48) for k in range(3)])
    with open(folder / "counts.tsv", "w", newline="") as f:
        rows = [[g, *[int(rng.integers(20, 200)) * (1 + h // 8 if j < 6 else 1) for h in (0, 16, 48) for _ in range(3)]] for j, g in enumerate(genes)]
        csv.writer(f, delimiter="\t").writerows([["NAME", *[f"t{h}_{k}" for h in (0, 16, 48) for k in range(3)]], *rows])
    (folder / "clinical").mkdir()
    patients = {"gpl570": [f"p{i:03d}" for i in range(90)], "gpl6480": [f"q{i:03d}" for i in range(60)]}
    cov = []
    for cohort, own in patients.items():
        bad = rng.normal(size=len(own))
        table(f"clinical/{cohort}.csv", ["gene", *own], [[g, *[round(float(rng.normal() + (1.5 * bad[i] if j < 6 else 0)), 4) for i in range(len(own))]] for j, g in enumerate(genes)])
        cov += [[p, f"s{i % 3}", int(rng.random() < 1 / (1 + np.exp(-bad[i]))), "x", "false", "" if i == 3 else round(float(rng.random()), 3), 0.1, 0.1, f"CMS{1 + i % 2}", "MSS" if i % 5 else "MSI", 0.1, cohort] for i, p in enumerate(own)]
    table("clinical/covariates.csv", ["sample_id", "study", "response", "regimen", "bev_added", "purity", "StromalScore", "ImmuneScore", "cms", "msi_ntp", "msi_ntp_fdr", "platform"], cov)
    table("regulons.csv", ["source", "target", "weight"], [[f"TF{k}", g, (-1) ** j] for k in range(2) for j, g in enumerate(genes[k * 5 : k * 5 + 12])])
    table("tss.csv", ["symbol", "chrom", "tss", "strand", "gene_start", "gene_end", "gene_length"], [[g, "chr1", 1000 * j + 500, "+", 1000 * j, 1000 * j + 900, 500 + 10 * j] for j, g in enumerate(genes)])
    table("peaks.csv", ["seqnames", "start", "end", "annotation", "name"], [["chr1", 1000 * j + 50 * k, 1000 * j + 50 * k + 20, ["Distal", "Promoter"][(j + k) % 2 if j > 6 else k % 3 == 0], f"k{j}_{k}"] for j in range(30) for k in range(5)])
    table("links.csv", ["name", "gene"], [["k0_0", "G05"]])
    table("models.csv", ["model_id", "model_name", "synonyms", "tissue", "cancer_type", "cancer_type_detail", "growth_properties", "msi_status", "mutational_burden", "gender", "age_at_sampling"], [[m, m.upper(), "", "t", "c", "", "", "MSI" if i % 4 == 1 else "MSS", 1.0, "", ""] for i, m in enumerate(models)])
    head = ["SANGER_MODEL_ID", "CELL_LINE_NAME", "TCGA_DESC", "DRUG_ID", "DRUG_NAME", "LN_IC50", "AUC", "RMSE", "Z_SCORE", "MIN_CONC", "MAX_CONC"]
    for k, name in enumerate(runner.SCREENS):
        rows = [[m, m, ["COREAD", "LUAD", "SKCM", "LAML"][i % 4 if i < 40 else 0], 1, "5-Fluorouracil" if i % 9 else "FLUOROURACIL (b)", 1.0, round(float(0.8 + 0.05 * level[i] + 0.01 * rng.normal()), 5), 0.1, 0.0, 0.1, 10.0] for i, m in enumerate(models)]
        others = [[m, m, "COREAD", 2 + k, f"Other {k}", 1.0, round(float(0.7 + 0.1 * rng.random()), 5), 0.1, 0.0, 0.1, 10.0] for k in range(3) for m in models]
        table(f"{name}.csv", head, rows + others)


def test_from_files_to_results(spark, tmp_path):
    _files(tmp_path / "data")
    s = runner.Settings(f"file://{tmp_path}/data", f"file://{tmp_path}/out", repeats=1, features=10, n_boot=50, model=modelling.ElasticNet, draws=20, general_least=30)
    with pytest.raises(stages.StageError):
        runner.run(spark, "models", s)
    (tmp_path / "data/regulons.csv").rename(tmp_path / "data/later.csv")
    assert set(runner.run(spark, "all", s)) == set(runner.STAGES) - {"regulators"}
    (tmp_path / "data/later.csv").rename(tmp_path / "data/regulons.csv")
    runner.run(spark, "regulators", s)
    read = lambda n: {r[0]: r for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/out/{n}.csv").collect()}
    assert spark.read.parquet(f"{tmp_path}/out/y_train").filter("TCGA_DESC = 'LAML'").count() == 0
    assert read("screen_agreement")  # the ceiling of any model
    found = read("associations")
    assert found["DTP"].r_gdsc1 > 0.5 and found["DTP"].same_sign
    results = read("final_model_results")
    assert set(results) == {"transcriptome", "transcriptome_deconfounded", "leave_lineage_out", "modules", "lineage_and_number"}
    assert results["transcriptome"].r_mean > 0.5 and results["leave_lineage_out"].n_lineages_within >= 1
    assert read("model_comparisons")["transcriptome"].model_b == "lineage_and_number"
    rows = lambda n: spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/out/{n}.csv").collect()
    assert {(r.gene, r.lines) for r in rows("driver_mutations")} == {(g, k) for g in ("TP53", "KRAS") for k in ("all", "COREAD")}
    assert {r["set"] for r in rows("msi_interactions")} == {"DTP", "CellCycle", "MYC"} and len(rows("drug_similarity")) == 3
    assert {r.response for r in rows("specificity_check")} == {"raw", "general", "specific"}
    trend = {r["set"]: r for r in rows("induction_stats")}
    assert trend["DTP_up"].trend_r > 0.3 and set(trend) == {"DTP", "DTP_up", "DTP_down", "CellCycle", "MYC"} and {r.feature for r in rows("compositional_control")} >= {"CellCycle"}
    assert len(rows("drug_specificity")) == len(rows("drug_targets")) * 3
    tested = {(r.cohort, r.feature, r.model): r for r in rows("clinical_validation")}
    assert tested["gpl570", "DTP", "adjusted"].n == 89 and tested["gpl570", "DTP", "unadjusted"].OR_per_SD > 1.2
    assert {(r.cohort, r.feature) for r in rows("clinical_null")} == {(c, f) for c in ("gpl570", "gpl6480") for f in ("DTP", "CellCycle", "MYC")}
    assert len(rows("pca_gpl570")) == 90 and {r.screen for r in rows("tf_associations")} == {"train", "test"}
    assert {r.metric for r in rows("regulatory_permutation")} == {"distal_ratio", "distal_fraction"} and len(rows("regulatory_architecture")) > 20
    assert len(rows("cell_lines")) == len(spark.read.parquet(f"{tmp_path}/out/oof_transcriptome").select("line").distinct().collect()) and {r.table for r in rows("dashboard_results")} >= {"associations"}
    assert "permuted labels" in read("baseline_results") and (tmp_path / "out/reports/baseline_results.md").exists()


def test_screened_in_spark_as_in_the_task(spark):
    """cross_validate_long gives what a screen inside each task gives, raw and de-confounded."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 40))
    y = x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=60)
    group = [f"g{i % 3}" for i in range(60)]
    long = spark.createDataFrame([(f"l{i:02d}", j, float(x[i, j])) for i in range(60) for j in range(40)], "line string, f int, v double")
    target = spark.createDataFrame([(f"l{i:02d}", float(y[i]), group[i]) for i in range(60)], "line string, y double, g string")
    matrix = spark.createDataFrame([(f"l{i:02d}", x[i].tolist(), float(y[i]), group[i]) for i in range(60)], "line string, features array<double>, y double, g string")
    for deconfound in (False, True):
        a = modelling.cross_validate_long(long, target, "line", "f", "v", "y", modelling.ElasticNet, "g", deconfound, repeats=1, k=7)
        b = modelling.cross_validate(matrix, "line", "features", "y", lambda: modelling.Screened(modelling.ElasticNet(), 7), "g", deconfound, repeats=1)
        got, want = ({r.line: (r.fold, r.truth, r.pred) for r in d.collect()} for d in (a, b))
        assert got.keys() == want.keys()
        for line in want:
            assert got[line] == pytest.approx(want[line])


def test_concordance_counts_all_pairs(spark):
    from tessera.operators.stats import concordance

    rng = np.random.default_rng(7)
    y, p, e = rng.integers(0, 12, 90).astype(float), rng.integers(0, 9, 90).astype(float), rng.random(90) < 0.7
    earlier = (y[:, None] < y[None, :]) & e[:, None]
    want = (earlier & (p[:, None] < p[None, :])).sum() + 0.5 * (earlier & (p[:, None] == p[None, :])).sum()
    assert modelling.concordance(y, p, e) == pytest.approx(want / earlier.sum())
    assert np.isnan(modelling.concordance(np.ones(3), np.arange(3.0)))
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for a, b, c in zip(y, p, e)], "y double, p double, e boolean")
    got = concordance(df, "y", "p", "e").first()
    assert (got.pairs, got.concordance) == (earlier.sum(), pytest.approx(want / earlier.sum()))
    assert tuple(concordance(df.limit(0), "y", "p").first()) == (0.0, None)


def test_statistics_of_the_study():
    from tessera.operators import resampling as rs

    # a null centred away from zero counts from its own mean
    values = np.full(50, 4.0) + np.linspace(-1, 1, 50)
    c = rs.compositional_null(lambda i: values[i].mean(), 50, {"s": 10}, {"s": 3.9}, 100, 3)
    rng = np.random.default_rng(3)
    null = np.array([values[rng.choice(50, 10, replace=False)].mean() for _ in range(100)])
    assert c.loc[0, "p_empirical"] == (np.abs(null - null.mean()) >= abs(3.9 - null.mean())).mean() < 1


def test_fixed_penalty_forms_no_block_of_lines(spark, monkeypatch):
    """Folds of an ElasticNet come from sums: groups without a fold's rows, lines without a group, and few tested lines as in one task."""
    monkeypatch.setattr(modelling, "_one_fold", None)  # no task holds a fold's lines
    rng = np.random.default_rng(11)
    n = 75
    x = rng.normal(3, 1, size=(n, 6))
    y = x[:, 0] - x[:, 2] + 0.3 * rng.normal(size=n)
    group = [None if i % 25 == 7 else "solo" if i == 9 else f"g{i % 3}" for i in range(n)]
    long = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(n) for j in range(6)], "line int, f string, v double")
    target = spark.createDataFrame([(i, float(y[i]), group[i]) for i in range(n)], "line int, y double, g string")
    for deconfound, by_group in ((False, False), (True, False), (False, True)):
        got = {(r.line, r.repeat): (r.fold, r.truth, r.pred, r.alpha, r.n_train) for r in modelling.cross_validate_long(long, target, "line", "f", "v", "y", modelling.ElasticNet, "g", deconfound, repeats=2, by_group=by_group).collect()}
        want, g = {}, np.array(group, object)
        plan = modelling._fold_plan(n, g, 5, 2, 0, by_group)
        for r in range(len(plan)):
            for f in sorted(set(plan[r].tolist()) - {-1}):
                train, test, xs, ys = plan[r] != f, plan[r] == f, x, y
                if deconfound:
                    xs, ys, ok = modelling.deconfounded(x, y, g, train)
                    train, test = train & ok & np.isfinite(ys), test & ok & np.isfinite(ys)
                m = modelling.ElasticNet().fit(xs[train], ys[train])
                want |= {(str(i), r): (f, ys[i], p, m.alpha, train.sum()) for i, p in zip(np.flatnonzero(test), m.predict(xs[test]))}
        assert got.keys() == want.keys()
        for key in want:
            assert got[key] == pytest.approx(want[key], abs=1e-9)
    with pytest.raises(Exception, match="lacks a feature"):
        modelling.cross_validate_long(long.filter("line <> 3 OR f <> 'f1'"), target, "line", "f", "v", "y", modelling.ElasticNet, "g").collect()
