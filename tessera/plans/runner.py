"""The stages as commands, from files to result tables.

    python -m tessera.plans.runner tables    --data DIR --out DIR [--drug fluorouracil]
    python -m tessera.plans.runner baselines --data DIR --out DIR
    python -m tessera.plans.runner models    --data DIR --out DIR [--repeats 5]
    python -m tessera.plans.runner confounds | induction | multidrug | clinical | regulators | architecture | dashboard ...
    python -m tessera.plans.runner all       --data DIR --out DIR

--data holds train.csv and test.csv (the responses of two screens, columns of tables.RESPONSE),
models.csv (tables.MODELS), expression.csv (tables.EXPRESSION), sets/*.txt (a symbol a line) and,
optionally, aliases.csv. A stage reads what those before it wrote to --out, and raises
StageError or SourceError if that is missing. Further inputs, by stage:

    confounds     mutations.csv (tables.MUTATIONS)
    induction     counts.tsv (NAME, a column a sample), timecourse.csv (sample, hours, treatment)
    clinical      clinical/<cohort>.csv (genes x samples), clinical/covariates.csv (tables.CLINICAL)
    regulators    regulons.csv (tables.EDGES)
    architecture  peaks.csv (tables.PEAKS), tss.csv (tables.TSS), links.csv (name, gene)

`all` runs the stages whose inputs are there, and says which it left out."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.local import cut
from ..operators import components, draws, genesets, modelling, regression, relational, scoring, stats
from ..sources import sinks
from ..sources import tables as tb
from . import stages

log = logging.getLogger("tessera")


@dataclass
class Settings:
    """What a run can choose; the defaults are the study's."""

    data: str
    out: str
    drug: str = "fluorouracil"
    target: str = "AUC"
    lineage: str = "TCGA_DESC"
    number: str = "CellCycle"
    least_recovery: float | None = 80.0
    repeats: int = modelling.REPEATS
    features: int = modelling.TOP_FEATURES
    n_boot: int = 500
    model: Callable = modelling.TunedElasticNet
    draws: int = draws.NULL_DRAWS
    #: The study's driver genes, the genes of the drug's pathway, drugs compared with it, and cohorts.
    drivers: tuple[str, ...] = ("TP53", "KRAS", "BRAF", "PIK3CA", "APC", "SMAD4", "PTEN", "NRAS")
    pathway: tuple[str, ...] = ("TYMS", "DPYD", "UPP1", "UCK2", "TK1", "ABCB6")
    lineage_of_interest: str = "COREAD"
    general_least: int = stages.MIN_OVERLAP
    cohorts: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (("gpl570", ("purity",), ("cms", "msi_ntp", "study")), ("gpl6480", (), ("cms", "msi_ntp")))


SCREENS = ("train", "test")


def _read(spark: SparkSession, s: Settings, name: str) -> DataFrame:
    path = f"{s.out}/{name}"
    if not tb.exists(spark, path):
        raise stages.StageError(f"{path} is missing; run the stage that writes it first")
    return spark.read.parquet(path)


def _result(s: Settings, df: DataFrame, name: str) -> None:
    sinks.write_result(df, f"{s.out}/{name}.csv", name)
    sinks.write_report(f"{s.out.removeprefix('file://')}/reports/{name}.md", f"## {name}\n\n{sinks.markdown(df)}\n")


def tables(spark: SparkSession, s: Settings) -> None:
    """expression, y_<screen> and scores_<screen> (Parquet); agreement and recovery."""
    models = tb.csv(spark, f"{s.data}/models.csv", tb.MODELS)
    responses = {n: tb.csv(spark, f"{s.data}/{n}.csv", tb.RESPONSE).withColumn("ordinal", F.monotonically_increasing_id()) for n in SCREENS}
    ids = None
    for r in responses.values():
        own = r.filter(F.lower("DRUG_NAME").contains(s.drug.lower())).select("SANGER_MODEL_ID")
        ids = own if ids is None else ids.unionByName(own)
    raw = tb.expression(spark, f"{s.data}/expression.csv", ids.distinct())
    stages.complete(raw).write.mode("overwrite").parquet(f"{s.out}/expression")
    full = _read(spark, s, "expression")
    names = tb.aliases(spark, f"{s.data}/aliases.csv", required=False)
    sets = tb.set_files(spark, f"{s.data}/sets")
    for n, r in responses.items():
        y = stages.solid(stages.build_table(r, s.drug, models, full), s.lineage)
        y.write.mode("overwrite").parquet(f"{s.out}/y_{n}")
        own = full.join(_read(spark, s, f"y_{n}").select("model_id"), "model_id", "left_semi")
        score, recovery = stages.score_table(own, sets, names, s.least_recovery)
        score.write.mode("overwrite").parquet(f"{s.out}/scores_{n}")
        _result(s, recovery, f"recovery_{n}")
    _result(s, stages.agreement_table(_read(spark, s, "y_train"), _read(spark, s, "y_test"), s.drug, (s.target,)), "screen_agreement")


def baselines(spark: SparkSession, s: Settings) -> None:
    """baseline_results, with the leakage tripwire; associations of the scores, and their replication."""
    y = _read(spark, s, "y_train")
    one = _read(spark, s, "scores_train").filter(F.col("set") == s.number).select("model_id", F.col("score").alias(s.number))
    _result(s, stages.baselines(y.join(one, "model_id"), "model_id", s.target, [s.number], s.lineage), "baseline_results")
    per = {n: stages.associations(_read(spark, s, f"scores_{n}"), _read(spark, s, f"y_{n}"), s.target, n_boot=s.n_boot) for n in SCREENS}
    _result(s, stages.replicated(per["train"], per["test"]), "associations")


def models(spark: SparkSession, s: Settings) -> None:
    """oof_<model> (Parquet); final_model_results and model_comparisons.

    The transcriptome is screened in Spark; modules, and lineages with one number, are narrow."""
    y, score = _read(spark, s, "y_train"), _read(spark, s, "scores_train")
    full = _read(spark, s, "expression").join(y.select("model_id"), "model_id", "left_semi")
    long = ("model_id", "gene_symbol", "value", s.target, s.model)
    cv = lambda table, **more: modelling.cross_validate_long(full, table, *long, s.lineage, repeats=s.repeats, k=s.features, **more)
    big = stages.relational.in_large_groups(y, s.lineage, stages.MIN_LINEAGE_N)
    modules = stages.matrix_of(score, "model_id", "set", "score").join(y, "model_id")
    one = score.filter(F.col("set") == s.number).select("model_id", F.col("score").alias(s.number))
    runs = {
        "transcriptome": cv(y),
        "transcriptome_deconfounded": cv(big, deconfound=True),
        "leave_lineage_out": cv(big, by_group=True),
        "modules": regression.cross_validate_sums(modules, "model_id", "features", s.target, "ridge", repeats=s.repeats),
        "lineage_and_number": stages.same_split_baseline(y.join(one, "model_id"), s.target, s.lineage, s.number, repeats=s.repeats),
    }
    rows = []
    for name, oof in runs.items():
        oof.write.mode("overwrite").parquet(f"{s.out}/oof_{name}")
        runs[name] = _read(spark, s, f"oof_{name}")
        rows.append({k: None if v != v else v for k, v in modelling.summarise(runs[name], name).items()})
    within = modelling.within_groups(runs["leave_lineage_out"], y, "model_id", s.lineage, stages.MIN_LINEAGE_N).first()
    for r in rows:
        held = r["model"] == "leave_lineage_out"
        r |= {"r_within_median": within.r_within_median if held else None, "n_lineages_within": within.n_groups_within if held else None}
    kinds = "model string, r_mean double, r_lo double, r_hi double, r_sd double, rho_mean double, cindex_mean double, alpha_median double, alpha_edge_frac double, r_within_median double, n_lineages_within long"
    _result(s, spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in rows], kinds), "final_model_results")
    pairs = [("transcriptome", "lineage_and_number"), ("modules", "lineage_and_number")]
    out = None
    for a, b in pairs:
        one = stages.compare(runs[a], runs[b], a, b)
        out = one if out is None else out.unionByName(one)
    _result(s, out, "model_comparisons")


def _named_sets(spark: SparkSession, s: Settings, universe: DataFrame) -> DataFrame:
    """set, gene: the cleaned sets in the symbols of a universe, those of enough recovery only (fewer genes are no set)."""
    sets = genesets.clean_sets(tb.set_files(spark, f"{s.data}/sets"), universe)
    found = genesets.resolve_sets(sets, universe, tb.aliases(spark, f"{s.data}/aliases.csv", required=False))
    good = genesets.recovery(sets, found).filter(F.col("pct") >= (s.least_recovery or 0.0)).select("set")
    return cut(found.join(good, "set", "left_semi").select("set", "gene"))


def _ranked(long: DataFrame, sets: DataFrame, sample: str) -> tuple[DataFrame, DataFrame]:
    """(ranks, scores with DTP as up less down) of a long table (sample, gene, value)."""
    ranks = cut(scoring.rank_matrix(long, sample, "gene", "value"))
    score = scoring.background_score(ranks, sets, sample, "gene").select(sample, "set", "score")
    return ranks, cut(scoring.up_down(score, sample, "DTP_up", "DTP_down", "DTP"))


def confounds(spark: SparkSession, s: Settings) -> None:
    """driver_mutations, msi_interactions, drug_similarity, gene_target_check and specificity_check: what else could explain the associations."""
    y, score = _read(spark, s, "y_train"), _read(spark, s, "scores_train")
    responses = tb.csv(spark, f"{s.data}/train.csv", tb.RESPONSE)
    flags = relational.flag_matrix(tb.csv(spark, f"{s.data}/mutations.csv", tb.MUTATIONS), y.select("model_id"), "model_id", "gene_symbol", list(s.drivers))
    whole = stages.flag_correlations(flags, y, s.target, list(s.drivers))
    inside = stages.flag_correlations(flags, y.filter(F.col(s.lineage) == s.lineage_of_interest), s.target, list(s.drivers))
    _result(s, whole.withColumn("lines", F.lit("all")).unionByName(inside.withColumn("lines", F.lit(s.lineage_of_interest))), "driver_mutations")

    msi = y.filter("msi_status IN ('MSI', 'MSS')").withColumn("msi", (F.col("msi_status") == "MSI").cast("int"))
    out = None
    for name in sorted(r["set"] for r in score.select("set").distinct().collect()):  # a bounded list of sets
        own = msi.join(score.filter(F.col("set") == name).select("model_id", "score"), "model_id")
        for lines, table, category in ((s.lineage_of_interest, own.filter(F.col(s.lineage) == s.lineage_of_interest), None), ("all", own, s.lineage)):
            one = regression.interaction(table, s.target, "score", "msi", category).select(F.lit(name).alias("set"), F.lit(lines).alias("lines"), "*")
            out = one if out is None else out.unionByName(one)
    _result(s, out, "msi_interactions")

    all_drugs = responses.select(F.col("SANGER_MODEL_ID").alias("model_id"), F.when(F.lower("DRUG_NAME").contains(s.drug.lower()), s.drug).otherwise(F.col("DRUG_NAME")).alias("drug"), s.target)
    _result(s, relational.similarity(all_drugs, "model_id", "drug", s.target, s.drug).orderBy(F.desc("r"), "drug"), "drug_similarity")
    genes = _read(spark, s, "expression").filter(F.col("gene_symbol").isin(*s.pathway)).join(y.select("model_id", s.target), "model_id")
    _result(s, stats.pearson(genes, "value", s.target, "gene_symbol"), "gene_target_check")
    parts = stages.specific_response(all_drugs, "model_id", "drug", s.target, s.drug, s.general_least).join(y.filter(F.col(s.lineage) == s.lineage_of_interest).select("model_id"), "model_id")
    long = parts.select("model_id", F.inline(F.array(*[F.struct(F.lit(n).alias("response"), F.col(c).alias("value")) for n, c in (("raw", s.target), ("general", "general"), ("specific", "residual"))])))
    _result(s, stats.pearson(long.join(score, "model_id"), "score", "value", "set", "response"), "specificity_check")


def induction(spark: SparkSession, s: Settings) -> None:
    """induction_stats, compositional_control and cellcycle_adjusted of a treated time course."""
    samples = tb.csv(spark, f"{s.data}/timecourse.csv", "sample string, hours int, treatment string")
    of = {r["sample"]: (r["hours"], r["treatment"]) for r in samples.limit(10_000).collect()}  # a column a sample
    long = tb.counts(spark, f"{s.data}/counts.tsv", of).select(F.col("NAME").alias("gene"), "sample", "hours", F.log2(F.col("count") + 1).alias("value"))
    long = cut(long.filter("value IS NOT NULL"))
    sets = _named_sets(spark, s, long.select("gene").distinct())
    ranks, score = _ranked(long, sets, "sample")
    parts = scoring.background_score(ranks, sets.filter(F.col("set").isin("DTP_up", "DTP_down")), "sample", "gene").select("sample", "set", "score")
    score = cut(score.unionByName(parts))  # both directions by themselves as well
    hours = samples.select("sample", "hours")
    members: dict[str, list[str]] = {}
    for r in sets.orderBy("set", "gene").collect():
        members.setdefault(r["set"], []).append(r["gene"])
    got = stages.induction(score.join(hours, "sample"), ranks.join(hours, "sample"), members)
    _result(s, stages.with_trend_p(scoring.trend_stats(score.join(hours, "sample"), "set", "hours", "score")), "induction_stats")
    for name, key in (("compositional_control", "compositional"), ("cellcycle_adjusted", "adjusted")):
        if len(got[key]):
            _result(s, spark.createDataFrame(got[key]), name)


def multidrug(spark: SparkSession, s: Settings) -> None:
    """drug_targets and drug_specificity: each drug of the screen with enough lines, and whether the scores say anything of it beyond MSI and general sensitivity."""
    y, score = _read(spark, s, "y_train"), _read(spark, s, "scores_train")
    own = tb.csv(spark, f"{s.data}/train.csv", tb.RESPONSE).select(F.col("SANGER_MODEL_ID").alias("model_id"), F.col("DRUG_NAME").alias("drug"), F.col(s.target).alias("auc"))
    cells = cut(own.join(y.select("model_id", "msi_status"), "model_id").groupBy("model_id", "drug", "msi_status").agg(F.avg("auc").alias("auc")).filter("auc IS NOT NULL"))
    per = cells.groupBy("drug").agg(F.count(F.lit(1)).alias("n"), F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_sd"), *[F.avg((F.col("auc") > c).cast("double")).alias(f"share_gt_{int(100 * c)}") for c in (0.90, 0.95, 0.98)])
    per = cut(per.filter(F.col("n") >= stages.MIN_LINES))
    _result(s, per.orderBy("drug"), "drug_targets")
    # the general axis of a drug leaves the drug itself out: its sum of z over drugs, less its own
    w = "drug"
    z = cells.join(per.select(w, F.col("auc_mean").alias("_m"), F.col("auc_sd").alias("_s")), w).withColumn("_z", F.try_divide(F.col("auc") - F.col("_m"), F.nullif("_s", F.lit(0.0))))
    total = z.groupBy("model_id").agg(F.sum("_z").alias("_t"), F.count("_z").alias("_k"))
    table = z.join(total, "model_id").withColumn("general", F.try_divide(F.col("_t") - F.coalesce("_z", F.lit(0.0)), F.nullif((F.col("_k") - F.col("_z").isNotNull().cast("int")).cast("double"), F.lit(0.0))))
    names = sorted(r["set"] for r in score.select("set").distinct().collect())  # a bounded list of sets
    wide = score.groupBy("model_id").pivot("set", names).agg(F.first("score"))
    table = table.withColumn("msi", (F.col("msi_status") == "MSI").cast("int")).join(wide, "model_id")
    drugs = [r["drug"] for r in per.select("drug").orderBy("drug").limit(5000).collect()]
    _result(s, stages.specificity(table, drugs, names, "msi", "general"), "drug_specificity")


def clinical(spark: SparkSession, s: Settings) -> None:
    """clinical_validation, clinical_null and, by cohort, pca_<cohort> and scores_<cohort> (Parquet) of patients' response."""
    got = tb.clinical(spark, f"{s.data}/clinical", [c for c, _, _ in s.cohorts])
    if got is None:
        raise stages.StageError("the clinical cohorts, or their covariates, are missing")
    tables, covariates = got
    tests = null = None
    for name, controls, categories in s.cohorts:
        long = cut(relational.log2_if_linear(tables[name].withColumnRenamed("sample", "sample_id"), "value"))
        lines = cut(covariates.join(long.select("sample_id").distinct(), "sample_id", "left_semi"))
        sets = _named_sets(spark, s, long.select("gene").distinct())
        ranks, score = _ranked(long.filter("value IS NOT NULL"), sets, "sample_id")
        score.write.mode("overwrite").parquet(f"{s.out}/scores_{name}")
        names = sorted(r["set"] for r in score.select("set").distinct().collect())  # a bounded list of sets
        one = stages.clinical_tests(score, lines, names, list(controls), list(categories)).withColumn("cohort", F.lit(name))
        members: dict[str, list[str]] = {}
        for r in sets.orderBy("set", "gene").collect():
            members.setdefault(r["set"], []).append(r["gene"])
        asked = {n: [members["DTP_up"], members["DTP_down"]] if n == "DTP" else [members[n]] for n in names if n == "DTP" or n in members}
        two = stages.clinical_null(ranks, lines, asked, list(controls), list(categories), n_draws=s.draws).withColumn("cohort", F.lit(name))
        tests, null = (one, two) if tests is None else (tests.unionByName(one), null.unionByName(two))
        scores, share = components.pca(long, "sample_id", "gene", "value")
        _result(s, scores.join(lines.select("sample_id", "study"), "sample_id", "left").withColumn("share_1", F.lit(float(share[0]))).withColumn("share_2", F.lit(float(share[1]))), f"pca_{name}")
    _result(s, tests, "clinical_validation")
    _result(s, null, "clinical_null")


def regulators(spark: SparkSession, s: Settings) -> None:
    """tf_associations: inferred activities of regulators against the response, in both screens."""
    edges, _ = tb.regulons(spark, f"{s.data}/regulons.csv", "regulons")
    long = _read(spark, s, "expression").select("model_id", F.col("gene_symbol").alias("gene"), F.col("value").cast("double").alias("value"))
    activity = cut(scoring.ulm_activity(long, edges.withColumnRenamed("target", "gene"), "model_id", "gene", "value"))
    out = None
    for n in SCREENS:
        one = stages.tf_associations(activity, _read(spark, s, f"y_{n}"), s.target, [], "model_id").withColumn("screen", F.lit(n))
        out = one if out is None else out.unionByName(one)
    _result(s, out, "tf_associations")


def architecture(spark: SparkSession, s: Settings) -> None:
    """regulatory_architecture (counts of regions a gene) and regulatory_permutation: each set against genes of like expression and length."""
    peaks = tb.csv(spark, f"{s.data}/peaks.csv", tb.PEAKS).withColumnRenamed("seqnames", "chrom")
    tss = tb.csv(spark, f"{s.data}/tss.csv", tb.TSS)
    links = tb.csv(spark, f"{s.data}/links.csv", "name string, gene string").coalesce(1).withColumn("ordinal", F.monotonically_increasing_id())
    counts = cut(stages.architecture(peaks, tss, links))
    _result(s, counts, "regulatory_architecture")
    level = _read(spark, s, "expression").groupBy(F.col("gene_symbol").alias("gene")).agg(F.avg(F.col("value").cast("double")).alias("expr"))
    lengths = tss.filter("gene_length > 0").groupBy(F.col("symbol").alias("gene")).agg(F.max("gene_length").alias("length"))
    table = cut(counts.withColumnRenamed("symbol", "gene").join(level, "gene").join(lengths, "gene"))
    sets, out = _named_sets(spark, s, level.select("gene")), None
    for metric in ("distal_ratio", "distal_fraction"):
        one = stages.matched_shift(table, sets, metric)
        out = one if out is None else out.unionByName(one)
    _result(s, out, "regulatory_permutation")


def dashboard(spark: SparkSession, s: Settings) -> None:
    """cell_lines (calibrated predictions with metadata) and model_results under one schema."""
    oof, y = _read(spark, s, "oof_transcriptome"), _read(spark, s, "y_train")
    c = stages.calibrate(oof.groupBy("line").agg(F.first("truth").alias("truth"), F.avg("pred").alias("pred")), "truth", "pred", "line")
    meta = y.select(F.col("model_id").alias("line"), s.lineage, "model_name", "msi_status")
    _result(s, stages.dashboard_lines(oof, meta, c["a"], c["b"]), "cell_lines")
    tables = {n: spark.read.option("header", True).option("inferSchema", True).csv(f"{s.out}/{n}.csv") for n in ("final_model_results", "baseline_results", "associations") if tb.exists(spark, f"{s.out}/{n}.csv")}
    _result(s, stages.dashboard_results(tables), "dashboard_results")


STAGES = {"tables": tables, "baselines": baselines, "models": models, "confounds": confounds, "induction": induction, "multidrug": multidrug, "clinical": clinical, "regulators": regulators, "architecture": architecture, "dashboard": dashboard}
#: What a stage needs beside the screens.
INPUTS = {"confounds": ["mutations.csv"], "induction": ["counts.tsv", "timecourse.csv"], "clinical": ["clinical/covariates.csv"], "regulators": ["regulons.csv"], "architecture": ["peaks.csv", "tss.csv", "links.csv"]}


def run(spark: SparkSession, name: str, s: Settings) -> list[str]:
    """One stage, or all in order whose inputs are there; the first that fails stops the run. What ran."""
    done = []
    for stage in STAGES if name == "all" else [name]:
        lost = [f for f in INPUTS.get(stage, []) if not tb.exists(spark, f"{s.data}/{f}")]
        if lost and name == "all":
            log.warning("stage %s left out: no %s", stage, ", ".join(lost))
            continue
        log.info("stage %s", stage)
        STAGES[stage](spark, s)
        done.append(stage)
    return done


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("stage", choices=[*STAGES, "all"])
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--drug", default=Settings.drug)
    p.add_argument("--repeats", type=int, default=Settings.repeats)
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    run(spark, a.stage, Settings(a.data, a.out, drug=a.drug, repeats=a.repeats))


if __name__ == "__main__":
    main()
