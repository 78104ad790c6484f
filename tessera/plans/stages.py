"""The stage pipelines: long tables in, result DataFrames (or small result frames) out.

Names of columns, groups and thresholds are parameters, with the study's values as
defaults. Lazy DataFrames stay lazy; cohorts (hundreds of lines) are brought to numpy
only where a solver or a resampling kernel needs them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.local import cut, to_local
from ..functions.multiplicity import bh_q
from ..functions.nulls import not_in, safe_corr
from ..functions.ranks import bin_edges, keep_first, value_bin
from ..functions.special import normal_two_sided, pearson_p, rank_average
from ..operators import draws, genesets, genomics, modelling, regression, relational, resampling, scoring, set_tests, stats
from ..operators.adjustment import batch_adjusted  # noqa: F401  a stage of its own

#: Blood lineages that solid cohorts leave out, and stage thresholds.
HAEM = ["ALL", "CLL", "DLBC", "LAML", "LCML", "MM"]
MIN_LINEAGE_N, MAX_MISSING, MIN_OVERLAP, MIN_LINES = 10, 0.2, 300, 30


class StageError(ValueError):
    """A stage's own check failed; results must not be used."""


# ---------------------------------------------------------------- L1 tables and scores


def build_table(responses: DataFrame, drug: str, models: DataFrame, expression: DataFrame, order: str = "ordinal") -> DataFrame:
    """The response table of a drug: first row of each line, with metadata, for lines that have
    expression, and whether the IC50 lies above the highest dose; row_ix in order of line."""
    rows = keep_first(relational.contains(responses, "DRUG_NAME", drug), ["SANGER_MODEL_ID"], [F.asc(order)])
    rows = rows.withColumnRenamed("SANGER_MODEL_ID", "model_id").join(expression.select("model_id").distinct(), "model_id", "left_semi")
    rows = relational.with_metadata(rows, models.withColumn("_o", F.lit(0)), "model_id", [F.asc("_o"), F.asc("model_name")]).drop("_o")
    return rows.withColumn("ic50_extrapolated", relational.beyond_range("LN_IC50", "MAX_CONC")).withColumn("row_ix", F.row_number().over(W.orderBy("model_id")) - 1)


def complete(expression: DataFrame, most: float = MAX_MISSING) -> DataFrame:
    """Expression of genes missing in at most a share of the models, medians in the gaps."""
    good = relational.missing_filter(expression, "model_id", "gene_symbol", "value", most)
    return relational.median_fill(expression.join(good.select("gene_symbol"), "gene_symbol", "left_semi"), "model_id", "gene_symbol", "value")


def score_table(expression: DataFrame, raw_sets: DataFrame, aliases: DataFrame, least: float | None = 80.0, up: str = "DTP_up", down: str = "DTP_down", both: str = "DTP", method: str = "background") -> tuple[DataFrame, DataFrame]:
    """(model_id, set, score; recovery): sets cleaned and resolved, recovery required, up - down."""
    long = expression.select("model_id", F.col("gene_symbol").alias("gene"), "value")
    universe = long.select("gene").distinct()
    sets = genesets.clean_sets(raw_sets, universe)
    found = genesets.resolve_sets(sets, universe, aliases)
    table = genesets.recovery(sets, found)
    genesets.require_recovery(table, least)
    ranks = scoring.rank_matrix(long, "model_id", "gene", "value")
    score = (scoring.background_score if method == "background" else scoring.ssgsea)(ranks, found.select("set", "gene"), "model_id", "gene")
    return scoring.up_down(score.select("model_id", "set", "score"), "model_id", up, down, both), table


def agreement_table(a: DataFrame, b: DataFrame, drug: str, values: tuple[str, ...] = ("AUC", "LN_IC50"), key: str = "model_id", lines: DataFrame | None = None) -> DataFrame:
    """drug, target, n, r, p, rho of two screens: the ceiling of any model."""
    out = [stats.screen_agreement(a, b, key, v, lines).withColumn("drug", F.lit(drug)).withColumn("target", F.lit(v)) for v in values]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def solid(table: DataFrame, lineage: str = "TCGA_DESC") -> DataFrame:
    return table.filter(not_in(lineage, HAEM))


# ---------------------------------------------------------------- L2, L3 baselines and models


def matrix_of(long: DataFrame, sample: str, feature: str, value: str, names: DataFrame | None = None) -> DataFrame:
    """sample, features: one array a sample, in the order of the feature names."""
    cells = long if names is None else long.join(names.select(feature).distinct(), feature, "left_semi")
    return cells.groupBy(sample).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(feature).alias("f"), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("features"))


def baselines(table: DataFrame, line: str, y: str, numeric: list[str], category: str, folds: int = 5, seed: int = 0, stop: bool = False) -> DataFrame:
    """baseline, pearson_r, r2, rmse, n, leak: ridge on each number, on the category, on both, and on permuted
    labels: the leakage tripwire, which can stop the run. `leak` is of that row only."""
    out = cut(regression.baselines(table, line, y, numeric, category, modelling.RIDGE_ALPHAS, folds, seed))
    r = out.filter("baseline = 'permuted labels'").first().pearson_r
    leak = modelling.tripwire(0.0 if r is None else r, stop)
    return out.withColumn("leak", F.when(F.col("baseline") == "permuted labels", F.lit(leak)))


def final_models(matrix: DataFrame, y: str, lineage: str, line: str = "model_id", repeats: int = modelling.REPEATS, factory=modelling.transcriptome_model) -> tuple[pd.DataFrame, dict[str, DataFrame]]:
    """Raw and de-confounded cross-validation, and leave-one-lineage-out: (summary, out-of-fold tables).

    The last has the median r within held-out lineages as well: its pooled r rewards their averages."""
    big = relational.in_large_groups(matrix, lineage, MIN_LINEAGE_N)
    runs = {
        "raw": modelling.cross_validate(matrix, line, "features", y, factory, repeats=repeats),
        "deconfounded": modelling.cross_validate(big, line, "features", y, factory, lineage, True, repeats=repeats),
        "leave-lineage-out": modelling.cross_validate(big, line, "features", y, factory, lineage, by_group=True),
    }
    runs = {k: v.persist() for k, v in runs.items()}
    within = modelling.within_groups(runs["leave-lineage-out"], matrix, line, lineage, MIN_LINEAGE_N).first()
    rows = [modelling.summarise(v, k) for k, v in runs.items()]
    rows[-1] |= {"r_within_median": within.r_within_median, "n_lineages_within": within.n_groups_within}
    return pd.DataFrame(rows), runs


def same_split_baseline(table: DataFrame, y: str, lineage: str, number: str, line: str = "model_id", repeats: int = modelling.REPEATS, seed: int = 0) -> DataFrame:
    """Out-of-fold predictions of ridge on all lineages (as 0/1 columns) and one number, on the folds
    of cross_validate over the same lines: what a model has to beat, split by split (compare)."""
    known = table.withColumn("_l", F.coalesce(F.col(lineage), F.lit("UNKNOWN")))
    names = [r["_l"] for r in known.select("_l").distinct().orderBy("_l").limit(1000).collect()]
    columns = [*[(F.col("_l") == n).cast("double") for n in names], F.col(number).cast("double")]
    return regression.cross_validate_sums(known.withColumn("features", F.array(*columns)), line, "features", y, "ridge", repeats=repeats, seed=seed)


def compare(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """model_a, model_b, n_splits, mean_diff, t, p of two models on the same splits."""
    d = stats.difference_by_split(a, b)
    n_train = a.dropDuplicates(["repeat", "fold"]).agg(F.avg("n_train")).first()[0]
    n_test = a.groupBy("repeat", "fold").count().agg(F.avg("count")).first()[0]
    return stats.corrected_ttest(d, "diff", n_train, n_test).select(F.lit(name_a).alias("model_a"), F.lit(name_b).alias("model_b"), "*")


def transfer(matrix: DataFrame, y: str, lineage: str, target: str, factory=modelling.fixed_model, line: str = "model_id", n_boot: int = resampling.BOOT) -> dict:
    """Fit on every other lineage, tested on one: n, r, p, lo, hi."""
    t, pred, _ = _transferred(matrix, y, lineage, target, factory, line)
    r, p, lo, hi = resampling.bootstrap_r(t, pred, n_boot)
    return {"n": len(t), "r": r, "p": p, "lo": lo, "hi": hi}


def _transferred(matrix: DataFrame, y: str, lineage: str, target: str, factory, line: str) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    rows = matrix.select(line, lineage, "features", y).dropna(subset=[y])
    width = rows.agg(F.max(F.size("features"))).first()[0] or 1
    pdf = to_local(rows, "the lines of a transfer", width).sort_values(line, kind="stable")
    x, t, own = np.stack(pdf["features"]).astype(float), pdf[y].to_numpy(float), (pdf[lineage] == target).to_numpy()
    return t[own], factory().fit(x[~own], t[~own]).predict(x[own]), pdf.loc[own, [line]]


def transfer_comparison(matrix: DataFrame, modules: DataFrame, y: str, lineage: str, target: str, factory=modelling.transcriptome_model, line: str = "model_id", repeats: int = modelling.REPEATS, n_boot: int = resampling.BOOT) -> pd.DataFrame:
    """Three ways to one lineage, one row each: (a) ridge on the modules of its own lines, cross-
    validated; (b) a model of every other lineage, applied; (c) the modules with (b)'s prediction
    as one more feature, cross-validated.

    modules: line and `features`, the module scores."""
    truth, pred, lines = _transferred(matrix, y, lineage, target, factory, line)
    spark = matrix.sparkSession
    kind = matrix.schema[line].dataType.simpleString()
    given = spark.createDataFrame(list(zip(lines[line].tolist(), truth.tolist(), pred.tolist(), strict=True)), f"{line} {kind}, {y} double, _pan double")
    own = modules.select(line, "features").join(F.broadcast(given), line)  # the lines of one lineage
    more = own.withColumn("features", F.concat("features", F.array("_pan")))
    a, c = (modelling.summarise(regression.cross_validate_sums(m, line, "features", y, "ridge", repeats=repeats), n) for m, n in ((own, "modules, own lines"), (more, "modules and transfer")))
    draws = resampling.bootstrap_draws(truth, pred, n_boot)
    r, p, lo, hi = resampling.bootstrap_r(truth, pred, n_boot)
    b = {"model": "transfer", "r_mean": r, "r_lo": lo, "r_hi": hi, "r_sd": float(np.nanstd(draws)), "p": p, "cindex_mean": modelling.concordance(truth, pred)}
    b["rho_mean"] = float(resampling.row_r(rank_average(truth)[None], rank_average(pred)[None])[0])
    return pd.DataFrame([a, b, c])


def bands_of(oof: DataFrame, edges: tuple[float, float] = (0.90, 0.95)) -> DataFrame:
    """band, n, r of predictions by response band (bands of over ten lines)."""
    band = F.when(F.col("truth") <= edges[0], "responsive").when(F.col("truth") <= edges[1], "middle").otherwise("ceiling")
    per = oof.groupBy("line").agg(F.first("truth").alias("truth"), F.avg("pred").alias("pred")).withColumn("band", band)
    return per.groupBy("band").agg(F.count(F.lit(1)).alias("n"), safe_corr("truth", "pred").alias("r")).filter("n > 10")


def associations(scores: DataFrame, target: DataFrame, y: str, sample: str = "model_id", n_boot: int = resampling.BOOT) -> DataFrame:
    """set, n, r, p, lo, hi, q of each score with a response (bootstrap interval)."""
    rows = scores.join(target.select(sample, y), sample)
    return draws.bootstrap_r(rows, "score", y, sample, ["set"], n_boot).withColumn("_f", F.lit(0)).withColumn("q", bh_q("p", "_f")).drop("_f")


def replicated(a: DataFrame, b: DataFrame, key: str = "set") -> DataFrame:
    """Both screens' associations side by side: same_sign, ci_overlap."""
    j = relational.outer_named(a, b, key, ("gdsc1", "gdsc2"))
    overlap = (F.greatest("lo_gdsc1", "lo_gdsc2") <= F.least("hi_gdsc1", "hi_gdsc2"))
    return j.withColumn("same_sign", F.signum("r_gdsc1") == F.signum("r_gdsc2")).withColumn("ci_overlap", overlap)


# ---------------------------------------------------------------- L4, L5 enrichment and calibration


def directed_enrichment(coefficients: DataFrame, sets: DataFrame, universe: DataFrame) -> DataFrame:
    """Overlap of non-zero coefficients (gene, coef) with each set, and the direction test of its coefficients."""
    base = stats.enrichment(coefficients, sets, universe, "gene")
    own = sets.select("set", "gene").join(coefficients.select("gene"), "gene", "left_semi")
    extra = set_tests.signed_set_test(coefficients, own, "gene", "coef").select("set", *[F.col(a).alias(b) for a, b in (("n", "coef_n"), ("n_positive", "coef_n_resistance"), ("p_sign", "coef_p_sign"), ("mean_value", "coef_mean"), ("p_rank", "coef_p_rank"))])
    return base.join(extra, "set", "left")


def calibrate(pred: DataFrame, truth: str, value: str, key: str, seed: int = 0) -> dict:
    """Slope and intercept fitted on a seeded half of the lines, and the metrics on the other half
    before and after."""
    pdf = to_local(pred.select(key, truth, value).dropna(), "the lines of a calibration").sort_values(key, kind="stable")
    half = np.zeros(len(pdf), bool)
    half[np.random.default_rng(seed).permutation(len(pdf))[: len(pdf) // 2]] = True
    x, y = pdf[value].to_numpy(float), pdf[truth].to_numpy(float)
    a, b = np.polyfit(x[half], y[half], 1) if half.sum() > 1 else (math.nan, math.nan)
    def row(p):
        return {"r": float(resampling.row_r(p[None], y[~half][None])[0]), "rmse": float(np.sqrt(((y[~half] - p) ** 2).mean())), "bias": float((p - y[~half]).mean())}
    return {"a": float(a), "b": float(b), "n_fit": int(half.sum()), "raw": row(x[~half]), "calibrated": row(a * x[~half] + b)}


# ---------------------------------------------------------------- L6, L7, L8 confounds


def flag_correlations(flags: DataFrame, target: DataFrame, y: str, names: list[str], key: str = "model_id") -> DataFrame:
    """gene, n, n_mutant, r, p of each 0/1 flag with a response."""
    rows = flags.join(target.select(key, y), key).select(y, F.inline(F.array(*[F.struct(F.lit(n).alias("gene"), F.col(f"`{n}`").cast("double").alias("flag")) for n in names if n in flags.columns])))
    n = rows.filter(F.col(y).isNotNull()).groupBy("gene").agg(F.sum("flag").cast("long").alias("n_mutant"))
    return stats.pearson(rows, "flag", y, "gene").join(n, "gene")


def interaction(table: DataFrame, y: str, score: str, flag: str, category: str | None = None) -> dict:
    """Least squares of y ~ score * flag (+ category): the interaction's coefficient, interval and p."""
    return regression.interaction(table, y, score, flag, category).first().asDict()


def by_stratum(table: DataFrame, x: str, y: str, stratum: str) -> DataFrame:
    """stratum, n, r, p, lo, hi within each stratum (Fisher interval)."""
    g = stats.pearson(table.filter(F.col(stratum).isNotNull()), x, y, stratum)
    lo, hi = stats.fisher_ci("r", "n")
    return g.select("*", lo.alias("lo"), hi.alias("hi"))


def specific_response(long: DataFrame, line: str, item: str, value: str, focal: str, least: int = MIN_OVERLAP) -> DataFrame:
    """line, value, general, residual: a drug's response less its fit on the general axis."""
    axis = relational.general_axis(long, line, item, value, focal, least)
    own = long.filter(F.col(item) == focal).groupBy(line).agg(F.avg(value).alias(value))
    return stats.residual_axis(own.join(axis, line), value, "general")


# ---------------------------------------------------------------- L9 induction


def induction(scores: DataFrame, ranks: DataFrame, sets: dict[str, list[str]], hours: str = "hours", adjust: str = "CellCycle", draws: int = 200, seed: int = 0) -> dict[str, pd.DataFrame]:
    """Trends of each score over time, its trend against random sets scored the same way, and
    adjusted for one score.

    A dozen samples: the rank matrix is small, the draws run on it in numpy."""
    trend = to_local(scoring.trend_stats(scores, "set", hours, "score"), "trends")
    cells = ranks.groupBy("sample", hours, "gene").agg(F.first("p").alias("p"))
    wide = to_local(cells, "the ranks of a time course").pivot(index=["sample", hours], columns="gene", values="p").sort_index()
    genes, h = list(wide.columns), wide.index.get_level_values(hours).to_numpy(float)
    m = wide.to_numpy(float)
    at = {g: i for i, g in enumerate(genes)}
    mean, var = np.nanmean(m, axis=1), np.nanvar(m, axis=1, ddof=1)

    def r_of(index: np.ndarray) -> float:
        """r with time of the background score of these genes: (mean rank - mean) / standard error."""
        n, k = m.shape[1], len(index)
        se = np.sqrt(var / k * (n - k) / (n - 1))
        with np.errstate(all="ignore"):
            score = np.where(se > 0, (m[:, index].mean(axis=1) - mean) / se, np.nan)
        return float(resampling.row_r(score[None], h[None])[0])

    own = {s: np.array([at[g] for g in gs if g in at], int) for s, gs in sets.items()}
    own = {s: i for s, i in own.items() if len(i)}
    null = resampling.compositional_null(r_of, len(genes), {s: len(i) for s, i in own.items()}, {s: r_of(i) for s, i in own.items()}, draws, seed)
    pivot = scores.groupBy("sample", hours).pivot("set").agg(F.first("score"))
    rows = []
    for s in own:
        if s != adjust and adjust in own:
            r = stats.partial_corr(pivot, f"`{s}`" if not s.isidentifier() else s, hours, [adjust]).first()
            rows.append({"feature": s, "r_adjusted": r.r, "p_adjusted": r.p})
    return {"trend": trend, "compositional": null, "adjusted": pd.DataFrame(rows)}


def cross_arm(resistance: DataFrame, trend: DataFrame, above: float = 0.2) -> DataFrame:
    """feature, r_resistance (across lines), r_induction (over time), both_positive.

    resistance: set, r; trend: set, trend_r."""
    j = resistance.select(F.col("set").alias("feature"), F.col("r").alias("r_resistance")).join(trend.select(F.col("set").alias("feature"), F.col("trend_r").alias("r_induction")), "feature")
    return j.withColumn("both_positive", F.coalesce((F.col("r_resistance") > above) & (F.col("r_induction") > above), F.lit(False)))


def low_recovery(recovery: DataFrame, features: list[str], parts: dict[str, tuple[str, ...]], least: float = 80.0) -> DataFrame:
    """feature, low_recovery: whether a feature, or any of the sets it is made of, has under `least`
    percent of its genes. recovery: set, pct."""
    rows = [(f, s) for f in features for s in parts.get(f, (f,))]
    of = recovery.sparkSession.createDataFrame(rows, "feature string, `set` string")
    low = F.coalesce(F.max(F.col("pct") < least), F.lit(False))
    return of.join(recovery.select("set", "pct"), "set", "left").groupBy("feature").agg(low.alias("low_recovery"))


def shared_gene_readout(ranks: DataFrame, sets: DataFrame, a: str, b: str, sample: str = "sample", lines: DataFrame | None = None) -> dict:
    """How much of two scores' correlation comes from shared genes: n_shared, pct of the smaller set,
    r of the full and of the trimmed sets over samples (all, or the given ones)."""
    own = sets.filter(F.col("set").isin(a, b)).select("set", "gene").distinct()
    n = {r["set"]: r["count"] for r in own.groupBy("set").count().collect()}
    both = own.groupBy("gene").agg(F.count(F.lit(1)).alias("k")).filter("k = 2").select("gene")
    shared = both.count()
    out = {"a": a, "b": b, "n_shared": shared, "pct": 100 * shared / min(n.get(a, 0), n.get(b, 0)) if a in n and b in n else math.nan}
    for name, s in (("full", own), ("trimmed", own.join(both, "gene", "left_anti"))):
        score = scoring.background_score(ranks, s, sample, "gene")
        wide = score.groupBy(sample).pivot("set", [a, b]).agg(F.first("score"))
        wide = wide if lines is None else wide.join(lines.select(sample).distinct(), sample, "left_semi")
        out[f"r_{name}"] = wide.agg(safe_corr(F.col(f"`{a}`"), F.col(f"`{b}`"))).first()[0]
    return out


def odds_text(row: dict) -> str:
    """One association in a line of a report, with its flag for low recovery."""
    if row["status"] != "ok":
        return f"n={row['n']}, {row['status']}"
    mark = ("*" if row["p"] < 0.05 else "") + ("  **LOW RECOVERY**" if row.get("low_recovery") else "")
    return f"n={row['n']}, OR/SD={row['OR_per_SD']:.2f} (95% CI {row['OR_CI95_lo']:.2f}-{row['OR_CI95_hi']:.2f}), p={row['p']:.3f}{mark}"


# ---------------------------------------------------------------- L10, L11, L12 several drugs


def drug_targets(responses: DataFrame, drug: str, order: str = "ordinal", least: int = MIN_LINES, min_agreement: float = 0.3) -> tuple[DataFrame, dict]:
    """One row a line of a drug under all its ids, and its quality; ids that disagree, or too few
    lines, raise StageError."""
    rows = responses.filter(F.col("DRUG_NAME") == drug)
    ids = sorted(r[0] for r in rows.select("DRUG_ID").distinct().collect() if r[0] is not None)
    worst = None
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = (rows.filter(F.col("DRUG_ID") == k).groupBy("SANGER_MODEL_ID").agg(F.avg("AUC").alias("AUC")) for k in (a, b))
            got = stats.screen_agreement(x, y, "SANGER_MODEL_ID", "AUC").first()
            if got.r is not None:
                worst = got.r if worst is None else min(worst, got.r)
    if worst is not None and worst < min_agreement:
        raise StageError(f"the ids of {drug} disagree: r = {worst:.2f}")
    out = relational.collapse_drug(rows, "SANGER_MODEL_ID", ["CELL_LINE_NAME", "TCGA_DESC"], ["LN_IC50", "AUC", "RMSE", "Z_SCORE", "MIN_CONC", "MAX_CONC"], order)
    out = out.withColumn("ic50_extrapolated", relational.beyond_range("LN_IC50", "MAX_CONC"))
    over = [F.avg((F.col("AUC") > c).cast("double")).alias(f"o{i}") for i, c in enumerate((0.90, 0.95, 0.98))]
    q = out.agg(F.count(F.lit(1)).alias("n"), F.avg("AUC").alias("m"), F.stddev_samp("AUC").alias("s"), F.avg(F.col("ic50_extrapolated").cast("double")).alias("x"), *over).first()
    if q.n < least:
        raise StageError(f"{drug} has {q.n} lines")
    return out, {"drug": drug, "drug_ids": ids, "id_agreement_r": worst, "n": q.n, "auc_mean": q.m, "auc_sd": q.s, "pct_extrapolated": 100 * q.x, "pct_auc_gt_090": 100 * q.o0, "pct_auc_gt_095": 100 * q.o1, "pct_auc_gt_098": 100 * q.o2}


def specificity(table: DataFrame, drugs: list[str], modules: list[str], msi: str, general: str, least: int = 15) -> DataFrame:
    """drug, module, n, and r, p, q raw and adjusted for MSI, the general axis, and both: raw, msi_adj, general_adj, both_adj.

    table: one row a (drug, line) with `drug`, `auc`, the modules and both controls. One aggregation: the correlations
    of four columns by (drug, module); partial ones follow from them, a constant control adjusting nothing."""
    own = table.filter(F.col("drug").isin(drugs)).dropna(subset=["auc", msi, general])
    n = own.groupBy("drug").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    cells = own.select("drug", F.col("auc").alias("_y"), F.col(msi).cast("double").alias("_m"), F.col(general).cast("double").alias("_g"), F.inline(F.array(*[F.struct(F.lit(m).alias("module"), F.col(f"`{m}`").cast("double").alias("_x")) for m in modules])))
    pairs = {a + b: safe_corr(f"_{a}", f"_{b}") for a, b in ("xy", "xm", "ym", "xg", "yg", "mg")}
    per = cells.filter("_x IS NOT NULL").groupBy("drug", "module").agg(F.count(F.lit(1)).alias("_k"), *[c.alias(k) for k, c in pairs.items()])
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))

    def partial(xy, xz, yz):
        return F.try_divide(xy - xz * yz, F.nullif(F.sqrt(F.greatest((1 - xz * xz) * (1 - yz * yz), F.lit(0.0))), F.lit(0.0)))

    xy_m = partial(F.col("xy"), known("xm"), known("ym"))
    xg_m, yg_m = partial(known("xg"), known("xm"), known("mg")), partial(known("yg"), known("ym"), known("mg"))
    r = {"raw": F.col("xy"), "msi_adj": xy_m, "general_adj": partial(F.col("xy"), known("xg"), known("yg")), "both_adj": partial(xy_m, F.coalesce(xg_m, F.lit(0.0)), F.coalesce(yg_m, F.lit(0.0)))}
    out = per.join(n, "drug").select("drug", "module", "n", F.lit(0).alias("_f"), *[c.alias(f"r_{k}") for k, c in r.items()], *[stats.pearson_p_udf(c, F.col("_k").cast("double")).alias(f"p_{k}") for k, c in r.items()])
    for k in r:
        out = out.withColumn(f"q_{k}", bh_q(f"p_{k}", "_f"))
    return out.drop("_f")


def adjusted(p: np.ndarray) -> np.ndarray:
    """Step-up q of a small array; missing p are passed over."""
    q, ok = np.full(len(p), np.nan), np.flatnonzero(np.isfinite(p))
    order = ok[np.argsort(p[ok], kind="stable")]
    q[order] = np.minimum(1, np.minimum.accumulate((p[order] * len(ok) / np.arange(1, len(ok) + 1))[::-1])[::-1])
    return q


def outcome(significant: int) -> str:
    """general for three drugs or more, specific for one at most."""
    return "general" if significant >= 3 else "specific" if significant <= 1 else "mixed"


def regimen(a: DataFrame, b: DataFrame, line: str = "line") -> DataFrame:
    """line, score: the mean of two drugs' standardised out-of-fold predictions."""
    def z(df: DataFrame, n: str) -> DataFrame:
        own = df.groupBy(line).agg(F.avg("pred").alias("p"))
        m = own.agg(F.avg("p").alias("_m"), F.stddev_samp("p").alias("_s"))  # one row
        return own.crossJoin(F.broadcast(m)).select(line, F.try_divide(F.col("p") - F.col("_m"), F.nullif("_s", F.lit(0.0))).alias(n))

    return z(a, "za").join(z(b, "zb"), line).withColumn("score", (F.col("za") + F.col("zb")) / 2)


# ---------------------------------------------------------------- L13 clinical cohorts


def clinical_tests(scores: DataFrame, covariates: DataFrame, modules: list[str], adjust: list[str], categories: list[str], sample: str = "sample_id") -> DataFrame:
    """feature, model (unadjusted / adjusted), n, coef, OR_per_SD and its 95 % interval, p, q, status, rounds of the response on
    each module's score, standardised over the cohort."""
    own = scores.filter(F.col("set").isin(modules))
    fits = [regression.logistic(own, covariates, "response", *more, sample, "set", "score").withColumn("model", F.lit(name)) for name, more in (("unadjusted", ((), ())), ("adjusted", (adjust, categories)))]
    out = fits[0].unionByName(fits[1]).withColumnsRenamed({"set": "feature", "odds": "OR_per_SD", "lo": "OR_CI95_lo", "hi": "OR_CI95_hi"})
    return out.withColumn("q", bh_q("p", "model"))


def clinical_null(ranks: DataFrame, covariates: DataFrame, sets: dict[str, list[list]], adjust: list[str], categories: list[str], sample: str = "sample_id", gene: str = "gene", n_draws: int = draws.NULL_DRAWS, seed: int = 0) -> DataFrame:
    """feature, z, p_random, n_valid of each feature's genes ([set], or [up, down]) against random genes in the adjusted model."""
    out = None
    for name, own in sets.items():
        one = draws.random_set_null(ranks, covariates, "response", own, adjust, categories, sample, gene, draws=n_draws, seed=seed).select(F.lit(name).alias("feature"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- L14 to L17 methylation


def methylation(long: DataFrame, annotation: DataFrame, regions: list[str], cross_reactive: DataFrame, snp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gene, sample, beta, m over the probes of the regions; probe filter counts).

    long: probe, sample, beta, pval; annotation: probe, chr, gene, region (';' lists)."""
    kept, n = genomics.keep_probes(annotation, "probe", cross_reactive, snp, "chr")
    pairs = genomics.explode_lists(kept, ["probe"], "gene", "region", distinct=True).filter(F.col("region").isin(regions))
    rows = long.withColumn("beta", genomics.mask_detection("beta", "pval")).groupBy("probe", "sample").agg(F.avg("beta").alias("beta"))
    return genomics.gene_means(rows, pairs, "probe", "gene", "sample", "beta").withColumn("m", genomics.m_value("beta")), n


def require_overlap(a: DataFrame, b: DataFrame, key: str, least: int = MIN_OVERLAP) -> int:
    n = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").count()
    if n < least:
        raise StageError(f"only {n} lines in common")
    return n


def msi_adjustment(table: DataFrame, score: str, y: str, msi: str, mlh1: str) -> dict:
    """r of a score with a response raw, and given MSI, MLH1 methylation, and both; MLH1
    must follow MSI first (or ValueError)."""
    gate = stats.point_biserial_gate(table, msi, mlh1).first()
    out = {"r_MSI_vs_MLH1_M": gate.r, "p_MSI_vs_MLH1_M": gate.p, "n": gate.n}
    full = table.withColumn("_msi", F.col(msi).cast("double")).dropna(subset=[score, y, "_msi", mlh1])
    for name, c in (("unadjusted", []), ("adj_binary_MSI", ["_msi"]), ("adj_MLH1_methylation", [mlh1]), ("adj_both", ["_msi", mlh1])):
        r = stats.partial_corr(full, score, y, c).first()
        out |= {f"r_{name}": r.r, f"p_{name}": r.p}
    return out


def multi_view(expression: DataFrame, methyl: DataFrame, y: str, line: str, factory=modelling.transcriptome_model, repeats: int = modelling.REPEATS) -> dict[str, DataFrame]:
    """Out-of-fold tables of both views and their late fusion, on the same lines and folds."""
    both = methyl.select(F.col(line), F.col("features").alias("_m"))
    rows = expression.join(both, line)
    e = modelling.cross_validate(rows, line, "features", y, factory, repeats=repeats).persist()
    m = modelling.cross_validate(rows.drop("features").withColumnRenamed("_m", "features"), line, "features", y, factory, repeats=repeats).persist()
    return {"expression": e, "methylation": m, "fusion": modelling.late_fusion(e, m)}


def context_correlations(strata: dict[str, DataFrame], expression_score: DataFrame, target: DataFrame, y: str, sample: str = "sample") -> DataFrame:
    """stratum, n, r with the expression score and with the response, q over strata."""
    rows = None
    for name, s in strata.items():
        j = s.select(sample, F.col("score").alias("meth")).join(expression_score.select(sample, F.col("score").alias("expr")), sample).join(target.select(sample, y), sample)
        one = j.agg(F.count(F.lit(1)).alias("n"), safe_corr("meth", "expr").alias("r_meth_vs_expr"), safe_corr("meth", y).alias("r_meth_vs_auc")).withColumn("stratum", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    for c in ("expr", "auc"):
        rows = rows.withColumn(f"p_meth_vs_{c}", stats.pearson_p_udf(F.col(f"r_meth_vs_{c}"), F.col("n").cast("double")))
        rows = rows.withColumn("_f", F.lit(0)).withColumn(f"q_meth_vs_{c}", bh_q(f"p_meth_vs_{c}", "_f")).drop("_f")
    return rows


def replicated_strata(table: DataFrame, q: str, below: float = 0.05) -> DataFrame:
    """Strata significant in every screen."""
    n = table.select("screen").distinct().count()
    return table.filter(F.col(q) < below).groupBy("stratum").agg(F.countDistinct("screen").alias("k")).filter(F.col("k") == n).select("stratum")


# ---------------------------------------------------------------- L18, L19 regulators


def tf_associations(activity: DataFrame, target: DataFrame, y: str, named: list[str], sample: str = "sample") -> DataFrame:
    """source, n, r, p, declared, q: declared factors keep raw p, the rest get q among themselves."""
    g = stats.pearson(activity.join(target.select(sample, y), sample), "t", y, "source")
    g = g.withColumn("declared", F.col("source").isin(named))
    return g.withColumn("_q", bh_q("p", "declared")).withColumn("q", F.when(~F.col("declared"), F.col("_q"))).drop("_q")


def architecture(peaks: DataFrame, tss: DataFrame, links: DataFrame) -> DataFrame:
    """gene, distal and promoter counts and shares: a peak belongs to its linked gene, else to the
    nearest start site."""
    at = peaks.withColumn("pos", genomics.midpoint("start", "end"))
    near = genomics.nearest_point(at, tss.select("chrom", F.col("tss").alias("pos"), "symbol"), "chrom", "pos", "symbol", ["name", "annotation"])
    given = genomics.linked_gene(links, "name", "gene", "ordinal")
    rows = near.join(given, "name", "left").withColumn("symbol", F.coalesce("gene", "symbol")).filter("symbol IS NOT NULL")
    return relational.region_shares(rows, "symbol", "annotation")


def matched_shift(table: DataFrame, sets: DataFrame, value: str, bins: int = 5, n_perm: int = draws.MATCHED, seed: int = 0) -> DataFrame:
    """signature, metric, n, n_missing, obs, null_mean, null_sd, z, p, q against genes of like expression and length.

    table: gene, expr, length and the value; sets: set, gene. Strata are quantile bins of both over all genes."""
    log = F.log10(F.col("length").cast("double"))
    level = lambda c, name: value_bin(c, bin_edges(table.withColumn(name, c), name, bins))
    placed = table.withColumn("_stratum", level(F.col("expr").cast("double"), "_e") * bins + level(log, "_l"))
    got = draws.matched_permutation(placed, sets, "gene", value, "_stratum", n_perm, seed)
    return got.withColumnRenamed("set", "signature").withColumn("metric", F.lit(value)).withColumn("q", bh_q("p", "metric"))


# ---------------------------------------------------------------- L20, L22 dashboard and preparation


def dashboard_lines(oof: DataFrame, metadata: DataFrame, a: float, b: float, line: str = "line") -> DataFrame:
    """line, truth, calibrated prediction and metadata, for display."""
    per = oof.groupBy(line).agg(F.first("truth").alias("truth"), F.avg("pred").alias("pred"))
    return per.withColumn("pred_display", F.lit(a) * F.col("pred") + F.lit(b)).join(metadata, line, "left")


def dashboard_results(tables: dict[str, DataFrame]) -> DataFrame:
    """All result tables under one schema, with the table's name; absent columns are NULL."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("table", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def collapse_probes(long: DataFrame, probes: DataFrame, probe: str, symbols: str, sample: str, value: str) -> DataFrame:
    """gene, sample, value: probes to the first of their symbols (' /// ' lists), means in which a
    missing probe makes the gene missing; log2 first if the values are linear."""
    first = F.regexp_replace(F.trim(F.col(symbols)), " ///.*$", "")
    pairs = probes.select(probe, first.alias("gene")).filter("gene <> ''")
    return genomics.gene_means(relational.log2_if_linear(long, value), pairs, probe, "gene", sample, value, propagate=True)


def difference_p(r1: float, n1: int, r2: float, n2: int) -> float:
    """p of the difference of two correlations."""
    if min(n1, n2) <= 3:
        return math.nan
    return normal_two_sided((math.atanh(r1) - math.atanh(r2)) / math.sqrt(1 / (n1 - 3) + 1 / (n2 - 3)))


def correlation_p(r: float, n: int) -> float:
    return pearson_p(r, n)


# ---------------------------------------------------------------- L21, L24, and p-values of trends


def with_trend_p(trend: DataFrame) -> DataFrame:
    """trend_p of the correlation with time, and ttest_p of last against first."""
    return trend.withColumn("trend_p", stats.pearson_p_udf(F.col("trend_r"), F.col("n").cast("double"))).withColumn("ttest_p", stats.t_two_sided_udf(F.col("t"), F.col("t_df")))


def promoter_strata(annotation: DataFrame, promoter: list[str], least_coverage: float = 5.0, covered: DataFrame | None = None) -> DataFrame:
    """stratum, probe, gene: promoter probes by their relation to the island, and the enhancer
    probes, those only if every set's coverage (pct_genes_with_enhancer_probe) allows it.

    annotation: probe, gene, region (';' lists), relation_to_island, enhancer."""
    pairs = genomics.explode_lists(annotation, ["probe", "relation_to_island", "enhancer"], "gene", "region", distinct=True)
    near = pairs.filter(F.col("region").isin(promoter)).select(F.concat(F.lit("promoter_"), F.col("relation_to_island")).alias("stratum"), "probe", "gene").distinct()
    if covered is not None:
        low = covered.agg(F.min("pct_genes_with_enhancer_probe")).first()[0]
        if low is None or low < least_coverage:
            return near
    enh = pairs.filter(F.upper(F.coalesce(F.col("enhancer"), F.lit(""))) == "TRUE").select(F.lit("enhancer").alias("stratum"), "probe", "gene").distinct()
    return near.unionByName(enh)


def view(lines: DataFrame, lineage: str, chosen: list[str] | None, x: str, y: str) -> tuple[DataFrame, dict]:
    """What the dashboard shows of a selection: the points, and n, r, slope and intercept of their fit."""
    rows = (lines if not chosen else lines.filter(F.col(lineage).isin(chosen))).select("line", lineage, x, y).dropna(subset=[x, y])
    slope, intercept, n = stats.affine_fit(rows, x, y)
    return rows, {"n": n, "r": rows.agg(safe_corr(x, y)).first()[0], "slope": slope, "intercept": intercept}


def share_of_ceiling(r: float, ceiling: float) -> float:
    return 100 * r / ceiling if ceiling else math.nan


def split_readouts(score: DataFrame, ranks: DataFrame, parts: DataFrame, target: DataFrame, y: str, sample: str = "sample") -> DataFrame:
    """part, n, r, p of each part of a set (set, gene) with a response, beside the whole set's."""
    s = scoring.background_score(ranks, parts, sample, "gene").select(sample, "set", "score").unionByName(score.select(sample, F.lit("whole").alias("set"), "score"))
    return stats.pearson(s.join(target.select(sample, y), sample), "score", y, "set")


# ---------------------------------------------------------------- grids over screens, drugs and penalties


def penalty_grid(screens: dict[str, DataFrame], feature_sets: dict[str, DataFrame], y: str, lineage: str, line: str = "model_id", repeats: int = 1) -> pd.DataFrame:
    """screen, features, target (raw / deconfounded), scaling, auc_sd, r_mean, r_sd: whether the
    penalty's scale explains a difference, under four rules for the target's scale.

    feature_sets: name -> (line, features)."""
    rows = []
    for s, table in screens.items():
        sd = table.agg(F.stddev_pop(y)).first()[0]
        rules = {
            "fixed": modelling.fixed_model, "fixed, unit SD": lambda: modelling.ScaledTarget(modelling.fixed_model()),
            "fixed, common SD": lambda sd=sd: modelling.ScaledTarget(modelling.fixed_model(), sd or 1.0), "tuned": modelling.transcriptome_model,
        }
        for f, x in feature_sets.items():
            m = table.select(line, lineage, y).join(x, line)
            for target in ("raw", "deconfounded"):
                for rule, factory in rules.items():
                    oof = modelling.cross_validate(m, line, "features", y, factory, lineage, target == "deconfounded", repeats=repeats)
                    got = modelling.summarise(oof, rule)
                    rows.append({"screen": s, "features": f, "target": target, "scaling": rule, "auc_sd": sd, "r_mean": got["r_mean"], "r_sd": got["r_sd"]})
    return pd.DataFrame(rows)


def module_discrepancy(screens: dict[str, DataFrame], line_sets: dict[str, DataFrame], y: str, lineage: str, line: str = "model_id", ceiling: float = 0.95, repeats: int = 1) -> pd.DataFrame:
    """screen, line_set, n, n_lineages, pct_auc_ceiling, auc_sd, r_mean, r_lo, r_hi, and r between and
    within lineages, of a module model on each screen's lines and on the shared ones.

    Screens: tables with line, lineage, y and features."""
    rows = []
    for s, table in screens.items():
        for name, keep in line_sets.items():
            own = table.join(keep.select(line).distinct(), line, "left_semi").dropna(subset=[y])
            q = own.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(lineage).alias("k"), F.avg((F.col(y) > ceiling).cast("double")).alias("c"), F.stddev_samp(y).alias("sd")).first()
            oof = modelling.cross_validate(own, line, "features", y, lambda: modelling.ScaledTarget(modelling.ElasticNet()), repeats=repeats).persist()
            got = modelling.summarise(oof, name)
            per = oof.groupBy("line").agg(F.first("truth").alias("t"), F.avg("pred").alias("p")).join(own.select(F.col(line).cast("string").alias("line"), lineage), "line")
            split = relational.between_within(per, "t", "p", lineage).first()
            rows.append({"screen": s, "line_set": name, "n": q.n, "n_lineages": q.k, "pct_auc_ceiling": 100 * (q.c or 0.0), "auc_sd": q.sd, "r_mean": got["r_mean"], "r_lo": got["r_lo"], "r_hi": got["r_hi"], "r_between_lineage": split.r_between, "r_within_lineage": split.r_within})
    return pd.DataFrame(rows)


def multidrug_models(drugs: dict[tuple[str, str], DataFrame], y: str, lineage: str, baseline: dict[tuple[str, str], float] | None = None, line: str = "model_id", repeats: int = modelling.REPEATS, factory=modelling.transcriptome_model) -> pd.DataFrame:
    """drug, screen, n and both models' summaries, with a verdict against the baseline's r.

    drugs: (drug, screen) -> line, lineage, y, features."""
    rows = []
    for (drug, screen), table in drugs.items():
        big = relational.in_large_groups(table, lineage, MIN_LINEAGE_N)
        for name, m, deconfound in (("raw", table, False), ("deconfounded", big, True)):
            oof = modelling.cross_validate(m, line, "features", y, factory, lineage, deconfound, repeats=repeats).persist()
            got = {"drug": drug, "screen": screen, "n": oof.select("line").distinct().count()} | modelling.summarise(oof, name)
            base = (baseline or {}).get((drug, screen))
            got["verdict"] = None if base is None else "yes" if got["r_lo"] > base else "no" if got["r_hi"] < base else "inconclusive"
            rows.append(got)
    return pd.DataFrame(rows)


def chosen_screen(tables: dict[str, DataFrame], value: str = "AUC") -> str:
    """The screen with the larger spread of responses; the first of equal ones."""
    rows = None
    for name, t in tables.items():
        one = t.select(F.lit(name).alias("screen"), value)
        rows = one if rows is None else rows.unionByName(one)
    return relational.best_group(rows, "screen", value, list(tables)).first().screen
