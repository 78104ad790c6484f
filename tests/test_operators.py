import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import genesets, genomics, relational, scoring, stats


def test_set_cleaning_and_resolution(spark):
    lines = [("s", 0, "Symbol"), ("s", 1, "A1"), ("s", 2, "NA"), ("s", 3, "B2.03"), ("s", 4, " c3 "), ("s", 5, "D4"), ("s", 6, ""), ("s", 7, "gone")]
    universe = spark.createDataFrame([("A1",), ("B2",), ("C3",), ("E5",), ("E5b",)], "gene string")
    clean = genesets.clean_sets(spark.createDataFrame(lines, "set string, line_no int, gene string"), universe)
    assert sorted(r.gene for r in clean.collect()) == ["A1", "B2", "D4", "c3", "gone"]
    al = spark.createDataFrame([("c3", "X", 0), ("c3", "C3", 1), ("D4", "E5", 2), ("E5b", "E5", 3)], "alias string, symbol string, ordinal int")
    got = {(r.gene, r.how) for r in genesets.resolve_sets(clean, universe, al).collect()}
    assert got == {("A1", "direct"), ("B2", "direct"), ("C3", "alias")}  # E5 has two names here: not taken
    rec = genesets.recovery(clean, genesets.resolve_sets(clean, universe, al))
    assert rec.first().pct == pytest.approx(60.0)
    with pytest.raises(genesets.SetError):
        genesets.require_recovery(rec, 80)
    bad = spark.createDataFrame([("e", i, f"ENSG{i}") for i in range(3)] + [("e", 9, "A1")], "set string, line_no int, gene string")
    with pytest.raises(genesets.SetError):
        genesets.clean_sets(bad, universe)


def test_gene_axis(spark):
    al = spark.createDataFrame([("a", "A"), ("b", "B")], "alias string, symbol string")
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert genesets.gene_axis(one("A", "B", "s1"), one("s2"), al) == "rows"
    assert genesets.gene_axis(one("A"), one("B"), al) == "columns"
    with pytest.raises(genesets.SetError, match="Ensembl"):
        genesets.gene_axis(one("ENSG1", "ENSG2"), one("s1"), al)


def test_shifted_set_scores_high(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 200))
    x[0, :20] += 5
    long = spark.createDataFrame([(s, g, float(x[s, g])) for s in range(2) for g in range(200)], "s int, g int, v double")
    sets = spark.createDataFrame([("up", g) for g in range(20)], "set string, g int")
    ranks = scoring.rank_matrix(long, "s", "g", "v")
    got = {r.s: r.score for r in scoring.background_score(ranks, sets, "s", "g").collect()}
    assert got[0] > 6 and abs(got[1]) < 3
    es = {r.s: r.score for r in scoring.ssgsea(ranks, sets, "s", "g").collect()}
    assert es[0] - es[1] == pytest.approx(1.0)


def test_activity_is_a_regression_slope_t(spark):
    rng = np.random.default_rng(1)
    y, w = rng.normal(size=40), np.zeros(40)
    w[:15] = rng.choice([-1.0, 1.0], 15)
    long = spark.createDataFrame([(0, g, float(y[g])) for g in range(40)], "s int, g int, v double")
    edges = spark.createDataFrame([("tf", g, float(w[g])) for g in range(15)] + [("few", 1, 1.0)], "source string, g int, weight double")
    got = scoring.ulm_activity(long, edges, "s", "g", "v").collect()
    a = np.column_stack([np.ones(40), w])
    b, res, *_ = np.linalg.lstsq(a, y, rcond=None)
    se = np.sqrt(res[0] / 38 * np.linalg.inv(a.T @ a)[1, 1])
    assert [(r.source, r.t) for r in got] == [("tf", pytest.approx(b[1] / se))]


def test_nearest_and_overlap_edges(spark):
    pts = spark.createDataFrame([("1", 10, "a"), ("1", 20, "b"), ("1", 20, "aa"), ("2", 5, "z")], "chrom string, pos int, name string")
    pk = spark.createDataFrame([("1", 15, "p"), ("1", 100, "q"), ("1", 0, "r"), ("1", 20, "s"), ("3", 7, "t")], "chrom string, pos int, peak string")
    got = {r.peak: (r.name, r.distance) for r in genomics.nearest_point(pk, pts, "chrom", "pos", "name", ["peak"]).collect()}
    assert got == {"p": ("a", 5), "q": ("aa", 80), "r": ("a", 10), "s": ("aa", 0), "t": (None, None)}
    a = spark.createDataFrame([("x", "1", 0, 100), ("y", "1", 50, 50), ("w", "2", 0, 9)], "k string, chrom string, start int, end int")
    b = spark.createDataFrame([("m", "1", 90, 200), ("n", "1", 0, 10), ("o", "1", 40, 60), ("l", "1", 100, 300)], "n string, chrom string, start int, end int")
    assert [tuple(r) for r in genomics.best_overlap(a, b, "k", "n", width=16).collect()] == [("x", "o", 20)]


def test_list_lengths_must_agree(spark):
    df = spark.createDataFrame([("p", "A;B;A", "x;y;x"), ("q", "", ""), ("r", None, None)], "p string, g string, r string")
    assert genomics.explode_lists(df, ["p"], "g", "r").count() == 3
    assert genomics.explode_lists(df, ["p"], "g", "r", distinct=True).count() == 2
    with pytest.raises(Exception, match="differ in length"):
        genomics.explode_lists(spark.createDataFrame([("p", "A;B", "x")], "p string, g string, r string"), ["p"], "g", "r").collect()


def test_partial_correlation_by_residuals(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=200)
    x, y = 0.8 * z + 0.5 * rng.normal(size=200), 0.7 * z + 0.5 * rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z)], "x double, y double, z double")
    one, many, none = (stats.partial_corr_1(df, "x", "y", "z").first(), stats.partial_corr(df, "x", "y", ["z"]).first(), stats.partial_corr(df, "x", "y", []).first())
    assert one.r == pytest.approx(many.r) and abs(one.r) < 0.25 and none.r > 0.5 and one.p == pytest.approx(many.p)
    lo, hi = df.limit(1).select(F.lit(0.5).alias("r"), F.lit(103).alias("n")).select(*stats.fisher_ci("r", "n")).first()
    assert (lo, hi) == (pytest.approx(np.tanh(np.arctanh(0.5) - 0.196)), pytest.approx(np.tanh(np.arctanh(0.5) + 0.196)))


def test_enrichment_known_case(spark):
    genes = lambda r: spark.createDataFrame([(f"g{i}",) for i in r], "gene string")
    sets = spark.createDataFrame([("s", f"g{i}") for i in range(20)] + [("none", "zz")], "set string, gene string")
    got = {r.set: r for r in stats.enrichment(genes([*range(8), *range(50, 54), 999]), sets, genes(range(100)), "gene").collect()}
    s = got["s"]
    assert (s.query_size, s.signature_size, s.observed, s.expected, s.fold) == (12, 20, 8, pytest.approx(2.4), pytest.approx(8 / 2.4))
    assert s.p_value == pytest.approx(0.00020337427, rel=1e-6) and got["none"].p_value is None


def test_agreement_concordance_and_corrected_t(spark):
    a = spark.createDataFrame([(i, float(i % 7)) for i in range(9)], "k int, v double")
    assert stats.screen_agreement(a, a, "k", "v").first().r is None
    assert stats.concordance(spark.createDataFrame([(1.0, 1.0, False), (2.0, 2.0, True), (3.0, 3.0, True)], "y double, p double, e boolean"), "y", "p", "e").first()[:] == (1.0, 1.0)
    d = [0.02, 0.05, -0.01, 0.03, 0.04]
    t = stats.corrected_ttest(spark.createDataFrame([(v,) for v in d], "d double"), "d", 80, 20).first()
    assert t.t == pytest.approx(np.mean(d) / np.sqrt(np.var(d, ddof=1) * (1 / 5 + 0.25)))
    oof = spark.createDataFrame([("a", 0, 0, 1.0, 1.0)], "line string, repeat int, fold int, truth double, pred double")
    with pytest.raises(ValueError):
        stats.difference_by_split(oof, oof.withColumn("fold", F.lit(1)))


def test_general_axis_leaves_the_focal_item_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"d{j}", float(rng.normal() + i)) for i in range(12) for j in range(3)]
    long = spark.createDataFrame(rows, "line int, item string, v double")
    with_, without = ({r.line: r.general for r in relational.general_axis(long, "line", "item", "v", f, 10).collect()} for f in (None, "d0"))
    m = np.array([r[2] for r in rows]).reshape(12, 3)
    z = (m - m.mean(axis=0)) / m.std(axis=0, ddof=1)
    assert with_ == {i: pytest.approx(z[i].mean()) for i in range(12)} and without == {i: pytest.approx(z[i, 1:].mean()) for i in range(12)}


def test_flags_names_and_recodes(spark):
    ev = spark.createDataFrame([("m1", "TP53"), ("m1", "TP53"), ("m2", "KRAS")], "model_id string, gene string")
    ids = spark.createDataFrame([("m1",), ("m3",)], "model_id string")
    out = relational.flag_matrix(ev, ids, "model_id", "gene", ["TP53", "KRAS", "APC"])
    assert out.columns == ["model_id", "TP53", "KRAS"] and {tuple(r) for r in out.collect()} == {("m1", 1, 0), ("m3", 0, 0)}
    models = spark.createDataFrame([("1", "HT-29", "ht29x"), ("2", "ht29 x", None)], "model_id string, model_name string, synonyms string")
    want = spark.createDataFrame([("HT29X",), ("ht.29",), ("none",)], "n string")
    assert {r.n: r.model_id for r in relational.lookup_names(want, "n", models).collect()} == {"HT29X": "2", "ht.29": "1", "none": None}
    r = spark.createDataFrame([("CR ",), ("pd",), ("?",)], "x string").select(relational.recode("x", {"1": ["CR", "PR"], "0": ["SD", "PD"]})).collect()
    assert [v[0] for v in r] == ["1", "0", None]


def test_overlaps_of_short_and_long_intervals(spark):
    """Against every pair; a chromosome-long interval stands in two bins, not in thousands."""
    rng = np.random.default_rng(4)
    make = lambda n, tag: [(f"{tag}{i}", "c" if i % 7 else "d", int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(-500, 100_000, n), rng.choice([0, 1, 5, 17, 90, 700, 6000, 200_000], n)))]
    a, b = make(70, "a") + [("null", None, 1, 5)], make(90, "b") + [("huge", "c", -(10**12), 10**12)]
    want = {}
    for k, c, s, e in a:
        found = [(-(min(e, f) - max(s, r)), n) for n, d, r, f in b if c == d and s < f and r < e and s < e and r < f]
        if found:
            o, n = min(found)
            want[k] = (n, -o)
    schema = "{} string, chrom string, start long, end long"
    got = genomics.best_overlap(spark.createDataFrame(a, schema.format("k")), spark.createDataFrame(b, schema.format("n")), "k", "n", width=16)
    assert {r.k: (r.n, r.overlap) for r in got.collect()} == want


def test_nearest_point_reads_no_stretch_anew(spark):
    pts = spark.range(0, 4000, 2).select(F.lit("c").alias("chrom"), F.col("id").alias("pos"), F.concat(F.lit("p"), F.col("id")).alias("name"))
    pk = spark.range(0, 4000, 3).select(F.lit("c").alias("chrom"), F.col("id").alias("pos"), F.col("id").alias("peak"))
    near = genomics.nearest_point(pk, pts, "chrom", "pos", "name", ["peak"])
    assert "rangeframe, currentrow$(), unboundedfollowing" not in near._jdf.queryExecution().executedPlan().toString().lower()
    assert all((r.name, r.distance) == (f"p{r.peak - r.peak % 2}", r.peak % 2) for r in near.collect())


def test_overlaps_in_full_bins_form_no_pairs(spark, monkeypatch):
    """Against every pair, where many intervals lie over each other; bins are swept, whole and in parts."""
    rng = np.random.default_rng(12)
    make = lambda n, tag: [(f"{tag}{i}", "cd"[i % 2], int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, 60, n), rng.choice([0, 1, 5, 17, 17, 40], n)))]
    a, b = make(400, "a"), make(500, "b") + [(None, "c", 20, 24)]
    want = {}
    for k, c, s, e in a:
        found = [(-(min(e, f) - max(s, r)), n is not None, n) for n, d, r, f in b if c == d and s < f and r < e and s < e and r < f]
        if found:
            o, _, n = min(found, key=lambda x: (x[0], x[1], x[2] or ""))
            want[k] = (n, -o)
    schema = "{} string, chrom string, start long, end long"
    for rows in (genomics.SWEPT, 90):
        monkeypatch.setattr(genomics, "SWEPT", rows)
        got = genomics.best_overlap(spark.createDataFrame(a, schema.format("k")), spark.createDataFrame(b, schema.format("n")), "k", "n", width=64)
        assert {r.k: (r.n, r.overlap) for r in got.collect()} == want
        assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
