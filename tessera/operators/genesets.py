"""Gene sets: cleaning, symbol resolution, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Entries of a gene list that stand for no gene, and words of a header line.
PLACEHOLDERS = ["None", "NA", "NaN", "null", "-", ""]
HEADERS = ["gene", "symbol", "gene_symbol", "x"]


class SetError(ValueError):
    """A gene set or cohort that cannot be used."""


def clean_sets(lines: DataFrame, universe: DataFrame) -> DataFrame:
    """set, gene of raw lines (set, line_no, gene): blanks, placeholders and a header go; a
    symbol a spreadsheet has given decimals (NAME.00) loses them if only then known.

    Raises SetError for a set of which over half are Ensembl ids."""
    g = lines.withColumn("gene", F.trim("gene")).filter("gene <> ''")
    first = F.row_number().over(W.partitionBy("set").orderBy("line_no"))
    g = g.withColumn("_rn", first).filter(~((F.col("_rn") == 1) & F.lower("gene").isin(HEADERS))).drop("_rn")
    bad = g.groupBy("set").agg(F.avg(F.col("gene").startswith("ENSG").cast("double")).alias("share")).filter("share > 0.5").select("set").take(5)
    if bad:
        raise SetError(f"Ensembl ids instead of symbols in: {', '.join(r.set for r in bad)}")
    g = g.filter(~F.col("gene").isin(PLACEHOLDERS))
    short = F.when(F.col("gene").rlike(r"^.+\.\d+$"), F.regexp_replace("gene", r"\.\d+$", ""))
    u = universe.select(F.col("gene").alias("_u")).distinct()
    g = g.withColumn("_s", short).join(u.withColumn("_here", F.lit(True)), F.col("gene") == F.col("_u"), "left").drop("_u")
    g = g.join(u.withColumn("_there", F.lit(True)), F.col("_s") == F.col("_u"), "left").drop("_u")
    gene = F.when(F.col("_here").isNull() & F.col("_there"), F.col("_s")).otherwise(F.col("gene"))
    return g.select("set", "line_no", gene.alias("gene"))


def last_alias(aliases: DataFrame) -> DataFrame:
    """alias, symbol: of a repeated alias, the last listed."""
    return aliases.groupBy("alias").agg(F.max_by("symbol", "ordinal").alias("symbol"))


def resolve_sets(sets: DataFrame, universe: DataFrame, aliases: DataFrame) -> DataFrame:
    """set, gene (name in the universe), how ('direct' or 'alias'), distinct.

    A gene of the universe is itself. Another is reduced to its official symbol and
    taken only if exactly one gene of the universe reduces to the same."""
    u = universe.select("gene").distinct()
    a = last_alias(aliases).select("alias", F.col("symbol").alias("_c"))
    canon = lambda df: df.join(a, F.col("gene") == F.col("alias"), "left").withColumn("canon", F.coalesce("_c", "gene")).drop("alias", "_c")
    wanted = sets.select("set", "gene").distinct()
    direct = wanted.join(u, "gene", "left_semi").select("set", "gene", F.lit("direct").alias("how"))
    alone = canon(u).groupBy("canon").agg(F.count(F.lit(1)).alias("n"), F.min("gene").alias("_name")).filter("n = 1")
    rest = canon(wanted.join(u, "gene", "left_anti")).join(alone, "canon").select("set", F.col("_name").alias("gene"), F.lit("alias").alias("how"))
    both = direct.unionByName(rest)
    return both.groupBy("set", "gene").agg(F.max("how").alias("how"))


def recovery(sets: DataFrame, resolved: DataFrame) -> DataFrame:
    """set, n_listed, n_found, pct: found over all listed genes, repeats included."""
    n = sets.groupBy("set").agg(F.count("gene").alias("n_listed"))
    f = resolved.groupBy("set").agg(F.count("gene").alias("n_found"))
    return n.join(f, "set", "left").select("set", "n_listed", F.coalesce("n_found", F.lit(0)).alias("n_found"), (100 * F.coalesce("n_found", F.lit(0)) / F.col("n_listed")).alias("pct"))


def require_recovery(table: DataFrame, least: float | None = 80.0) -> None:
    if least is None:
        return
    low = table.filter(F.col("pct") < least).orderBy("set").take(20)
    if low:
        raise SetError("low recovery: " + ", ".join(f"{r.set} {r.pct:.1f}%" for r in low))


def gene_axis(row_ids: DataFrame, column_ids: DataFrame, aliases: DataFrame) -> str:
    """'rows' or 'columns', whichever names more known genes; ties go to columns."""
    known = aliases.select(F.col("alias").alias("id")).union(aliases.select("symbol")).distinct()
    r, c = (x.toDF("id").distinct().join(known, "id", "left_semi").count() for x in (row_ids, column_ids))
    if not r and not c:
        for x in (row_ids, column_ids):
            head = [i[0] for i in x.limit(200).collect()]
            if head and sum(str(i).startswith("ENSG") for i in head) > len(head) / 2:
                raise SetError("the genes are Ensembl ids; symbols are needed")
        raise SetError("neither axis has known genes")
    return "rows" if r > c else "columns"


def overlap_sizes(sets: DataFrame) -> DataFrame:
    """set_a, set_b, n_a, n_b, shared (a before b); pairs that share nothing are left out."""
    s = sets.select("set", "gene").distinct()
    size = s.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    a, b = s.select(F.col("set").alias("set_a"), "gene"), s.select(F.col("set").alias("set_b"), "gene")
    both = a.join(b, "gene").filter("set_a < set_b").groupBy("set_a", "set_b").agg(F.count(F.lit(1)).alias("shared"))
    both = both.join(size.select(F.col("set").alias("set_a"), F.col("n").alias("n_a")), "set_a")
    return both.join(size.select(F.col("set").alias("set_b"), F.col("n").alias("n_b")), "set_b")


def without_shared(sets: DataFrame, a: str, b: str) -> DataFrame:
    """The two sets, less the genes they share."""
    n = F.count(F.lit(1)).over(W.partitionBy("gene"))
    return sets.filter(F.col("set").isin(a, b)).select("set", "gene").distinct().withColumn("_n", n).filter("_n = 1").drop("_n")
