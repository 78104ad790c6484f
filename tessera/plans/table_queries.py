"""More of the library's operators on the driver's tables, with the same in DuckDB SQL: filters, joins,
counts, associations, and models that have a closed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ranks import spearman, with_rank
from ..operators import genesets, genomics, modelling, regression, relational, resampling, scoring, stats
from . import stages
from .queries import DAYS, LONG, RANKS, SCREENS, _screen, features, query, rounded, table

# ---------------------------------------------------------------- rows


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%'")
def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.contains(table(spark, sf_dir, "part"), "p_name", "RiNg").select("p_partkey", "p_name")


@query("""WITH x AS (SELECT c_custkey AS id, c_mktsegment AS g FROM customer WHERE c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING') SELECT id, g FROM x WHERE g IN (SELECT g FROM x WHERE g IS NOT NULL GROUP BY 1 HAVING count(*) >= 150)""")
def large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"))
    return relational.in_large_groups(c, "g", 150)


@query("""SELECT user_id, event_type, value FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) FILTER (value > 20) >= 300)""")
def detected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return relational.detected(e.withColumn("over", F.col("value") - 20), "event_type", "over", 300).select("user_id", "event_type", "value")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) FILTER ((coalesce(o_orderstatus = 'O', false) AND coalesce(o_orderpriority = '1-URGENT', false)) OR coalesce(o_orderstatus = 'P', false)) AS n_declared FROM orders GROUP BY ALL""")
def declared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = relational.declared([{"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}, {"o_orderstatus": "P"}])
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(mask, 1)).alias("n_declared"))


@query("""SELECT CASE WHEN lower(trim(o_orderstatus)) = 'o' THEN 'open' WHEN lower(trim(o_orderstatus)) IN ('f', 'p') THEN 'done' END AS state, count(*) AS n FROM orders GROUP BY 1""")
def recoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(relational.recode("o_orderstatus", {"open": ["O"], "done": ["F", "P"]}).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(c_mktsegment, 'UNKNOWN') AS segment, count(*) AS n, round(100.0 * avg((c_acctbal > 0)::INT), 6) AS pct_positive, round(median(c_acctbal), 4) AS median, max(c_acctbal) AS top FROM customer GROUP BY 1")
def labelled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("segment", F.coalesce("c_mktsegment", F.lit("UNKNOWN")))
    return c.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col("c_acctbal") > 0).cast("double")), 6).alias("pct_positive"), F.round(F.median("c_acctbal"), 4).alias("median"), F.max("c_acctbal").alias("top"))


@query("""WITH x AS (SELECT c_custkey AS id, nullif(c_custkey % 5, 0) AS a, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer) SELECT id, a, b FROM x WHERE a IS NOT NULL AND b IS NOT NULL""")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.nullif(F.col("c_custkey") % 5, F.lit(0)).alias("a"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("b"))
    return c.dropna(subset=["a", "b"])


# ---------------------------------------------------------------- joins and sets


@query("""WITH d AS (SELECT c_nationkey AS k, arg_min(c_name, c_custkey) AS c_name, min(c_custkey) AS first FROM customer GROUP BY 1) SELECT s_suppkey, s_nationkey, c_name, first FROM supplier LEFT JOIN d ON s_nationkey = k""")
def first_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey"), "c_name", F.col("c_custkey").alias("first"))
    return relational.with_metadata(s, c, "s_nationkey", [F.asc("first")]).select("s_suppkey", "s_nationkey", "c_name", "first")


@query(f"""WITH {SCREENS} SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, round(a, 4) AS value_one, round(b, 4) AS value_two FROM a FULL JOIN b USING (o_custkey)""")
def outer_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.outer_named(_screen(spark, sf_dir, "O"), _screen(spark, sf_dir, "F"), "o_custkey", ("one", "two")), 4)


@query("SELECT a.n_name AS n_name_a, b.n_name AS n_name_b FROM nation a JOIN nation b ON a.n_name < b.n_name")
def item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.pairs_of(table(spark, sf_dir, "nation"), "n_name")


@query("""SELECT 'with orders' AS part, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders)""")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    rich = c.filter("c_acctbal > 0").select("id")
    parts = {"with orders": c.join(o, "id", "left_semi"), "without": c.join(o, "id", "left_anti"), "either": rich.union(o).distinct(), "both": rich.intersect(o)}
    return stages.dashboard_results({k: v.agg(F.count(F.lit(1)).alias("n")) for k, v in parts.items()}).withColumnRenamed("table", "part")


@query("SELECT l_orderkey AS peak, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) AS gene FROM lineitem GROUP BY 1")
def linked_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("peak"), F.col("l_partkey").alias("gene"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("o"))
    return genomics.linked_gene(li, "peak", "gene", "o")


@query("""WITH u AS (SELECT DISTINCT p_brand AS gene FROM part), r AS (SELECT 'Brand#' || (i % 60) AS gene FROM range(100) t(i)), c AS (SELECT 'x' || i AS gene FROM range(100) t(i)) SELECT CASE WHEN (SELECT count(DISTINCT gene) FROM r WHERE gene IN (FROM u)) > (SELECT count(DISTINCT gene) FROM c WHERE gene IN (FROM u)) THEN 'rows' ELSE 'columns' END AS axis""")
def gene_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").select(F.col("p_brand").alias("alias")).distinct().withColumn("symbol", F.col("alias")).withColumn("ordinal", F.lit(0))
    ids = spark.range(100)
    rows, columns = ids.select(F.concat(F.lit("Brand#"), (F.col("id") % 60).cast("string")).alias("gene")), ids.select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("gene"))
    return spark.createDataFrame([(genesets.gene_axis(rows, columns, known),)], "axis string")


# ---------------------------------------------------------------- counts and reshaping


@query("SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS BUILDING, count(*) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY, count(*) FILTER (c_mktsegment = 'NONE') AS NONE FROM customer GROUP BY 1")
def counts_with_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.counts_with_zero(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY", "NONE"])


@query("""WITH x AS (SELECT user_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events) SELECT event_type, round(count(*) FILTER (value IS NULL) / count(*)::DOUBLE, 6) AS missing_frac FROM x GROUP BY 1""")
def missing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return rounded(relational.missing_shares(e, "event_type", "value"))


@query("SELECT o_orderpriority, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1 ORDER BY stddev_samp(o_totalprice) DESC LIMIT 1")
def widest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.best_group(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", []), 4)


@query("""SELECT user_id, event_type || '__low' AS feature, value FROM events WHERE value < 10 UNION ALL SELECT user_id, event_type || '__high', value FROM events WHERE value >= 10""")
def suffixed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("feature"), "value")
    return relational.suffixed_union({"low": e.filter("value < 10"), "high": e.filter("value >= 10")}, "feature")


@query(f"WITH {LONG}, m AS (FROM l WHERE feature < 8) SELECT a.feature AS feature_a, b.feature AS feature_b, count(*) AS n, round(corr(a.value, b.value), 6) AS r FROM m a JOIN m b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2")
def score_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.correlation_matrix(features(spark, sf_dir).filter("feature < 8"), "sample", "feature", "value"))


@query("SELECT c_custkey, unnest(['balance', 'nation']) AS measure, unnest([c_acctbal, c_nationkey::DOUBLE]) AS value FROM customer")
def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return relational.tall(c, ["c_custkey"], ["balance", "nation"], "measure", "value")


@query("""(SELECT 'head' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12) UNION ALL (SELECT 'tail', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)""")
def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.ends(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 12, 5)


@query(f"WITH {LONG} SELECT sample % 50 AS id, feature, round(avg(value), 6) AS value, round(sum(value), 6) AS total FROM l GROUP BY 1, 2")
def replicate_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).withColumn("id", F.col("sample") % 50)
    total = rows.groupBy("id", "feature").agg(F.sum("value").alias("total"))
    return rounded(relational.mean_cells(rows, "id", "feature", "value").join(total, ["id", "feature"]))


@query(f"WITH {LONG} SELECT sample, feature, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) AS z FROM l WINDOW w AS (PARTITION BY feature)")
def population_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = features(spark, sf_dir)
    return rounded(long.select("sample", "feature", scoring.zscore_within(long, "value", "feature").alias("z")))


@query("""WITH x AS (SELECT o_orderkey, o_totalprice AS v FROM orders) SELECT o_orderkey, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS place FROM x""")
def whole_table_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "place").select("o_orderkey", "place")


# ---------------------------------------------------------------- associations


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag").drop("p"))


@query("""WITH x AS (SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS b FROM lineitem) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM x""")
def spearman_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spearman(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity"))


@query("""WITH g AS (SELECT l_returnflag AS f, corr(l_quantity, l_extendedprice) AS r, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) SELECT a.f AS first, b.f AS second, round((atanh(a.r) - atanh(b.r)) / sqrt(1.0::DOUBLE / (a.n - 3) + 1.0::DOUBLE / (b.n - 3)), 6) AS z FROM g a JOIN g b ON a.f < b.f""")
def fisher_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stats.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag").withColumn("n", F.col("n").cast("double"))
    a = g.select(F.col("l_returnflag").alias("first"), F.col("r").alias("r1"), F.col("n").alias("n1"))
    b = g.select(F.col("l_returnflag").alias("second"), F.col("r").alias("r2"), F.col("n").alias("n2"))
    return rounded(a.join(b, F.col("first") < F.col("second")).select("first", "second", stats.fisher_difference_z("r1", "n1", "r2", "n2").alias("z")))


@query("""SELECT count(*) AS n, round(corr((c_mktsegment = 'BUILDING')::INT, c_acctbal), 6) AS r FROM customer WHERE c_mktsegment IS NOT NULL""")
def point_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_mktsegment IS NOT NULL").withColumn("flag", (F.col("c_mktsegment") == "BUILDING").cast("double"))
    return rounded(stats.pearson(c, "flag", "c_acctbal").drop("p"))


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_extendedprice - (a + b * l_quantity), 3) AS residual FROM lineitem, f""")
def residualized(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = stats.residualized(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(li.select("l_orderkey", "l_linenumber", "residual"), 3)


@query("""SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity) FILTER (l_linestatus = 'O') - regr_slope(l_extendedprice, l_quantity) FILTER (l_linestatus <> 'O'), 3) AS estimate FROM lineitem""")
def interaction_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("flag", (F.col("l_linestatus") == "O").cast("int"))
    return rounded(regression.interaction(li, "l_extendedprice", "l_quantity", "flag").select("n", "estimate"), 3)


@query(f"""WITH {LONG}, y AS (SELECT vec_id AS sample, label FROM embeddings) SELECT feature, count(*) AS n, round(corr(value, label), 6) AS r FROM l JOIN y USING (sample) GROUP BY 1""")
def every_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("double").alias("y"))
    return rounded(stats.all_feature_corr(features(spark, sf_dir), y, "sample", "feature", "value", "y").drop("p", "q"))


@query(f"""WITH {DAYS} SELECT event_type, {", ".join(f"round(avg(value) FILTER (h = {t}), 6) AS mean_{t}h, round(stddev_samp(value) FILTER (h = {t}), 6) AS sd_{t}h" for t in (0, 16, 32, 48))} FROM x GROUP BY 1""")
def trend_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.dayofmonth("ts") % 4 * 16).alias("h"), "value")
    return rounded(scoring.trend_by_time(e, "event_type", "h", "value", [0, 16, 32, 48]))



@query(f"""WITH {LONG}, y AS (SELECT vec_id AS sample, label % 5 AS g, embedding[1]::DOUBLE + embedding[2]::DOUBLE AS y, (row_number() OVER (ORDER BY vec_id) - 1) % 5 AS fold FROM embeddings),
t AS (SELECT f.fold AS fold, feature, value - avg(value) OVER w AS cx, (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS cy FROM l JOIN y USING (sample) JOIN (SELECT unnest(range(5)) AS fold) f ON y.fold <> f.fold WINDOW w AS (PARTITION BY f.fold, feature, g)),
r AS (SELECT fold, feature, abs(sum(cx * cy) / sqrt(sum(cx * cx) * sum(cy * cy))) AS r FROM t WHERE cy IS NOT NULL GROUP BY ALL)
SELECT 0 AS "repeat", fold::INT AS fold, feature FROM r QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(r, 10) DESC, feature) <= 8""")
def deconfounded_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature screen of every fold on values centred, and a response standardised, by the training
    rows of each group."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    y = stages.to_local(e.select(F.col("vec_id").alias("sample"), (F.col("label") % 5).alias("g"), (v[0] + v[1]).alias("y")), "lines").sort_values("sample").reset_index(drop=True)
    y["row_ix"] = np.arange(len(y))
    target = spark.createDataFrame(y)
    folds = target.select(F.lit(0).alias("repeat"), "row_ix", (F.col("row_ix") % 5).cast("int").alias("fold"))
    return modelling.screen_by_fold(features(spark, sf_dir), target, folds, "sample", "feature", "value", "y", 8, "g")


# ---------------------------------------------------------------- models with a closed form

#: Ridge with penalty 10 on one standardised column, each market segment predicted from the others.
RIDGE = """c AS (SELECT c_custkey AS id, c_mktsegment AS g, c_acctbal AS y, avg(o_totalprice) / 1000 AS x1, count(*)::DOUBLE AS x2 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL GROUP BY ALL),
k AS (SELECT g, dense_rank() OVER (ORDER BY g) - 1 AS fold FROM (SELECT DISTINCT g FROM c)),
t AS (SELECT k.g, k.fold, count(*) AS n, avg(y) AS my, avg(x1) AS m1, stddev_pop(x1) AS s1, covar_pop(x1, y) AS c1, avg(x2) AS m2, stddev_pop(x2) AS s2, covar_pop(x2, y) AS c2 FROM k JOIN c ON c.g <> k.g GROUP BY 1, 2),
o AS (SELECT id, c.g, fold, n AS n_train, y, my + (x1 - m1) / s1 * (n * c1 / s1) / (n + 10) AS p1, my + (x2 - m2) / s2 * (n * c2 / s2) / (n + 10) AS p2 FROM c JOIN t USING (g))"""


def _lines(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    x = o.groupBy("o_custkey").agg((F.avg("o_totalprice") / 1000).alias("x1"), F.count(F.lit(1)).cast("double").alias("x2"))
    rows = c.filter("c_mktsegment IS NOT NULL").join(x, F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("y"), F.array(column).alias("features"))


def _left_out(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    rows = _lines(spark, sf_dir, column)
    names = rows.select("g").distinct().withColumn("fold", F.dense_rank().over(W.orderBy("g")) - 1)  # one row a group
    out = regression.ridge_by_fold(rows.join(F.broadcast(names), "g"), "id", "features", "y", [10.0])
    return out.withColumn("line", F.col("line").cast("string")).withColumn("repeat", F.lit(0)).withColumn("n_train", F.col("n_train").cast("int"))


@query(f"WITH {RIDGE} SELECT id::VARCHAR AS line, fold::INT AS fold, y AS truth, round(p1, 4) AS pred, n_train::INT AS n_train FROM o")
def leave_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _left_out(spark, sf_dir, "x1").select("line", "fold", "truth", F.round("pred", 4).alias("pred"), "n_train")


@query(f"WITH {RIDGE}, w AS (SELECT g, count(*) AS n, corr(y, p1) AS r FROM o GROUP BY 1) SELECT round(median(r), 6) AS r_within_median, count(*) AS n_groups_within FROM w WHERE n >= 10")
def within_group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(modelling.within_groups(_left_out(spark, sf_dir, "x1"), _lines(spark, sf_dir, "x1"), "id", "g"))


@query(f"WITH {RIDGE} SELECT 0 AS \"repeat\", count(*) AS n, round(corr(y, p1), 6) AS r FROM o")
def per_repeat_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(modelling.per_repeat(_left_out(spark, sf_dir, "x1")))


@query(f"WITH {RIDGE} SELECT id::VARCHAR AS line, fold::INT AS fold, round((p1 + p2) / 2, 4) AS pred FROM o")
def late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(modelling.late_fusion(_left_out(spark, sf_dir, "x1"), _left_out(spark, sf_dir, "x2")).select("line", "fold", "pred"), 4)


@query(f"""WITH {RIDGE}, d AS (SELECT fold, corr(y, p1) - corr(y, p2) AS d, count(*) AS n, any_value(n_train) AS n_train FROM o GROUP BY 1), s AS (SELECT count(*) AS n_splits, avg(d) AS m, var_samp(d) AS v, avg(n) / avg(n_train) AS ratio FROM d)
SELECT 'one' AS model_a, 'two' AS model_b, n_splits, round(m, 6) AS mean_diff, round(m / sqrt(v * (1.0::DOUBLE / n_splits + ratio)), 6) AS t FROM s""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stages.compare(_left_out(spark, sf_dir, "x1"), _left_out(spark, sf_dir, "x2"), "one", "two").drop("p"))


@query(f"WITH {RIDGE} SELECT id::VARCHAR AS line, round(((p1 - avg(p1) OVER ()) / stddev_samp(p1) OVER () + (p2 - avg(p2) OVER ()) / stddev_samp(p2) OVER ()) / 2, 6) AS score FROM o")
def regimen_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stages.regimen(_left_out(spark, sf_dir, "x1"), _left_out(spark, sf_dir, "x2")).select("line", "score"))


@query(f"WITH {RIDGE} SELECT id::VARCHAR AS line, y AS truth, round(p1, 4) AS pred, round(0.5 * p1 + 100, 4) AS pred_display, g AS segment FROM o")
def display_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _lines(spark, sf_dir, "x1").select(F.col("id").cast("string").alias("line"), F.col("g").alias("segment"))
    out = stages.dashboard_lines(_left_out(spark, sf_dir, "x1"), meta, 0.5, 100.0)
    return rounded(out.select("line", "truth", "pred", "pred_display", "segment"), 4)


@query("""WITH s AS (SELECT count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL AND c_custkey IN (SELECT o_custkey FROM orders)) SELECT r::INT AS "repeat", f::INT AS fold, (n // 5 + (f < n % 5)::INT)::BIGINT AS n FROM s, range(3) a(r), range(5) b(f)""")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _lines(spark, sf_dir, "x1").count()
    return modelling.fold_table(spark, n, 5, 3, 42).groupBy(F.col("repeat").cast("int").alias("repeat"), F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- probes, lists and parts of sets


@query(f"""WITH {LONG}, v AS (SELECT sample, feature // 4 AS gene, CASE WHEN value <= 0.35 THEN value END AS v FROM l) SELECT gene, sample, CASE WHEN count(*) = count(v) THEN round(avg(v), 8) END AS value FROM v GROUP BY ALL""")
def mean_na_propagates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of four probes a gene; one that is missing makes the mean missing."""
    long = features(spark, sf_dir).withColumn("value", F.when(F.col("value") <= 0.35, F.col("value")))
    pairs = spark.range(64).select(F.col("id").cast("int").alias("feature"), F.expr("cast(id div 4 as int)").alias("gene"))
    return rounded(genomics.gene_means(long, pairs, "feature", "gene", "sample", "value", propagate=True), 8)


@query("""WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS a, string_split(upper(p_type), ' ') AS b FROM part) SELECT DISTINCT p_partkey, word, loud FROM (SELECT p_partkey, unnest(a) AS word, unnest(b) AS loud FROM p) WHERE word <> ''""")
def paired_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("word"), F.upper("p_type").alias("loud"))
    return genomics.explode_lists(p, ["p_partkey"], "word", "loud", " ", distinct=True)


@query("""WITH p AS (SELECT p_partkey % 97 AS gene, CASE WHEN p_size < 17 THEN 'low' WHEN p_size < 34 THEN 'mid' ELSE 'high' END AS region, p_retailprice > 1500 AS e FROM part), s AS (SELECT DISTINCT c_mktsegment AS "set", c_custkey % 131 AS gene FROM customer WHERE c_mktsegment IS NOT NULL),
g AS (SELECT gene, count(*) AS n, count(*) FILTER (e) AS e, count(*) FILTER (region = 'low') AS lo, count(*) FILTER (region = 'high') AS hi FROM p GROUP BY 1)
SELECT "set", count(*) AS n_genes, count(n) AS n_genes_any_probe, coalesce(sum(n), 0)::BIGINT AS n_probe_gene_pairs, coalesce(sum(e), 0)::BIGINT AS n_enhancer_probe_gene_pairs, count(*) FILTER (e > 0) AS n_genes_with_enhancer_probe, coalesce(sum(lo), 0)::BIGINT AS region_low, coalesce(sum(hi), 0)::BIGINT AS region_high,
  round(100.0 * count(n) / count(*), 6) AS pct_genes_any_probe, round(100.0 * count(*) FILTER (e > 0) / count(*), 6) AS pct_genes_with_enhancer_probe FROM s LEFT JOIN g USING (gene) GROUP BY 1""")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.when(F.col("p_size") < 17, "low").when(F.col("p_size") < 34, "mid").otherwise("high")
    pairs = table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("gene"), region.alias("region"), (F.col("p_retailprice") > 1500).alias("enhancer"))
    sets = table(spark, sf_dir, "customer").filter("c_mktsegment IS NOT NULL").select(F.col("c_mktsegment").alias("set"), (F.col("c_custkey") % 131).alias("gene"))
    return rounded(genomics.coverage(sets, pairs, "gene", "region", "enhancer", ["low", "high"]))


@query(f"""WITH {RANKS}, m AS (SELECT 'whole' AS "set", unnest(range(0, 64, 4))::INT AS feature UNION ALL SELECT 'one', unnest(range(0, 32, 4))::INT UNION ALL SELECT 'two', unnest(range(32, 64, 4))::INT),
t AS (SELECT sample, count(*) AS n, avg(p) AS m, var_samp(p) AS v FROM r GROUP BY 1), b AS (SELECT sample, "set", (avg(p) - any_value(t.m)) / sqrt(any_value(t.v) / count(*) * (any_value(t.n) - count(*)) / (any_value(t.n) - 1)) AS score FROM r JOIN m USING (feature) JOIN t USING (sample) GROUP BY ALL)
SELECT "set", count(*) AS n, round(corr(score, label), 6) AS r FROM b JOIN embeddings ON vec_id = sample GROUP BY 1""")
def split_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set's score against a response, beside those of its two halves."""
    long = features(spark, sf_dir).withColumnRenamed("feature", "gene")
    ranks = scoring.rank_matrix(long, "sample", "gene", "value")
    every = spark.range(0, 64, 4).select(F.col("id").cast("int").alias("gene"))
    whole = scoring.background_score(ranks, every.withColumn("set", F.lit("up")), "sample", "gene")
    parts = every.withColumn("set", F.when(F.col("gene") < 32, "one").otherwise("two"))
    y = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("double").alias("y"))
    return rounded(stages.split_readouts(whole, ranks, parts, y, "y").drop("p"))
