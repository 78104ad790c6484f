"""The library's operators on the driver's tables, and the same in DuckDB SQL.

Roles: embeddings are samples x features; users (or customers) are lines, event types items;
market segments groups; nations chromosomes; account balances positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.local import to_local
from ..functions.multiplicity import with_bh_q
from ..functions.nulls import nan_to_null
from ..functions.ranks import bin_edges, keep_first, ordinal_bin, spearman, value_bin
from ..operators import genesets, genomics, relational, scoring, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, feature, value of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return nan_to_null(e.select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double")))


LONG = "l AS (SELECT vec_id AS sample, unnest(range(len(embedding)))::INT AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"
RANKS = LONG + """, r AS (SELECT sample, feature, value, (rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0::DOUBLE)
  / count(value) OVER (PARTITION BY sample) AS p FROM l)"""
SETS = "s AS (SELECT 'up' AS \"set\", unnest(range(0, 64, 4))::INT AS feature UNION ALL SELECT 'down', unnest(range(1, 64, 5))::INT)"


def module_sets(spark: SparkSession) -> DataFrame:
    up = spark.range(0, 64, 4).select(F.lit("up").alias("set"), F.col("id").cast("int").alias("feature"))
    return up.unionByName(spark.range(1, 64, 5).select(F.lit("down").alias("set"), F.col("id").cast("int").alias("feature")))


# ---------------------------------------------------------------- scores

SCORES = f"""{RANKS}, {SETS}, t AS (SELECT sample, count(*) AS n, avg(p) AS m, var_samp(p) AS v FROM r GROUP BY sample),
k AS (SELECT sample, "set", count(*) AS k, avg(p) AS mp FROM r JOIN s USING (feature) GROUP BY ALL),
b AS (SELECT sample, "set", k, (mp - m) / nullif(sqrt(v / k * (n - k) / (n - 1.0::DOUBLE)), 0) AS score FROM k JOIN t USING (sample))"""


@query(f'WITH {SCORES} SELECT sample, "set", k, round(score, 6) AS score FROM b')
def background_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scoring.rank_matrix(features(spark, sf_dir), "sample", "feature", "value")
    return rounded(scoring.background_score(r, module_sets(spark), "sample", "feature"))


@query(f"""WITH {SCORES} SELECT sample, 'both' AS "set", round(u.score - d.score, 6) AS score FROM (FROM b WHERE "set" = 'up') u JOIN (FROM b WHERE "set" = 'down') d USING (sample)""")
def bidirectional_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scoring.rank_matrix(features(spark, sf_dir), "sample", "feature", "value")
    s = scoring.background_score(r, module_sets(spark), "sample", "feature")
    return rounded(scoring.up_down(s, "sample", "up", "down", "both"))


@query(f"""WITH {RANKS}, {SETS}, o AS (SELECT sample, feature, count(*) OVER w0 AS n, row_number() OVER (PARTITION BY sample ORDER BY p DESC, feature) AS i FROM r WINDOW w0 AS (PARTITION BY sample)),
g AS (SELECT o.*, pow((n - i + 1)::DOUBLE, 0.25) AS w, q."set", EXISTS (FROM s WHERE s."set" = q."set" AND s.feature = o.feature) AS has FROM o, (SELECT DISTINCT "set" FROM s) q),
c AS (SELECT sample, "set", sum(CASE WHEN has THEN w ELSE 0 END) OVER x / sum(CASE WHEN has THEN w ELSE 0 END) OVER a - sum(CASE WHEN has THEN 0 ELSE 1.0::DOUBLE END) OVER x / sum(CASE WHEN has THEN 0 ELSE 1.0::DOUBLE END) OVER a AS d
  FROM g WINDOW x AS (PARTITION BY sample, "set" ORDER BY i ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY sample, "set")),
e AS (SELECT sample, "set", sum(d) AS raw FROM c GROUP BY ALL)
SELECT sample, "set", round(raw / nullif(max(raw) OVER (PARTITION BY "set") - min(raw) OVER (PARTITION BY "set"), 0), 6) AS score FROM e""")
def ssgsea(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scoring.rank_matrix(features(spark, sf_dir), "sample", "feature", "value")
    return rounded(scoring.ssgsea(r, module_sets(spark), "sample", "feature"))


@query(f"""WITH {LONG}, z AS (SELECT sample, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM l WHERE feature < 4 WINDOW w AS (PARTITION BY feature)),
m AS (SELECT sample, avg(z) AS m FROM z GROUP BY sample) SELECT sample, round((m - avg(m) OVER ()) / nullif(stddev_pop(m) OVER (), 0), 6) AS score FROM m""")
def four_gene_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.mean_of_z(features(spark, sf_dir).filter("feature < 4"), "sample", "feature", "value"))


EDGES = "e AS (SELECT 'tf' || (i % 4) AS source, (i % 64)::INT AS feature, CASE WHEN i % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM range(0, 64) t(i))"


@query(f"""WITH {LONG}, {EDGES}, x AS (SELECT sample, source, value AS y, coalesce(weight, 0) AS w FROM l CROSS JOIN (SELECT DISTINCT source FROM e) q LEFT JOIN e USING (source, feature)),
g AS (SELECT sample, source, count(*) AS n, corr(w, y) AS r FROM x GROUP BY ALL) SELECT sample, source, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM g""")
def ulm_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    e = spark.range(64).select(F.concat(F.lit("tf"), (i % 4).cast("string")).alias("source"), i.cast("int").alias("feature"), F.when(i % 3 == 0, -1.0).otherwise(1.0).alias("weight"))
    return rounded(scoring.ulm_activity(features(spark, sf_dir), e, "sample", "feature", "value"))


# ---------------------------------------------------------------- lines and items

CELLS = "c AS (SELECT user_id, event_type, avg(value) AS value FROM events GROUP BY ALL)"


@query(f"""WITH {CELLS}, z AS (SELECT user_id, event_type, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY event_type))
SELECT user_id, round(avg(z), 6) AS general FROM z WHERE n >= 20 AND event_type <> 'purchase' GROUP BY user_id""")
def general_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.general_axis(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "purchase", 20))


@query(f"""WITH {CELLS} SELECT a.event_type, count(*) AS n, round(corr(a.value, b.value), 6) AS r FROM c a JOIN c b USING (user_id) WHERE a.event_type <> 'purchase' AND b.event_type = 'purchase' GROUP BY 1""")
def drug_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.similarity(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "purchase"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE ((l_partkey * 7919 + l_orderkey * 31) % 1000 + 1) / 1001.0::DOUBLE END AS p FROM lineitem),
k AS (SELECT *, count(p) OVER (PARTITION BY l_returnflag) AS m, rank() OVER (PARTITION BY l_returnflag ORDER BY p) + count(*) OVER (PARTITION BY l_returnflag, p) - 1 AS i FROM p WHERE p IS NOT NULL)
SELECT l_orderkey, l_linenumber, round(least(1.0::DOUBLE, min(p * m / i) OVER (PARTITION BY l_returnflag ORDER BY p DESC)), 6) AS q FROM k UNION ALL SELECT l_orderkey, l_linenumber, NULL FROM p WHERE p IS NULL""")
def bh_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("l_partkey") % 50 == 0, None).otherwise(((F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31) % 1000 + 1) / F.lit(1001.0))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", p.alias("p"))
    return rounded(with_bh_q(df, "p", "q", "l_returnflag").select("l_orderkey", "l_linenumber", "q"))


def _screen(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status)
    return o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("value"))


SCREENS = """a AS (SELECT o_custkey, avg(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey, avg(o_totalprice) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
x AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM a JOIN b USING (o_custkey))"""


@query(f"WITH {SCREENS} SELECT count(*) AS n, round(corr(a, b), 6) AS r, round(corr(ra, rb), 6) AS rho FROM x")
def screen_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _screen(spark, sf_dir, "O"), _screen(spark, sf_dir, "F")
    return rounded(stats.screen_agreement(a, b, "o_custkey", "value").select("n", "r", "rho"))


@query("""WITH x AS (SELECT l_returnflag, l_extendedprice AS t, l_quantity * 1500 AS p FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY t) + (count(*) OVER (PARTITION BY l_returnflag, t) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY l_returnflag ORDER BY p) + (count(*) OVER (PARTITION BY l_returnflag, p) - 1) / 2.0 AS rp FROM x)
SELECT l_returnflag, count(*) AS n, round(corr(t, p), 6) AS r, round(corr(rt, rp), 6) AS rho, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) AS r2, round(sqrt(avg((t - p) * (t - p))), 4) AS rmse, round(avg(p - t), 4) AS bias FROM r GROUP BY 1""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("p"))
    m = relational.regression_metrics(df, "t", "p", "l_returnflag")
    return m.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("r", "rho", "r2")], *[F.round(c, 4).alias(c) for c in ("rmse", "bias")])


@query("""WITH x AS (SELECT c_mktsegment AS g, avg(o_totalprice) AS t, any_value(c_acctbal) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment),
m AS (SELECT *, avg(t) OVER (PARTITION BY g) AS mt, avg(p) OVER (PARTITION BY g) AS mp, count(*) OVER (PARTITION BY g) AS k FROM x WHERE g IS NOT NULL), y AS (FROM m WHERE k >= 10), q AS (SELECT g, any_value(mt) AS mt, any_value(mp) AS mp FROM y GROUP BY g)
SELECT (SELECT count(*) FROM y) AS n, (SELECT count(*) FROM q) AS n_groups, round((SELECT corr(mt, mp) FROM q), 6) AS r_between, round((SELECT sum((t - mt) * (p - mp)) / sqrt(sum((t - mt) ** 2) * sum((p - mp) ** 2)) FROM y), 6) AS r_within""")
def between_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    per = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("t")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("g"), "t", F.col("c_acctbal").alias("p"))
    out = relational.between_within(per, "t", "p", "g")
    return rounded(out.select(F.col("n").cast("long").alias("n"), "n_groups", "r_between", "r_within"))


GAPS = "x AS (SELECT user_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events WHERE (user_id + length(event_type)) % 4 <> 0)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter((F.col("user_id") + F.length("event_type")) % 4 != 0)
    return e.select("user_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))


@query(f"WITH {GAPS} SELECT event_type, count(DISTINCT CASE WHEN value IS NOT NULL THEN user_id END) AS n FROM x GROUP BY 1 HAVING ((SELECT count(DISTINCT user_id) FROM x) - count(DISTINCT CASE WHEN value IS NOT NULL THEN user_id END)) / (SELECT count(DISTINCT user_id) FROM x) <= 0.3")
def missing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.missing_filter(_gaps(spark, sf_dir), "user_id", "event_type", "value", 0.3)


@query(f"""WITH {GAPS}, m AS (SELECT event_type, median(value) AS med FROM x GROUP BY 1), c AS (SELECT user_id, event_type, avg(value) AS value FROM x GROUP BY ALL)
SELECT user_id, event_type, round(coalesce(value, med), 6) AS value FROM (SELECT DISTINCT user_id FROM x) CROSS JOIN m LEFT JOIN c USING (user_id, event_type)""")
def median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.median_fill(_gaps(spark, sf_dir), "user_id", "event_type", "value"))


@query("""SELECT l_returnflag, count(*) AS n, round((corr(l_quantity, l_discount) - corr(l_quantity, l_extendedprice) * corr(l_discount, l_extendedprice)) / sqrt((1 - corr(l_quantity, l_extendedprice) ** 2) * (1 - corr(l_discount, l_extendedprice) ** 2)), 6) AS r FROM lineitem GROUP BY 1""")
def partial_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.partial_corr_1(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", "l_returnflag").drop("p"))


@query("""WITH g AS (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1) SELECT l_returnflag, n, round(r, 6) AS r, round(tanh(atanh(r) - 1.96 / sqrt(n - 4.0)), 6) AS lo, round(tanh(atanh(r) + 1.96 / sqrt(n - 4.0)), 6) AS hi FROM g""")
def fisher_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stats.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag").drop("p")
    lo, hi = stats.fisher_ci("r", "n", 1)
    return rounded(g.select("*", lo.alias("lo"), hi.alias("hi")))


@query("""SELECT o_orderkey, round(o_totalprice - (regr_intercept(o_totalprice, d) OVER w + regr_slope(o_totalprice, d) OVER w * d), 4) AS residual
FROM (SELECT o_orderkey, o_orderpriority, o_totalprice, (o_custkey % 97)::DOUBLE AS d FROM orders) WINDOW w AS (PARTITION BY o_orderpriority)""")
def residual_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", (F.col("o_custkey") % 97).cast("double"))
    return rounded(stats.residual_axis(o, "o_totalprice", "d", "o_orderpriority").select("o_orderkey", "residual"), 4)


@query("SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS grp FROM customer WHERE coalesce(nullif(c_mktsegment, 'MACHINERY') NOT IN ('BUILDING', 'FURNITURE'), true)")
def exclude_keeps_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("grp"))
    return relational.exclude(c, "grp", ["BUILDING", "FURNITURE"])


@query("""SELECT band, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT CASE WHEN v <= 0.9 THEN 'responsive' WHEN v <= 0.95 THEN 'middle' ELSE 'ceiling' END AS band, v FROM (SELECT l_quantity / 50.0 AS v FROM lineitem)) GROUP BY 1 HAVING count(*) > 10""")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.bands(table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50.0).alias("v")), "v"))


@query("SELECT l_returnflag, count(*) AS n, round(100 * avg(CASE WHEN ln(l_extendedprice) > ln(l_quantity * 1000) THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct FROM lineitem GROUP BY 1")
def beyond_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.ln("l_extendedprice").alias("ic"), (F.col("l_quantity") * 1000).alias("mx"))
    flag = relational.beyond_range("ic", "mx")
    return rounded(li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(flag.cast("double"))).alias("pct")))


@query("SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS \"view\" FROM events GROUP BY 1")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.wide(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["click", "view"]))


@query("""SELECT c_custkey, coalesce(max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END), 0)::INT AS "1-URGENT", coalesce(max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END), 0)::INT AS "2-HIGH" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def flag_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    m = relational.flag_matrix(table(spark, sf_dir, "orders"), ids, "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "no such"])
    return m.withColumnRenamed("o_custkey", "c_custkey")


@query("""WITH g AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS d, count(*) FILTER (l_returnflag = 'A') AS p FROM lineitem GROUP BY 1)
SELECT l_partkey, d AS n_distal, p AS n_promoter, round(d / (p + 1), 6) AS distal_ratio, round(d / nullif(d + p, 0), 6) AS distal_fraction FROM g""")
def region_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.region_shares(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", "R", "A"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def keep_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(table(spark, sf_dir, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, arg_min(nullif(o_orderpriority, '1-URGENT'), o_orderkey) FILTER (o_orderpriority <> '1-URGENT') AS pri, round(avg(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY 1")
def collapse_drug(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("pri", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return rounded(relational.collapse_drug(o, "o_custkey", ["pri"], ["o_totalprice"], "o_orderkey"))


@query("""WITH p AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS gene FROM part) SELECT gene, l_suppkey, round(avg(l_quantity), 6) AS l_quantity FROM lineitem JOIN p ON l_partkey = p_partkey WHERE gene <> '' GROUP BY ALL""")
def probe_gene_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("gene"), F.col("p_name").alias("region"))
    pairs = genomics.explode_lists(part, ["l_partkey"], "gene", "region", " ")
    return rounded(genomics.gene_means(table(spark, sf_dir, "lineitem"), pairs, "l_partkey", "gene", "l_suppkey", "l_quantity"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(l_tax >= 0.06, false) THEN NULL ELSE round(log2(b / (1 - b)), 6) END AS m FROM (SELECT *, greatest(least(l_discount * 10, 1 - 1e-4), 1e-4) AS b FROM lineitem)""")
def masked_m_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("beta", F.col("l_discount") * 10)
    li = li.withColumn("masked", genomics.mask_detection("beta", "l_tax", 0.06))
    return rounded(li.select("l_orderkey", "l_linenumber", genomics.m_value("masked").alias("m")))


POINTS = """p AS (SELECT c_nationkey AS chrom, (c_acctbal * 100)::BIGINT AS x, min(c_name) AS name FROM customer GROUP BY ALL), q AS (SELECT s_suppkey, s_nationkey AS chrom, (s_acctbal * 100)::BIGINT AS x FROM supplier)"""


@query(f"""WITH {POINTS} SELECT s_suppkey, q.chrom, q.x AS pos, p.name, abs(p.x - q.x) AS distance FROM q LEFT JOIN p ON p.chrom = q.chrom QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(p.x - q.x), p.x) = 1""")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = lambda c: F.round(F.col(c) * 100).cast("long").alias("pos")
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("chrom"), pos("c_acctbal"), F.col("c_name").alias("name"))
    q = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("chrom"), pos("s_acctbal"))
    return genomics.nearest_point(q, p, "chrom", "pos", "name", ["s_suppkey"])


@query("""WITH a AS (SELECT s_suppkey, s_nationkey AS chrom, (s_acctbal * 100)::BIGINT AS s, (s_acctbal * 100)::BIGINT + 40000 AS e FROM supplier), b AS (SELECT c_name, c_nationkey AS chrom, (c_acctbal * 100)::BIGINT AS s, (c_acctbal * 100)::BIGINT + (c_custkey % 50) * 1000 AS e FROM customer)
SELECT s_suppkey, c_name, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM a JOIN b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e AND b.e > b.s QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY least(a.e, b.e) - greatest(a.s, b.s) DESC, c_name) = 1""")
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = lambda c: F.round(F.col(c) * 100).cast("long")
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("chrom"), pos("s_acctbal").alias("start"), (pos("s_acctbal") + 40000).alias("end"))
    b = table(spark, sf_dir, "customer").select("c_name", F.col("c_nationkey").alias("chrom"), pos("c_acctbal").alias("start"), (pos("c_acctbal") + F.col("c_custkey") % 50 * 1000).alias("end"))
    return genomics.best_overlap(a, b, "s_suppkey", "c_name")


# ---------------------------------------------------------------- sets

UNIVERSE = "u AS (SELECT DISTINCT upper(unnest(string_split(p_name, ' '))) AS gene FROM part), al AS (SELECT DISTINCT lower(gene) AS alias, gene AS symbol FROM u WHERE length(gene) % 2 = 0), st AS (SELECT DISTINCT p_brand AS \"set\", CASE WHEN p_size % 2 = 0 THEN lower(g) ELSE upper(g) END AS gene FROM (SELECT p_brand, p_size, unnest(string_split(p_name, ' ')) AS g FROM part))"


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    words = part.select("p_brand", "p_size", F.explode(F.split("p_name", " ")).alias("g"))
    u = words.select(F.upper("g").alias("gene")).distinct()
    al = u.filter(F.length("gene") % 2 == 0).select(F.lower("gene").alias("alias"), F.col("gene").alias("symbol"), F.lit(0).alias("ordinal"))
    st = words.select(F.col("p_brand").alias("set"), F.when(F.col("p_size") % 2 == 0, F.lower("g")).otherwise(F.upper("g")).alias("gene")).distinct()
    return st, u, al


@query(f"""WITH {UNIVERSE}, d AS (SELECT "set", gene, 'direct' AS how FROM st WHERE gene IN (SELECT gene FROM u)),
k AS (SELECT coalesce(symbol, gene) AS canon, min(gene) AS name FROM u LEFT JOIN al ON alias = gene GROUP BY 1 HAVING count(*) = 1),
x AS (SELECT "set", name AS gene, 'alias' AS how FROM (SELECT "set", coalesce(symbol, gene) AS canon FROM st LEFT JOIN al ON alias = gene WHERE gene NOT IN (SELECT gene FROM u)) JOIN k USING (canon))
SELECT "set", gene, max(how) AS how FROM (FROM d UNION ALL FROM x) GROUP BY 1, 2""")
def resolve_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genesets.resolve_sets(*_sets(spark, sf_dir))


@query(f"""WITH {UNIVERSE} SELECT a."set" AS set_a, b."set" AS set_b, count(*) AS shared, any_value((SELECT count(*) FROM st x WHERE x."set" = a."set")) AS n_a, any_value((SELECT count(*) FROM st x WHERE x."set" = b."set")) AS n_b FROM st a JOIN st b ON a.gene = b.gene AND a."set" < b."set" GROUP BY 1, 2""")
def set_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genesets.overlap_sizes(_sets(spark, sf_dir)[0])




@query(f"""WITH {UNIVERSE}, q AS (SELECT gene FROM u WHERE length(gene) > 5), s AS (SELECT DISTINCT "set", gene FROM st WHERE gene IN (SELECT gene FROM u)), c AS (SELECT "set", count(s.gene) AS b, count(*) FILTER (s.gene IN (SELECT gene FROM q)) AS k FROM (SELECT DISTINCT "set" FROM st) LEFT JOIN s USING ("set") GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM u)::DOUBLE AS u, (SELECT count(*) FROM q)::DOUBLE AS a)
SELECT "set", u::BIGINT AS universe_size, b AS signature_size, a::BIGINT AS query_size, k AS observed, round(nullif(a * b / u, 0), 6) AS expected, round(k / nullif(a * b / u, 0), 6) AS fold,
round(CASE WHEN b > 0 THEN least(1.0, (SELECT sum(exp(lgamma(a + 1) - lgamma(i + 1) - lgamma(a - i + 1) + lgamma(u - a + 1) - lgamma(b - i + 1) - lgamma(u - a - b + i + 1) - lgamma(u + 1) + lgamma(b + 1) + lgamma(u - b + 1))) FROM range(0, 100) t(i) WHERE i >= greatest(k, a + b - u) AND i <= least(a, b))) END, 6) AS p_value FROM c, n""")
def set_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    st, u, _ = _sets(spark, sf_dir)
    e = stats.enrichment(u.filter(F.length("gene") > 5), st, u, "gene")
    return rounded(e.select("set", F.col("universe_size").cast("long").alias("universe_size"), "signature_size", F.col("query_size").cast("long").alias("query_size"), "observed", "expected", "fold", "p_value"))


@query(f"""WITH {UNIVERSE} SELECT "set", count(*) AS n_listed, count(*) FILTER (gene IN (SELECT gene FROM u)) AS n_found, round(100.0 * count(*) FILTER (gene IN (SELECT gene FROM u)) / count(*), 6) AS pct FROM st GROUP BY 1""")
def set_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    st, u, _ = _sets(spark, sf_dir)
    return rounded(genesets.recovery(st, st.join(u, "gene", "left_semi")))


# ---------------------------------------------------------------- bins, ranks, trends


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey, greatest(ceil(i * 10.0::DOUBLE / (n - 1)) - 1, 0)::INT AS bin FROM r""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ordinal_bin([F.asc("p_retailprice"), F.asc("p_partkey")], 10).alias("bin"))


@query("""WITH e AS (SELECT list_sort(list_distinct([quantile_cont(v, 0.0), quantile_cont(v, 0.2), quantile_cont(v, 0.4), quantile_cont(v, 0.6), quantile_cont(v, 0.8), quantile_cont(v, 1.0)])) AS e FROM (SELECT p_size::DOUBLE AS v FROM part))
SELECT p_partkey, greatest(len(list_filter(e, lambda x: x < p_size)) - 1, 0)::INT AS bin FROM part, e""")
def value_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", value_bin("p_size", bin_edges(p, "p_size", 5)).alias("bin"))


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events) SELECT event_type, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spearman(table(spark, sf_dir, "events"), "value", "user_id", "event_type"))


DAYS = "x AS (SELECT event_type, (day(ts) % 4) * 16 AS h, value FROM events)"


@query(f"""WITH {DAYS}, r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY h) + (count(*) OVER (PARTITION BY event_type, h) - 1) / 2.0 AS b FROM x),
g AS (SELECT event_type, count(*) AS n, corr(h, value) AS trend_r, corr(a, b) AS spearman, avg(value) FILTER (h = 0) AS m0, avg(value) FILTER (h = 48) AS m1, stddev_samp(value) FILTER (h = 0) AS s0, stddev_samp(value) FILTER (h = 48) AS s1, count(*) FILTER (h = 0) AS n0, count(*) FILTER (h = 48) AS n1 FROM r GROUP BY 1)
SELECT event_type, n, round(trend_r, 6) AS trend_r, round(spearman, 6) AS spearman, round(m1 - m0, 6) AS delta, round((m1 - m0) / sqrt((s0 ** 2 + s1 ** 2) / 2), 6) AS cohens_d, round((m1 - m0) / sqrt(((n0 - 1) * s0 ** 2 + (n1 - 1) * s1 ** 2) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 6) AS t, (n0 + n1 - 2)::DOUBLE AS t_df, round(m0, 6) AS mean_first, round(m1, 6) AS mean_last, round(s0, 6) AS sd_first, round(s1, 6) AS sd_last FROM g""")
def trend_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.dayofmonth("ts") % 4 * 16).alias("h"), "value")
    return rounded(scoring.trend_stats(e, "event_type", "h", "value"))


@query(f"""WITH {DAYS}, m AS (SELECT event_type, h, avg(value) AS mean FROM x GROUP BY ALL) SELECT event_type, h::INT AS h, round(mean, 6) AS mean, round(mean - first_value(mean) OVER (PARTITION BY event_type ORDER BY h), 6) AS shift FROM m""")
def baseline_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.dayofmonth("ts") % 4 * 16).alias("h"), "value")
    return rounded(relational.baseline_shift(e, "event_type", "h", "value"))


@query("""WITH g AS (SELECT count(*) FILTER (toxic = 0) AS n_a, count(*) FILTER (toxic = 1) AS n_b, avg(quality) FILTER (toxic = 0) AS a, avg(quality) FILTER (toxic = 1) AS b, var_samp(quality) FILTER (toxic = 0) AS va, var_samp(quality) FILTER (toxic = 1) AS vb FROM labels)
SELECT n_a, n_b, round(b - a, 6) AS diff, round((b - a) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b)), 6) AS t, (n_a + n_b - 2)::DOUBLE AS df, round((b - a) / sqrt((va + vb) / 2), 6) AS cohens_d FROM g""")
def two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.two_sample(table(spark, sf_dir, "labels"), "toxic", "quality", 0, 1).drop("p"))


@query("""WITH x AS (SELECT c_custkey, c_acctbal AS y, avg(o_totalprice) AS p, c_custkey % 5 <> 0 AS e FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL), j AS (SELECT a.p AS pa, b.p AS pb FROM x a JOIN x b ON a.y < b.y WHERE a.e)
SELECT count(*)::DOUBLE AS pairs, round(sum(CASE WHEN pa < pb THEN 1.0::DOUBLE WHEN pa = pb THEN 0.5 ELSE 0 END) / count(*), 6) AS concordance FROM j""")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    x = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("p")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_acctbal").alias("y"), "p", (F.col("c_custkey") % 5 != 0).alias("e"))
    return rounded(stats.concordance(x, "y", "p", "e"))


@query("""WITH d AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderstatus = 'O') / 1000 - avg(o_totalprice) FILTER (o_orderstatus = 'F') / 1000 AS d FROM orders GROUP BY o_orderpriority, o_custkey % 25),
g AS (SELECT o_orderpriority, count(d) AS n_splits, avg(d) AS m, var_samp(d) AS v FROM d GROUP BY 1) SELECT o_orderpriority, n_splits, round(m, 6) AS mean_diff, round(m / sqrt(v * (1.0::DOUBLE / n_splits + 0.25)), 6) AS t FROM g""")
def corrected_ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))) / 1000
    d = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_custkey") % 25).alias("k")).agg((at("O") - at("F")).alias("d"))
    return rounded(stats.corrected_ttest(d, "d", 80, 20, "o_orderpriority").drop("p"))


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem WHERE l_orderkey % 2 = 0) SELECT count(*) AS n, round(any_value(b), 4) AS slope, round(any_value(a), 4) AS intercept, round(corr(l_extendedprice, a + b * l_quantity), 6) AS r, round(sqrt(avg((l_extendedprice - a - b * l_quantity) ** 2)), 4) AS rmse FROM lineitem, f WHERE l_orderkey % 2 = 1""")
def affine_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    b, a, _ = stats.affine_fit(li.filter("l_orderkey % 2 = 0"), "l_quantity", "l_extendedprice")
    test = li.filter("l_orderkey % 2 = 1").withColumn("pred", F.lit(a) + F.lit(b) * F.col("l_quantity"))
    m = relational.regression_metrics(test, "l_extendedprice", "pred")
    return m.select("n", F.round(F.lit(b), 4).alias("slope"), F.round(F.lit(a), 4).alias("intercept"), F.round("r", 6).alias("r"), F.round("rmse", 4).alias("rmse"))


@query(f"""WITH {LONG}, y AS (SELECT vec_id AS sample, label::DOUBLE AS y, (row_number() OVER (ORDER BY vec_id) - 1) % 5 AS fold FROM embeddings),
g AS (SELECT f.fold, feature, abs(corr(value, y)) AS r FROM l JOIN y USING (sample) JOIN (SELECT unnest(range(5)) AS fold) f ON y.fold <> f.fold GROUP BY ALL)
SELECT 0 AS "repeat", fold::INT AS fold, feature FROM g QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(r, 10) DESC, feature) <= 8""")
def screen_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.modelling import screen_by_fold as screen

    e = table(spark, sf_dir, "embeddings")
    target = e.select(F.col("vec_id").alias("sample"), F.col("label").cast("double").alias("y"), (F.row_number().over(W.orderBy("vec_id")) - 1).alias("row_ix"))
    folds = target.select(F.lit(0).alias("repeat"), "row_ix", (F.col("row_ix") % 5).cast("int").alias("fold"))
    return screen(features(spark, sf_dir), target, folds, "sample", "feature", "value", "y", 8)


@query(f"WITH {LONG} SELECT feature, round(var_samp(value), 8) AS variance FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.top_by_variance(features(spark, sf_dir), "feature", "value", 10), 8)


@query("""WITH p AS (SELECT *, p_size % 7 = 0 AS x, p_size % 5 = 0 AS s, p_brand IN ('Brand#11', 'Brand#12') AS c FROM part) SELECT unnest(['all', 'cross_reactive', 'snp', 'sex', 'kept']) AS filter, unnest([count(*), count(*) FILTER (x), count(*) FILTER (s), count(*) FILTER (c), count(*) FILTER (NOT x AND NOT s AND NOT c)]) AS n FROM p""")
def probe_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("chrom", F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), "chrX").otherwise("chr1"))
    return genomics.keep_probes(p, "p_partkey", p.filter("p_size % 7 = 0"), p.filter("p_size % 5 = 0"), "chrom")[1]


@query("""SELECT s_suppkey, arg_min(c_custkey, c_custkey) AS model_id FROM supplier LEFT JOIN customer ON upper(regexp_replace(right(s_name, 5), '[^A-Za-z0-9]', '', 'g')) = upper(regexp_replace(right(c_name, 5), '[^A-Za-z0-9]', '', 'g')) GROUP BY 1""")
def lookup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_id"), F.right("c_name", F.lit(5)).alias("model_name"), F.lit("").alias("synonyms"))
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", F.right("s_name", F.lit(5)).alias("name"))
    return relational.lookup_names(wanted, "name", models).select("s_suppkey", "model_id")


@query(f"""WITH {LONG}, y AS (SELECT vec_id AS sample, label AS g, (row_number() OVER (ORDER BY vec_id) - 1) % 5 AS fold FROM embeddings),
t AS (SELECT g, avg(value) AS m, stddev_samp(value) AS s FROM l JOIN y USING (sample) WHERE feature = 0 AND fold <> 0 GROUP BY 1)
SELECT sample, round((value - m) / nullif(s, 0), 6) AS z FROM l JOIN y USING (sample) JOIN t USING (g) WHERE feature = 0""")
def deconfounded_in_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").alias("g"), F.col("embedding")[0].cast("double").alias("v"))
    e = e.withColumn("fold", (F.row_number().over(W.orderBy("sample")) - 1) % 5)
    w, train = W.partitionBy("g"), F.when(F.col("fold") != 0, F.col("v"))
    z = F.try_divide(F.col("v") - F.avg(train).over(w), F.nullif(F.stddev_samp(train).over(w), F.lit(0.0)))
    return rounded(e.select("sample", z.alias("z")))


# ---------------------------------------------------------------- resampling and models: tested in tests/


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = F.col("embedding").cast("array<double>")
    y = x[0] * 2 + x[1] - x[2] * 1.5 + F.col("label") * 0.05
    return e.select(F.col("vec_id").alias("model_id"), x.alias("features"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("lineage"), y.alias("y"))


@query()
def cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.modelling import ElasticNet, cross_validate_long

    c = _cohort(spark, sf_dir)
    long = c.select("model_id", F.posexplode("features").alias("feature", "value"))
    return cross_validate_long(long, c.select("model_id", "lineage", "y"), "model_id", "feature", "value", "y", ElasticNet, "lineage", True)
