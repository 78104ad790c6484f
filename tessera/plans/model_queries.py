"""Models, batch adjustment, components, bootstraps and nulls on the driver's tables, with the same in DuckDB SQL:
Newton steps and fixed points are unrolled, draws are listed by the same checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjustment, components, draws, regression, scoring, set_tests
from ..operators.modelling import RIDGE_ALPHAS
from .queries import LONG, RANKS, features, query, rounded, table

# ---------------------------------------------------------------- batches and components


@query(f"""WITH {LONG}, m AS (SELECT feature, label % 3 AS b, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l JOIN embeddings ON vec_id = sample GROUP BY ALL),
g AS (SELECT feature, sum(n * m) / sum(n) AS grand, sqrt(sum(n * v) / sum(n)) AS sd FROM m GROUP BY 1),
h AS (SELECT feature, b, n, grand, sd, (m - grand) / sd AS g, n * v / (n - 1) / (sd * sd) AS d FROM m JOIN g USING (feature)),
p AS (SELECT b, avg(g) AS gb, var_samp(g) AS t2, (2 * var_samp(d) + avg(d) ** 2) / var_samp(d) AS a, (avg(d) * var_samp(d) + avg(d) ** 3) / var_samp(d) AS c FROM h GROUP BY 1),
f AS (SELECT feature, b, grand, sd, list_reduce(list_prepend({{'g': g, 'd': d}}, list_transform(range(200), lambda i: {{'g': 0.0::DOUBLE, 'd': 0.0::DOUBLE}})),
  lambda s, i: {{'g': (n * t2 * g + s.d * gb) / (n * t2 + s.d), 'd': (0.5::DOUBLE * ((n - 1) * d + n * (g - (n * t2 * g + s.d * gb) / (n * t2 + s.d)) ** 2) + c) / (n / 2.0::DOUBLE + a - 1)}}) AS s FROM h JOIN p USING (b))
SELECT feature, sample, round(((value - grand) / sd - s.g) / sqrt(s.d) * sd + grand, 8) AS value FROM l JOIN embeddings ON vec_id = sample JOIN f USING (feature) WHERE f.b = label % 3""")
def batch_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), (F.col("label") % 3).alias("batch"))
    return rounded(adjustment.batch_adjusted(features(spark, sf_dir), "feature", "sample", "value", batch), 8)


_SQUARED = "list_transform({m}, lambda r: list_transform({m}, lambda c: list_dot_product(r, c) / list_sum(list_transform(range(1, len({m}) + 1), lambda i: list_dot_product({m}[i], {m}[i])))))"


@query(f"""WITH RECURSIVE {LONG}, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM l GROUP BY 1),
z AS (SELECT sample, list((value - m) / s ORDER BY feature) AS z FROM l JOIN s USING (feature) GROUP BY 1),
c AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM (SELECT i, j, sum(z[i] * z[j]) AS v FROM z, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL) GROUP BY 1)),
p AS (SELECT 0 AS k, m AS q FROM c UNION ALL SELECT k + 1, {_SQUARED.format(m="q")} FROM p WHERE k < 24),
v1 AS (SELECT list_transform(q[1], lambda x: x / sqrt(list_dot_product(q[1], q[1]))) AS v FROM p WHERE k = 24),
l1 AS (SELECT v, list_sum(list_transform(range(1, 65), lambda i: v[i] * list_dot_product(m[i], v))) AS e FROM v1, c),
d AS (SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: m[i][j] - e * v[i] * v[j])) AS m FROM c, l1),
p2 AS (SELECT 0 AS k, m AS q FROM d UNION ALL SELECT k + 1, {_SQUARED.format(m="q")} FROM p2 WHERE k < 24),
v2 AS (SELECT list_transform(q[1], lambda x: x / sqrt(list_dot_product(q[1], q[1]))) AS v FROM p2 WHERE k = 24),
w AS (SELECT list_transform(v1.v, lambda x: x * sign(list_reduce(v1.v, lambda a, b: CASE WHEN abs(b) > abs(a) THEN b ELSE a END))) AS a, list_transform(v2.v, lambda x: x * sign(list_reduce(v2.v, lambda a, b: CASE WHEN abs(b) > abs(a) THEN b ELSE a END))) AS b FROM v1, v2)
SELECT sample, round(list_dot_product(z, a), 4) AS "PC1", round(list_dot_product(z, b), 4) AS "PC2" FROM z, w""")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL squares the Gram matrix until its columns are the first component, takes that out, and does it again."""
    return rounded(components.pca(features(spark, sf_dir), "sample", "feature", "value")[0], 4)


# ---------------------------------------------------------------- logistic models and their null

#: Newton steps of y on 1, a control and a standardised score (columns of d: k, x, s, y), by Cramer's rule.
_NEWTON = """n AS (SELECT 0 AS step, k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, NULL::DOUBLE AS v FROM (SELECT DISTINCT k FROM d) UNION ALL
  SELECT step + 1, k, b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / e, b1 + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / e,
    b2 + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / e, (h00 * h11 - h01 * h01) / e
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS e FROM (
    SELECT any_value(step) AS step, k, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum((y - p) * s) AS g2, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * s) AS h02,
      sum(p * (1 - p) * x * x) AS h11, sum(p * (1 - p) * x * s) AS h12, sum(p * (1 - p) * s * s) AS h22
    FROM (SELECT n.step, n.k, b0, b1, b2, x, s, y, 1 / (1 + exp(-(b0 + b1 * x + b2 * s))) AS p FROM n JOIN d ON d.k = n.k WHERE step < 9) GROUP BY k)))"""


def _responders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), (F.col("label") >= 5).cast("int").alias("y"), (F.col("vec_id") % 7).cast("double").alias("c"))


@query(f"""WITH RECURSIVE {LONG}, d AS (SELECT feature AS k, vec_id % 7 AS x, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS s, (label >= 5)::INT AS y FROM l JOIN embeddings ON vec_id = sample WINDOW w AS (PARTITION BY feature)), {_NEWTON}
SELECT k AS feature, (SELECT count(*) FROM embeddings) AS n, round(b2, 6) AS coef, round(b2 / sqrt(v), 6) AS z, round(exp(b2), 6) AS odds, 'ok' AS status FROM n WHERE step = 9""")
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = regression.logistic(features(spark, sf_dir), _responders(spark, sf_dir), "y", ["c"], score="value")
    return rounded(fits.select("feature", "n", "coef", "z", "odds", "status"))


_UP, _DOWN = list(range(0, 64, 4)), list(range(1, 64, 5))
_SCORED = """t AS (SELECT sample, count(*) AS n, avg(p) AS m, var_samp(p) AS v FROM r GROUP BY 1),
b AS (SELECT sample, k, side, (avg(p) - any_value(m)) / sqrt(any_value(v) / count(*) * (any_value(n) - count(*)) / (any_value(n) - 1)) AS score FROM r JOIN q USING (feature) JOIN t USING (sample) GROUP BY ALL),
u AS (SELECT sample, k, sum(CASE WHEN side = 0 THEN score ELSE -score END) AS score FROM b GROUP BY ALL),
d AS (SELECT k, vec_id % 7 AS x, (score - avg(score) OVER w) / stddev_pop(score) OVER w AS s, (label >= 5)::INT AS y FROM u JOIN embeddings ON vec_id = sample WINDOW w AS (PARTITION BY k))"""


@query(f"""WITH RECURSIVE {RANKS}, f AS (SELECT unnest(range(64))::INT AS feature), o AS (SELECT unnest({_UP})::INT AS feature, 0 AS side UNION ALL SELECT unnest({_DOWN})::INT, 1),
x AS (SELECT k, feature, row_number() OVER (PARTITION BY k ORDER BY md5('0:' || k || ':' || feature), feature) AS i FROM f, range(1, 1001) e(k)),
q AS (SELECT 0 AS k, side, feature FROM o UNION ALL SELECT k, (i > {len(_UP)})::INT, feature FROM x WHERE i <= {len(_UP) + len(_DOWN)}), {_SCORED}, {_NEWTON},
z AS (SELECT k, b2 / sqrt(v) AS z FROM n WHERE step = 9)
SELECT round(any_value(z0), 6) AS z, round((1 + count(*) FILTER (abs(z) >= abs(z0))) / (1.0::DOUBLE + count(*)), 6) AS p_random, count(*) AS n_valid FROM z, (SELECT z AS z0 FROM z WHERE k = 0) WHERE k > 0""")
def random_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[up, down] sets in an adjusted model, against 1,000 pairs of random sets."""
    ranks = scoring.rank_matrix(features(spark, sf_dir), "sample", "feature", "value")
    return rounded(draws.random_set_null(ranks, _responders(spark, sf_dir), "y", [_UP, _DOWN], ["c"]))


# ---------------------------------------------------------------- bootstraps and matched permutations

#: Place k of four under n, from the checksum of seed, pack and slot.
_PICK = "('0x' || substr(md5('0:' || pack || ':' || {slot}), 8 * k + 1, 8))::BIGINT % n"


@query(f"""WITH o AS (SELECT o_orderpriority AS g, o_totalprice AS x, (o_custkey % 97)::DOUBLE AS y, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
p AS (SELECT g, 4 * pack + k AS draw, {_PICK.format(slot="i")} AS i FROM o, range(125) a(pack), range(4) b(k)),
d AS (SELECT p.g, draw, corr(x, y) AS r FROM p JOIN o ON o.g = p.g AND o.i = p.i GROUP BY ALL),
e AS (SELECT g, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM d GROUP BY 1)
SELECT o.g AS o_orderpriority, count(*) AS n, round(corr(x, y), 6) AS r, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi FROM o JOIN e ON e.g = o.g GROUP BY o.g""")
def bootstrap_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", (F.col("o_custkey") % 97).cast("double"))
    return rounded(draws.bootstrap_r(o, "o_totalprice", "d", "o_orderkey", ["o_orderpriority"]).drop("p"))


@query(f"""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS g, c_acctbal AS x, (c_nationkey * 3 + c_custkey % 11)::DOUBLE AS y FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM c),
p AS (SELECT g, 4 * pack + k AS draw, {_PICK.format(slot="g || ':' || i")} AS i FROM o, range(500) a(pack), range(4) b(k)),
d AS (SELECT p.g, draw, corr(x, y) AS r FROM p JOIN o ON o.g = p.g AND o.i = p.i GROUP BY ALL),
f AS (SELECT draw, max(r) FILTER (g = 'BUILDING') - max(r) FILTER (g = 'MACHINERY') AS d FROM d GROUP BY 1)
SELECT round((SELECT corr(x, y) FILTER (g = 'BUILDING') - corr(x, y) FILTER (g = 'MACHINERY') FROM o), 6) AS difference, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi FROM f""")
def bootstrap_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("y", (F.col("c_nationkey") * 3 + F.col("c_custkey") % 11).cast("double"))
    return rounded(draws.bootstrap_difference(c, "c_acctbal", "y", "c_custkey", "c_mktsegment", "BUILDING", "MACHINERY"))


@query(f"""WITH {LONG}, f AS (SELECT sample, feature % 4 AS feature, avg(value) AS value, any_value(label)::DOUBLE AS y FROM l JOIN embeddings ON vec_id = sample GROUP BY 1, 2),
o AS (SELECT vec_id AS sample, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings),
p AS (SELECT 4 * pack + k AS draw, {_PICK.format(slot="i")} AS i FROM o, range(500) a(pack), range(4) b(k)),
t AS (SELECT draw, sample, count(*) AS w FROM p JOIN o ON o.i = p.i GROUP BY ALL),
s AS (SELECT draw, feature, sum(w) AS n, sum(w * value) AS x, sum(w * y) AS y, sum(w * value * value) AS xx, sum(w * y * y) AS yy, sum(w * value * y) AS xy FROM t JOIN f USING (sample)  GROUP BY ALL),
m AS (SELECT draw, avg((xy - x * y / n) / sqrt((xx - x * x / n) * (yy - y * y / n))) AS m FROM s GROUP BY 1)
SELECT round((SELECT avg(r) FROM (SELECT corr(value, y) AS r FROM f  GROUP BY feature)), 6) AS r_mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def bootstrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four predictions of one label, from every fourth feature each; lines drawn once for all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("double").alias("y"))
    return rounded(draws.bootstrap_lines(features(spark, sf_dir).groupBy("sample", (F.col("feature") % 4).alias("quarter")).agg(F.avg("value").alias("value")).join(e, "sample"), "sample", "quarter", "y", "value"))


@query(f"""WITH v AS (SELECT p_partkey AS gene, p_retailprice AS v, (p_size % 6)::VARCHAR AS s FROM part), w AS (SELECT p_partkey AS gene, CASE WHEN p_partkey % 13 = 0 THEN 'thirteen' ELSE 'sixes' END AS "set" FROM part WHERE p_partkey % 13 = 0 OR (p_size % 6 = 0 AND p_partkey % 13 <> 1)),
o AS (SELECT "set", gene, v, s FROM w JOIN v USING (gene)), b AS (SELECT "set", count(*) AS n, avg(v) AS obs FROM o GROUP BY 1),
l AS (SELECT b."set", gene, v, s FROM b, v WHERE NOT EXISTS (SELECT 1 FROM w WHERE w."set" = b."set" AND w.gene = v.gene)),
a AS (SELECT "set", s, v, row_number() OVER (PARTITION BY "set", s ORDER BY gene) - 1 AS i, count(*) OVER (PARTITION BY "set", s) AS n FROM l UNION ALL SELECT "set", NULL, v, row_number() OVER (PARTITION BY "set" ORDER BY gene) - 1, count(*) OVER (PARTITION BY "set") FROM l),
z AS (SELECT "set", s, any_value(n) AS n FROM a GROUP BY ALL), t AS (SELECT o."set", gene, h.s AS s, coalesce(h.n, e.n) AS n FROM o LEFT JOIN z h ON h."set" = o."set" AND h.s = o.s JOIN z e ON e."set" = o."set" AND e.s IS NULL),
p AS (SELECT "set", s, 4 * pack + k AS draw, {_PICK.format(slot="gene")} AS i FROM t, range(500) c(pack), range(4) d(k)),
m AS (SELECT p."set", draw, avg(v) AS m FROM p JOIN a ON a."set" = p."set" AND a.s IS NOT DISTINCT FROM p.s AND a.i = p.i GROUP BY ALL)
SELECT m."set" AS "set", any_value(n) AS n, 0 AS n_missing, round(any_value(obs), 4) AS obs, round(avg(m), 4) AS null_mean, round(stddev_pop(m), 4) AS null_sd, round((any_value(obs) - avg(m)) / stddev_pop(m), 4) AS z, round((1 + count(*) FILTER (m >= obs - 1e-9::DOUBLE * abs(obs))) / 2001.0::DOUBLE, 4) AS p FROM m JOIN b ON b."set" = m."set" GROUP BY m."set" """)
def matched_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of parts by price, in strata of size; the second takes a whole stratum, and so falls back to all parts."""
    p = table(spark, sf_dir, "part")
    values = p.select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").cast("double").alias("v"), (F.col("p_size") % 6).alias("s"))
    inside = F.when(F.col("p_partkey") % 13 == 0, "thirteen").when((F.col("p_size") % 6 == 0) & (F.col("p_partkey") % 13 != 1), "sixes")
    sets = p.select(inside.alias("set"), F.col("p_partkey").alias("gene")).filter("set IS NOT NULL")
    return rounded(draws.matched_permutation(values, sets, "gene", "v", "s"), 4)


# ---------------------------------------------------------------- ridge

#: Ridge of one penalty on two columns of customers by fold, in closed form: scaled Gram matrices of the other folds.
_RIDGE2 = """c AS (SELECT c_custkey AS id, c_acctbal AS y, avg(o_totalprice) / 1000 AS x1, count(*)::DOUBLE AS x2, c_custkey % 5 AS fold FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
a AS (SELECT unnest([0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0])::DOUBLE AS a),
t AS (SELECT k.fold, count(*)::DOUBLE AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, count(*) * corr(x1, x2) AS r, count(*) * covar_pop(x1, y) / stddev_pop(x1) AS g1, count(*) * covar_pop(x2, y) / stddev_pop(x2) AS g2 FROM (SELECT DISTINCT fold FROM c) k JOIN c ON c.fold <> k.fold GROUP BY 1),
b AS (SELECT t.*, a, ((n + a) * (n + a) - r * r) AS e, ((n + a) * g1 - r * g2) / ((n + a) * (n + a) - r * r) AS b1, ((n + a) * g2 - r * g1) / ((n + a) * (n + a) - r * r) AS b2 FROM t, a),
l AS (SELECT b.fold, a, sum(((y - my - b1 * (x1 - m1) / s1 - b2 * (x2 - m2) / s2) / (1 - 1 / n - ((n + a) * ((x1 - m1) / s1) ** 2 - 2 * r * (x1 - m1) / s1 * (x2 - m2) / s2 + (n + a) * ((x2 - m2) / s2) ** 2) / e)) ** 2) AS loss FROM b JOIN c ON c.fold <> b.fold GROUP BY ALL),
w AS (SELECT fold, a FROM l QUALIFY row_number() OVER (PARTITION BY fold ORDER BY loss, a) = 1)"""


@query(f"""WITH {_RIDGE2} SELECT id, fold::INT AS fold, round(my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2, 5) AS pred, a AS alpha, n::BIGINT AS n_train FROM c JOIN w USING (fold) JOIN b USING (fold, a)""")
def ridge_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge with the penalty of the least leave-one-out error in each training set."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    x = o.groupBy("o_custkey").agg((F.avg("o_totalprice") / 1000).alias("x1"), F.count(F.lit(1)).cast("double").alias("x2"))
    rows = c.join(x, F.col("c_custkey") == F.col("o_custkey")).withColumn("features", F.array("x1", "x2")).withColumn("fold", (F.col("c_custkey") % 5).cast("int"))
    out = regression.ridge_by_fold(rows, "c_custkey", "features", "c_acctbal", [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0])
    return out.select(F.col("line").alias("id"), "fold", F.round("pred", 5).alias("pred"), "alpha", "n_train")


@query("""WITH c AS (SELECT c_custkey AS id, c_acctbal / 1000 AS y, avg(o_totalprice) / 100000 AS x, c_custkey % 5 AS fold, c_custkey // 5 % 3 AS inner_ FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
a AS (SELECT unnest([0.2, 0.05, 0.01, 0.002, 0.0005])::DOUBLE AS a), k AS (SELECT DISTINCT fold FROM c), i AS (SELECT DISTINCT inner_ FROM c),
t AS (SELECT k.fold, count(*) AS n, avg(y) AS my, avg(x) AS m, stddev_pop(x) AS s, covar_pop(x, y) / stddev_pop(x) AS c FROM k JOIN c ON c.fold <> k.fold GROUP BY 1),
v AS (SELECT t.fold, i.inner_, avg(y) AS my, avg((x - m) / s) AS mz, var_pop((x - m) / s) AS v, covar_pop((x - m) / s, y) AS c FROM t, i, c WHERE c.fold <> t.fold AND c.inner_ <> i.inner_ GROUP BY ALL),
b AS (SELECT fold, inner_, a, my, mz, sign(c) * greatest(abs(c) - a / 2, 0) / (v + a / 2) AS b FROM v, a),
l AS (SELECT b.fold, b.inner_, a, avg((y - b.my - b * ((x - m) / s - mz)) ** 2) AS loss FROM b JOIN t ON t.fold = b.fold JOIN c ON c.fold <> b.fold AND c.inner_ = b.inner_ GROUP BY ALL),
w AS (SELECT fold, a FROM l GROUP BY fold, a QUALIFY row_number() OVER (PARTITION BY fold ORDER BY avg(loss), a DESC) = 1)
SELECT id, fold::INT AS fold, round(my + sign(t.c) * greatest(abs(t.c) - a / 2, 0) / (1 + a / 2) * (x - m) / s, 6) AS pred, a AS alpha, n AS n_train FROM c JOIN w USING (fold) JOIN t USING (fold)""")
def elastic_net_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An elastic net on one column, in closed form in the SQL, with the penalty of the least inner error."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    x = o.groupBy("o_custkey").agg((F.avg("o_totalprice") / 100000).alias("x"))
    rows = c.join(x, F.col("c_custkey") == F.col("o_custkey")).withColumn("features", F.array("x")).withColumn("y", F.col("c_acctbal") / 1000)
    rows = rows.withColumn("fold", (F.col("c_custkey") % 5).cast("int")).withColumn("inner", F.expr("cast((c_custkey div 5) % 3 as int)"))
    out = regression.elastic_net_by_fold(rows, "c_custkey", "features", "y", [0.2, 0.05, 0.01, 0.002, 0.0005])
    return out.select(F.col("line").alias("id"), "fold", F.round("pred", 6).alias("pred"), "alpha", "n_train")


#: Folds of a table as `regression.baselines` deals them, and ridge on one scaled number.
_DEALT = """v AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 2 + embedding[2]::DOUBLE - embedding[3]::DOUBLE * 1.5::DOUBLE + label * 0.05::DOUBLE AS y, embedding[1]::DOUBLE AS x0, (row_number() OVER (ORDER BY md5('fold0:' || vec_id)) - 1) % 5 AS fold FROM embeddings),
a AS (SELECT unnest([ALPHAS])::DOUBLE AS a),
t AS (SELECT k.fold, count(*)::DOUBLE AS n, avg(y) AS my, avg(x0) AS m, stddev_pop(x0) AS s, count(*) * covar_pop(x0, y) / stddev_pop(x0) AS g FROM (SELECT DISTINCT fold FROM v) k JOIN v ON v.fold <> k.fold GROUP BY 1),
l AS (SELECT t.fold, a, sum(((y - my - g / (n + a) * (x0 - m) / s) / (1 - 1 / n - ((x0 - m) / s) ** 2 / (n + a))) ** 2) AS loss FROM t, a, v WHERE v.fold <> t.fold GROUP BY ALL),
w AS (SELECT fold, a FROM l QUALIFY row_number() OVER (PARTITION BY fold ORDER BY loss, a) = 1),
p AS (SELECT y, my + g / (n + a) * (x0 - m) / s AS p FROM v JOIN w USING (fold) JOIN t USING (fold))"""


@query("WITH " + _DEALT.replace("ALPHAS", ", ".join(str(float(x)) for x in RIDGE_ALPHAS)) + " SELECT 'x0' AS baseline, round(corr(y, p), 6) AS pearson_r, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, count(*) AS n FROM p")
def baseline_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline of one number; the others are tested in tests/."""
    return rounded(_baselines(spark, sf_dir).filter("baseline = 'x0'"))


@query()
def baseline_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baselines(spark, sf_dir)


def _baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x[0].alias("x0"), x[1].alias("x1"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("lineage"), (x[0] * 2 + x[1] - x[2] * 1.5 + F.col("label") * 0.05).alias("y"))
    return regression.baselines(rows, "vec_id", "y", ["x0", "x1"], "lineage", RIDGE_ALPHAS)


# ---------------------------------------------------------------- tests of sets


@query(f"""WITH {LONG}, y AS (SELECT vec_id AS sample, label::DOUBLE + embedding[1]::DOUBLE AS y, (label % 3)::VARCHAR AS g FROM embeddings),
b AS (SELECT sample, g, row_number() OVER (PARTITION BY g ORDER BY sample) AS k FROM y), e AS (SELECT draw, g, y, row_number() OVER (PARTITION BY draw, g ORDER BY md5('0:' || draw || ':' || sample), sample) AS k FROM y, range(1, 1001) t(draw)),
p AS (SELECT sample, draw, y FROM b JOIN e USING (g, k) UNION ALL SELECT sample, 0, y FROM y), r AS (SELECT feature, draw, corr(value, y) AS r FROM l JOIN p USING (sample) GROUP BY ALL),
m AS (SELECT 'first' AS "set", unnest(range(3))::INT AS feature UNION ALL SELECT 'even', unnest(range(0, 64, 2))::INT), s AS (SELECT feature % 3 AS stratum, draw, avg(r) AS back FROM r GROUP BY ALL),
g AS (SELECT "set", r.draw AS draw, count(*) AS n, avg(r) AS mean_r, avg(back) AS background_r FROM m JOIN r USING (feature) JOIN s ON s.stratum = feature % 3 AND s.draw = r.draw GROUP BY "set", r.draw), o AS (SELECT * FROM g WHERE draw = 0)
SELECT o."set" AS "set", o.n AS n, round(o.mean_r, 8) AS mean_r, round(o.background_r, 8) AS background_r, round(o.mean_r - o.background_r, 8) AS shift, round((1 + (SELECT count(*) FROM g WHERE g."set" = o."set" AND draw > 0 AND abs(g.mean_r - g.background_r) >= abs(o.mean_r - o.background_r))) / 1001.0::DOUBLE, 8) AS p FROM o""")
def set_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL correlates every feature with every permutation."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), (F.col("label") + F.col("embedding")[0].cast("double")).alias("y"), (F.col("label") % 3).cast("string").alias("g"))
    ids = spark.range(64).select(F.col("id").cast("int").alias("feature"))
    sets = ids.filter("feature < 3").withColumn("set", F.lit("first")).unionByName(ids.filter("feature % 2 = 0").withColumn("set", F.lit("even")))
    return rounded(set_tests.set_shift(features(spark, sf_dir), e, sets, ids.withColumn("stratum", F.col("feature") % 3), "sample", "feature", "value", "y", "g"), 8)


@query("""WITH v AS (SELECT c_custkey AS feature, round(c_acctbal / 50) * 50 AS v FROM customer WHERE c_acctbal IS NOT NULL), r AS (SELECT feature, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM v),
m AS (SELECT DISTINCT c_mktsegment AS "set", c_custkey AS feature FROM customer WHERE c_mktsegment IS NOT NULL)
SELECT "set", count(*) AS n, count(*) FILTER (v > 0) AS n_positive, round(avg(v), 6) AS mean_value, sum(r) - count(*) * (count(*) + 1) / 2.0::DOUBLE AS u FROM m JOIN r USING (feature) GROUP BY 1""")
def signed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    values = c.select(F.col("c_custkey").alias("feature"), (F.round(F.col("c_acctbal") / 50) * 50).alias("v"))
    sets = c.filter("c_mktsegment IS NOT NULL").select(F.col("c_mktsegment").alias("set"), F.col("c_custkey").alias("feature"))
    return set_tests.signed_set_test(values, sets, "feature", "v").select("set", "n", "n_positive", F.round("mean_value", 6).alias("mean_value"), "u")
