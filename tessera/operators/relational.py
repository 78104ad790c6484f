"""Filters, joins, aggregation and reshaping of long measurement tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.nulls import is_true, not_in, pair_count, safe_corr
from ..functions.local import TooLarge
from ..functions.ranks import average_rank, keep_first, with_group_rank, with_rank

#: Features that go to each sample at once; items whose pairs are made.
GRID_FEATURES, PAIR_ITEMS = 100_000, 5_000

# ---------------------------------------------------------------- rows


def contains(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column, as text, contains `text` in any case; missing does not."""
    return df.filter(is_true(F.lower(F.col(column).cast("string")).contains(text.lower())))


def exclude(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is none of values; a missing one stays."""
    return df.filter(not_in(column, values))


def missing_filter(long: DataFrame, sample: str, feature: str, value: str, most: float) -> DataFrame:
    """feature, n: those missing in at most a share `most` of all samples (absent = missing)."""
    total = long.select(sample).distinct().count()
    n = long.groupBy(feature).agg(F.countDistinct(F.when(F.col(value).isNotNull(), F.col(sample))).alias("n"))
    return n.filter((F.lit(float(total)) - F.col("n")) / F.lit(float(max(total, 1))) <= most)


def median_fill(long: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """sample, feature, value for every pair, a missing value being its feature's median.

    The grid has samples x features rows: the dense matrix in long form."""
    medians = long.groupBy(feature).agg(F.median(value).alias("_median"))
    grid = _grid(long, sample, medians)
    cells = long.groupBy(sample, feature).agg(F.avg(value).alias(value))
    return grid.join(cells, [sample, feature], "left").select(sample, feature, F.coalesce(value, "_median").alias(value))


def _grid(long: DataFrame, sample: str, features: DataFrame) -> DataFrame:
    """Every (sample, feature): features go to each sample as one array, GRID_FEATURES at a time."""
    parts = max(1, -(-features.count() // GRID_FEATURES))
    out = None
    for i in range(parts):
        some = features if parts == 1 else features.filter(F.pmod(F.xxhash64(features.columns[0]), F.lit(parts)) == i)
        packed = some.agg(F.collect_list(F.struct(*features.columns)).alias("_f"))
        one = long.select(sample).distinct().join(F.broadcast(packed)).select(sample, F.inline("_f"))
        out = one if out is None else out.unionByName(one)
    return out


def detected(counts: DataFrame, feature: str, count: str, least: int = 6) -> DataFrame:
    """Rows of features with a positive count in at least `least` samples."""
    good = counts.groupBy(feature).agg(F.sum(F.when(F.col(count) > 0, 1).otherwise(0)).alias("_n")).filter(F.col("_n") >= least)
    return counts.join(good.select(feature), feature, "left_semi")


def beyond_range(log_ic50: str, max_conc: str) -> Column:
    """Whether an IC50 lies above the highest dose; unknown is false."""
    return is_true(F.col(log_ic50) > F.ln(max_conc))


def bands(df: DataFrame, value: str, edges: tuple[float, float] = (0.90, 0.95), more_than: int = 10) -> DataFrame:
    """band, n, mean: responsive (<= first), middle, ceiling (> second); small bands left out."""
    band = F.when(F.col(value) <= edges[0], "responsive").when(F.col(value) <= edges[1], "middle").when(F.col(value) > edges[1], "ceiling")
    return df.withColumn("band", band).filter("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).filter(F.col("n") > more_than)


def in_large_groups(df: DataFrame, group: str, least: int = 10) -> DataFrame:
    """Rows of groups with at least `least` rows; a missing group never qualifies."""
    n = F.count(F.lit(1)).over(W.partitionBy(group))
    return df.filter(F.col(group).isNotNull()).withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def declared(specs: list[dict]) -> Column:
    """Whether a row matches any of the specs, each {column: value} with all equal."""
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [is_true(F.col(c) == v) for c, v in s.items()], F.lit(True)) for s in specs], F.lit(False))


def recode(column: str, classes: dict[str, list[str]]) -> Column:
    """Response texts to 0/1 (or any class) by exact match after trim and lower; else NULL."""
    out = F.lit(None).cast("string")
    for name, values in classes.items():
        out = F.when(F.lower(F.trim(F.col(column))).isin([v.lower() for v in values]), name).otherwise(out)
    return out


# ---------------------------------------------------------------- joins


def with_metadata(facts: DataFrame, dim: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Left join with the dimension's first row of each key."""
    return facts.join(keep_first(dim, [key], order), key, "left")


def paired(a: DataFrame, b: DataFrame, key: str, value: str, lines: DataFrame | None = None) -> DataFrame:
    """key, a, b: rows with both values, optionally of the given keys only."""
    x = a.select(key, F.col(value).alias("a")).filter("a IS NOT NULL")
    y = b.select(key, F.col(value).alias("b")).filter("b IS NOT NULL")
    out = x.join(y, key)
    return out if lines is None else out.join(lines.select(key).distinct(), key, "left_semi")


def outer_named(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Full outer join; columns of both but the key get the names as suffixes."""
    x = a.select(key, *[F.col(c).alias(f"{c}_{names[0]}") for c in a.columns if c != key])
    y = b.select(key, *[F.col(c).alias(f"{c}_{names[1]}") for c in b.columns if c != key])
    return x.join(y, key, "full")


def resolve(names: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """names with `symbol`: the alias's official symbol (the last listed), else itself.

    aliases: alias, symbol, ordinal."""
    last = aliases.groupBy("alias").agg(F.max_by("symbol", "ordinal").alias("_symbol"))
    return names.join(last, F.col(column) == F.col("alias"), "left").withColumn("symbol", F.coalesce("_symbol", column)).drop("alias", "_symbol")


def plain_name(c: str | Column) -> Column:
    """Upper case, letters and digits only."""
    return F.upper(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[^A-Za-z0-9]", ""))


def lookup_names(wanted: DataFrame, column: str, models: DataFrame) -> DataFrame:
    """wanted with model_id, by plain name, a model's own name before its synonyms.

    models: model_id, model_name, synonyms (';'-joined)."""
    own = models.select("model_id", plain_name("model_name").alias("_k"), F.lit(0).alias("_p"))
    other = models.select("model_id", F.explode(F.split("synonyms", ";")).alias("_s")).select("model_id", plain_name("_s").alias("_k"), F.lit(1).alias("_p"))
    best = own.unionByName(other).filter("_k <> ''").groupBy("_k").agg(F.min_by("model_id", F.struct("_p", "model_id")).alias("model_id"))
    return wanted.join(best, plain_name(column) == F.col("_k"), "left").drop("_k")


def pairs_of(items: DataFrame, name: str) -> DataFrame:
    """name_a, name_b of a list of at most PAIR_ITEMS (or TooLarge), a before b."""
    if (n := items.select(name).distinct().count()) > PAIR_ITEMS:
        raise TooLarge(f"pairs of {n} items; at most {PAIR_ITEMS} are paired")
    ordered = items.select(name).distinct().withColumn("_o", F.row_number().over(W.orderBy(name)))
    packed = ordered.agg(F.collect_list(F.struct(F.col(name).alias("n"), F.col("_o").alias("o"))).alias("_all"))
    each = ordered.join(F.broadcast(packed)).select(F.col(name).alias(f"{name}_a"), F.explode(F.filter("_all", lambda s: s["o"] > F.col("_o"))).alias("s"))
    return each.select(f"{name}_a", F.col("s.n").alias(f"{name}_b"))


# ---------------------------------------------------------------- aggregation


def mean_cells(long: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """One mean for each (row, column), in long form."""
    return long.groupBy(row, column).agg(F.avg(value).alias(value))


def wide(long: DataFrame, row: str, column: str, value: str, names: list) -> DataFrame:
    """A narrow pivot with fixed columns, by mean."""
    return long.groupBy(row).pivot(column, names).agg(F.avg(value))


def tall(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """keys, name, value: the columns of a wide table as rows."""
    return df.unpivot(keys, columns, name, value)


def ends(df: DataFrame, by: str, key: str, first: int = 12, last: int = 5) -> DataFrame:
    """side, and the columns of df: its `first` rows with the largest values and `last` with the smallest;
    equal ones by key. Both are partial sorts."""
    full = df.filter(F.col(by).isNotNull())
    return full.orderBy(F.desc(by), key).limit(first).select(F.lit("head").alias("side"), "*").unionByName(full.orderBy(by, key).limit(last).select(F.lit("tail").alias("side"), "*"))


def flag_matrix(events: DataFrame, ids: DataFrame, row: str, column: str, names: list) -> DataFrame:
    """0/1 for each id and name; ids without an event have zeros. A name without any
    event has no column."""
    seen = {r[0] for r in events.filter(F.col(column).isin(names)).select(column).distinct().collect()}
    names = [n for n in names if n in seen]
    flags = events.filter(F.col(column).isin(names)).groupBy(row).pivot(column, names).agg(F.max(F.lit(1)))
    return ids.select(row).distinct().join(flags, row, "left").fillna(0, names)


def counts_with_zero(df: DataFrame, row: str, column: str, names: list[str]) -> DataFrame:
    """Counts of each name, 0 where there is none."""
    return df.groupBy(row).agg(*[F.sum(F.when(F.col(column) == n, 1).otherwise(0)).cast("long").alias(n) for n in names])


def region_shares(df: DataFrame, row: str, column: str, distal: str = "Distal", promoter: str = "Promoter") -> DataFrame:
    """Counts of both regions, distal / (promoter + 1), and the distal share."""
    n = counts_with_zero(df, row, column, [distal, promoter])
    d, p = F.col(distal), F.col(promoter)
    return n.select(row, d.alias("n_distal"), p.alias("n_promoter"), (d / (p + 1)).alias("distal_ratio"), F.try_divide(d.cast("double"), (d + p).cast("double")).alias("distal_fraction"))


def first_known(column: str, order: str) -> Column:
    """The first value that is not missing, in an explicit order."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def collapse_drug(df: DataFrame, line: str, texts: list[str], numbers: list[str], order: str) -> DataFrame:
    """One row a line: first known texts, means of numbers."""
    return df.groupBy(line).agg(*[first_known(c, order).alias(c) for c in texts], *[F.avg(c).alias(c) for c in numbers])


def regression_metrics(df: DataFrame, truth: str, pred: str, *groups: str, ceiling: float | None = None) -> DataFrame:
    """groups, n, r, rho, r2, rmse, bias (and the share of a ceiling) over complete pairs."""
    both = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    if groups:
        ranked = with_group_rank(with_group_rank(both, truth, "_rt", *groups), pred, "_rp", *groups)
    else:
        ranked = with_rank(with_rank(both, truth, "_rt"), pred, "_rp")
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    gap = t - p
    out = ranked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(truth, pred).alias("r"), safe_corr("_rt", "_rp").alias("rho"),
        (1 - F.try_divide(F.sum(gap * gap), F.nullif(F.var_pop(t) * F.count(F.lit(1)), F.lit(0.0)))).alias("r2"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(-gap).alias("bias"),
    )
    return out if ceiling is None else out.withColumn("pct_of_ceiling", 100 * F.col("r") / F.lit(float(ceiling)))


def between_within(df: DataFrame, truth: str, pred: str, group: str, least: int = 10, groups: int = 3, rows: int = 10) -> DataFrame:
    """n, n_groups, r_between (of group means), r_within (of residuals) over large groups;
    NULL with fewer than `groups` groups or `rows` rows."""
    both = in_large_groups(df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()), group, least)
    w = W.partitionBy(group)
    res = both.withColumn("_t", F.col(truth) - F.avg(truth).over(w)).withColumn("_p", F.col(pred) - F.avg(pred).over(w))
    per = res.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(truth).alias("mt"), F.avg(pred).alias("mp"),
        F.sum(F.col("_t") * F.col("_p")).alias("sxy"), F.sum(F.col("_t") * F.col("_t")).alias("sxx"), F.sum(F.col("_p") * F.col("_p")).alias("syy"),
    )
    out = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups"), safe_corr("mt", "mp").alias("r_between"), F.try_divide(F.sum("sxy"), F.nullif(F.sqrt(F.sum("sxx") * F.sum("syy")), F.lit(0.0))).alias("r_within"))
    enough = (F.col("n_groups") >= groups) & (F.col("n") >= rows)
    return out.select("n", "n_groups", *[F.when(enough, F.col(c)).alias(c) for c in ("r_between", "r_within")])


def best_group(df: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """The group with the largest sample SD of value; equal ones by the given order."""
    sd = df.groupBy(group).agg(F.stddev_samp(value).alias("sd"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(group).cast("string")), F.lit(0))
    return sd.filter("sd IS NOT NULL").orderBy(F.desc("sd"), place, group).limit(1)


def general_axis(long: DataFrame, line: str, item: str, value: str, focal: str | None, least: int = 300) -> DataFrame:
    """line, general: mean over items of values z-scored within each item (sample SD);
    items with fewer than `least` lines, and the focal one, do not count."""
    cells = mean_cells(long, line, item, value).filter(F.col(value).isNotNull())
    w = W.partitionBy(item)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))
    cells = cells.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_z", z).filter(F.col("_n") >= least)
    if focal is not None:
        cells = cells.filter(F.col(item) != focal)
    return cells.groupBy(line).agg(F.avg("_z").alias("general"))


def similarity(long: DataFrame, line: str, item: str, value: str, focal: str, least: int = 3) -> DataFrame:
    """item, n, r: correlation of every other item with the focal one over shared lines."""
    cells = mean_cells(long, line, item, value).filter(F.col(value).isNotNull())
    one = cells.filter(F.col(item) == focal).select(line, F.col(value).alias("_f"))
    both = cells.filter(F.col(item) != focal).join(one, line)
    return both.groupBy(item).agg(pair_count(value, "_f").alias("n"), safe_corr(value, "_f").alias("r")).filter(F.col("n") >= least)


def top_by_variance(long: DataFrame, feature: str, value: str, k: int) -> DataFrame:
    return long.groupBy(feature).agg(F.var_samp(value).alias("variance")).orderBy(F.desc_nulls_last("variance"), feature).limit(k)


def log2_if_linear(long: DataFrame, value: str, above: float = 30.0) -> DataFrame:
    """log2 of the values if any is above 30; what is not positive takes the smallest positive value first."""
    s = long.agg(F.max(value).alias("hi"), F.min(F.when(F.col(value) > 0, F.col(value))).alias("lo")).first()
    if s.hi is None or s.hi <= above:
        return long
    v = F.when(F.col(value) <= 0, F.lit(float(s.lo))).otherwise(F.col(value))
    return long.withColumn(value, F.log2(v))


def baseline_shift(df: DataFrame, group: str, time: str, value: str) -> DataFrame:
    """group, time, mean, shift: means over time less the first time's."""
    m = df.groupBy(group, time).agg(F.avg(value).alias("mean"))
    return m.withColumn("shift", F.col("mean") - F.first("mean").over(W.partitionBy(group).orderBy(time)))


def missing_shares(long: DataFrame, key: str, value: str) -> DataFrame:
    return long.groupBy(key).agg((F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)) / F.count(F.lit(1)).cast("double")).alias("missing_frac"))


def suffixed_union(parts: dict[str, DataFrame], feature: str) -> DataFrame:
    """Long tables stacked, each feature named with its part: the long form of joining wide tables
    side by side."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(feature, F.concat(F.col(feature).cast("string"), F.lit(f"__{name}")))
        out = one if out is None else out.unionByName(one)
    return out


def correlation_matrix(long: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """feature_a, feature_b, n, r of a bounded list of features (scores, modules), a before b.

    One pass packs each sample's few values; pairs are made inside the row."""
    packed = long.filter(F.col(value).isNotNull()).groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(F.col(feature).alias("f"), F.col(value).cast("double").alias("v")))).alias("_a"))
    pairs = packed.select(F.explode("_a").alias("a"), "_a").select("a", F.explode(F.filter("_a", lambda s: s["f"] > F.col("a.f"))).alias("b"))
    g = pairs.select(F.col("a.f").alias(f"{feature}_a"), F.col("b.f").alias(f"{feature}_b"), F.col("a.v").alias("x"), F.col("b.v").alias("y"))
    return g.groupBy(f"{feature}_a", f"{feature}_b").agg(pair_count("x", "y").alias("n"), safe_corr("x", "y").alias("r"))
