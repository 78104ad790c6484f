"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is made of blocks of `block` words. Every source gets its number of
blocks by the highest quotients target / (2k - 1); within a source, each shard
(a seeded hash group of its documents of about `shard_words` words)
gets an integer quota the same way. A shard's documents are laid end to end in
seeded order and cut into blocks; quota // blocks whole passes are taken, and the
remaining quota picks evenly spaced blocks from a seeded offset. What a document
gives then follows from its interval alone, in constant time.

Edge cases: null text has size 0; null sources form one source, last in order;
null doc_ids share one seed key; repeated rows are rows of their own (equal
rows tie, and any order of ties gives the same rows); an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import maybe_broadcast, scope, staged

WORD = r"[^\x20\x09-\x0D]+"
#: A chance of 1 in whole numbers: sums of them are exact in any order.
UNIT = 1 << 20


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def seed_key(seed: str, *cols: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def seed_number(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def apportion(table: DataFrame, group: list[str], weight: str, seats: str, cap: str, tie: list[str], out: str) -> DataFrame:
    """Sainte-Laguë: the column `seats` (one value per group) is dealt to the rows
    of the group by highest weight / (2k - 1), at most `cap` to a row; ties go to
    the first in order of `tie`.

    Rounding weight * seats / total leaves a few seats over or short, and no row
    gains or loses more than share * (those + rows) + 2 of them, so only that many
    next seats of each row are ranked: a number in proportion to the rows."""
    g = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    fair = F.coalesce(F.try_divide(F.col(weight) * F.col(seats), F.sum(weight).over(g).cast("double")), F.lit(0.0))
    t = table.withColumn("_q", F.least(F.floor(fair + 0.5), F.col(cap)).cast("long"))
    t = t.withColumn("_d", F.col(seats) - F.sum("_q").over(g))
    share = F.coalesce(F.try_divide(F.col(weight).cast("double"), F.sum(weight).over(g).cast("double")), F.lit(0.0))
    t = t.withColumn("_n", (F.floor(share * (F.abs("_d") + F.count(F.lit(1)).over(g))) + 2).cast("long"))
    keys = [*group, *tie]
    seat = F.when(F.col("_d") > 0, F.col("_q") + F.col("_k")).otherwise(F.col("_q") - F.col("_k") + 1)
    near = (
        t.filter(F.col("_d") != 0)
        .select(*keys, weight, cap, "_q", "_d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k"))
        .withColumn("_seat", seat)
        .filter((F.col("_seat") >= 1) & (F.col("_seat") <= F.col(cap)) & (F.col(weight) > 0))
        .withColumn("_x", F.col(weight) / (2 * F.col("_seat") - 1) * F.signum("_d"))
    )
    order = [F.desc("_x"), *[F.asc_nulls_last(c) for c in tie]]
    won = (
        near.withColumn("_rn", F.row_number().over(g.orderBy(*order)))
        .filter(F.col("_rn") <= F.abs("_d"))
        .groupBy(*keys)
        .agg(F.sum(F.signum("_d")).cast("long").alias("_more"))
    )
    renamed = won.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_more")
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return t.join(renamed, on, "left").withColumn(out, F.col("_q") + F.coalesce("_more", F.lit(0))).select(*table.columns, out)


def targets(sources: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """source, source_size -> target: `budget` times all words shared by the weights
    (repeating over the sources by code point, null last), no target over `most`
    times its source's size, what is cut off shared again."""
    everything = W.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1
    s = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = everything.orderBy("_ratio", F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    total = F.lit(float(budget)) * F.sum("source_size").over(everything)
    s = s.withColumn("_level", (total - before) / rest)
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("source").isNull().alias("n"), "source", "_level"))).over(everything)
    s = s.withColumn("_at", level["_level"])
    return s.withColumn("target", F.coalesce(F.least(F.col("_w") * F.col("_at"), F.col("_cap")), F.col("_cap"))).drop("_w", "_cap", "_ratio", "_level", "_at")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
    block: int = 16,
    shard_words: int = 250_000,
    seed: str = "mix",
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, base, extra, taken.

    taken = base * size + extra words; `carry` keeps the documents' own columns
    as well, as the struct column `row`, and the shard and key. A source's words are off its
    target by less than a block a shard, as each shard's last block is short; a source of
    whose target no block is left (under half a block) gives nothing."""
    if carry:  # whole rows are not written once more
        return _mix(docs, weights, budget, most, block, shard_words, seed, carry)
    with scope() as keep:
        return keep(staged(_mix(docs, weights, budget, most, block, shard_words, seed, carry)))


def _mix(docs: DataFrame, weights: tuple[int, ...], budget: float, most: float, block: int, shard_words: int, seed: str, carry: bool) -> DataFrame:
    own = [F.struct(*docs.columns).alias("row")] if carry else []
    sized = docs.select("doc_id", "source", n_words().alias("size"), seed_key(seed, "doc_id").alias("key"), *own)
    sized = staged(sized)
    of_source = staged(sized.groupBy("source").agg(F.sum("size").alias("words")))
    n, total = of_source.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    shards = of_source.select(F.col("source").alias("_source"), F.greatest(F.lit(1), F.ceil(F.col("words") / shard_words)).cast("long").alias("_shards"))
    sized = sized.join(maybe_broadcast(shards, 64, n), F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", seed_number(F.col("key")) % F.col("_shards")).drop("_source", "_shards")

    cells = staged(sized.groupBy("source", "shard").agg(F.sum("size").alias("tokens")))
    s = targets(cells.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, budget, most)
    s = s.withColumn("seats", F.floor(F.lit(budget * total / block) + 0.5).cast("long")).withColumn("cap", F.ceil(F.col("target") / block).cast("long"))
    s = staged(apportion(s, [], "target", "seats", "cap", ["source"], "quota").select("source", "source_size", "target", "quota"))

    cells = cells.withColumn("n", F.ceil(F.col("tokens") / block).cast("long")).withColumn("cap", F.ceil(F.col("n") * most).cast("long"))
    q = s.select(F.col("source").alias("_source"), "source_size", "target", F.col("quota").alias("seats"))
    cells = cells.join(q, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    cells = apportion(cells, ["source"], "tokens", "seats", "cap", ["shard"], "quota")
    n = F.expr("nullif(n, 0)")
    cells = staged(
        cells.select(
            F.col("source").alias("_source"), F.col("shard").alias("_shard"), "source_size", "target", "n",
            F.coalesce(F.expr("quota div nullif(n, 0)"), F.lit(0)).alias("base"),
            F.coalesce(F.col("quota") % n, F.lit(0)).alias("r"),
            F.coalesce(seed_number(seed_key(seed, "source", "shard")) % n, F.lit(0)).alias("o"),
        )
    )
    order = W.partitionBy("source", "shard").orderBy("key", "size")
    placed = sized.withColumn("z", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("a", F.col("z") - F.col("size"))
    out = placed.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))

    def upto(x: str) -> str:
        j = f"({x} div {block})"
        taken = f"(({j} * r + o) div n)"
        here = f"((({j} + 1) * r + o) div n - {taken})"
        return f"({block} * {taken} + ({x} % {block}) * {here})"

    out = out.withColumn("extra", F.expr(f"CASE WHEN n = 0 THEN 0L ELSE {upto('z')} - {upto('a')} END").cast("long"))
    cols = ["doc_id", "source", "size", "source_size", "target", "base", "extra", (F.col("base") * F.col("size") + F.col("extra")).alias("taken")]
    return out.select(*cols, *(["shard", "key", "row"] if carry else []))


def mix_documents(docs: DataFrame, seed: str = "mix", **more) -> DataFrame:
    """The mix as whole documents: each comes base times, and once more with a chance of
    extra / size, so that a source's words are right on average at any document length.

    The draw is systematic from a seeded start, over a shard's documents in order of size:
    of documents of like size, their share gets the copy, and a shard's words are off by
    little more than its longest document."""
    picked = mix(docs, seed=seed, carry=True, **more)
    chance = F.coalesce(F.expr(f"extra * {UNIT} div nullif(size, 0)"), F.lit(0)).cast("long")
    start = seed_number(seed_key(f"{seed}:copy", "source", "shard")) % UNIT
    upto = F.sum("_chance").over(W.partitionBy("source", "shard").orderBy("size", "key").rowsBetween(W.unboundedPreceding, 0)) + start
    rows = picked.withColumn("_chance", chance).withColumn("_upto", upto)
    once = F.expr(f"_upto div {UNIT} - (_upto - _chance) div {UNIT}")
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("base") + once).otherwise(0).cast("int")).filter("copies > 0")
    return rows.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")
