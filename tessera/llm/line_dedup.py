"""Line dedup over a suffix array of line IDs, by distributed prefix doubling.

The non-blank lines of a document, in order, form a sequence of line IDs (128-bit
digests); the corpus is the sequences in order of doc_id. Prefix doubling ranks
every suffix by its first 1, 2, 4, ... lines: rank[2k] refines rank[k] by the
rank of the suffix k lines on. A unique line ends every repeat, so only
suffixes that start with a repeated line stay, and after each round only those
that share their prefix with another. Suffixes that agree on k lines are
neighbours in the array: an LCP interval of value k or more. A run of any length n
between two powers is the interval named by the ranks at its first line and at
its last 2**j lines.

A run is a repeat when the corpus has it twice or more and it holds at least
`min_words` words; all suffixes of its interval but the earliest begin a later copy, and the
lines of later copies are deleted. With `tails` (op5 and the pipeline) a line goes if a
maximal run with an earlier copy holds it; without, the last lines of such a run that hold
under `min_words` words together stay. A maximal run is the union of the shortest runs in it that hold `min_words` words, from
each of its lines on and up to each of its lines: if s is the last line that such a run
starts from, fewer than `min_words` words follow it, so the shortest run up to the last line
starts at s or before. Those have `min_words` lines at most, so the lines that go are known
once the ranks are by as many lines as that.

`repeated_runs` goes on doubling until no two suffixes share a prefix, and gives the maximal
runs with the lines that they have in common with their earliest copy.

Everything is DataFrame code. Edge cases: null text stays null; an empty text, or
one of blank lines, is kept as it is; blank lines are never deleted and never break
a run; a text whose lines all go becomes "" (or its blank lines); null doc_ids come
first in order; rows equal in doc_id and text are one document: each gets the same
result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from .common import maybe_broadcast, scope, staged, text_key
from .mixing import WORD

#: Ranges of line IDs that are ranked apart.
BUCKET_BITS = 12
#: Next ranks of one rank that are put in order at once, and the ranges of those of a rank with more.
RANK_ROWS, RANGES = 512, 64


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, th, line (number in the text), i (number among the non-blank), id, words."""
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", text_key().alias("th"), F.split("text", "\n").alias("l"))
    numbered = F.transform(F.col("l"), lambda x, i: F.struct(i.alias("line"), x.alias("t")))
    full = F.filter(numbered, lambda s: s["t"].rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "th", F.posexplode(full).alias("i", "s"))
    out = rows.select("doc_id", "th", F.col("s.line").alias("line"), "i", F.unhex(F.md5("s.t")).alias("id"), F.regexp_count("s.t", F.lit(WORD)).alias("words"))
    # rows equal in doc_id and text are one document; where there are none, nothing has to move
    again = docs.filter(F.col("text").isNotNull()).groupBy("doc_id", text_key().alias("th")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out if again.isEmpty() else out.dropDuplicates(["doc_id", "th", "line"])


def first_ranks(lines: DataFrame) -> DataFrame:
    """Rank of each repeated line ID: how many repeated lines have a smaller one.

    IDs are counted before anything is sorted, so a hot line is one row; ranks are
    counted within ranges of IDs and shifted by the ranges before."""
    ids = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ids = ids.withColumn("b", F.conv(F.substring(F.hex("id"), 1, BUCKET_BITS // 4), 16, 10).cast("int"))
    ids = staged(ids)
    before = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    ranges = ids.groupBy("b").agg(F.sum("n").alias("m")).select(F.col("b").alias("rb"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("b").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    ids = ids.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ids.join(F.broadcast(ranges), F.col("b") == F.col("rb")).select("id", (F.col("start") + F.col("inside")).alias("rank"))


def doubled(level: DataFrame, k: int) -> DataFrame:
    """Ranks by 2k lines of the suffixes that share them, from the ranks by k."""
    pairs = level.withColumn("_j", F.lead("i", k).over(_doc())).withColumn("_r", F.lead("rank", k).over(_doc()))
    # k rows on is k lines on only if no line between has dropped out
    pairs = staged(pairs.filter(F.col("_j") == F.col("i") + k).drop("_j"))
    named = staged(pairs.groupBy("rank", "_r").agg(F.count(F.lit(1)).alias("n")))
    # a rank with very many next ranks has them ordered in ranges: the ranges' sums come first
    hot = named.groupBy(F.col("rank").alias("_hot")).agg(F.count(F.lit(1)).alias("m"), F.max("_r").alias("top")).filter(F.col("m") > RANK_ROWS).drop("m")
    hot = staged(hot)
    if n_hot := hot.count():
        width = F.expr(f"top div {RANGES} + 1")
        named = named.join(maybe_broadcast(hot, 24, n_hot), F.col("rank") == F.col("_hot"), "left").withColumn("b", F.when(F.col("_hot").isNotNull(), F.floor(F.col("_r") / width)))
        sums = named.filter("b IS NOT NULL").groupBy(F.col("rank").alias("_rank"), F.col("b").alias("_range")).agg(F.sum("n").alias("s"))
        before = W.partitionBy("_rank").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("start", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
        named = named.join(maybe_broadcast(sums, 32, n_hot * RANGES), (F.col("rank") == F.col("_rank")) & (F.col("b") == F.col("_range")), "left")
    else:
        named = named.withColumn("b", F.lit(None).cast("long")).withColumn("start", F.lit(0))
    inside = W.partitionBy("rank", "b").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    named = named.withColumn("next", F.col("rank") + F.coalesce("start", F.lit(0)) + F.coalesce(F.sum("n").over(inside), F.lit(0))).filter("n > 1")
    named = named.select(F.col("rank").alias("_a"), F.col("_r").alias("_b"), "next")
    return pairs.join(named, (F.col("rank") == F.col("_a")) & (F.col("_r") == F.col("_b"))).select(*[c for c in level.columns if c != "rank"], F.col("next").alias("rank"))


def _doc() -> WindowSpec:
    return W.partitionBy("doc_id", "th").orderBy("i")


_PLACE = ("doc_id", "th", "i")


def _earlier(runs: DataFrame, names: list[str]) -> DataFrame:
    """Runs (doc_id, th, i, need) of which the same interval has an earlier one."""
    place = F.struct(*_PLACE)
    first = runs.groupBy("need", *names).agg(F.min(place).alias("_first"))
    first = staged(first).select(F.col("need").alias("_need"), *[F.col(n).alias(f"_{n}") for n in names], "_first")
    on = [F.col(n) == F.col(f"_{n}") for n in ["need", *names]]
    return runs.join(first, on).filter(~place.eqNullSafe(F.col("_first"))).select(*_PLACE, "need")


def deleted_lines(docs: DataFrame, min_words: int = 5, tails: bool = False) -> DataFrame:
    """doc_id, th, i: the lines in later copies of repeated runs (i: among non-blank lines)."""
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    lines = staged(lines_of(docs))
    ranks = first_ranks(lines)
    level = lines.join(ranks, "id").select(*_PLACE, "line", "words", "rank")
    # lines needed from each on for min_words words: a non-blank line has one at least
    need = F.lit(None)
    sofar = F.sum("words").over
    for n in range(min_words, 0, -1):
        need = F.when(sofar(_doc().rowsBetween(0, n - 1)) >= min_words, n).otherwise(need)
    if tails:
        # also the runs that hold min_words words with their first line only: the shortest up to their last
        upto = [F.lit(0), *[sofar(_doc().rowsBetween(0, n - 1)) for n in range(1, min_words + 1)]]
        short = [(upto[n] >= min_words) & ((upto[n - 1] < min_words) | (upto[n] - F.col("words") < min_words)) for n in range(1, min_words + 1)]
        need = F.array_compact(F.array(*[F.when(short[n - 1], n) for n in range(1, min_words + 1)]))
    level = staged(level.withColumn("need", need))
    found, k = [], 1
    while True:
        here = level.withColumn("need", F.explode("need")) if tails else level
        here = here.filter(F.col("need").between(k, 2 * k - 1))
        found.append(_earlier(here.filter(F.col("need") == k), ["rank"]))
        if k > 1:
            tail = level.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("i").alias("_i"), F.col("rank").alias("tail"))
            at = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("_i") == F.col("i") + F.col("need") - k)
            found.append(_earlier(here.filter(F.col("need") > k).join(tail, at).drop("_d", "_t", "_i"), ["rank", "tail"]))
        k *= 2
        if k > min_words:
            break
        level = staged(doubled(level, k // 2))
    runs = found[0]
    for f in found[1:]:
        runs = runs.unionByName(f)
    return runs.select("doc_id", "th", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("need") - 1)).alias("i")).distinct()


def cut_by(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with `text` less the lines of gone, and n_lines, n_deleted, runs.

    The kept lines are slices between deleted ones, so a text takes time in
    proportion to its lines."""
    per = gone.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.sort_array(F.collect_list("i")).alias("_gone"))
    own = docs.columns
    out = docs.select(F.struct(*own).alias("row"), "doc_id", "text", text_key().alias("_th"))
    out = out.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    out = out.withColumn("_l", F.split("text", "\n"))
    numbered = F.transform(F.col("_l"), lambda x, i: F.struct(i.alias("i"), x.alias("t")))
    full = F.transform(F.filter(numbered, lambda s: s["t"].rlike(r"[^\x20\x09-\x0D]")), lambda s: s["i"])
    out = out.withColumn("_full", F.when(F.col("text").isNull(), F.array().cast("array<int>")).otherwise(full))
    out = out.withColumn("_cut", F.transform(F.col("_gone"), lambda g: F.col("_full")[g]))
    bounds = F.concat(F.array(F.lit(-1)), F.col("_cut"), F.array(F.size("_l")))
    out = out.withColumn("_b", bounds)
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_b") - 2), lambda j: F.slice(F.col("_l"), F.col("_b")[j] + 2, F.col("_b")[j + 1] - F.col("_b")[j] - 1)))
    starts = F.filter(F.transform(F.col("_gone"), lambda g, i: F.when((i == 0) | (F.get(F.col("_gone"), i - 1) < g - 1), g)), lambda x: x.isNotNull())
    new = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    zero = F.lit(0)
    return out.select(
        "row", new.alias("text"), F.size("_full").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.coalesce("_gone", F.array().cast("array<int>"))), zero).cast("long").alias("n_deleted"),
        F.size(F.coalesce(starts, F.array().cast("array<int>"))).cast("long").alias("n_runs"),
    )


def line_dedup(docs: DataFrame, min_words: int = 5, tails: bool = False) -> DataFrame:
    """row (the document as it was), text (less later copies), n_lines, n_deleted, n_runs."""
    with scope() as keep:
        gone = keep(staged(deleted_lines(docs, min_words, tails)))
    return cut_by(docs, gone)


def _at(table: DataFrame, doc: str, th: str, i: Column, names: dict[str, str]) -> tuple[DataFrame, Column]:
    """table with the columns `names` of it, under new names, and how it meets (doc, th, i)."""
    right = table.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("i").alias("_i"), *[F.col(c).alias(n) for c, n in names.items()])
    return right, F.col(doc).eqNullSafe(F.col("_d")) & (F.col(th) == F.col("_t")) & (i == F.col("_i"))


def repeated_runs(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """The maximal repeated runs: doc_id, start, n_lines, first_doc, first_start (lines are
    counted among the non-blank ones).

    Doubling goes on until no two suffixes share a prefix. Of each suffix the deepest interval
    with an earlier one is taken, and their longest common prefix is put together
    from the ranks of the levels below. Runs that go on from the line before, in both documents,
    are left out; runs with different first copies may overlap."""
    with scope() as keep:
        return keep(staged(_repeated_runs(docs, min_words)))


def _repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    lines = staged(lines_of(docs))
    level = staged(lines.join(first_ranks(lines), "id").select(*_PLACE, "rank"))
    place = F.struct(*_PLACE)
    levels, found, k = [], None, 1
    while True:
        first = level.groupBy(F.col("rank").alias("_rank")).agg(F.min(place).alias("p"))
        here = level.join(first, F.col("rank") == F.col("_rank")).filter(~place.eqNullSafe(F.col("p"))).select(*_PLACE, "p", F.lit(k).alias("n"))
        found = here if found is None else found.unionByName(here)
        levels.append((k, level))
        level = staged(doubled(level, k))
        k *= 2
        if level.isEmpty():
            break
    pairs = found.groupBy(*_PLACE).agg(F.max_by("p", "n").alias("p"), F.max("n").alias("n"))
    pairs = staged(pairs.select(*_PLACE, F.col("p.doc_id").alias("first_doc"), F.col("p.th").alias("first_th"), F.col("p.i").alias("first_start"), "n"))
    before = lambda c: F.lag(c).over(_doc())
    goes_on = (before("i") == F.col("i") - 1) & before("first_doc").eqNullSafe(F.col("first_doc")) & (before("first_th") == F.col("first_th")) & (before("first_start") == F.col("first_start") - 1)
    runs = pairs.withColumn("_on", F.coalesce(goes_on, F.lit(False))).filter("NOT _on").drop("_on")
    for k, level in reversed(levels):
        right, on = _at(level, "doc_id", "th", F.col("i") + F.col("n"), {"rank": "_own"})
        runs = runs.join(right, on, "left").drop("_d", "_t", "_i")
        right, on = _at(level, "first_doc", "first_th", F.col("first_start") + F.col("n"), {"rank": "_first"})
        runs = runs.join(right, on, "left").drop("_d", "_t", "_i")
        runs = staged(runs.withColumn("n", F.col("n") + F.when(F.col("_own") == F.col("_first"), k).otherwise(0)).drop("_own", "_first"))
    sofar = lines.withColumn("upto", F.sum("words").over(_doc()))
    right, on = _at(sofar, "doc_id", "th", F.col("i"), {"upto": "_a", "words": "_w"})
    runs = runs.join(right, on).drop("_d", "_t", "_i")
    right, on = _at(sofar, "doc_id", "th", F.col("i") + F.col("n") - 1, {"upto": "_z"})
    runs = runs.join(right, on).filter(F.col("_z") - F.col("_a") + F.col("_w") >= min_words)
    return runs.select("doc_id", F.col("i").alias("start"), F.col("n").alias("n_lines"), "first_doc", "first_start")


def dedup_documents(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """The documents with later copies of repeated line runs deleted, maximal runs to
    their ends, same columns; n_chars, if there, is counted again."""
    out = line_dedup(docs, min_words, tails=True)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
