"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of each 32 bytes is taken at every place of a text; of each 64 places in a
row, the one with the least hash is a cut. A chunk goes from the 32 bytes of one cut to the end
of the 32 bytes of the next, 33 to 96 bytes: what is cut inside a repeated passage is the
same wherever it stands, an insertion moves only the cuts near it, and two copies of any 159
bytes share a chunk. Of the chunks with one digest the first in order of (doc_id, text,
place) stays; later ones are joined to runs, and a run is compared byte by byte with the
first copy, 96 bytes beyond it on both sides, as the next cuts are no further. Stretches
of equal bytes that meet are one; cut back to whole words, those of `min_words` words, or of
`min_bytes` bytes where words are long or not spaced, are deleted.

Digests are counted before any chunk meets another, so a chunk that stands in a
third of all documents is one row of the join's small side, and no pairs are made.

Where `min_words` words stand within less than 159 bytes, cuts are denser as well: of each 34
places one, so that any two copies of 99 bytes (50 words of one letter) share a chunk. A passage
of short words says so itself, whatever stands around it, so its copies are cut alike.

Edge cases: null and empty texts have no chunks; null doc_ids come first in order;
rows equal in doc_id and text are one document; a text may become empty; repeats
within one text count as well; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import GEAR, SPACES, blocks, bound_batches, maybe_broadcast, mix64, offsets_of, scope, spans_of, staged, text_key, unstage

#: Bytes of a window, and places of which one is a cut.
WINDOW, REACH = 32, 64
#: Bytes of a block of texts, and the multiplier of its prefix sums with its inverse.
BLOCK = 1 << 20
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_UNEQUAL = np.array([True] + [False] * 255)
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))


def windows_of(data: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Starts of the windows that are cuts, the least of each `reach` in a row, in order; positions in data."""
    h = GEAR[data]
    for w in (1, 2, 4, 8, 16):
        h[w:] += h[:-w] << np.uint32(w)
    low = np.uint64(0xFFFFFFFF)
    key = (h.astype(np.uint64) << np.uint64(32)) | (low - np.arange(len(data), dtype=np.uint64))
    wide = 1
    while wide < reach:
        w = min(wide, reach - wide)
        key[w:] = np.minimum(key[w:], key[:-w])
        wide += w
    skip = WINDOW + reach - 2  # the first place whose windows all lie in the text
    n = np.maximum(np.diff(offsets) - skip, 0)
    ends = np.repeat(offsets[:-1] + skip - (np.cumsum(n) - n), n) + np.arange(n.sum())
    best = (low - (key[ends] & low)).astype(np.int64)
    return best[np.concatenate([[True], best[1:] != best[:-1]])] - (WINDOW - 1) if len(best) else best


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64; kept by the worker."""
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, BLOCK) - 1, base, np.uint64)]))
    return _POWERS[base][:n]


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each span, from sums over all bytes before it: spans may overlap."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[data] * _powers(_STEP, len(data)))])
        h = (sums[ends] - sums[starts]) * _powers(_BACK, len(data))[starts]
        return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


def short_worded(data: np.ndarray, offsets: np.ndarray, min_words: int) -> np.ndarray:
    """Places in a run of min_words words whose bytes are too few for two cuts."""
    starts, ends, per = spans_of(data, offsets)
    text = np.repeat(np.arange(len(per)), per)
    n = max(len(starts) - min_words + 1, 0)
    first = np.flatnonzero((text[:n] == text[min_words - 1 :]) & (ends[min_words - 1 :] - starts[:n] < WINDOW + 2 * REACH - 1)) if n else np.empty(0, np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts[first], 1)
    np.add.at(edge, ends[first + min_words - 1], -1)
    return np.cumsum(edge[:-1]) > 0


def chunks_of(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the chunks between neighbouring cuts; positions in data."""
    out = []
    for reach in (REACH, max(1, (2 * min_words - WINDOW) // 2)):
        if reach < REACH:
            short = short_worded(data, offsets, min_words)
            if not short.any():
                break
        elif out:
            break
        cuts = windows_of(data, offsets, reach)
        doc = np.searchsorted(offsets, cuts, side="right") - 1
        own = np.flatnonzero(doc[1:] == doc[:-1])
        doc, starts, ends = doc[own], cuts[own], cuts[own + 1] + WINDOW
        if out:
            covered = np.concatenate([[0], np.cumsum(short)])
            inside = covered[ends] - covered[starts] == ends - starts
            doc, starts, ends = doc[inside], starts[inside], ends[inside]
        out.append((doc, starts, ends))
    doc, starts, ends = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(out) > 1:  # a chunk that both give is one
        places = np.unique(np.stack([doc, starts, ends]), axis=1)
        doc, starts, ends = places
    return doc, starts, ends


def cut_chunks(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, th, start, size (bytes), d (digest) of the chunks between neighbouring cuts."""
    rows = docs.filter(F.octet_length("text") >= WINDOW + 2).select("doc_id", text_key().alias("th"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            data, offsets = offsets_of(b.column("text"))
            doc, starts, ends = chunks_of(data, offsets, min_words)
            place = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(place), b.column("th").take(place), pa.array((starts - offsets[doc]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(span_digests(data, starts, ends).view(np.int64))], ["doc_id", "th", "start", "size", "d"])

    return bound_batches(rows).mapInArrow(run, f"doc_id {kind}, th long, start int, size int, d long")


def later_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, th, start, first_doc, first_th, a, z: runs of later chunks on one diagonal.

    first_doc has the first copy; a to z are its bytes, and more on both sides; start
    is the place of its byte a in the later text (below 0: before it)."""
    cut = staged(cut_chunks(docs, min_words))
    again = not docs.groupBy("doc_id", text_key().alias("th")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    # what is counted is written before it is joined: the rows of one digest can be split over tasks
    twice = staged(cut.groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d"))
    met = staged(cut.join(twice, "d"))
    unstage(cut)
    place = F.struct("doc_id", "th", "start")
    first = staged(met.groupBy("d").agg(F.min(place).alias("first")))
    later = met.join(first, "d").filter(~place.eqNullSafe(F.col("first")))
    later = later.select("doc_id", "th", "start", "size", F.col("first.doc_id").alias("first_doc"), F.col("first.th").alias("first_th"), F.col("first.start").alias("at"))
    later = later.distinct() if again else later
    own = W.partitionBy("doc_id", "th").orderBy("start")
    before = lambda c: F.lag(c).over(own)
    near = (F.col("start") - before("start") <= 2 * REACH) & (F.col("start") - before("start") == F.col("at") - before("at"))
    same = before("first_doc").eqNullSafe(F.col("first_doc")) & (before("first_th") == F.col("first_th")) & near
    later = later.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(own))
    runs = later.groupBy("doc_id", "th", "run").agg(F.min("start").alias("start"), F.first("first_doc").alias("first_doc"), F.first("first_th").alias("first_th"), F.min("at").alias("at"), F.max(F.col("at") + F.col("size")).alias("last"))
    beyond = WINDOW + REACH
    a = F.greatest(F.col("at") - beyond, F.lit(0))
    out = staged(runs.select("doc_id", "th", (F.col("start") - F.col("at") + a).alias("start"), "first_doc", "first_th", a.alias("a"), (F.col("last") + beyond).alias("z")))
    unstage(met)
    return out


def _first_bytes(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """f, ft, fa, fz, raw: the bytes of first copies that the runs name, each once."""
    need = runs.select("first_doc", "first_th", "a", "z").distinct().groupBy(F.col("first_doc").alias("f"), F.col("first_th").alias("ft")).agg(F.collect_list(F.struct("a", "z")).alias("parts"))
    need = staged(need)
    n, parts = need.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("parts")), F.lit(0))).first()
    need = maybe_broadcast(need, 32, 2 * n + parts)
    rows = docs.select("doc_id", text_key().alias("th"), "text").join(need, F.col("doc_id").eqNullSafe(F.col("f")) & (F.col("th") == F.col("ft")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            doc, a, z, raw = [], [], [], []
            for i, (text, parts) in enumerate(zip(b.column("text").to_pylist(), b.column("parts").to_pylist(), strict=True)):
                whole = text.encode()
                for p in parts:
                    doc.append(i)
                    a.append(p["a"])
                    z.append(p["z"])
                    raw.append(whole[p["a"] : p["z"]])
            place = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("f").take(place), b.column("ft").take(place), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(raw, pa.binary())], ["f", "ft", "fa", "fz", "raw"])

    return bound_batches(rows.select("f", "ft", "parts", "text")).mapInArrow(run, f"f {kind}, ft long, fa int, fz int, raw binary").dropDuplicates(["f", "ft", "fa", "fz"])


def equal_stretches(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of the maximal stretches of a window or more where the bytes of a run's
    text, from its start on, equal those of the first copy: bounds are the runs' in raw."""
    n = np.diff(bounds)
    at = np.arange(len(raw)) - np.repeat(bounds[:-1] - start, n)
    inside = (at >= 0) & (at < np.repeat(np.diff(offsets)[doc], n))
    place = np.where(inside, at + np.repeat(offsets[:-1][doc], n), 0)
    same = inside & (data[place] == raw) if len(data) else inside
    a, z, per = spans_of(same.astype(np.uint8), bounds, _UNEQUAL)
    run = np.repeat(np.arange(len(n)), per)
    long = z - a >= WINDOW
    run, a, z = run[long], a[long], z[long]
    return run, a - bounds[run] + start[run], z - bounds[run] + start[run]


def to_words(own: np.ndarray, a: int, z: int) -> tuple[int, int]:
    """The stretch less a part of a word at its ends, or of a character if it has no such end
    within 64 bytes."""
    if a > 0:
        gap = SPACES[own[a - 1 : min(a + REACH, z)]]
        starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        if len(starts):
            a += int(starts[0])
        while a < z and own[a] & 0xC0 == 0x80:
            a += 1
    if z < len(own):
        lo = max(a, z - REACH)
        gap = SPACES[own[lo : z + 1]]
        ends = np.flatnonzero(~gap[:-1] & gap[1:])
        if len(ends):
            z = lo + int(ends[-1]) + 1
        while z > a and z < len(own) and own[z] & 0xC0 == 0x80:
            z -= 1
    return a, z


def copied_spans(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, raw: np.ndarray, bounds: np.ndarray, min_words: int, min_bytes: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, start, end, its runs) of the copied spans of a block of texts, in order."""
    run, a, z = equal_stretches(data, offsets, doc, start, raw, bounds)
    base = offsets[doc[run]] + doc[run]  # a gap between texts, so that stretches of two never meet
    order = np.argsort(base + a, kind="stable")
    run, a, z = run[order], (base + a)[order], (base + z)[order]
    if not len(run):
        return
    first = np.concatenate([[True], a[1:] > np.maximum.accumulate(z)[:-1]])
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(a))
    end = np.maximum.reduceat(z, lo)
    for i in np.flatnonzero(end - a[lo] >= min(2 * min_words - 1, min_bytes)).tolist():
        of = int(doc[run[lo[i]]])
        own = data[offsets[of] : offsets[of + 1]]
        s, e = to_words(own, int(a[lo[i]] - offsets[of] - of), int(end[i] - offsets[of] - of))
        if e - s >= min_bytes or (e - s >= 2 * min_words - 1 and len(spans_of(own[s:e], np.array([0, e - s]))[0]) >= min_words):
            yield of, s, e, run[lo[i] : hi[i]]


def substring_dedup(docs: DataFrame, min_words: int = 50, min_bytes: int = 400) -> DataFrame:
    """Documents with later copies: doc_id, n_bytes, dup_bytes, first_doc_ids (where the
    first copies stand), spans (start, end in bytes) and text without them. A
    document that is not listed has none."""
    with scope() as keep:
        return keep(staged(_substring_dedup(docs, min_words, min_bytes)))


def _substring_dedup(docs: DataFrame, min_words: int, min_bytes: int) -> DataFrame:
    runs = later_runs(docs, min_words)
    same = F.col("first_doc").eqNullSafe(F.col("f")) & (F.col("first_th") == F.col("ft")) & (F.col("a") == F.col("fa")) & (F.col("z") == F.col("fz"))
    per = runs.join(_first_bytes(docs, runs), same).groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(F.struct("start", "first_doc", "raw")).alias("runs"))
    # texts without a run do not move, as long as the ids of the others are few
    ids = staged(runs.select(F.col("doc_id").alias("_i"), F.col("th").alias("_h")).distinct())
    rows = docs.select("doc_id", text_key().alias("_th"), "text").join(maybe_broadcast(ids, 32), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_h")), "left_semi")
    rows = rows.join(staged(per), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "runs", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            data, offsets = offsets_of(b.column("text"))
            lists = b.column("runs")
            flat = lists.flatten()
            raw, bounds = offsets_of(flat.field("raw"))
            owner = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            spans: dict[int, list[tuple[int, int]]] = {}
            of: dict[int, list[np.ndarray]] = {}
            for d, s, e, runs in copied_spans(data, offsets, owner, flat.field("start").to_numpy(), raw, bounds, min_words, min_bytes):
                spans.setdefault(d, []).append((s, e))
                of.setdefault(d, []).append(runs)
            size, gone, ids, cut, left = [], [], [], [], []
            firsts = flat.field("first_doc")
            for d in spans:
                text, at, parts = data[offsets[d] : offsets[d + 1]].tobytes(), 0, []
                for s, e in spans[d]:
                    parts.append(text[at:s])
                    at = e
                parts.append(text[at:])
                left.append(b"".join(parts).decode())
                size.append(len(text))
                gone.append(sum(e - s for s, e in spans[d]))
                ids.append(sorted(set(firsts.take(pa.array(np.concatenate(of[d]))).to_pylist()) - {None}))
                cut.append([{"start": s, "end": e} for s, e in spans[d]])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            own = b.column("doc_id")
            yield pa.RecordBatch.from_arrays([own.take(pa.array(list(spans), pa.int64())), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(ids, pa.list_(own.type)), pa.array(cut, span), pa.array(left, pa.string())], ["doc_id", "n_bytes", "dup_bytes", "first_doc_ids", "spans", "text"])

    return bound_batches(rows).mapInArrow(run, f"doc_id {kind}, n_bytes long, dup_bytes long, first_doc_ids array<{kind}>, spans array<struct<start:int,end:int>>, text string")
