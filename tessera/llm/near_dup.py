"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Equal sets become one class first.
Classes are then branched down independent trees: in a node, a few positions of the
minwise signature are chosen, and a class goes to one child for each, named by its
token there, so similar sets keep meeting and others part. Nodes of up to `SMALL`
classes are compared exhaustively, and those of up to an EACH-th of SALT_ROWS as well unless they are tight or hold
too many pairs that pass; in others every class is compared with a
few pivots, and the node is branched again. In a node that is tight (seven in ten of a
hashed sample of it share half of one signature) the classes like that one are not
branched, as that would only copy them; those with next to nothing of it are branched only,
those between go both ways. Of what was not branched, the classes that are not in
its main component after linking are compared with all the others, in blocks, by full sets.

Compared means: the signatures' agreement lets the pair pass as a candidate (a bound
that a linked pair misses with a chance of about 1e-7). Every link is confirmed on the full
sets. Pairs that the first confirmed links already connect need no confirming: links
between different components are all that is left to find.

With TREES x ROOTS positions at the root, a pair at the threshold of 0.85 meets in no
node with a chance of 0.15 ** 8 = 3e-7 (at 0.8: 3e-6), and deeper nodes have ROOTS tries each.

Rows are sorted by node and walked once, which counts a node as it comes. Only nodes of
more than SALT_ROWS rows are counted before: they are spread over tasks by salt, with the
sample sent to each. Tasks hold no more than SALT_ROWS rows of a node at a time, and a node of no more than these is
branched to the end where it is: whatever lies below it is of its own rows, so its children are no rows of output, and
a pair that meets in several of them is one. Only nodes of more rows send children on, each as many as part it into
nodes of half of SALT_ROWS. Pairs: at most SMALL / 2 a class in a node that is compared exhaustively, one in a large one.

A class has a number of its own, so ids may be of any type and a doc_id with several texts
mixes up nothing.

Edge cases: null, empty and blank texts have an empty set, are linked with nothing and
kept; texts with fewer words than a shingle have their whole sequence as one; null
doc_ids take no part (component_id null, kept); rows with one doc_id are one node;
an empty table gives no rows; extra columns are ignored, and kept by dedup_documents
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER, blocks, bound_batches, hash_spans, maybe_broadcast, mix64, offsets_of, scope, spans_of, staged
from .components import components

TREES, ROOTS = 4, 2
SIGNATURE = 40  # positions; the first TREES * ROOTS name the trees' children
SMALL = 32
PIVOTS = 4
DEPTH = 8
#: Rows of a node in one task (1 MB); the part of them that is compared exhaustively, or are sets of a tight node in one task;
#: hot nodes that are named in an expression, more are joined.
SALT_ROWS, EACH, HOT_LIST = 8192, 8, 64
#: Equal places of a signature from which a class is like the tight node's, and under which it has nothing of it:
#: a pair at 0.8 of which one has ALIKE places and the other under FAR has a chance of 1e-8.
ALIKE, FAR = SIGNATURE // 2, 5
TIGHT_SHARE = 0.7
#: Places of a signature that name a child at most, and the chance that a pair at the threshold is lost below a node: that of
#: ROOTS tries of one place a level at 0.8, however many levels.
NAMED, LOST = 6, 0.0625
#: Sets of a tight node that are asked about at once.
ASKED = 1024

_RNG = np.random.Generator(np.random.PCG64(85))
_A = _RNG.integers(1, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SIGNATURE, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle fingerprints of each text."""
    low = LOWER[data]
    starts, ends, per = spans_of(low, offsets)
    h = hash_spans(low, starts, ends)
    with np.errstate(over="ignore"):
        at = 0
        for n in per.tolist():
            w = h[at : at + n]
            at += n
            if not n:
                yield w
                continue
            m = max(1, n - k + 1)
            x = np.full(m, min(n, k), np.uint64)
            for j in range(min(n, k)):
                x = x + w[j : j + m] * _PLACE[j]
            x = mix64(x)
            x.sort()
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]


def digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix64(s ^ _PLACE[14]).sum(dtype=np.uint64), mix64(s ^ _PLACE[15]).sum(dtype=np.uint64)
        return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def minwise(s: np.ndarray) -> np.ndarray:
    out = np.empty(SIGNATURE, np.uint64)
    with np.errstate(over="ignore"):
        if len(s) <= 50_000:
            out[:] = (s[None, :] * _A[:, None] + _B[:, None]).min(axis=1)
        else:
            for i in range(SIGNATURE):
                out[i] = (s * _A[i] + _B[i]).min()
        return mix64(out)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), d1, d2 (the set's digest), roots (array of long), sig (binary, 16 bits a position)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            n, d1, d2, roots, sig = [], [], [], [], []
            for s in shingle_sets(*offsets_of(b.column("text")), k):
                n.append(len(s))
                x, y = digest(s)
                d1.append(x)
                d2.append(y)
                m = minwise(s) if len(s) else np.zeros(SIGNATURE, np.uint64)
                roots.append(m[: TREES * ROOTS].view(np.int64))
                sig.append((m & np.uint64(0xFFFF)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(roots, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "n", "d1", "d2", "roots", "sig"])

    return bound_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, roots array<long>, sig binary")


# ----------------------------------------------------------------- nodes of the trees


def agreement_bound(similarity: float) -> int:
    sd = math.sqrt(SIGNATURE * similarity * (1 - similarity))
    return max(1, math.floor(SIGNATURE * similarity - 5.2 * sd))


def _passing(sig_a: np.ndarray, n_a: np.ndarray, sig_b: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Agreement of each pair that may be linked, 0 for others."""
    same = (sig_a[:, None, :] == sig_b[None, :, :]).sum(axis=2, dtype=np.int16)
    lo, hi = np.minimum(n_a[:, None], n_b[None, :]), np.maximum(n_a[:, None], n_b[None, :])
    return np.where((same >= agreement_bound(similarity)) & (lo >= (similarity - 1e-9) * hi), same, 0)


_NODE = "node long, depth int, rep long, n long, sig binary"
_OUT = "kind int, node long, depth int, rep long, n long, sig binary, other long"
PAIR, MORE_PAIRS, CHILD, TIGHT = 0, 1, 2, 3


class _Rows:
    """Rows of output, gathered as columns."""

    def __init__(self) -> None:
        self.kind, self.node, self.depth, self.rep, self.n, self.sig, self.other = [], [], [], [], [], [], []

    def pairs(self, kind: int, a: np.ndarray, b: np.ndarray) -> None:
        self.kind += [kind] * len(a)
        self.node += [None] * len(a)
        self.depth += [None] * len(a)
        self.rep += np.maximum(a, b).tolist()
        self.n += [None] * len(a)
        self.sig += [None] * len(a)
        self.other += np.minimum(a, b).tolist()

    def children(self, node: list, depth: int, rep: np.ndarray, n: np.ndarray, sig: np.ndarray) -> None:
        self.kind += [CHILD] * len(rep)
        self.node += node
        self.depth += [depth] * len(rep)
        self.rep += rep.tolist()
        self.n += n.tolist()
        self.sig += [s.tobytes() for s in sig]
        self.other += [None] * len(rep)

    def tight(self, node: int, rep: np.ndarray, other: list) -> None:
        """Members of a tight node, each with the pivot it may be linked with, or none."""
        self.kind += [TIGHT] * len(rep)
        self.node += [node] * len(rep)
        self.depth += [None] * len(rep)
        self.rep += rep.tolist()
        self.n += [None] * len(rep)
        self.sig += [None] * len(rep)
        self.other += other

    def below(self, other: _Rows) -> None:
        """The rows of a node and all below it, its pairs once each."""
        tight = [i for i, kind in enumerate(other.kind) if kind == TIGHT]
        met: dict = {}
        for kind, a, b in zip(other.kind, other.rep, other.other, strict=True):
            if kind != TIGHT:
                met[a, b] = min(kind, met.get((a, b), kind))
        for kind in (PAIR, MORE_PAIRS):
            of = np.array([p for p, k in met.items() if k == kind], np.int64).reshape(-1, 2)
            self.pairs(kind, of[:, 0], of[:, 1])
        for c in ("kind", "node", "depth", "rep", "n", "sig", "other"):
            column = getattr(other, c)
            getattr(self, c).extend(column[i] for i in tight)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(getattr(self, c), k) for c, k in zip(("kind", "node", "depth", "rep", "n", "sig", "other"), kinds, strict=True)], ["kind", "node", "depth", "rep", "n", "sig", "other"])


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "salt", "salts", "depth", "lead", "rep", "n")}
    raw, _ = offsets_of(b.column("sig"))
    out["sig"] = raw.view("<u2").reshape(-1, SIGNATURE) if len(raw) else np.empty((0, SIGNATURE), "<u2")
    return out


class _Large:
    """What is known of a large node: its pivots, and the class that a tight one is like."""

    def __init__(self, c: dict, lo: int, hi: int) -> None:
        sample = slice(lo, min(lo + SMALL, hi))
        sig = c["sig"][sample]
        like = (sig[:, None, :] == sig[None, :, :]).sum(axis=2) >= ALIKE
        mid = int(like.sum(axis=1).argmax())
        self.node, self.depth = int(c["node"][lo]), int(c["depth"][lo])
        self.last = self.depth >= DEPTH
        self.tight = like[mid].mean() >= TIGHT_SHARE
        self.middle = sig[mid].copy()
        # as many places as part a crowd that is alike by this much into nodes of half of what one task holds, or compares
        size, alike = max(hi - lo, SALT_ROWS * int(c["salts"][lo])), (sig[:, None, :] == sig[None, :, :]).mean()
        part = SALT_ROWS if c["salt"][lo] >= 0 else SALT_ROWS // EACH
        self.named = 1 if self.tight else min(NAMED, max(1, math.ceil(math.log(max(2 * size / part, 1)) / -math.log(min(max(alike, 1e-3), 0.99)))))
        # the middle and a few others are pivots
        p = lo + np.unique([mid, *range(min(PIVOTS, len(sig)))])
        self.rep, self.sig, self.n = c["rep"][p].copy(), c["sig"][p].copy(), c["n"][p].copy()


def _walk(similarity: float):
    """Rows sorted by (node, salt, lead, ord) to candidate pairs, children and tight nodes."""

    def small(out: _Rows, c: dict, lo: int, hi: int) -> None:
        rep = c["rep"][lo:hi]
        ok = np.tril(_passing(c["sig"][lo:hi], c["n"][lo:hi], c["sig"][lo:hi], c["n"][lo:hi], similarity), -1)
        i = np.flatnonzero(ok.any(axis=1))
        if not len(i):
            return
        best = np.argmax(ok[i] > 0, axis=1)  # the first that passes
        out.pairs(PAIR, rep[i], rep[best])
        ok[i, best] = 0
        a, b = np.nonzero(ok)
        out.pairs(MORE_PAIRS, rep[a], rep[b])

    def whole(out: _Rows, c: dict, lo: int, hi: int) -> None:
        """A node that is all here, and the nodes below it."""
        if hi - lo <= SMALL:
            return small(out, c, lo, hi)
        all_of_it, nodes = _Rows(), [{k: v[lo:hi] for k, v in c.items()}]
        while nodes:
            medium(all_of_it, nodes.pop(), nodes)
        out.below(all_of_it)

    def medium(out: _Rows, c: dict, nodes: list[dict]) -> None:
        lo, hi = 0, len(c["rep"])
        if hi <= SMALL:
            return small(out, c, lo, hi)
        of, rep = _Large(c, lo, hi), c["rep"]
        left, right, most = [], [], SMALL // 2 * hi if hi <= SALT_ROWS // EACH else -1
        if not of.tight and most >= 0:
            columns, n = np.ascontiguousarray(c["sig"][lo:hi].T), c["n"][lo:hi]
            for a in range(0, hi - lo, 128):
                z, same = min(a + 128, hi - lo), np.zeros((min(128, hi - lo - a), min(a + 128, hi - lo)), np.int8)
                for v in columns:
                    same += v[a:z, None] == v[None, :z]
                low, high = np.minimum(n[a:z, None], n[None, :z]), np.maximum(n[a:z, None], n[None, :z])
                i, j = np.nonzero(np.tril((same >= agreement_bound(similarity)) & (low >= (similarity - 1e-9) * high), a - 1))
                left.append(i + a)
                right.append(j)
                most -= len(i)
                if most < 0:
                    break
        if of.tight or most < 0:
            return large(out, c, lo, hi, of, nodes)
        i, j = np.concatenate(left), np.concatenate(right)
        first = np.ones(len(i), bool)
        first[1:] = i[1:] != i[:-1]  # the first that passes
        out.pairs(PAIR, rep[i[first]], rep[j[first]])
        out.pairs(MORE_PAIRS, rep[i[~first]], rep[j[~first]])

    def large(out: _Rows, c: dict, lo: int, hi: int, of: _Large, nodes: list[dict] | None = None) -> None:
        """Children go to nodes where the node is all here, and to the next level where it is not."""
        own = np.flatnonzero(c["lead"][lo:hi] == 1) + lo
        rep, n, sig = c["rep"][own], c["n"][own], c["sig"][own]
        ok = _passing(sig, n, of.sig, of.n, similarity)
        ok[rep[:, None] == of.rep[None, :]] = 0
        partner = np.where(ok.any(axis=1), of.rep[np.argmax(ok > 0, axis=1)], -1)
        stays, goes = np.full(len(own), of.last), np.full(len(own), not of.last)
        if of.tight and not of.last:
            same = (sig == of.middle[None, :]).sum(axis=1)
            stays, goes = same >= FAR, same < ALIKE
        out.tight(of.node, rep[stays], [x if x >= 0 else None for x in partner[stays].tolist()])
        i = ~stays & (partner >= 0)
        out.pairs(PAIR, rep[i], partner[i])
        rep, n, sig = rep[goes], n[goes], sig[goes]
        with np.errstate(over="ignore"):
            tries = max(ROOTS, math.ceil(math.log(LOST) / math.log(1 - similarity**of.named * (1 - LOST)) - 1e-9))
            for j in range(tries if len(rep) else 0):
                seed = mix64(np.array([of.node], np.int64).view(np.uint64) + np.uint64(j + 1))[0]
                spots = TREES * ROOTS + np.argsort(mix64(seed + np.arange(SIGNATURE - TREES * ROOTS, dtype=np.uint64)), kind="stable")[: of.named]
                child = mix64(seed + (sig[:, spots].astype(np.uint64) * _PLACE[: of.named]).sum(axis=1, dtype=np.uint64))
                if nodes is None:
                    out.children(child.view(np.int64).tolist(), of.depth + 1, rep, n, sig)
                    continue
                order = np.argsort(child, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(child[order])) + 1):
                    if len(at) > 1:  # one alone meets nothing
                        same = {"node": child[at].view(np.int64), "salt": np.full(len(at), -1), "salts": np.zeros(len(at), int), "depth": np.full(len(at), of.depth + 1)}
                        nodes.append(same | {"lead": np.ones(len(at), int), "rep": rep[at], "n": n[at], "sig": sig[at]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        at, of = None, None  # the large node that goes on, if one does
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                c = _columns(b.slice(lo, 4096))
                if held is not None:
                    c = {k: np.concatenate([held[k], c[k]]) for k in c}
                    held = None
                size = len(c["node"])
                edges = np.flatnonzero((c["node"][1:] != c["node"][:-1]) | (c["salt"][1:] != c["salt"][:-1])) + 1
                first, last = np.concatenate([[0], edges]), np.concatenate([edges, [size]])
                # a row that is alone in its node meets nothing; the first group may go on, the last may come to more
                more = (last - first > 1) | (c["salt"][first] >= 0)
                more[0] = more[-1] = True
                out = _Rows()
                for a, z in zip(first[more].tolist(), last[more].tolist(), strict=True):
                    here = (int(c["node"][a]), int(c["salt"][a]))
                    if here == at:
                        large(out, c, a, z, of)
                    elif here[1] >= 0 and (z - a > SMALL or z < size):
                        at, of = here, _Large(c, a, z)
                        large(out, c, a, z, of)
                    elif z == size:
                        held = {k: v[a:] for k, v in c.items()}
                    else:
                        whole(out, c, a, z)  # not spread: SALT_ROWS rows at most
                if out.kind:
                    yield out.batch()
        if held is not None:
            out, size = _Rows(), len(held["node"])
            if held["salt"][0] >= 0:
                large(out, held, 0, size, _Large(held, 0, size))
            else:
                whole(out, held, 0, size)
            if out.kind:
                yield out.batch()

    return run


def _level(rows: DataFrame, similarity: float) -> DataFrame:
    """One level of all trees: candidate pairs, and the rows of the next.

    salt is -1 in nodes that are not spread."""
    hot = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts")).filter("salts > 1")
    hot = staged(hot.select(F.col("node").alias("_node"), "salts"))  # a row for SALT_ROWS rows at most
    cols = ["node", "salt", "salts", "depth", "lead", "ord", "rep", "n", "sig"]
    rows = rows.withColumn("lead", F.lit(1)).withColumn("ord", F.xxhash64("rep", F.lit("order")))
    if n_hot := hot.count():
        if n_hot <= HOT_LIST:
            salts = F.lit(None).cast("int")
            for r in hot.collect():
                salts = F.when(F.col("node") == r["_node"], r["salts"]).otherwise(salts)
            rows = rows.withColumn("salts", salts)
        else:
            rows = rows.join(maybe_broadcast(hot, 16, n_hot), F.col("node") == F.col("_node"), "left")
        first = W.partitionBy("node").orderBy("ord", "rep")
        sample = rows.filter("salts > 1").withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= SMALL).drop("rn")
        sample = sample.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("lead", F.lit(0))
        rows = rows.withColumn("salt", F.coalesce(F.pmod(F.col("ord"), F.col("salts")), F.lit(-1)).cast("int"))
        rows = rows.withColumn("salts", F.coalesce("salts", F.lit(0))).select(cols).unionByName(sample.select(cols))
    else:
        rows = rows.withColumn("salt", F.lit(-1)).withColumn("salts", F.lit(0)).select(cols)
    dealt = rows.repartition(F.col("node"), F.col("salt")).sortWithinPartitions("node", "salt", "lead", "ord", "rep")
    return dealt.drop("ord").mapInArrow(_walk(similarity), _OUT)


# ----------------------------------------------------------------- confirming


def full_sets(docs: DataFrame, reps: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """rep, set (binary, sorted 64-bit) of the classes in need (rep, distinct)."""
    need = staged(need.join(reps.select("rep", "low", "d1", "d2"), "rep"))
    text = docs.select("doc_id", "text").join(maybe_broadcast(need, 64), F.col("doc_id") == F.col("low"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            rep, out = [], []
            for r, x, y, s in zip(b.column("rep").to_pylist(), b.column("d1").to_pylist(), b.column("d2").to_pylist(), shingle_sets(*offsets_of(b.column("text")), k), strict=True):
                if digest(s) == (x, y):  # another text may stand under the same doc_id
                    rep.append(r)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(out, pa.binary())], ["rep", "set"])

    return text.select("rep", "d1", "d2", "text").mapInArrow(sets, "rep long, set binary").dropDuplicates(["rep"])


def confirmed(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) with 100 * intersection >= percent * union of the full sets.

    b's set is sent once to each group of 256 of its partners, a's once a pair."""
    size = pairs.groupBy(F.col("b").alias("_b")).agg(F.count(F.lit(1)).alias("m"))
    pairs = pairs.join(size, F.col("b") == F.col("_b")).withColumn("g", F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / 256)).cast("int")).select("a", "b", "g")
    pairs = staged(pairs)
    uses = pairs.select(F.col("a").alias("rep"), F.col("b").alias("base"), "g", F.lit(1).alias("role")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("b").alias("base"), "g", F.lit(0).alias("role")).distinct())
    full = full_sets(docs, reps, uses.select("rep").distinct(), k)
    met = uses.join(full, "rep").repartition(F.col("base"), F.col("g")).sortWithinPartitions("base", "g", "role", "rep")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base = None, np.empty(0, np.uint64)
        for b in batches:
            left, right = [], []
            for rep, bs, g, role, raw in zip(*(b.column(c).to_pylist() for c in ("rep", "base", "g", "role")), b.column("set"), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if role == 0:
                    key, base = (bs, g), s.copy()
                elif key == (bs, g):
                    both = len(base) + len(s)
                    i = np.searchsorted(base, s)
                    same = int((base[np.minimum(i, len(base) - 1)] == s).sum()) if len(base) else 0
                    if same and 100 * same >= percent * (both - same):
                        left.append(rep)
                        right.append(bs)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return met.select("rep", "base", "g", "role", "set").mapInArrow(check, "a long, b long").distinct()


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components so far."""
    r = roots.select(F.col("node").alias("_n"), "root")
    p = pairs.join(r, F.col("a") == F.col("_n"), "left").select("a", "b", F.coalesce("root", "a").alias("ra"))
    p = p.join(r, F.col("b") == F.col("_n"), "left").select("a", "b", "ra", F.coalesce("root", "b").alias("rb"))
    return p.filter("ra <> rb").select("a", "b")


class _Asked:
    """Sets that are asked about, as lists of their numbers by shingle."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        self.shingle, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))

    def shared(self, s: np.ndarray) -> np.ndarray:
        """How many shingles of s each of the sets has."""
        i = np.minimum(np.searchsorted(self.shingle, s), len(self.shingle) - 1)
        i = i[self.shingle[i] == s]
        a, n = self.first[i], self.first[i + 1] - self.first[i]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.size))


def _leftovers(docs: DataFrame, reps: DataFrame, tight: DataFrame, roots: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) within tight nodes between classes outside the main component of their node
    and all that are not in their own, by full sets.

    Tight nodes with one main component have much the same members, as one group of copies makes
    several; so all its members in tight nodes are compared at once, with the classes outside
    it in any of those nodes. The classes asked about come in blocks, as an inverted list; the
    others stream past each block, which counts their common shingles with all its sets at
    once. Of the links, only those between parts not yet connected in the block are given."""
    r = roots.select(F.col("node").alias("_n"), "root")
    t = tight.join(r, F.col("rep") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "rep")).drop("_n")
    t = staged(t.select("node", "rep", "root"))
    counts = staged(t.groupBy("node", "root").agg(F.count(F.lit(1)).alias("c")))
    main = counts.groupBy(F.col("node").alias("_m")).agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    outside = counts.join(main, F.col("node") == F.col("_m")).filter("root <> main").select(F.col("node").alias("_m"), F.col("root").alias("_r"), "main")
    ask = staged(t.join(outside, (F.col("node") == F.col("_m")) & (F.col("root") == F.col("_r"))).select("main", "rep", "root").distinct())
    sizes = ask.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("blocks"))
    inside = t.select("root", "rep").distinct().join(sizes.select(F.col("main").alias("_main")), F.col("root") == F.col("_main"), "left_semi")
    rest = staged(inside.select(F.col("root").alias("main"), "rep", "root").unionByName(ask))
    sizes = staged(rest.groupBy(F.col("main").alias("_main")).agg(F.ceil(F.count(F.lit(1)) * EACH / SALT_ROWS).cast("int").alias("salts")).join(sizes, F.col("_main") == F.col("main")).drop("main"))
    rest = rest.join(sizes, F.col("main") == F.col("_main")).drop("_main")
    rest = rest.join(full_sets(docs, reps, rest.select("rep").distinct(), k), "rep")
    ask = rest.filter("root <> main").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("role", F.lit(0)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(1)).withColumn("salt", F.pmod(F.xxhash64("rep"), "salts").cast("int"))
    cols = ["main", "block", "salt", "role", "rep", "root", "set"]
    dealt = ask.select(cols).unionByName(rest.select(cols)).repartition(F.col("main"), F.col("block"), F.col("salt")).sortWithinPartitions("main", "block", "salt", "role", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, asked, parent = None, [], None, {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for b in batches:
            left, right = [], []
            for node, block, salt, role, rep, root, raw in zip(*(b.column(c).to_pylist() for c in cols[:-1]), b.column("set"), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if key != (node, block, salt):
                    key, held, asked, parent = (node, block, salt), [], None, {}
                if role == 0:
                    held.append((rep, root, s.copy()))
                    continue
                if not held:
                    continue
                if asked is None:
                    asked = _Asked([h[2] for h in held])
                both = asked.shared(s)
                for i in np.flatnonzero(100 * both >= percent * (asked.size + len(s) - both)).tolist():
                    x, y = find(held[i][1]), find(root)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        left.append(max(rep, held[i][0]))
                        right.append(min(rep, held[i][0]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


# ----------------------------------------------------------------- the join


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, of every row."""
    with scope() as keep:
        return keep(staged(_near_duplicates(docs, k, percent)))


def _near_duplicates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    similarity = percent / 100
    marks = staged(signatures(docs, k))
    full = marks.filter("n > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.any_value("n").alias("n"), F.any_value("roots").alias("roots"), F.any_value("sig").alias("sig"))
    reps = staged(reps.withColumn("rep", F.monotonically_increasing_id()))
    # one doc_id may hold several texts: their classes are linked through it
    texts = full.groupBy("doc_id").agg(F.count_distinct("d1", "d2").alias("m")).filter("m > 1").drop("m")
    own = full.join(texts, "doc_id", "left_semi").select("doc_id", "d1", "d2").distinct().join(reps.select("d1", "d2", "rep"), ["d1", "d2"])
    own = staged(own.select("doc_id", "rep"))
    own = own.join(own.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").filter("a <> b").distinct()

    with scope() as hold:
        pairs, tight = map(hold, _candidates(reps, similarity))
    with scope() as hold:
        links = hold(staged(confirmed(docs, reps, pairs.filter(F.col("kind") == PAIR).select("a", "b"), k, percent).unionByName(own)))
    with scope() as hold:
        tied = hold(staged(components(links)))
    with scope() as hold:
        rest = _between(pairs.filter(F.col("kind") == MORE_PAIRS).select("a", "b"), tied)
        more = hold(staged(_leftovers(docs, reps, tight, tied, k, percent).unionByName(confirmed(docs, reps, rest.distinct(), k, percent))))
    with scope() as hold:
        tied = hold(staged(components(links.unionByName(more))))
    least = staged(tied.join(reps.select("rep", "low"), F.col("node") == F.col("rep")).groupBy(F.col("root").alias("_root")).agg(F.min("low").alias("least")))
    tied = tied.join(maybe_broadcast(least, 32), F.col("root") == F.col("_root")).select(F.col("node").alias("rep"), "least")
    classes = reps.select("d1", "d2", "rep", "low").join(tied, "rep", "left").select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.coalesce("least", "low").alias("root"))
    here = marks.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2", F.when(F.col("n") > 0, F.col("doc_id")).isNotNull().alias("has"))
    out = here.join(classes, F.col("has") & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _candidates(reps: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, kind of the pairs to confirm; node, rep of the tight nodes), from all levels of the trees."""
    roots = reps.select("rep", "n", "sig", F.posexplode("roots").alias("i", "v"))
    rows = roots.select(F.xxhash64(F.lit("tree"), "i", "v").alias("node"), F.lit(1).alias("depth"), "rep", "n", "sig")
    pairs, tight = [], []
    while True:
        out = staged(_level(rows, similarity))
        pairs.append(out.filter("other IS NOT NULL").select(F.when(F.col("kind") == MORE_PAIRS, MORE_PAIRS).otherwise(PAIR).alias("kind"), F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")))
        tight.append(out.filter(F.col("kind") == TIGHT).select("node", "rep"))
        rows = out.filter(F.col("kind") == CHILD).select("node", "depth", "rep", "n", "sig")
        if rows.isEmpty():
            break
    every, closed = reduce(DataFrame.unionByName, pairs), reduce(DataFrame.unionByName, tight)
    return staged(every.groupBy("a", "b").agg(F.min("kind").alias("kind"))), staged(closed)


def dedup_documents(docs: DataFrame, k: int = 5, percent: int = 80, as_read: DataFrame | None = None) -> DataFrame:
    """docs less all but one document of each component (the smallest doc_id; of several
    rows with that doc_id, the one whose text hashes lowest, and one only of equal rows).
    Rows without a doc_id all stay.

    as_read: the documents (doc_id, text) before an earlier step cut their texts. What is
    left of two copies may share nothing any more; so of the rows that stay, those whose
    documents as they were read are of one component are a group as well, and the
    smallest doc_id of it stays. Rows without a counterpart there are not touched by this."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    with scope() as keep:
        gone = keep(staged(_gone(docs, k, percent, as_read)))
    left = rows.join(gone.select(F.col("doc_id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti")
    # ids are counted first, so rows with an id of their own are not sorted
    twice = staged(left.filter("id IS NOT NULL").groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("m"), F.min("th").alias("_th")).filter("m > 1").drop("m"))
    single = left.join(twice, F.col("id") == F.col("_id"), "left_anti").select("row.*")
    least = left.join(twice, (F.col("id") == F.col("_id")) & F.col("th").eqNullSafe(F.col("_th"))).dropDuplicates(["id"]).select("row.*")
    return single.unionByName(least)


def _gone(docs: DataFrame, k: int, percent: int, as_read: DataFrame | None) -> DataFrame:
    """doc_id of the documents that dedup_documents leaves out, each once."""
    gone = staged(near_duplicates(docs, k, percent).filter("NOT kept").select("doc_id").distinct())
    if as_read is None:
        return gone
    stays = docs.filter("doc_id IS NOT NULL").select("doc_id").distinct().join(gone, "doc_id", "left_anti")
    before = as_read.select("doc_id", "text").join(docs.select("doc_id"), "doc_id", "left_semi")
    of = near_duplicates(before, k, percent).filter("n_shingles > 0").select("doc_id", "component_id").distinct().join(stays, "doc_id", "left_semi")
    of = staged(of)
    one = of.groupBy("component_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    many = of.join(one.select("component_id"), "component_id", "left_semi").join(one.select("doc_id"), "doc_id", "left_anti")
    return gone.unionByName(many.select("doc_id"))
