"""Toxicity by maximum-scoring segments of token log-odds.

Training (labelled rows only): for each token, and each beginning of a token, the documents of either label that
hold it give log-odds with an informative Dirichlet prior (the pooled counts), and
a z-score. Those whose z-score reaches `min_z` keep their log-odds, and a token has the
largest of its word's and its beginnings'; every other token scores a negative background, set so that the expected score of a
non-toxic token is below zero, as segment statistics need.

Scoring: one pass over a text finds all maximal scoring segments (linear time).
The chance of a segment score S in n clean tokens follows an extreme-value law,
1 - exp(-K n exp(-lambda S)): lambda solves E[exp(lambda s)] = 1 over the clean
tokens, K is fitted on the clean training documents. A segment is significant if
that chance is at most `alpha`. A document's evidence is the log of the smallest
chance and the number of significant segments; a logistic fit on the training
documents turns it into a score from 0 to 1.

Edge cases: null and empty texts have no segment and get the score of no evidence;
where both labels are needed and missing (no labelled rows, or of one label only), train raises
NothingToLearn (a ValueError), and train_on gives a model that knows nothing: every text
gets the score NO_EVIDENCE and is not toxic; rows whose label is null are not learnt from; labels repeated for one doc_id count once, as the larger;
extra columns pass through score_documents unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, blocks, bound_batches, hash_spans, offsets_of, scope, spans_of, staged

#: Labelled documents that are learnt from at most, lowest seeded hash first.
TRAIN_ROWS = 30_000
#: Tokens in the model at most, highest z-score first: a bound of the model, which is sent to every
#: task, as TRAIN_ROWS bounds what it learns from. Tokens beyond it score as any unknown one.
MODEL_TOKENS = 20_000

#: Bytes of the beginnings of a token that count as features beside the whole.
STEMS = (4, 5, 6, 7, 8)

#: The score where nothing was learnt.
NO_EVIDENCE = 0.01

#: A token is a run of letters: ASCII letters and every byte of a longer character.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


class NothingToLearn(ValueError):
    """The training rows do not have both labels."""


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray  # sorted fingerprints
    scores: np.ndarray  # their log-odds
    background: float  # of any other token
    lam: float
    k: float
    alpha: float
    weights: tuple[float, float, float]  # intercept, evidence, log1p(significant segments)


def segments(at: np.ndarray, score: np.ndarray, background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of one text.

    at, score: places and scores of the tokens that are not background. Linear
    time: candidates are kept on a stack with the sums before and after each and a link
    to the next that a later one could join; background between two places is one step."""
    # first, last, sum before, sum after, place of the nearest earlier one that starts lower
    found: list[list] = []
    total, last = 0.0, -1
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total += background * (p - last - 1)
        last = p
        before, total = total, total + s
        if s <= 0:
            continue
        new = [p, p, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(int(f), int(e), b - a) for f, e, a, b, _ in found]


def features_of(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of tokens, fingerprints) of the whole words, then of their beginnings of each
    length in STEMS: inflected and compounded words are known by their stems."""
    yield np.arange(len(starts)), hash_spans(low, starts, ends)
    for n in STEMS:
        i = np.flatnonzero(ends - starts > n)
        yield i, hash_spans(low, starts[i], starts[i] + n, 1)


def scored_tokens(data: np.ndarray, offsets: np.ndarray, tokens: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: number of tokens, places and scores of the model's, byte starts and ends."""
    starts, ends, per = spans_of(data, offsets, NOT_LETTER)
    best = np.zeros(len(starts))
    for place, h in features_of(LOWER[data], starts, ends) if len(tokens) else ():
        i = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
        known = tokens[i] == h
        place, i = place[known], i[known]
        best[place] = np.maximum(best[place], scores[i])
    hit = np.flatnonzero(best)
    first = np.concatenate([[0], np.cumsum(per)])
    cut = np.searchsorted(hit, first)
    for d in range(len(per)):
        own = hit[cut[d] : cut[d + 1]]
        yield int(per[d]), own - first[d], best[own], starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]]


def _tail(k: float, lam: float, n: int, s: float) -> float:
    """log of the chance of a segment of s or more in n clean tokens."""
    x = math.log(max(k * max(n, 1), 1e-300)) - lam * s
    return x if x < -20 else math.log(-math.expm1(-math.exp(min(x, 50.0))))


def evidence(n: int, at: np.ndarray, score: np.ndarray, m: Model) -> tuple[float, list[tuple[int, int, float, float]]]:
    """-log of the smallest chance, and the significant segments with theirs."""
    best, kept = 0.0, []
    for f, e, s in segments(at, score, m.background):
        x = _tail(m.k, m.lam, n, s)
        best = max(best, -x)
        if x <= math.log(m.alpha):
            kept.append((f, e, s, x))
    return best, kept


def probability(best: float, n_kept: int, m: Model) -> float:
    a, b, c = m.weights
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * min(best, 60.0) + c * math.log1p(n_kept)))))


# ------------------------------------------------------------------------- training


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most `rows` labelled documents with learn true."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("doc_id", F.col("_id")).filter(learn).drop("doc_id").orderBy(F.xxhash64("_id", F.lit("toxicity")), "_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).drop("_id")


def _count_schema() -> T.StructType:
    return T.StructType([T.StructField("token", T.LongType()), T.StructField("d0", T.LongType()), T.StructField("d1", T.LongType())])


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label per token, within a block of texts."""
    for b in blocks(batches, "text"):
        data, offsets = offsets_of(b.column("text"))
        toxic = np.asarray(b.column("toxic").to_pylist(), np.int64) > 0
        starts, ends, per = spans_of(data, offsets, NOT_LETTER)
        of = np.repeat(np.arange(len(per)), per)
        found = list(features_of(LOWER[data], starts, ends))
        h, doc = np.concatenate([x for _, x in found]), np.concatenate([of[i] for i, _ in found])
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        u, first = np.unique(h, return_index=True)
        d1 = np.add.reduceat(toxic[doc].astype(np.int64), first) if len(u) else np.empty(0, np.int64)
        n = np.diff(np.concatenate([first, [len(h)]]))
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n - d1), pa.array(d1)], ["token", "d0", "d1"])


def _sample_schema() -> T.StructType:
    return T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("at", T.ArrayType(T.LongType())), T.StructField("score", T.ArrayType(T.DoubleType()))])


def train(rows: DataFrame, min_z: float = 3.0, min_docs: int = 5, alpha: float = 0.01, prior: float = 0.1) -> Model:
    """Fit on rows (text, toxic), already bounded by training_rows.

    prior: the Dirichlet prior's weight as a share of the pooled counts. The bar on
    z rises with the number of tokens tried, as the largest of so many would by chance."""
    rows = staged(bound_batches(rows).select("text", F.col("toxic").cast("int").alias("toxic")))
    n0, n1 = rows.agg(F.count(F.when(F.col("toxic") <= 0, 1)), F.count(F.when(F.col("toxic") > 0, 1))).first()
    if not n0 or not n1:
        raise NothingToLearn("both labels are needed to train")
    counts = rows.mapInArrow(_count_tokens, _count_schema()).groupBy("token").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    counts = staged(counts.filter(F.col("d0") + F.col("d1") >= min_docs))
    t0, t1 = counts.agg(F.sum("d0"), F.sum("d1")).first()
    t0, t1 = float(t0 or 1), float(t1 or 1)
    tried = counts.count()
    bar = max(min_z, 0.85 * math.sqrt(2 * math.log(max(tried, 2))))
    a, pooled = (F.col("d0") + F.col("d1")) * prior, (t0 + t1) * prior
    odds = lambda d, t: F.log((F.col(d) + a) / (t + pooled - F.col(d) - a))
    z = counts.withColumn("w", odds("d1", t1) - odds("d0", t0)).withColumn("z", F.col("w") / F.sqrt(1 / (F.col("d1") + a) + 1 / (F.col("d0") + a)))
    best = z.filter(F.col("z") >= bar).orderBy(F.desc("z"), "token").limit(MODEL_TOKENS).select("token", "w").collect()
    best = sorted((np.uint64(x.token % 2**64), float(x.w)) for x in best)
    tokens, scores = np.array([x[0] for x in best], np.uint64), np.array([x[1] for x in best])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            data, offsets = offsets_of(b.column("text"))
            got = [(n, at, s) for n, at, s, _, _ in scored_tokens(data, offsets, tokens, scores)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))], ["toxic", "n", "at", "score"])

    seen = [(x.toxic > 0, x.n, np.array(x.at, np.int64), np.array(x["score"])) for x in rows.mapInArrow(sample, _sample_schema()).collect()]
    clean = [x for x in seen if not x[0]]
    # rate of each model token among clean tokens, add-one smoothed per model token
    n_clean = sum(x[1] for x in clean) + 1.0
    hits = np.concatenate([x[3] for x in clean]) if clean else np.empty(0)
    mass, mean = (len(hits) + 1) / n_clean, hits.sum() / n_clean
    background = -max(0.05, 2.0 * mean)
    values, rates = (hits, np.full(len(hits), 1 / n_clean)) if len(hits) else (np.array([1.0]), np.array([1 / n_clean]))
    drift = lambda x: float((rates * np.exp(np.minimum(x * values, 500))).sum() + (1 - mass) * math.exp(x * background) - 1)
    lo, hi = 1e-6, 1.0
    while drift(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if drift(mid) < 0 else (lo, mid)
    lam = (lo + hi) / 2
    # K: maximum likelihood of the clean documents' best segments, given lambda
    tops = [(n, max((s for *_, s in segments(at, sc, background)), default=0.0)) for _, n, at, sc in clean]
    k = len(tops) / max(1e-12, sum(max(n, 1) * math.exp(-lam * s) for n, s in tops))
    m = Model(tokens, scores, background, lam, k, alpha, (0.0, 1.0, 0.0))
    x = np.array([[1.0, min(b, 60.0), math.log1p(len(kept))] for b, kept in (evidence(n, at, sc, m) for _, n, at, sc in seen)])
    y = np.array([float(s[0]) for s in seen])
    w = np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (y - p) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(tokens, scores, background, lam, k, alpha, tuple(map(float, w)))


# ------------------------------------------------------------------------- scoring


def score_documents(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """docs with tox_score and tox_segments (and tox_passages: start byte, end byte,
    score, log chance of each significant segment); no shuffle."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("log_p", T.DoubleType())])
    more = [T.StructField("tox_score", T.DoubleType()), T.StructField("tox_segments", T.LongType())]
    if passages:
        more.append(T.StructField("tox_passages", T.ArrayType(span)))
    docs = docs.drop(*[f.name for f in more])
    schema = T.StructType([*docs.schema.fields, *more])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in blocks(batches, "text"):
            data, offsets = offsets_of(b.column(b.schema.get_field_index("text")))
            score, count, spans = [], [], []
            for n, at, sc, starts, ends in scored_tokens(data, offsets, m.tokens, m.scores):
                best, kept = evidence(n, at, sc, m) if len(at) else (0.0, [])
                score.append(probability(best, len(kept), m))
                count.append(len(kept))
                if passages:
                    base = offsets[len(score) - 1]
                    spans.append([{"start": int(starts[f] - base), "end": int(ends[e] - base), "score": s, "log_p": x} for f, e, s, x in kept])
            new = [pa.array(score, pa.float64()), pa.array(count, pa.int64())]
            if passages:
                new.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *[f.name for f in more]])

    return bound_batches(docs).mapInArrow(run, schema)


def doc_crc() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def train_on(docs: DataFrame, labels: DataFrame, **more) -> Model:
    """Learn from the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    try:
        with scope():
            return train(training_rows(docs, labels, doc_crc() % 5 != 0), **more)
    except NothingToLearn:
        odds = math.log(NO_EVIDENCE / (1 - NO_EVIDENCE))
        return Model(np.empty(0, np.uint64), np.empty(0), -1.0, 1.0, 1.0, 0.01, (odds, 0.0, 0.0))
