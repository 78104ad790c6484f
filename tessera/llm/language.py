"""Language ID by a byte convolutional network, trained here in numpy.

A text is cut into windows of `WINDOW` bytes (overlapping by the widest filter less
one, so no byte sequence is lost). Each byte is a class (letters without case, every
byte of a longer character, everything else); filters of several widths slide over
the classes, each keeps its maximum over the window, and a softmax layer gives the
languages. A document's probabilities are those of its windows, weighted by their
letters. Every window of every text is scored, in batches of fixed length.

Training uses at most `per_language` documents of each language (lowest seeded hash
first) and `windows_each` evenly spaced windows of each, a bound of this module.

Edge cases: null texts and texts without a letter (Unicode category L) get `und` and
score 0; rows with a null language are not learnt from; with nothing to learn from all
texts get `und` and 0; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import blocks, bound_batches, free_name, offsets_of

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
STRIDE = WINDOW - max(WIDTHS) + 1
#: Windows that are convolved at once.
BATCH = 512

OTHER = 0
CLASS = np.zeros(256, np.uint8)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = np.arange(27, 155)
N_CLASSES = 155


@dataclass
class Network:
    languages: list[str]
    taps: list[np.ndarray]  # for each offset: classes x filters wide enough to reach it
    bias: np.ndarray  # of each filter, widest first
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray


def _widths() -> np.ndarray:
    return np.repeat(sorted(WIDTHS, reverse=True), FILTERS)


def convolve(net: Network, x: np.ndarray) -> np.ndarray:
    """Classes (windows x WINDOW) to filter values (windows x STRIDE x filters)."""
    y = net.taps[0][x[:, :STRIDE]]
    for j, tap in enumerate(net.taps[1:], 1):
        y[:, :, : tap.shape[1]] += tap[x[:, j : j + STRIDE]]
    return y


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict_windows(net: Network, x: np.ndarray) -> np.ndarray:
    return softmax(np.maximum(convolve(net, x).max(axis=1) + net.bias, 0) @ net.out + net.out_bias)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each window, its first byte, the text's end)."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-(size - WINDOW + STRIDE) // STRIDE))
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, offsets[:-1][doc] + nth * STRIDE, offsets[1:][doc]


def classes_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    if not len(data):
        return np.full(at.shape, OTHER, np.uint8)
    return np.where(at < end[:, None], CLASS[data[np.minimum(at, len(data) - 1)]], OTHER)


def train_network(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 12, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on cross-entropy; x: windows of classes, y: language numbers."""
    rng = np.random.default_rng(seed)
    widths, n = _widths(), len(languages)
    taps = [rng.normal(0, 0.3, (N_CLASSES, int((widths > j).sum()))).astype(np.float32) for j in range(max(WIDTHS))]
    net = Network(languages, taps, np.zeros(len(widths), np.float32), rng.normal(0, 0.3, (len(widths), n)).astype(np.float32), np.zeros(n, np.float32))
    params = [*net.taps, net.bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            xb, yb = x[order[lo : lo + 128]], y[order[lo : lo + 128]]
            conv = convolve(net, xb)
            peak = conv.argmax(axis=1)
            top = np.take_along_axis(conv, peak[:, None, :], axis=1)[:, 0, :] + net.bias
            act = np.maximum(top, 0)
            dz = softmax(act @ net.out + net.out_bias)
            dz[np.arange(len(yb)), yb] -= 1
            dz /= len(yb)
            dtop = (dz @ net.out.T) * (top > 0)
            grads = []
            for j, tap in enumerate(net.taps):
                g = np.zeros_like(tap)
                f = tap.shape[1]
                seen = np.take_along_axis(xb, peak[:, :f] + j, axis=1)
                np.add.at(g, (seen, np.arange(f)[None, :]), dtop[:, :f])
                grads.append(g)
            grads += [dtop.sum(axis=0), act.T @ dz, dz.sum(axis=0)]
            t += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, learn: Column, per_language: int = 500, windows_each: int = 4) -> Network | None:
    """A network from the documents with learn true; only text and lang are looked at."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    th = F.xxhash64("text", F.lit("language"))
    keys = rows.select("lang", th.alias("th")).distinct()  # equal texts count once
    keys = keys.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("th"))).filter(F.col("rn") <= per_language)
    keys = keys.select(F.col("lang").alias("_lang"), F.col("th").alias("_th"))  # per_language rows a language
    picked = rows.join(F.broadcast(keys), (F.col("lang") == F.col("_lang")) & (th == F.col("_th"))).groupBy("lang", "_th").agg(F.min("text").alias("text"))
    got = sorted((r.lang, r.text.encode("utf-8", "replace")) for r in picked.select("lang", "text").toLocalIterator())
    languages = sorted({g[0] for g in got})
    if not languages:
        return None
    xs, ys = [], []
    for lang, text in got:
        data = np.frombuffer(text, np.uint8)
        _, start, end = windows_of(data, np.array([0, len(data)]))
        keep = np.unique(np.linspace(0, len(start) - 1, windows_each).round().astype(int))
        xs.append(classes_at(data, start[keep], end[keep]))
        ys += [languages.index(lang)] * len(keep)
    return train_network(np.concatenate(xs), np.array(ys), languages)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and lang_score (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "lang_score")
    mark = free_name(docs, "_letter")
    rows = docs.withColumn(mark, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in blocks(batches, "text"):
            letter = np.asarray(b.column(mark).to_pylist(), bool)
            own = b.drop_columns([mark])
            if model is None:
                best, score = ["und"] * len(letter), np.zeros(len(letter))
            else:
                data, offsets = offsets_of(b.column(b.schema.get_field_index("text")))
                doc, start, end = windows_of(data, offsets)
                total = np.zeros((len(letter), len(model.languages)))
                for lo in range(0, len(doc), BATCH):
                    x = classes_at(data, start[lo : lo + BATCH], end[lo : lo + BATCH])
                    p = predict_windows(model, x) * (x != OTHER).sum(axis=1, keepdims=True)
                    d = doc[lo : lo + BATCH]
                    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                    total[d[first]] += np.add.reduceat(p, first, axis=0)
                mass = total.sum(axis=1)
                known = letter & (mass > 0)
                best = [model.languages[i] if k else "und" for i, k in zip(total.argmax(axis=1), known, strict=True)]
                score = np.where(known, total.max(axis=1) / np.where(mass > 0, mass, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(best, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], [*own.schema.names, "lang_pred", "lang_score"])

    return bound_batches(rows).mapInArrow(run, schema)
