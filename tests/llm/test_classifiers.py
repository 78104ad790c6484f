import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.language import CLASS, WINDOW, convolve, fit, identify, train_network, windows_of
from tessera.llm.toxicity import doc_crc, score_documents, segments, train, train_on, training_rows

from .helpers import SCHEMA, edge_texts, prose, rows


def _maximal(scores):
    """All maximal scoring segments by their definition (recursive, quadratic)."""
    out = []

    def split(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0
            for j in range(i, hi):
                total += scores[j]
                if total > 0 and (best is None or total > best[2] or (total == best[2] and j - i < best[1] - best[0])):
                    best = (i, j, total)
        if best:
            out.append(best)
            split(lo, best[0])
            split(best[1] + 1, hi)

    split(0, len(scores))
    return sorted(out)


def test_segments_are_all_maximal_ones():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(0, 25)
        full = [-1.0 if rng.random() < 0.6 else float(rng.choice([-3, 2, 3, 5, 7])) + rng.random() / 64 for _ in range(n)]
        at = np.array([i for i, s in enumerate(full) if s != -1.0], int)
        got = segments(at, np.array([full[i] for i in at]), -1.0)
        want = _maximal(full)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def _labelled():
    rng, bad = random.Random(8), ["vile", "nasty", "awful"]
    texts = []
    for i, t in enumerate(prose(31, 300, 60)):
        w = t.split()
        if i % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(20, 30), rng.choice(bad))
        texts.append(" ".join(w))
    return texts, [(i, int(i % 5 == 0)) for i in range(300)]


def test_toxic_passages(spark):
    texts, marks = _labelled()
    data = rows(texts + edge_texts())
    df = spark.createDataFrame(data, SCHEMA).withColumn("tox_score", F.lit("old"))
    labels = spark.createDataFrame([*marks, marks[0], (5, None), (None, 1)], "doc_id long, toxic int")
    model = train_on(df, labels, min_docs=3)
    out = score_documents(df, model, passages=True).collect()
    assert len(out) == len(data)
    for r in out:
        assert 0 <= r.tox_score <= 1
        assert (r.tox_score >= 0.5) == (r.doc_id < 300 and r.doc_id % 5 == 0)
        raw = (r.text or "").encode()
        for p in r.tox_passages:
            assert any(w in raw[p.start : p.end].decode() for w in ("vile", "nasty", "awful"))
    assert len({r.tox_score for r in out if not (r.text or "").strip()}) == 1
    again = train_on(df, labels, min_docs=3)
    assert again.weights == model.weights and (again.tokens == model.tokens).all()


def test_training_needs_both_labels_and_is_bounded(spark):
    df = spark.createDataFrame(rows(edge_texts()), SCHEMA)
    with pytest.raises(ValueError):
        train(df.select("text", F.lit(0).alias("toxic")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, toxic int")
    assert training_rows(df, labels, doc_crc() % 5 != 0, rows=4).count() == 4
    empty = spark.createDataFrame([], SCHEMA)
    model = train_on(*(lambda t, m: (spark.createDataFrame(rows(t), SCHEMA), spark.createDataFrame(m, "doc_id long, toxic int")))(*_labelled()), min_docs=3)
    assert score_documents(empty, model).count() == 0


def test_without_labels_every_document_gets_a_score(spark):
    df = spark.createDataFrame(rows(edge_texts()), SCHEMA)
    for marks in ([], [(1, None)], [(i, 1) for i in range(16)], [(i, 0) for i in range(16)]):
        out = score_documents(df, train_on(df, spark.createDataFrame(marks, "doc_id long, toxic int"))).collect()
        assert len(out) == df.count() and {r.tox_score < 0.5 for r in out} == {True}
    empty = spark.createDataFrame([], SCHEMA)
    assert score_documents(empty, train_on(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).count() == 0


def _languages(seed, n):
    rng, out = random.Random(seed), []
    parts = {"aa": ["kla", "mir", "ton", "es"], "bb": ["zu", "ung", "ei", "sch"], "cc": ["ñá", "llo", "que", "ar"]}
    for i in range(n):
        lang = list(parts)[i % 3]
        out.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 200))), lang))
    return out


def test_language(spark):
    data = _languages(1, 150)
    more = [(1000 + i, t, None) for i, t in enumerate([None, "", "123 456", "...", "😀"])] + [(None, "kla mir ton kla", "aa")]
    df = spark.createDataFrame(data + more, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("_letter", F.lit(0))
    net = fit(df, doc_crc() % 3 != 1)
    out = identify(df, net).collect()
    assert len(out) == len(data) + len(more)
    assert {r._letter for r in out} == {0}
    for r in out:
        assert 0 <= r.lang_score <= 1
        if r.doc_id is None or r.doc_id < 1000:
            assert r.lang_pred == r.lang
        else:
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
    assert {r.lang_pred for r in identify(df, None).collect()} == {"und"}
    assert fit(df.filter("doc_id >= 1000"), F.lit(True)) is None
    assert identify(df.limit(0), net).count() == 0


def test_windows_cover_every_sequence():
    for n in (0, 1, 100, 255, 256, 257, 508, 509, 510, 5000):
        _, start, end = windows_of(np.zeros(n, np.uint8), np.array([0, n]))
        seen = {i for s in start for i in range(s, min(s + WINDOW - 3, max(n - 3, 0)))}
        assert seen == set(range(max(n - 3, 0))) and (end == n).all()


def test_convolution_by_hand():
    x = np.random.default_rng(0).integers(0, 155, (6, WINDOW)).astype(np.uint8)
    net = train_network(x, np.array([0, 1, 0, 1, 0, 1]), ["a", "b"], epochs=1)
    y = convolve(net, x)
    for f, width in ((0, 4), (8, 3), (23, 2)):
        assert y[2, 17, f] == pytest.approx(sum(net.taps[j][x[2, 17 + j], f] for j in range(width)), rel=1e-5)
    assert CLASS[ord("A")] == CLASS[ord("a")] != CLASS[ord("b")]
