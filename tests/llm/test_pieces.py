import os
import random

import pytest

from tessera.llm.pieces import MARK, Encoder, Vocabulary, _Memory, decode_documents, default_model, encode_documents

from .helpers import SCHEMA, edge_texts, prose, rows

pytestmark = pytest.mark.skipif(not os.path.exists(default_model()), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def encoder():
    with open(default_model(), "rb") as f:
        return Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    sp = pytest.importorskip("sentencepiece")
    return sp.SentencePieceProcessor(model_file=default_model())


def _texts(encoder):
    rng = random.Random(1)
    noise = ["".join(rng.choice("abcdeinorstu  \n.,'éñü▁ 0123") for _ in range(rng.randrange(60))) for _ in range(400)]
    glued = ["".join(rng.choice(encoder.v.pieces[300:]).replace(MARK, " ") for _ in range(rng.randrange(12))) for _ in range(400)]
    return [t or "" for t in edge_texts()] + noise + glued + ["  two", " " * 33 + "z", "\n\n a\n", "a\tb", "ｆｕｌｌ①", "<s>hi</s> <unk> <0x41>", "x" * 3000]


def test_as_the_library(encoder, library):
    texts = _texts(encoder)
    memory = _Memory(encoder)
    flat, per = memory.ids([encoder.marked(t) for t in texts])
    at = 0
    for t, n in zip(texts, per.tolist()):
        ids = flat[at : at + n].tolist()
        at += n
        assert ids == library.encode(t)
        assert encoder.decode(ids) == t.replace(MARK, " ")


def test_shared_prefixes_change_nothing(encoder):
    words = sorted({w for t in prose(3, 10, 80) for w in t.split()} | {"a", "ab", "abc", "b"})
    together = list(encoder.encode_sorted(words))
    assert together == [next(encoder.encode_sorted([w])) for w in words]
    assert together == [[encoder.v.id[p] for p in encoder.merge(list(w))] for w in words]


def test_unigram_is_viterbi():
    def field(n, kind, body):
        return bytes([n << 3 | kind]) + body

    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -4.0, 1), ("▁a", -3.5, 1), ("ba", -5.5, 1), ("▁ab", -9.0, 1)]
    raw = b""
    for p, s, t in pieces:
        m = field(1, 2, bytes([len(p.encode())]) + p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t]))
        raw += field(1, 2, bytes([len(m)]) + m)
    raw += field(2, 2, bytes([2]) + field(3, 0, bytes([1]))) + field(3, 2, bytes([2]) + field(4, 0, bytes([0])))
    e = Encoder(raw)
    score = {p: s for p, s, t in pieces if t == 1}

    def best(w):
        out = [(0.0, [])] + [None] * len(w)
        for i in range(1, len(w) + 1):
            c = [(out[j][0] + score[w[j:i]], out[j][1] + [w[j:i]]) for j in range(i) if w[j:i] in score and out[j]]
            out[i] = max(c) if c else None
        return out[-1][1]

    words = sorted({"▁" + "".join(random.Random(i).choice("ab") for _ in range(i % 9)) for i in range(60)})
    for w, ids in zip(words, e.encode_sorted(words)):
        assert sum(score[e.v.pieces[i]] for i in ids) == pytest.approx(sum(score[p] for p in best(w)))


def test_documents_round_trip(spark, encoder):
    data = rows(edge_texts())
    df = spark.createDataFrame(data, SCHEMA)
    out = encode_documents(df, check=True)
    assert out.columns == [*df.columns, "token_ids", "n_tokens", "round_trip"]
    back = {r.doc_id: (r.text, r.decoded, r.round_trip, r.token_ids) for r in decode_documents(out).collect()}
    for d in data:
        t, decoded, whole, ids = back[d[0]]
        assert t == decoded == d[1] and (whole is None) == (d[1] is None) and (ids is None) == (d[1] is None)
    assert encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_models_that_change_texts_are_refused():
    with pytest.raises(ValueError):
        Vocabulary(b"")
