import random

import numpy as np

from tessera.llm.common import gear_cuts, hash_spans
from tessera.llm.substrings import chunks_of, substring_dedup

from .helpers import SCHEMA, edge_texts, prose, rows


def _chunks(text, min_words=50):
    data = np.frombuffer(text, np.uint8)
    return [(int(a), int(z)) for _, a, z in zip(*chunks_of(data, np.array([0, len(data)]), min_words))]


def test_chunks_resist_insertions_and_neighbours():
    text = " ".join(prose(1, 20, 60)).encode()
    parts = [text[a:z] for a, z in _chunks(text)]
    assert max(map(len, parts)) <= 96 and min(map(len, parts)) >= 33
    moved = text[:500] + b"an insertion" + text[500:]
    assert len(set(parts) - {moved[a:z] for a, z in _chunks(moved)}) <= 8
    texts = [t.encode() for t in prose(2, 30, 40)] + [b"", b"a b " * 80, b"c " * 60 + texts_of_one_letter()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc, s, e = chunks_of(data, off, 50)
    got = [sorted((int(a - off[i]), int(z - off[i])) for a, z in zip(s[doc == i], e[doc == i])) for i in range(len(texts))]
    assert got == [sorted(_chunks(t)) for t in texts]


def texts_of_one_letter():
    return _words(random.Random(1), 200, 1).encode()


def test_cuts_are_the_least_of_their_neighbours():
    from tessera.llm.common import GEAR
    from tessera.llm.substrings import windows_of

    data = np.frombuffer(_words(random.Random(2), 300, 3).encode(), np.uint8)
    h = [sum(int(GEAR[data[i - j]]) << j for j in range(32)) % 2**32 for i in range(31, len(data))]
    for reach in (64, 34):
        want = sorted({min(range(i, i + reach), key=lambda j: (h[j], -j)) for i in range(len(h) - reach + 1)})
        assert sorted(set(windows_of(data, np.array([0, len(data)]), reach).tolist())) == want


def test_gear_cuts_match_the_definition():
    from tessera.llm.common import GEAR

    data = np.frombuffer(random.Random(4).randbytes(5000), np.uint8)
    at, want = 0, []
    for i in range(len(data)):
        h = sum(int(GEAR[data[i - j]]) << j for j in range(32) if i - j >= 0) % 2**32
        if i + 1 - at == 400 or (i + 1 - at >= 64 and h < 1 << 26) or i + 1 == len(data):
            want.append(i + 1)
            at = i + 1
    assert gear_cuts(data, 64, 6, 400, step=700).tolist() == want


def test_planted_passages_are_found(spark):
    passage = prose(11, 1, 60)[0]
    clean = prose(12, 40, 80)
    texts = edge_texts() + clean + [f"{a} {passage} {b}" for a, b in zip(prose(13, 6, 30), prose(14, 6, 30))]
    data = rows(texts)
    df = spark.createDataFrame(data, SCHEMA)
    out = {r.doc_id: r for r in substring_dedup(df).collect()}
    first = len(texts) - 6
    assert set(range(first + 1, first + 6)) <= set(out)
    assert not set(out) & set(range(len(edge_texts()), first + 1))
    for d in range(first + 1, first + 6):
        raw = texts[d].encode()
        gone = b" ".join(raw[s.start : s.end] for s in out[d].spans)
        assert len(gone) >= 140 and gone[:40] in passage.encode() and first in out[d].first_doc_ids
        assert out[d].n_bytes == len(raw) and out[d].dup_bytes == sum(s.end - s.start for s in out[d].spans)
        assert len(out[d].text.encode()) == len(raw) - out[d].dup_bytes
    assert out[7].text == "" and out[7].first_doc_ids == [6]  # an exact copy


def test_nothing(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert substring_dedup(spark.createDataFrame([(None, None, None, None, 1, 1, "", "", 1)], SCHEMA)).count() == 0


def test_fingerprints_do_not_depend_on_steps():
    data = np.frombuffer(" ".join(prose(5, 3, 50)).encode(), np.uint8)
    s = np.arange(0, len(data) - 10, 10)
    assert (hash_spans(data, s, s + 9, 0) == hash_spans(data, s, s + 9, 0, step=7)).all()
    assert (hash_spans(data, s, s + 9, 0) != hash_spans(data, s, s + 9, 1)).all()


def _words(rng, n, longest):
    return [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, longest))) for _ in range(n))][0]


def test_short_passages_in_two_documents_are_found_whole(spark):
    """51 words once in each of two documents, of words of up to 9, 4, 2 and 1 letters, among long and among short words."""
    rng, texts, passages = random.Random(51), [], []
    for longest in (9, 4, 2, 1):
        for around in (9, longest):
            for _ in range(40):
                passage = _words(rng, 51, longest)
                passages.append(passage)
                texts += [" ".join([_words(rng, rng.randint(5, 90), around), passage, _words(rng, rng.randint(5, 90), around)]) for _ in range(2)]
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert set(out) == set(range(1, len(texts), 2))
    for i, p in enumerate(passages):
        r = out[2 * i + 1]
        raw = texts[2 * i + 1].encode()
        # what stands beside the passage in both may begin or end alike
        assert any(p in raw[s.start : s.end].decode() for s in r.spans) and 2 * i in r.first_doc_ids


def _copied(texts, min_words):
    """doc -> words that lie in a run of min_words words or more that came before, by the definition."""
    seen, out = {}, {}
    for d, text in enumerate(texts):
        w, gone = (text or "").split(" "), set()
        for i in range(len(w) - min_words + 1):
            run = tuple(w[i : i + min_words])
            if run in seen:
                gone.update(range(i, i + min_words))
            else:
                seen[run] = (d, i)
        if gone:
            out[d] = gone
    return out


def test_query_against_brute_force(spark):
    """Whole results: every word of later runs of 50 words or more goes, and nothing else."""
    rng = random.Random(7)
    passages = [_words(rng, rng.randint(50, 120), longest) for longest in (1, 1, 2, 3, 6, 9) for _ in range(4)]
    texts = [None, ""]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts.append(_words(rng, rng.randint(3, 60), rng.choice([1, 5, 9])))
            if rng.random() < 0.5:
                parts.append(rng.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[5], passages[0] + " " + passages[0]]
    want = _copied(texts, 50)
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows(texts), SCHEMA), min_bytes=10**6).collect()}
    assert set(out) == set(want)
    for d, gone in want.items():
        at, got = 0, set()
        for i, w in enumerate(texts[d].split(" ")):
            if any(s.start <= at and at + len(w) <= s.end for s in out[d].spans):
                got.add(i)
            at += len(w) + 1
        assert got == gone, d


def test_rows_twice_and_long_texts(spark):
    rng = random.Random(9)
    long = _words(rng, 120_000, 6)
    texts = [long, "x " + long[300_000:300_900] + " y", _words(rng, 80, 5)]
    once = {r.doc_id: r.spans for r in substring_dedup(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    twice = substring_dedup(spark.createDataFrame(rows(texts) + rows(texts), SCHEMA)).collect()
    assert set(once) == {1} and {r.doc_id: r.spans for r in twice} == once
