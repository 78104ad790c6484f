import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.common import offsets_of
from tessera.llm.packing import ByteLevel, dealt, pack, sweep, tokenizer_file

from .helpers import SCHEMA, edge_texts, prose, rows

ODD = ["a", "B", "é", " ", "  ", "\n", "\t", " ", " ", "　", "ñ", "😀", "1", "23", "'s", "'", "!", "<|endoftext|>", "漢", "\x1c", "\u0085", "\r\n", "the", " of", "​", "Ⅷ", "٣"]


@pytest.fixture(scope="module")
def raw():
    with open(tokenizer_file(), "rb") as f:
        return f.read()


def _ids(raw, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(raw.decode()).encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_are_the_librarys(raw):
    tool, rng = ByteLevel(raw, 2), np.random.default_rng(1)
    texts = ["".join(rng.choice(ODD, rng.integers(0, 30))) for _ in range(4000)] + ["", "a" * 5000, "x " * 3000]
    flat, per = tool.documents(*offsets_of(pa.array(texts)))
    want = [e.ids + [2] for e in tool.tool.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in np.split(flat, np.cumsum(per)[:-1])] == want


def _best_fit(lengths, capacity):
    """One document after the other, longest first, each into the smallest gap that holds it."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sweep_packs_like_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 100, 600), rng.integers(1, 30, 900), rng.integers(20, 70, 500), np.r_[rng.integers(1, 5, 500), rng.integers(60, 100, 200)], np.full(400, 34), rng.geometric(0.05, 800).clip(1, 99)][seed]
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    found = sweep(counts, 100)
    used = {}
    for size, matches in found.items():
        assert sum(n for n, _, _ in matches) == counts[size]
        for n, first, offset in matches:
            for s in range(first, first + n):
                assert used.get(s, 0) == offset
                used[s] = offset + size
    assert max(used.values()) <= 100
    assert len(used) <= _best_fit(lengths, 100) + max(1, len(used) // 100)


def test_dealt_keeps_ranks():
    assert dealt([(5, 0, 0), (2, 9, 40)], [3, 0, 4]) == [[(0, 0, 0)], [], [(0, 3, 0), (2, 9, 40)]]


@pytest.mark.parametrize("stripe", [1 << 26, 1500])
def test_whole_results(spark, raw, stripe):
    texts = edge_texts() + prose(5, 40, 300) + ["word " * 9000, None, ""]
    data = rows(texts) + rows([texts[6]] * 30, first_id=500) + [(None, "no id", None, None, 0, 1, "x", None, 3)] * 2
    out = [r.asDict() for r in pack(spark.createDataFrame(data, SCHEMA), stripe_tokens=stripe).collect()]
    want = []
    for d, text, *_ in data:
        ids = _ids(raw, text)
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(d, i, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for i, (a, z) in enumerate(zip(edges[:-1], edges[1:]))]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted([tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out], key=key) == sorted(want, key=key)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    if stripe > 2000:
        assert len(sequences) <= _best_fit([w[3] for w in want], 1024) + 1
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
