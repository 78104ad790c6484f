import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from tessera.llm import conversations as cv
from tessera.llm.queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string, cid string, n long, place long"
SPACE = " \t\n\x0b\x0c\r"


def _faults(rows):
    """(kind, row) of rows in order: blank, duplicate, truncated or none."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((kind, role, text))
    return out


def _cheapest(rows):
    """By recursion over all edits with at most four inserts: (cost, audit, lines)."""
    faults = _faults(rows)
    allowed = ("s", "u", "su", "ua", "au")

    @lru_cache(None)
    def best(i, state, inserts):  # state: the last role's initial, or ""
        edits = []
        if i < len(faults):
            kind, role, text = faults[i]
            edits.append((2, "D", None, i + 1, state))
            if kind not in ("blank", "duplicate"):
                edits += [(c + (5 if kind else 0), letter, f"{name}:{text}", i + 1, name[:1]) for name, letter, c in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)) if name[:1] and state + name[:1] in allowed]
        if inserts < 4:
            edits += [(5, "I", f"{name}:", i, name[:1]) for name in ("user", "assistant") if state + name[:1] in allowed]
        ways = [(0, "", ())] if i == len(faults) and state in ("", "a") else []
        for cost, letter, line, j, after in edits:
            if rest := best(j, after, inserts + (letter == "I")):
                ways.append((cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2]))
        return min(ways) if ways else None

    return best(0, "", 0)


def _expected(rows):
    by = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by.setdefault(c, [])
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
        role = "user" if fault == 4 else role
        by[c] += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in own if r[0] is not None]
        kinds = [k for k, _, _ in _faults([r[1:] for r in own])]
        cost, audit, lines = _cheapest(tuple(r[1:] for r in own)) if own else (0, "", ())
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _rows(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", "Well!", "one. two", None, "Über so.", "a", "b."]
    out = []
    for c in range(n):
        turn = rng.randint(0, 3)
        for _ in range(rng.randint(1, longest)):
            out.append((c if rng.random() > 0.01 else None, turn if rng.random() > 0.05 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts) if rng.random() < 0.3 else f"text {rng.random()}."))
            turn += rng.choice([0, 1, 1, 1, 1, 2])
    return out


def _got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    out = cv.structure(damaged(df), df).collect()
    assert len(out) == len({r[0] for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in out}


def test_against_all_edits(spark):
    rows = _rows(1, 120, 9) + [(900, 1, "user", "Hi.")] * 50 + [(None, None, None, None)] * 3 + [(901, None, "system", "S.")]
    got, want = _got(spark, rows), _expected(rows)
    assert got == want


@pytest.mark.parametrize("piece", [1, 7])
def test_pieces_join_to_the_same(spark, monkeypatch, piece):
    rows = _rows(2, 12, 40)
    want = _expected(rows)
    monkeypatch.setattr(cv, "JOIN", 3)
    monkeypatch.setattr(cv, "PIECE", piece)
    assert _got(spark, rows) == want
    rng = random.Random(3)
    for _ in range(60):
        kinds = tuple((k, rng.randint(2, 4) if k == "x" else 1) for k in rng.choices("suaoSUAOx", k=rng.randint(1, 12)))
        cut = rng.randint(1, len(kinds))
        both = cv.joined(cv.chart(kinds[:cut]), cv.chart(kinds[cut:])) if cut < len(kinds) else cv.chart(kinds)
        column = {}
        for (a, z), way in both.items():
            if a in cv.START:
                cv._put(column, z, way)
        assert cv.repair_of(column) == cv.whole(kinds)


def test_one_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"Row {i % 1900}.") for i in range(3000)] + [(2, 0, "user", "Q?"), (2, 1, "assistant", "A.")]
    large = [(5, 0, "user", "y " * 1_200_000 + "?"), (5, 2, "assistant", "z" * 1_200_000 + "."), (5, 3, "user", "And?"), (5, 4, "assistant", "So.")]
    got = _got(spark, rows + large)
    assert got[5] == _expected(large)[5]
    assert got[1][5] == cv.repair_of(cv.parse(_kinds(rows, 1), cv.START))[0] and got[1][6] == cv.repair_of(cv.parse(_kinds(rows, 1), cv.START))[1]


def _kinds(rows, c):
    own = []
    for conv, turn, role, text in rows:
        if conv == c:
            fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
            if fault:
                own += [("user" if fault == 4 else role, "" if fault == 1 else text.replace(".", "") if fault == 2 else text)] * (2 if fault == 3 else 1)
    kinds = {"blank": "x", "duplicate": "x"}
    return tuple((kinds.get(k, role[0].upper() if k else role[0]), 1) for k, role, _ in _faults(own))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cv.structure(damaged(df), df).count() == 0
