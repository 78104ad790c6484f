"""Conversation structure repair by error-correcting Earley parsing.

A conversation reads as the roles (s?(ua)+)? by their initials. The grammar's words are met
by edits: a row is kept where its initial fits, or given the role user or assistant (rerole), a row
without text is inserted, and any item passes over a row that is deleted. Blank rows and
duplicates must be deleted; a truncated row costs more when it stays. A chart column holds the
items (rule, dot) that are open after a row, each with the least (cost, audit) of all ways to
it; as the grammar is left-recursive, every item begins at the first row and needs no
origin. The completed start rule with the least (cost, audit) is the repair: an audit's
letters, the initials of its edits, fix the roles of all rows that stay.

The rows, equal ones counted, are range-sorted by conversation and turn, and each task
parses what it holds in pieces of at most `PIECE` rows. A conversation inside one
piece is done there. Of others, a piece's chart is made once for each item that can be open
where it begins, and says for each item open at its end the least (cost, audit) between
the two; pieces are then joined by 32s, over their common items, until one is left,
and its audit is cut back into theirs. Of two ways between the same items with equal costs
neither audit begins the other (it would have inserts more), so the least of joined ways joins least ways.
Whatever its length, no conversation's rows meet in one task; its audit and its counts do.

Edge cases: null roles and texts are one space, so such a text is blank and such a role fits
nothing; a null conv_id is a conversation; null turns come first; rows of one turn follow by role and text,
copies side by side; a role's case counts; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bound_batches, scope, staged

#: C: conversation, T: turns; S, U and A are rows of system, user and assistant.
RULES = (("C", ""), ("C", "T"), ("T", "UA"), ("T", "SUA"), ("T", "TUA"))
ROLES = {"U": "user", "A": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows, and characters of text, of a piece; pieces joined at once.
PIECE, PIECE_TEXT, JOIN = 256, 1 << 20, 32

Item = tuple[int, int]
Ways = dict[Item, tuple[int, str]]
SPACE = " \t\n\x0b\x0c\r"

#: The items that wait for a row, or are complete; those that wait for turns to complete hold no row.
ITEMS: tuple[Item, ...] = tuple((r, d) for r, (head, body) in enumerate(RULES) for d in range(len(body) + 1) if (body[d : d + 1] != "T") and not (head == "T" and d == len(body)))
START: Ways = {(r, 0): (0, "") for r, (_, body) in enumerate(RULES) if body[:1] != "T"}


def _put(column: Ways, item: Item, way: tuple[int, str]) -> bool:
    if item in column and column[item] <= way:
        return False
    column[item] = way
    return True


def _closed(column: Ways) -> Ways:
    """The column with what follows without a row: inserts, and completed turns."""
    todo = list(column)
    while todo:
        rule, dot = item = todo.pop()
        if item not in column:  # completed before, on a better way
            continue
        head, body = RULES[rule]
        cost, audit = column[item]
        if dot == len(body):
            if head == "T":
                del column[item]
                for r, (_, b) in enumerate(RULES):
                    if b[:1] == "T" and _put(column, (r, 1), (cost, audit)):
                        todo.append((r, 1))
        elif body[dot] in ROLES and _put(column, (rule, dot + 1), (cost + INSERT, audit + "I")):
            todo.append((rule, dot + 1))
    return column


def _scanned(column: Ways, kind: str, n: int) -> Ways:
    """The column after n rows of a kind: s, u, a or o by initial, in capitals if truncated, x if they must go."""
    out: Ways = {}
    for (rule, dot), (cost, audit) in column.items():
        _put(out, (rule, dot), (cost + DELETE * n, audit + "D" * n))
        word = RULES[rule][1][dot : dot + 1]
        if kind == "x" or not word:
            continue
        stay = cost + (TRUNCATED if kind.isupper() else 0)
        if word == kind.upper():
            _put(out, (rule, dot + 1), (stay, audit + "K"))
        if word in ROLES:
            _put(out, (rule, dot + 1), (stay + REROLE, audit + "R"))
    return _closed(out)


def parse(rows: tuple[tuple[str, int], ...], column: Ways) -> Ways:
    """The last column of the chart of rows (kind, how many: more than one only of x)."""
    column = _closed(dict(column))
    for kind, n in rows:
        column = _scanned(column, kind, n)
    return column


@lru_cache(4096)
def chart(rows: tuple[tuple[str, int], ...]) -> dict[tuple[Item, Item], tuple[int, str]]:
    """The least (cost, audit) between every item open before the rows and every one open after."""
    return {(a, z): way for a in ITEMS for z, way in parse(rows, {a: (0, "")}).items()}


def repair_of(column: Ways) -> tuple[int, str]:
    """The least completed conversation of a last column."""
    return min(way for (rule, dot), way in column.items() if RULES[rule][0] == "C" and dot == len(RULES[rule][1]))


@lru_cache(65_536)
def whole(rows: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    return repair_of(parse(rows, START))


def joined(a: dict, b: dict) -> dict:
    """The chart of two pieces."""
    after: dict[Item, list] = {}
    for (j, k), way in b.items():
        after.setdefault(j, []).append((k, way))
    out: dict = {}
    for (i, j), (cost, audit) in a.items():
        for k, (more, rest) in after.get(j, ()):
            _put(out, (i, k), (cost + more, audit + rest))
    return out


def edited(audit: str, rows: list[dict], first: int, system: bool) -> list[dict]:
    """The rows that stay of a piece, edited by its part of the audit; `first` rows stayed before it."""
    out, given = [], (r for r in rows for _ in range(r["n"]))
    for letter in audit:
        row = None if letter == "I" else next(given)
        if letter == "D":
            continue
        place = first + len(out) - system
        role = row["role"] if letter == "K" else ROLES["A" if place % 2 else "U"]
        out.append({"role": role, "text": row["text"] if row else ""})
    return out


def _odd(audit: str) -> bool:
    """Whether the conversation begins with a system row: then an odd number of rows stay."""
    return (len(audit) - audit.count("D")) % 2 == 1


class _Piece:
    """Rows of a conversation that follow each other, as they are read."""

    def __init__(self, cid: str) -> None:
        self.cid, self.rows, self.kinds, self.chars = cid, [], [], 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.first_role = self.last_role = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, role: str, text: str, n: int, seen: bool) -> None:
        c, initial, body = self.counts, role[:1], text.rstrip(SPACE)
        kind = initial if initial and initial in "sua" else "o"
        if not body:
            c["blank"] += n
            self.kinds.append(("x", n))
        else:
            cut = body[-1] not in ".!?"
            again = n if seen else n - 1
            c["duplicate"] += again
            if not seen:
                c["truncated"] += cut
                self.kinds.append((kind.upper() if cut else kind, 1))
            if again:
                self.kinds.append(("x", again))
        if self.rows:
            c["illegal"] += self.last_role + initial not in ("su", "ua", "au")
        else:
            self.first_role = initial
        c["illegal"] += n - 1
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            c["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.rows.append({"role": role, "text": text, "n": n})
        self.chars += len(text)

    def record(self, order: int, alone: bool) -> dict:
        kinds = tuple(self.kinds)
        out = {"cid": self.cid, "place": order, "alone": alone, "first_role": self.first_role, "last_role": self.last_role, "first_turn": self.first_turn, "last_turn": self.last_turn, **self.counts}
        if alone:
            cost, audit = whole(kinds)
            return out | {"cost": cost, "audit": audit, "lines": edited(audit, self.rows, 0, _odd(audit))}
        ways = chart(kinds)
        return out | {"ways": [{"a": ITEMS.index(a), "z": ITEMS.index(z), "cost": c, "audit": s} for (a, z), (c, s) in ways.items()], "sizes": [sum(r["n"] for r in self.rows)], "rows": self.rows}


_WAYS = "ways array<struct<a:int,z:int,cost:long,audit:string>>"
_COUNTS = "first_role string, last_role string, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, turns long"
_PIECES = f"cid string, place long, alone boolean, {_COUNTS}, cost long, audit string, lines array<struct<role:string,text:string>>, {_WAYS}, sizes array<long>, rows array<struct<role:string,text:string,n:long>>"


def _pieces(tokens: DataFrame) -> DataFrame:
    """The pieces of range-sorted rows (cid, turn, role, text, n, seen). No shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, done, text = TaskContext.get().partitionId() << 33, 0, [], 0
        piece, begun = None, False  # begun: the conversation's first row is in this task, and it is not its first conversation
        single = True

        def close(last: bool) -> None:
            nonlocal number, text
            done.append(piece.record(base + number, begun and single and last))
            number += 1
            text += piece.chars

        for b in batches:
            for cid, turn, role, body, n, seen in zip(*(b.column(c).to_pylist() for c in ("cid", "turn", "role", "text", "n", "seen")), strict=True):
                if piece is None:
                    piece = _Piece(cid)
                elif piece.cid != cid:
                    close(True)
                    piece, begun, single = _Piece(cid), True, True
                elif len(piece.rows) >= PIECE or piece.chars >= PIECE_TEXT:
                    close(False)
                    piece, single = _Piece(cid), False
                piece.add(turn, role, body, n, seen)
                if len(done) >= 1000 or text >= 8 * PIECE_TEXT:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, text = [], 0
        if piece is not None:
            close(False)  # more of it may be in the next task
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return bound_batches(tokens).mapInArrow(run, _PIECES)


def _ways(found: list) -> dict:
    return {(ITEMS[w["a"]], ITEMS[w["z"]]): (int(w["cost"]), w["audit"]) for w in found}


def _combined(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one group as one."""
    parts = parts.sort_values("place")
    ways, sizes, out = None, [], None
    for p in parts.to_dict("records"):
        for c in ("first_turn", "last_turn"):
            p[c] = None if pd.isna(p[c]) else int(p[c])
        mine = _ways(p["ways"])
        sizes += list(p["sizes"])
        if out is None:
            out, ways = p, mine
            continue
        ways = joined(ways, mine)
        for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
            out[c] += p[c]
        out["illegal"] += out["last_role"] + p["first_role"] not in ("su", "ua", "au")
        out["turns"] -= out["last_turn"] is not None and out["last_turn"] == p["first_turn"]
        out["last_role"] = p["last_role"]
        out["first_turn"] = p["first_turn"] if out["first_turn"] is None else out["first_turn"]
        out["last_turn"] = out["last_turn"] if p["last_turn"] is None else p["last_turn"]
    out |= {"ways": [{"a": ITEMS.index(a), "z": ITEMS.index(z), "cost": c, "audit": s} for (a, z), (c, s) in ways.items()], "sizes": sizes}
    for c in ("first_turn", "last_turn"):
        out[c] = pd.array([out[c]], "Int64")
    return pd.DataFrame({c: v if c.endswith("_turn") else [v] for c, v in out.items()})[list(parts.columns)]


def _merged(pieces: DataFrame) -> DataFrame:
    """One row a conversation of pieces that are not alone, joined JOIN at a time."""
    narrow = pieces.drop("alone", "cost", "audit", "lines", "rows")
    schema = f"cid string, place long, {_COUNTS}, {_WAYS}, sizes array<long>"
    while True:
        numbered = narrow.withColumn("place", (F.row_number().over(W.partitionBy("cid").orderBy("place")) - 1).cast("long"))
        narrow = staged(numbered.groupBy("cid", F.floor(F.col("place") / JOIN).alias("_g")).applyInPandas(_combined, schema))
        if not (narrow.agg(F.max("place")).first()[0] or 0):
            return narrow


def _finished(merged: DataFrame) -> DataFrame:
    """cost and audit of merged conversations, and each piece's part: ord, part, first, system."""
    schema = "cid string, cost long, audit string, parts array<struct<ord:long,part:string,first:long,system:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                column: Ways = {}
                for (a, z), way in _ways(row["ways"]).items():
                    if a in START:
                        _put(column, z, way)
                cost, audit = repair_of(column)
                letters = np.frombuffer(audit.encode(), np.uint8)
                eats, stays = np.flatnonzero(letters != ord("I")), np.concatenate([[0], np.cumsum(letters != ord("D"))])
                ends = [*(eats[np.cumsum(row["sizes"])[:-1] - 1] + 1).tolist(), len(audit)]
                parts = [{"ord": i, "part": audit[a:z], "first": int(stays[a]), "system": _odd(audit)} for i, (a, z) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]
                yield pa.RecordBatch.from_pylist([{"cid": row["cid"], "cost": cost, "audit": audit, "parts": parts}], pa.schema([("cid", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("parts", pa.list_(pa.struct([("ord", pa.int64()), ("part", pa.string()), ("first", pa.int64()), ("system", pa.bool_())])))]))

    return merged.select("cid", "ways", "sizes").mapInArrow(run, schema)


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows (cid, turn, role, text) in order, how many there are of each (n), and whether its role and text came in an earlier turn (seen)."""
    named = rows.select(_cid().alias("cid"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    counted = staged(named.groupBy("cid", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")))
    what = F.md5(F.concat_ws("\0", F.length("role"), "role", "text").cast("binary"))
    at = counted.select("cid", "turn", what.alias("what"))
    # null turns come first, and there is one row of each content and turn
    met = at.groupBy("cid", "what").agg(F.count(F.lit(1)).alias("times"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("has_null")).filter("times > 1")
    firsts = met.select("cid", "what", F.when(~F.col("has_null"), F.col("least")).alias("first"))
    later = staged(at.join(firsts, ["cid", "what"]).filter(~F.col("turn").eqNullSafe(F.col("first"))).select(F.md5(F.concat_ws("\0", "cid", F.coalesce(F.col("turn").cast("string"), F.lit("-")), "what").cast("binary")).alias("row_key")).withColumn("seen", F.lit(True)))
    row_key = F.md5(F.concat_ws("\0", "cid", F.coalesce(F.col("turn").cast("string"), F.lit("-")), what).cast("binary"))
    flagged = counted.withColumn("row_key", row_key).join(later, "row_key", "left").drop("row_key").withColumn("seen", F.coalesce("seen", F.lit(False)))
    order = ["cid", F.asc_nulls_first("turn"), "role", "text"]
    return flagged.repartitionByRange(*order).sortWithinPartitions(*order)


def _cid() -> Column:
    """conv_id as a string that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(" "))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, lines) of rows (conv_id, turn, role, text).

    conversations: cid, first_turn, last_turn, turns, blank, duplicate, truncated, illegal, cost, audit.
    lines: cid, place, alone, lines (array of role and text): the repaired rows, by place; one row only if alone."""
    pieces = staged(_pieces(_sorted_rows(rows)))
    open_ = pieces.filter(~F.col("alone"))
    merged = _merged(open_)
    ends = staged(_finished(merged))
    names = ["cid", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    conversations = pieces.filter("alone").select(names).unionByName(merged.join(ends, "cid").select(names))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):  # a piece has up to PIECE_TEXT characters and one row
                r = b.slice(at, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist([{"cid": r["cid"], "place": r["place"], "alone": False, "lines": edited(r["part"], r["rows"], r["first"], r["system"])}], line_schema)

    line_schema = pa.schema([("cid", pa.string()), ("place", pa.int64()), ("alone", pa.bool_()), ("lines", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    parts = ends.select("cid", F.explode("parts").alias("p")).select("cid", "p.*")
    numbered = open_.select("cid", "place", "rows", (F.row_number().over(W.partitionBy("cid").orderBy("place")) - 1).cast("long").alias("ord"))
    late = numbered.join(parts, ["cid", "ord"]).select("cid", "place", "rows", "part", "first", "system").mapInArrow(edit, "cid string, place long, alone boolean, lines array<struct<role:string,text:string>>")
    return conversations, staged(pieces.filter("alone").select("cid", "place", "alone", "lines").unionByName(late))


def digests(lines: DataFrame) -> DataFrame:
    """cid, repaired_sha256 of the rows role:text with line breaks between; streamed where a conversation has several pieces."""
    text = F.array_join(F.transform("lines", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    short = lines.filter("alone").select("cid", F.sha2(text, 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, digest, empty = None, None, True
        done = lambda: pa.RecordBatch.from_pylist([{"cid": cid, "repaired_sha256": digest.hexdigest()}])
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                if r["cid"] != cid:
                    if digest:
                        yield done()
                    cid, digest, empty = r["cid"], hashlib.sha256(), True
                for line in r["lines"]:
                    digest.update((b"" if empty else b"\n") + f"{line['role']}:{line['text']}".encode())
                    empty = False
        if digest:
            yield done()

    long = lines.filter(~F.col("alone")).repartition("cid").sortWithinPartitions("cid", "place").select("cid", "lines")
    return short.unionByName(long.mapInArrow(run, "cid string, repaired_sha256 string"))


def structure(rows: DataFrame, original: DataFrame) -> DataFrame:
    """Every conv_id of original with the faults of rows, the cheapest repair and the repaired text's SHA-256."""
    with scope() as keep:
        conversations, lines = repair(rows)
        every = original.select("conv_id", _cid().alias("cid")).distinct()
        found = every.join(conversations.join(digests(lines), "cid"), "cid", "left")
        count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
        nothing = hashlib.sha256().hexdigest()
        out = found.select("conv_id", gaps, count("blank"), count("duplicate"), count("truncated"), count("illegal"), count("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
        return keep(staged(out))
