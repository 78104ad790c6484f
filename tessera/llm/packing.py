"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous steps.

A document's ids are cut into pieces of `capacity`, the first of which may be shorter. Full
pieces are sequences of their own; the others are packed.

1. Each task tokenises its documents and numbers its pieces of each length as it meets
   them. Ordering by length, then task, then number is a range sort of all pieces that
   needs no exchange: a piece's rank among those of its length is what the tasks before it
   hold, and its own number.
2. Tasks are dealt into stripes of about `STRIPE_TOKENS` tokens; each stripe is swept by a
   task of its own, and knows its pieces only as counts by (task, length), at most
   `capacity` lengths a task. Equal pieces form a run, equal gaps as well. From the
   longest run down, a step matches a run to its successor, the run of the
   smallest gaps that hold it; where more pieces than gaps meet, the lower ranks win and
   the others go to the next step; the gaps are updated, and it repeats. Pieces that no
   gap holds open sequences: as many as it takes when each is filled with them.
3. Every piece looks its rank up among the matches of its (task, length).

Only counts pass through the sweeps. They are sorted and swept as runs, as a run of equal
lengths behaves like its pieces one by one: the result is best-fit decreasing in each stripe.

Texts are cut where white space follows something else, which no token of a byte-level model
crosses; the distinct words of a block of texts are encoded together, once.

Edge cases: a null text is empty, and an empty document is its end mark alone; rows repeat as
often as they come; null doc_ids stay null; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, blocks, bound_batches, offsets_of, scope, staged

#: Tokens of a stripe; a stripe may leave one sequence partly empty that a single one would fill.
STRIPE_TOKENS = 1 << 26
#: Fixed value of the format: how texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of texts whose distinct words are encoded together.
TEXT_BYTES = 16 << 20
#: Sequences of a stripe are numbered from its own multiple of this.
NUMBERS = 1 << 40


class ByteLevel:
    """Ids of texts by a byte-level tokenizer file.

    A file whose merges are in the order of their ids is asked through `tiktoken`, which gives
    the same ids (tests compare them) in a sixth of the time; words with an added token's
    text in them, and any other file, are asked through `tokenizers`."""

    def __init__(self, raw: bytes, end: int) -> None:
        from tokenizers import Tokenizer

        self.end, self.tool = end, Tokenizer.from_str(raw.decode())
        file = json.loads(raw)
        self.added = [t["content"] for t in file.get("added_tokens", [])]
        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        byte = _byte_of()
        tokens = {t: bytes(byte[c] for c in t) for t in vocabulary}
        self.size = np.zeros(max(self.tool.get_vocab(with_added_tokens=True).values()) + 1, np.int64)
        for t, i in vocabulary.items():
            self.size[i] = len(tokens[t])
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        before = file.get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not file.get("normalizer")
        self.joined: Callable[[str], list[int]]
        if usual and made == sorted(made) and min(made, default=0) >= 256:
            import tiktoken

            self.joined = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={tokens[t]: i for t, i in vocabulary.items()}, special_tokens={}).encode_ordinary
        else:
            self.joined = lambda text: self.tool.encode(text, add_special_tokens=False).ids

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words side by side, how many each has), in the words' order.

        Words that begin with white space and do not end with it keep their ids side by side, so
        they are encoded as one text; the rest (where texts begin and end) one by one."""
        data, off = offsets_of(words)
        plain = SPACES[data[off[:-1]]] & ~SPACES[data[off[1:] - 1]] & ~_odd(data, off[1:])
        for t in self.added:
            plain &= ~pc.match_substring(words, t).to_numpy(zero_copy_only=False)
        per = np.zeros(len(words), np.int64)
        joins = words.filter(pa.array(plain))
        bytes_, ends = offsets_of(joins)
        flat = np.array(self.joined(bytes_.tobytes().decode()), np.int32)
        per[plain] = np.diff(np.searchsorted(np.cumsum(self.size[flat]), ends[1:], side="right"), prepend=0)
        alone = self.tool.encode_batch(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
        per[~plain] = [len(e.ids) for e in alone]
        out, own = np.empty(int(per.sum()), np.int32), np.repeat(plain, per)
        out[own] = flat
        out[~own] = np.fromiter(chain.from_iterable(e.ids for e in alone), np.int32)
        return out, per

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of whole texts as bytes, each with the end mark."""
        if not len(data):
            return np.full(len(offsets) - 1, self.end, np.int32), np.ones(len(offsets) - 1, np.int64)
        starts = cuts(data, offsets)
        # blocks of texts are below what a 32-bit offset reaches, as a column of strings is
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        ids, n = self.words(words.dictionary)
        which = words.indices.to_numpy()
        upto = np.searchsorted(starts, offsets[1:])
        # each text's end mark is one more word
        first, n = np.append(np.cumsum(n) - n, len(ids)), np.append(n, 1)
        which = np.insert(which, upto, len(n) - 1)
        many = n[which]
        ends = np.cumsum(many)
        flat = np.append(ids, np.int32(self.end))[np.repeat(first[which] - (ends - many), many) + np.arange(ends[-1])]
        return flat, np.diff(ends[upto + np.arange(len(upto))], prepend=0)


def _byte_of() -> dict[str, int]:
    """The format's characters for bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def _odd(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether what ends before each place could be white space outside ASCII (its lead byte says so)."""
    return (data[ends - 1] >= 0x80) & (_LEADS[0, data[ends - 2]] | _LEADS[1, data[ends - 3]])


#: Lead bytes of characters of two or three bytes among which white space is.
_LEADS = np.zeros((2, 256), bool)
_LEADS[0, 0xC2] = True
_LEADS[1, 0xE1:0xE4] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the words that tile the texts: white space, then what is not.

    No cut falls after a character that might be white space outside ASCII."""
    space = SPACES[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    at = np.flatnonzero(cut)
    at = at[at > 0]
    cut[at[_odd(data, at)]] = False
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


_HERE: dict[tuple[int, int], ByteLevel] = {}


def _here(raw: bytes, end: int) -> ByteLevel:
    """This worker process's tokenizer, kept from task to task."""
    key = (zlib.crc32(raw), end)
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = ByteLevel(raw, end)
    return _HERE[key]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(docs: DataFrame, capacity: int, end: int, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with the task that cut it and its
    number (nth) among that task's pieces of its length. No shuffle."""
    with open(tokenizer or tokenizer_file(), "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task, met = _here(raw.value, end), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in blocks(batches, "text", TEXT_BYTES):
            flat, per = tool.documents(*offsets_of(b.column("text")))
            raw_ids = flat.astype("<u4").tobytes()
            many = -(-per // capacity)
            doc = np.repeat(np.arange(len(per)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            first = (per - capacity * (many - 1))[doc]
            start = np.where(piece == 0, 0, first + capacity * (piece - 1))
            length = np.where(piece == 0, first, capacity)
            at = (np.cumsum(per) - per)[doc] + start
            crc = [zlib.crc32(raw_ids[4 * a : 4 * z]) for a, z in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sizes, begin, count = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.repeat(begin, count) + np.repeat(met[sizes], count)
            met[sizes] += count
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task)), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return bound_batches(rows).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long")


def sweep(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """length -> matches (pieces, first sequence, offset) in order of rank.

    counts: pieces of each length, all under capacity. A match puts one piece into
    each of as many consecutive sequences, all with the same offset."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    opened, out = 0, {}
    for size in sorted(counts, reverse=True):
        left, matches = counts[size], []
        while left:
            gap = min((g for g in gaps if g >= size), default=None)
            if gap is None:
                new = -(-left // (capacity // size))
                gaps[capacity] = [(opened, new)]
                opened += new
                continue
            first, n = gaps[gap].pop()
            won = min(n, left)
            if n > won:
                gaps[gap].append((first + won, n - won))
            elif not gaps[gap]:
                del gaps[gap]
            if gap > size:
                gaps.setdefault(gap - size, []).append((first, won))
            matches.append((won, first, capacity - gap))
            left -= won
        out[size] = matches
    return out


def dealt(matches: list[tuple[int, int, int]], shares: list[int]) -> list[list[tuple[int, int, int]]]:
    """The matches of each task that holds the next `share` ranks: (from its own rank, first sequence, offset)."""
    out, i, used = [], 0, 0
    for share in shares:
        mine, at = [], 0
        while at < share:
            n, first, offset = matches[i]
            take = min(n - used, share - at)
            mine.append((at, first + used, offset))
            at, used = at + take, used + take
            if used == n:
                i, used = i + 1, 0
        out.append(mine)
    return out


def pack(docs: DataFrame, capacity: int = 1024, end: int = 2, tokenizer: str | None = None, stripe_tokens: int = STRIPE_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    with scope() as keep:
        return keep(staged(_pack(docs, capacity, end, tokenizer, stripe_tokens)))


def _pack(docs: DataFrame, capacity: int, end: int, tokenizer: str | None, stripe_tokens: int) -> DataFrame:
    rows = staged(pieces_of(docs, capacity, end, tokenizer))
    short = F.col("length") < capacity
    counts = staged(rows.filter(short).groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    tokens = counts.agg(F.sum(F.col("n") * F.col("length"))).first()[0] or 0
    stripes = max(1, -(-tokens // stripe_tokens))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "task"], kind="stable")
        found = sweep(own.groupby("length")["n"].sum().to_dict(), capacity)
        made, base = [], int(key[0]) * NUMBERS
        for size, part in own.groupby("length", sort=True):
            for task, mine in zip(part["task"], dealt(found[size], part["n"].tolist()), strict=True):
                at, first, offset = zip(*mine, strict=True)
                made.append((task, size, list(at), [2 * (base + s) for s in first], list(offset)))
        return pd.DataFrame(made, columns=["task", "length", "ranks", "firsts", "offsets"])

    plan = counts.groupBy(F.pmod("task", F.lit(stripes)).alias("stripe")).applyInPandas(run, "task long, length long, ranks array<long>, firsts array<long>, offsets array<long>")
    last = F.size(F.filter("ranks", lambda r: r <= F.col("nth"))) - 1
    placed = rows.join(plan, ["task", "length"], "left").withColumn("_i", last)
    number = F.get("firsts", F.col("_i")) + 2 * (F.col("nth") - F.get("ranks", F.col("_i")))
    own = 2 * (F.col("task") * F.lit(1 << 36) + F.col("nth")) + 1  # full pieces have odd numbers
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.when(short, number).otherwise(own).alias("sequence_id"), F.when(short, F.get("offsets", F.col("_i"))).otherwise(F.lit(0)).cast("long").alias("offset"))
