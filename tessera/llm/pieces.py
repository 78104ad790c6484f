"""SentencePiece encoding and decoding by shared-prefix search.

A text is cut into marked words: a run of word marks (spaces) with what follows. No
piece crosses such a cut, which is checked when a model is read. The cuts are found on
the bytes of a block of texts, and Arrow gives its distinct words; those that the worker
does not know yet are sorted, which puts them in depth-first order of their trie; going
from one to the next, the forward states of the common prefix are kept and only
the rest is computed. A worker process remembers words from task to task; when they come
to CACHE, those met once go.

A unigram model's forward state is the best score of a prefix (Viterbi). A BPE model has
merge ranks, not scores to add up: the best-scoring path is not its encoding.
But the last piece of a prefix's encoding is unique, and it is the one that stays whole
beside the last piece before it, so the same forward search over prefixes, with that
test in place of the sum, gives exactly the pieces of merging by rank.

Edge cases: a null text gives null ids; an empty one none; characters outside the
vocabulary become byte pieces (or the unknown piece); a text with the mark character
itself decodes to a space there, as in the format; other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks, bound_batches, offsets_of

#: Fixed values of the file format.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Words whose pieces a worker remembers, and pairs of pieces.
CACHE = 1_000_000
#: Bytes of texts whose words are found at once.
TEXT_BYTES = 4 << 20


def default_model() -> str:
    return os.environ.get("TESSERA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            b = raw[at]
            x |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return x, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


class Vocabulary:
    """Pieces, scores and types of a model file."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.prefix, squeeze, charsmap = UNIGRAM, True, True, b""
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                self.prefix, squeeze, charsmap = bool(f.get(3, 1)), bool(f.get(4, 1)), f.get(2, b"")
        if self.kind not in (UNIGRAM, BPE) or squeeze or charsmap:
            raise ValueError("only unigram and BPE models that leave the text as it is are supported")
        plain = [p for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER)]
        if any(MARK in p.lstrip(MARK) for p in plain) or USER in self.types:
            raise ValueError("a piece crosses a word mark, or is user-defined")
        self.newline_cuts = not any("\n" in p for p in plain)
        self.id = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.size = [len(p) for p in self.pieces]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode()
            for p, t in zip(self.pieces, self.types, strict=True)
        ]


class Encoder:
    def __init__(self, raw: bytes) -> None:
        self.v = Vocabulary(raw)
        self._beside: dict[int, bool] = {}
        self._edges: dict[int, list[tuple[str, float]] | None] = {}
        self._floor = min(self.v.scores, default=0.0) - 10.0
        # without a newline in any piece, a newline is a cut as well
        self._cut = re.compile(" +[^ \n]*|[^ \n]+|\n" if self.v.newline_cuts else " +[^ ]*|[^ ]+")
        # character -> [children, piece or -1]; a BPE piece that merging never gives is left out
        self.trie: dict[str, list] = {}
        for p, i in self.v.id.items():
            if self.v.kind == UNIGRAM or len(p) == 1 or self.merge(list(p)) == [p]:
                kids, node = self.trie, None
                for c in p:
                    node = kids.setdefault(c, [{}, -1])
                    kids = node[0]
                node[1] = i
        if MARK in self.trie:  # a mark comes as the space it stands for as well
            self.trie[" "] = self.trie[MARK]
            for node in self._nodes(self.trie[MARK]):
                if MARK in node[0]:
                    node[0][" "] = node[0][MARK]
        size = np.array([len(b) for b in self.v.bytes], np.int64)
        self._bytes, self._size, self._first = np.frombuffer(b"".join(self.v.bytes), np.uint8), size, np.cumsum(size) - size

    @staticmethod
    def _nodes(node: list) -> Iterator[list]:
        """A node of the trie and the runs of marks below it."""
        while node is not None:
            yield node
            node = node[0].get(MARK)

    # ------------------------------------------------------------ marked words

    def marked(self, text: str) -> list[str]:
        """The marked words of a text, marks as spaces."""
        if not text:
            return []
        return self._cut.findall((" " if self.v.prefix else "") + text.replace(MARK, " "))

    def merge(self, symbols: list[str], trace: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Merging by rank, the definition: the best pair first, the left one of equals.

        trace, if given, gets the two parts of what each merge made."""
        left, right, alive = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1], symbols[:]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (p := self.v.id.get(alive[i] + alive[j])) is not None:
                heapq.heappush(heap, (-self.v.scores[p], i, alive[i] + alive[j]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or alive[i] + alive[j] != p:
                continue
            if trace is not None:
                trace[p] = alive[i], alive[j]
            alive[i], alive[j] = p, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in alive if s]

    def _edge(self, piece: int, side: int) -> list[tuple[str, float]] | None:
        """What stands at one end of a piece while it is merged, from its last (side 1) or
        first (0) character up, each with the rank of the merge that takes it in.

        None if the ranks do not rise: then the order of merges says more than they do."""
        key = 2 * piece + side
        if key not in self._edges:
            trace: dict[str, tuple[str, str]] = {}
            at, rank, found = self.v.pieces[piece], float("inf"), []
            self.merge(list(at), trace)
            rising = True
            while True:
                found.append((at, rank))
                if at not in trace:
                    break
                new = -self.v.scores[self.v.id[at]]
                rising &= new < rank
                at, rank = trace[at][side], new
            self._edges[key] = found[::-1] if rising else None
        return self._edges[key]

    def _fits(self, a: int, b: int) -> bool:
        """Whether piece b stays whole after piece a: no merge across their border comes
        before those that make them up. Of equal ranks the left one comes first."""
        key = a * len(self.v.pieces) + b
        if (known := self._beside.get(key)) is None:
            if len(self._beside) > CACHE:
                self._beside.clear()
            x, y = self._edge(a, 1), self._edge(b, 0)
            if x is None or y is None:
                pa_, pb = self.v.pieces[a], self.v.pieces[b]
                known = self.merge(list(pa_ + pb)) == [pa_, pb]
            else:
                known, i, j, ids, scores = True, 0, 0, self.v.id, self.v.scores
                while True:
                    (left, r), (right, t) = x[i], y[j]
                    if (p := ids.get(left + right)) is not None and -scores[p] < r and -scores[p] <= t:
                        known = False
                        break
                    if i + 1 == len(x) and j + 1 == len(y):
                        break
                    if r <= t:
                        i += 1
                    else:
                        j += 1
            self._beside[key] = known
        return known

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Piece ids of each of the sorted marked words (marks as MARK or spaces)."""
        return self._by_scores(words) if self.v.kind == UNIGRAM else self._by_merges(words)

    def _back(self, word: str, last: list[int]) -> list[int]:
        """The pieces of a word from the last one of each prefix (-1: a character of its own)."""
        size, ids, i = self.v.size, [], len(word)
        while i:
            if (t := last[i]) >= 0:
                ids.append(t)
                i -= size[t]
            else:
                ids += self._ids(word[i - 1])[::-1]
                i -= 1
        ids.reverse()
        return ids

    def _by_merges(self, words: list[str]) -> Iterator[list[int]]:
        root, beside, n_pieces, fits, back = self.trie, self._beside, len(self.v.pieces), self._fits, self._back
        last: list[int] = [-2]
        open_: list[list] = [[]]  # of each prefix: places where pieces have begun, with what may follow
        before = ""
        for word in words:
            n = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                n += 1
            before = word
            del last[n + 1 :], open_[n + 1 :]
            begun = open_[n]
            for i, c in enumerate(word[n:], n):
                here, tok = [], -1
                for j, kids in begun:
                    if c in kids:
                        kids, t = kids[c]
                        if kids:
                            here.append((j, kids))
                        if tok < 0 <= t:
                            if (b := last[j]) < 0:
                                tok = t
                            else:
                                if (good := beside.get(b * n_pieces + t)) is None:
                                    good = fits(b, t)
                                if good:
                                    tok = t
                if c in root:
                    kids, t = root[c]
                    if kids:
                        here.append((i, kids))
                    if tok < 0 <= t:
                        if (b := last[i]) < 0:
                            tok = t
                        else:
                            if (good := beside.get(b * n_pieces + t)) is None:
                                good = fits(b, t)
                            if good:
                                tok = t
                last.append(tok)
                open_.append(here)
                begun = here
            yield back(word, last)

    def _by_scores(self, words: list[str]) -> Iterator[list[int]]:
        """Viterbi: the best score of each prefix, with its last piece."""
        root, scores = self.trie, self.v.scores
        last, best, open_ = [-2], [0.0], [[]]
        before = ""
        for word in words:
            n = len(os.path.commonprefix((before, word)))
            before = word
            del last[n + 1 :], best[n + 1 :], open_[n + 1 :]
            for i in range(n, len(word)):
                c, here, tok, score = word[i], [], -1, best[i] + self._floor
                for j, kids in (*open_[i], (i, root)):
                    if (x := kids.get(c)) is None:
                        continue
                    kids, t = x
                    if kids:
                        here.append((j, kids))
                    if t >= 0 and ((s := best[j] + scores[t]) > score or tok < 0):
                        tok, score = t, s
                last.append(tok)
                best.append(score)
                open_.append(here)
            yield self._back(word, last)

    def encode_words(self, words: list[str]) -> tuple[list[str], list[list[int]]]:
        """Distinct marked words in order, and their pieces, found depth-first over their trie."""
        # several marks in a row merge in order of equal ranks: by definition
        runs = [w for w in words if w.startswith("  ")] if self.v.kind == BPE else []
        plain = sorted(w for w in words if not w.startswith("  ")) if runs else sorted(words)
        got = list(self.encode_sorted(plain))
        got += [[t for p in self.merge(list(w.replace(" ", MARK))) for t in self._ids(p)] for w in runs]
        return plain + runs, got

    def _ids(self, piece: str) -> list[int]:
        piece = piece.replace(" ", MARK)
        if piece in self.v.id:
            return [self.v.id[piece]]
        return [self.v.byte[x] for x in piece.encode("utf-8", "replace")] if self.v.byte else [self.v.unknown]

    def decode(self, ids: list[int]) -> str:
        data, _ = self.decoded(np.asarray(ids, np.int64), np.array([len(ids)]))
        return data.tobytes().decode("utf-8", "replace")

    def decoded(self, flat: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of `per` ids each."""
        n = self._size[flat]
        ends = np.cumsum(n)
        data = self._bytes[np.repeat(self._first[flat] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        if self.v.prefix and len(data):
            starts = offsets[:-1][np.diff(offsets) > 0]
            starts = starts[data[starts] == 0x20]
            data = np.delete(data, starts)
            offsets = offsets - np.searchsorted(starts, offsets)
        return data, offsets


class _Memory:
    """Pieces of words seen, as slices of one array."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.slot: dict[str, int] = {}
        self.start, self.pool, self.met = np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)

    def _forget(self) -> None:
        """Only words met twice or more stay (none, if that leaves too many)."""
        often = self.met > 1
        if 2 * int(often.sum()) > CACHE:
            often[:] = False
        keep = np.flatnonzero(often)
        stays = often.tolist()
        self.slot = {w: i for i, w in enumerate(w for w, s in self.slot.items() if stays[s])}
        a, n = self.start[keep], self.start[keep + 1] - self.start[keep]
        ends = np.cumsum(n)
        self.pool = self.pool[np.repeat(a - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        self.start, self.met = np.concatenate([[0], ends]), np.ones(len(keep), np.int64)

    def _slots(self, words: list[str]) -> np.ndarray:
        """Slots of distinct words; those not known are encoded."""
        if len(self.slot) > CACHE:
            self._forget()
        new = [w for w in words if w not in self.slot]
        if new:
            new, got = self.encoder.encode_words(new)
            at = len(self.slot)
            self.slot.update(zip(new, range(at, at + len(new)), strict=True))
            size = np.fromiter(map(len, got), np.int64, len(got))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(got), np.int32, int(size.sum()))])
            self.met = np.concatenate([self.met, np.zeros(len(got), np.int64)])
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def _gather(self, slots: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text) from the slots of their words."""
        a, n = self.start[slots], self.start[slots + 1] - self.start[slots]
        ends = np.cumsum(n)
        flat = self.pool[np.repeat(a - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate([[0], ends])
        first = np.concatenate([[0], np.cumsum(words)])
        return flat, total[first[1:]] - total[first[:-1]]

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are cut into marked words already."""
        words = [w for t in texts for w in t]
        distinct = list(dict.fromkeys(words))
        of = dict(zip(distinct, self._slots(distinct).tolist(), strict=True))
        return self._gather(np.array([of[w] for w in words], np.int64), np.array([len(t) for t in texts], np.int64))

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts as bytes: cut into marked words as Encoder.marked does."""
        v = self.encoder.v
        if (data == 0xE2).any() and MARK.encode() in data.tobytes():
            texts = [data[a:z].tobytes().replace(MARK.encode(), b" ") for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        full = np.diff(offsets) > 0
        if v.prefix:
            data = np.insert(data, offsets[:-1][full], 0x20)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(full), np.int64)
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        if v.newline_cuts:
            line = data == 0x0A
            cut |= line
            cut[1:] |= line[:-1]
        cut[offsets[:-1][full]] = True
        starts = np.flatnonzero(cut)
        # whole texts of at most a 32-bit offset: a column of strings has no longer ones
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        known = self._slots(words.dictionary.to_pylist())
        which = words.indices.to_numpy()
        self.met[known] += np.bincount(which, minlength=len(known))
        return self._gather(known[which], np.diff(np.searchsorted(starts, offsets)))


_HERE: dict[bytes, _Memory] = {}


def memory_of(raw: bytes) -> _Memory:
    """This worker process's encoder and words of the model, kept from task to task."""
    key = hashlib.sha256(raw).digest()
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = _Memory(Encoder(raw))
    return _HERE[key]


def encode_documents(docs: DataFrame, model: str | None = None, check: bool = False) -> DataFrame:
    """docs with token_ids and n_tokens (and, with check, round_trip: whether the ids
    decode to the text); columns of these names are replaced. No shuffle."""
    with open(model or default_model(), "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    more = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    if check:
        more.append(T.StructField("round_trip", T.BooleanType()))
    docs = docs.drop(*[f.name for f in more])
    schema = T.StructType([*docs.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(raw.value)
        for b in blocks(batches, "text", TEXT_BYTES):
            text = b.column(b.schema.get_field_index("text"))
            data, offsets = offsets_of(text)
            flat, per = memory.ids_of(data, offsets)
            null = text.is_null().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array(null))
            new = [ids, pa.array(per, pa.int64(), mask=null)]
            if check:
                back, at = memory.encoder.decoded(flat, per)
                same = [back[i:j].tobytes() == data[a:z].tobytes() for i, j, a, z in zip(at[:-1], at[1:], offsets[:-1], offsets[1:], strict=True)]
                new.append(pa.array(same, pa.bool_(), mask=null))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *[f.name for f in more]])

    return bound_batches(docs).mapInArrow(run, schema)


def decode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with decoded: the text of token_ids (null for null)."""
    with open(model or default_model(), "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memory_of(raw.value).encoder
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                ids = b.column(b.schema.get_field_index("token_ids"))
                per = ids.value_lengths().fill_null(0).to_numpy()
                data, ends = encoder.decoded(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), per)
                null = ids.is_null().to_pylist()
                out = [None if n else data[a:z].tobytes().decode("utf-8", "replace") for n, a, z in zip(null, ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    return bound_batches(docs).mapInArrow(run, schema)
