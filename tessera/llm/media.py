"""Media columns as a store of content-defined chunks.

A payload (a text's UTF-8 bytes, padded) is cut where a rolling gear hash of its last
32 bytes has zero upper bits, so an insertion moves only the cuts near it. The store
keeps every distinct chunk once, as a compressed frame, with the payload that owns it (the first by
digest), and every distinct payload as an ordered list of chunk digests.

Which chunks are shared is found by a join of digests alone; payload bytes move only
for chunks that several payloads share. Reading back puts a payload's own chunks and
the fetched ones in order, checks each against its digest, and only then computes features.

media_bytes and media_sha256 are of a payload's stored form, from the bytes read back: MAGIC, its
length, its stored list of (chunk length, chunk sha256), and the stored (compressed) frames
of those chunks in that order. A chunk is a frame of its own whoever owns it, so the stored
form is that of the payload alone.

Edge cases: a null text is an empty payload (576 bytes of 255); equal payloads are
stored once and each of their documents gets the same values; null and repeated doc_ids
pass through, a row each; a chunk that fails its digest raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bound_batches, gear_cuts, maybe_broadcast, scope, staged, unstage

UNIT = 576
PAD = 255
MAGIC = b"CDCM\x02"
LEVEL = 3
#: Chunks have 1 KiB to 16 KiB, 1 KiB + 2 KiB in the mean.
LEAST, MASK_BITS, MOST = 1024, 11, 16384


def payload_of(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % UNIT or (UNIT if not text else 0))


def chunks_of(payload: bytes) -> list[bytes]:
    at, out = 0, []
    for to in gear_cuts(np.frombuffer(payload, np.uint8), LEAST, MASK_BITS, MOST).tolist():
        out.append(payload[at:to])
        at = to
    return out


def _binary(array: pa.Array) -> list[bytes]:
    return [x or b"" for x in array.to_pylist()]


def _pack(frames: list[bytes]) -> bytes:
    return b"".join(struct.pack("<I", len(f)) + f for f in frames)


def _unpack(packed: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(packed):
        (n,) = struct.unpack_from("<I", packed, at)
        out.append(packed[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _opened(frames: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
    """digest -> (frame, chunk) of the frames that are whole."""
    tool, out = zstandard.ZstdDecompressor(), {}
    for f in frames:
        c = tool.decompress(f)
        out[hashlib.sha256(c).digest()] = f, c
    return out


def manifests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (sha256), chunks (digests in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "bytes"):
            size, sha, lists = [], [], []
            for text in _binary(b.column("bytes")):
                p = payload_of(text)
                size.append(len(text))
                sha.append(hashlib.sha256(p).digest())
                lists.append([hashlib.sha256(c).digest() for c in chunks_of(p)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(sha, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "payload", "chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("bytes"))
    return bound_batches(rows).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload binary, chunks array<binary>")


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_bytes, payload) of every document, and the store: payload, chunks,
    here (frames of the chunks that this payload owns), lent (digests of those that others
    need), away (digests owned elsewhere)."""
    lists = staged(manifests(docs))
    # one document of each payload writes it: the smallest doc_id, null first. What is counted is
    # written before it is joined, so that the rows of one payload or chunk can be split over tasks
    distinct = staged(lists.groupBy("payload").agg(F.any_value("chunks").alias("chunks"), F.min("doc_id").alias("writer"), F.count(F.lit(1)).alias("copies")))
    uses = distinct.select("payload", F.explode(F.array_distinct("chunks")).alias("digest"))
    shared = staged(uses.groupBy("digest").agg(F.min("payload").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    met = uses.join(shared, "digest")
    flags = met.groupBy("payload").agg(F.collect_list(F.when(F.col("payload") == F.col("owner"), F.col("digest"))).alias("lent"), F.collect_list(F.when(F.col("payload") != F.col("owner"), F.col("digest"))).alias("away"))
    # what a writer must know that its own bytes do not tell it; others just write
    flags = staged(flags)
    unstage(shared)
    n, digests = flags.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("lent") + F.size("away")), F.lit(0))).first()
    skip = lists.join(distinct.filter("copies > 1").select("payload", "writer"), "payload").filter(~F.col("doc_id").eqNullSafe(F.col("writer"))).select("doc_id", "payload")
    skip = staged(skip)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("bytes"))
    sha = F.unhex(F.sha2(F.concat(F.coalesce("bytes", F.lit(b"")), F.expr(f"unhex(repeat('{PAD:02x}', CASE WHEN coalesce(octet_length(bytes), 0) = 0 THEN {UNIT} ELSE pmod(-octet_length(bytes), {UNIT}) END))")), 256))
    rows = rows.withColumn("payload", sha)
    k = skip.select(F.col("doc_id").alias("_d"), F.col("payload").alias("_p"))
    rows = rows.join(maybe_broadcast(k, 80), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("payload") == F.col("_p")), "left_anti")
    rows = rows.join(maybe_broadcast(flags, 48, 2 * n + digests), "payload", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=LEVEL)
        for b in blocks(batches, "bytes"):
            lists, here = [], []
            for text, away in zip(_binary(b.column("bytes")), b.column("away").to_pylist(), strict=True):
                parts = chunks_of(payload_of(text))
                digests = [hashlib.sha256(c).digest() for c in parts]
                gone, seen, own = set(away or ()), set(), []
                for d, c in zip(digests, parts, strict=True):
                    if d not in gone and d not in seen:
                        seen.add(d)
                        own.append(tool.compress(c))
                lists.append([struct.pack("<I", len(c)) + d for d, c in zip(digests, parts, strict=True)])
                here.append(_pack(own))
            yield pa.RecordBatch.from_arrays([b.column("payload"), pa.array(lists, pa.list_(pa.binary())), pa.array(here, pa.binary()), b.column("lent"), b.column("away")], ["payload", "chunks", "here", "lent", "away"])

    kept = rows.select("payload", "bytes", "lent", "away").mapInArrow(run, "payload binary, chunks array<binary>, here binary, lent array<binary>, away array<binary>")
    return lists.select("doc_id", "n_bytes", "payload"), staged(kept)


FEATURES = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(payload: bytes, chunks: list[bytes], frames: list[bytes]) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    media = b"".join([MAGIC, struct.pack("<QI", len(payload), len(chunks)), *chunks, *frames])
    a = np.frombuffer(payload, np.uint8)
    feature = f"chunks={len(chunks)};distinct={len(set(chunks))};mean={a.mean():.6f};std={a.std():.6f};values={len(np.unique(a))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def read_back(kept: DataFrame) -> DataFrame:
    """Features of every stored payload, from the stored bytes."""
    lenders = kept.filter(F.size("lent") > 0).select("here", "lent")

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "here", 1 << 20):
            digest, chunk = [], []
            for here, lent in zip(_binary(b.column("here")), b.column("lent").to_pylist(), strict=True):
                have = _opened(_unpack(here))
                for d in set(lent).intersection(have):
                    digest.append(d)
                    chunk.append(have[d][0])
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(chunk, pa.binary())], ["digest", "chunk"])

    lent = lenders.mapInArrow(lend, "digest binary, chunk binary")
    needs = kept.filter(F.size("away") > 0).select("payload", F.explode("away").alias("digest"))
    # a payload's chunks are no more than the payload itself
    fetched = needs.join(lent, "digest").groupBy("payload").agg(F.collect_list("chunk").alias("fetched"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "here", 1 << 20):
            out: list[list] = [[] for _ in range(7)]
            for key, chunks, here, fetched in zip(*(b.column(c).to_pylist() for c in ("payload", "chunks", "here", "fetched")), strict=True):
                have = _opened([*_unpack(here or b""), *(fetched or [])])
                missing = [x for x in chunks if x[4:] not in have]
                if missing:
                    raise ValueError(f"chunk {missing[0][4:].hex()} of payload {key.hex()} is missing or damaged")
                payload = b"".join(have[x[4:]][1] for x in chunks)
                if hashlib.sha256(payload).digest() != key:
                    raise ValueError(f"payload {key.hex()} was not put together as it was stored")
                for o, x in zip(out, (key, *features(payload, chunks, [have[x[4:]][0] for x in chunks])), strict=True):
                    o.append(x)
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])

    whole = kept.filter(F.coalesce(F.size("away"), F.lit(0)) <= 0).select("payload", "chunks", "here", F.lit(None).cast("array<binary>").alias("fetched"))
    parted = kept.filter(F.size("away") > 0).select("payload", "chunks", "here").join(fetched, "payload", "left")
    return whole.mapInArrow(read, FEATURES).unionByName(parted.mapInArrow(read, FEATURES))


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and FEATURES of every document, read back from the store."""
    with scope() as keep:
        rows, kept = store(docs)
        got = staged(read_back(kept).dropDuplicates(["payload"]))
        return keep(staged(rows.join(got, "payload").drop("payload")))
