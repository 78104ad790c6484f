import hashlib
import struct
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.media import chunks_of, media_features, payload_of, read_back, store

from .helpers import SCHEMA, edge_texts, prose, rows


def _texts():
    shared = " ".join(prose(21, 30, 90))
    return edge_texts() + [" ".join(prose(22, 8, 90)) + shared, shared + "tail", "x" * 575, "x" * 576, "x" * 40000, " ".join(prose(23, 60, 90))]


def test_values_and_equal_texts(spark):
    data = rows(_texts()) + [(None, "null id", None, None, 1, 1, "", "", 1), rows(_texts())[6]]
    out = media_features(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(out) == len(data)
    texts = {d[0]: d[1] for d in data}
    seen = {}
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert seen.setdefault(texts[r.doc_id] or "", (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_chunks_are_stored_once(spark):
    docs = spark.createDataFrame(rows(_texts()), SCHEMA)
    _, kept = store(docs)
    distinct = {hashlib.sha256(c).digest() for t in _texts() for c in chunks_of(payload_of((t or "").encode()))}
    owned = sum(len({x[4:] for x in map(bytes, r.chunks)} - {bytes(a) for a in (r.away or [])}) for r in kept.collect())
    assert owned == len(distinct)


def test_stored_form_is_what_is_stored(spark):
    """media_bytes and media_sha256 from the files of the store alone."""
    docs = spark.createDataFrame(rows(_texts()), SCHEMA)
    _, kept = store(docs)
    held, owners, lists = [r.asDict() for r in kept.collect()], {}, {}
    for r in held:
        raw, at = bytes(r["here"] or b""), 0
        while at < len(raw):
            (n,) = struct.unpack_from("<I", raw, at)
            frame = raw[at + 4 : at + 4 + n]
            owners[hashlib.sha256(zstandard.ZstdDecompressor().decompress(frame)).digest()] = frame
            at += 4 + n
        lists[bytes(r["payload"]).hex()] = [bytes(c) for c in r["chunks"]]
    got = {r.payload_sha256: r for r in read_back(kept).collect()}
    assert set(got) == set(lists)
    for sha, listed in lists.items():
        size = sum(struct.unpack("<I", c[:4])[0] for c in listed)
        form = b"CDCM\x02" + struct.pack("<QI", size, len(listed)) + b"".join(listed) + b"".join(owners[c[4:]] for c in listed)
        assert (got[sha].media_bytes, got[sha].media_sha256) == (len(form), hashlib.sha256(form).hexdigest())


def test_both_sides_of_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(rows(_texts()), SCHEMA)
    want = sorted(map(str, media_features(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(str, media_features(docs).collect())) == want


def test_damage_is_found(spark):
    _, kept = store(spark.createDataFrame(rows(["some text", "other text"]), SCHEMA))
    with pytest.raises(Exception, match="missing or damaged"):
        read_back(kept.withColumn("here", F.lit(None).cast("binary"))).collect()


def test_nothing(spark):
    assert media_features(spark.createDataFrame([], SCHEMA)).count() == 0
