"""What the operators of this subpackage share: staged tables, size-checked
broadcasts, and numpy kernels over the raw bytes of Arrow string columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured rows need no more than this.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
#: Bytes of text that a numpy kernel handles at once (a longer text comes alone).
BLOCK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. In local mode, where one machine is all there is, a
    temporary one if none is set; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tessera-shared"
        spark.sparkContext.setCheckpointDir(base)
    return base


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends
    there, and a lost executor costs no more than the tasks it was running.

    The files go when the application ends, or before by unstage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


#: Staged tables of the scopes that are open, innermost last.
_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are deleted at its end, but for those given to what it yields. An
    operator stages its result, keeps that, and so leaves nothing else behind; the shuffle
    files of what is gone go as well."""
    own: list[DataFrame] = []
    _SCOPES.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own[:] = [t for t in own if t is not df]
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(df)
        return df

    try:
        yield keep
    finally:
        _SCOPES.pop()
        unstage(*own)
        own.clear()


def unstage(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again, and let go of the shuffle
    files of plans that nothing holds (Spark deletes those as the driver's garbage is collected)."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def maybe_broadcast(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only when the counted rows fit; a shuffle join otherwise."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def bound_batches(df: DataFrame) -> DataFrame:
    """Arrow batches of at most BATCH_ROWS rows from here on in the session: a batch of whole
    texts is held on both sides of the pipe to Python."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """name, or with more underscores before it if a column of df has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key() -> Column:
    """Tells apart texts under one doc_id."""
    return F.xxhash64(F.col("text"))


# ---------------------------------------------------------------- Arrow batches


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes in the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(batch.schema.get_field_index(column)))[1][1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def offsets_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary array; nulls are empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


# ---------------------------------------------------------------- byte kernels

_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Bytes that end a word: [\x20\x09-\x0D].
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_of(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text) of the maximal runs of bytes that do not end a word."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    inside = ~ends_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, step: int = 200_000) -> np.ndarray:
    """A 64-bit polynomial fingerprint of each non-empty span (spans in order, apart)."""
    out = np.empty(len(starts), np.uint64)
    base, table = _BASE[which], _TABLE[which]
    with np.errstate(over="ignore"):
        longest = int((ends - starts).max(initial=1))
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(longest - 1, base, np.uint64)]))
        for lo in range(0, len(starts), step):
            s, e = starts[lo : lo + step], ends[lo : lo + step]
            size = e - s
            flat = np.repeat(s - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            x = table[data[flat]] * power[flat - np.repeat(s, size)]
            h = np.add.reduceat(x, np.concatenate([[0], np.cumsum(size)[:-1]]))
            out[lo : lo + step] = mix64(h ^ (size.astype(np.uint64) * _BASE[1 - which]))
    return out


GEAR = _RNG.integers(0, 2**32, size=256, dtype=np.uint32)


def gear_cuts(data: np.ndarray, least: int, mask_bits: int, most: int, step: int = 1 << 20) -> np.ndarray:
    """Ends of the content-defined chunks of one byte string.

    The gear hash of position i is sum(GEAR[byte[i-j]] << j) over the last 32
    bytes, built by doubling. A cut falls after i where its upper mask_bits are
    zero, no chunk but the last is under `least` bytes, none is over `most`."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    found = []
    bar = np.uint32(1 << (32 - mask_bits))
    for lo in range(0, n, step):
        back = max(0, lo - 31)
        h = GEAR[data[back : lo + step]]
        for w in (1, 2, 4, 8, 16):
            h[w:] += h[:-w] << np.uint32(w)
        found.append(np.flatnonzero(h[lo - back :] < bar) + lo + 1)
    marks = np.concatenate(found)
    if n <= most and not len(marks):
        return np.array([n])
    cuts, at = [], 0
    while at < n:
        i = np.searchsorted(marks, at + least)
        to = min(int(marks[i]) if i < len(marks) else n, at + most, n)
        cuts.append(to)
        at = to
    return np.array(cuts, np.int64)
