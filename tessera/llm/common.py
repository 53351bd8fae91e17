"""Shared parts: word and hash kernels over Arrow text, grouped streams, and written tables.

Kernels work on chunks of whole documents of about ``CHUNK_BYTES``; a longer document is a
chunk of its own, so memory follows the longest document and not the batch.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: Bytes that a writer of an intermediate table holds before it ends a row group.
GROUP_BYTES = 1 << 25
MASK64 = (1 << 64) - 1


# ---------------------------------------------------------------- tables in the shared folder


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local, for others would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set, and executors do not share the driver's disk")
    if not hasattr(spark, "_tessera_folder"):
        import tempfile

        spark._tessera_folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(_remove, spark, spark._tessera_folder)
    return spark._tessera_folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended first
        pass


#: Bytes of a batch of rows that Spark hands to Python: both sides hold some copies of it.
BATCH_BYTES = 1 << 23


def small_batches(spark: SparkSession) -> None:
    """Keeps the batches that Python gets at ``BATCH_BYTES`` at most from now on; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = str(spark.conf.get(name)).lower()
    unit = {"k": 10, "m": 20, "g": 30}.get(size.rstrip("b")[-1:], 0)
    digits = size.rstrip("bkmg")
    if not digits.isdigit() or not 0 < int(digits) << unit <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Tables:
    """Intermediate tables of one query, written to the shared folder and read again.

    A written table cuts lineage, survives lost executors and is computed once. ``drop``
    removes tables that no later plan reads; the rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
        self.names: list[str] = []
        atexit.register(_remove, spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.append(name)
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Drops all tables of this query but these."""
        for name in [n for n in self.names if n not in names]:
            self.drop(name)
            self.names.remove(name)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")


# ---------------------------------------------------------------- columns


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns cannot clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def bucket_of(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)


# ---------------------------------------------------------------- chunks of text


def text_array(col) -> pa.Array:
    """A text column as large_binary with nulls empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    return col.cast(pa.large_binary())


def chunks(col, most: int = CHUNK_BYTES):
    """Yields (first row, end row, bytes as uint8, offsets from 0 of each row and the end)."""
    arr = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_binary())
    n = len(arr)
    if not n:
        return
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    if arr.null_count and np.diff(off)[arr.is_null().to_numpy(zero_copy_only=False)].any():  # nulls that hold bytes
        yield from chunks(text_array(col), most)
        return
    data = np.frombuffer(arr.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    released()


def released() -> None:
    """Gives memory that is free in this Python worker back to the system: workers outlive their tasks, and what they hold counts beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


# ---------------------------------------------------------------- hashes

#: A random odd word for each byte, for rolling hashes of short windows.
BYTE = np.random.default_rng(0x7E55E7A).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Byte maps: as they are, and with A-Z lower-cased.
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[65:91] += 32
#: Spans of more bytes are hashed by BLAKE2.
LONG = 256
STEP = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer over a uint64 array."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & MASK64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = STEP) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base & MASK64, dtype=np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each document, and its number of words."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off) - 1, np.int64)
    solid = ~SPACE[buf]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    cut = off[1:-1]
    before[cut[cut < len(buf)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span's bytes under a byte map: eight bytes at a time go through ``mix``,
    so no pattern of bytes collides by its structure, as it can in polynomials modulo 2**64.
    """
    lens = ends - starts
    h = mix(lens.astype(np.uint64), 21)
    if not len(lens):
        return h
    padded = np.concatenate((buf if table is PLAIN else table[buf], np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place
    part = np.append((np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1), np.uint64(MASK64))
    some = np.flatnonzero((lens > 0) & (lens <= LONG))
    k = 0
    while len(some):
        h[some] = mix(h[some] ^ (eight[starts[some] + k] & part[np.minimum(lens[some] - k, 8)]), 22 + k)
        k += 8
        some = some[lens[some] > k]
    for j in np.flatnonzero(lens > LONG).tolist():
        h[j] = int.from_bytes(hashlib.blake2b(padded[starts[j] : ends[j]].tobytes(), digest_size=8).digest(), "little")
    return h


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lens[i] - 1 of all spans in a row."""
    ends = np.cumsum(lens)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n < 1 << 30 and (not n or int(starts.max()) < 1 << 30) else np.int64
    return np.repeat((starts - ends + lens).astype(kind), lens) + np.arange(n, dtype=kind)


# ---------------------------------------------------------------- groups


def grouped(df: DataFrame, keys: list[str], fn, schema: str, parts: int | None = None) -> DataFrame:
    """``fn(table) -> iterable of RecordBatch`` over runs of whole groups of ``keys``.

    Rows are hash-partitioned and sorted by the keys, then read as a stream; ``fn`` gets one
    Arrow table at a time that holds whole groups only, at least ``CHUNK_BYTES`` of them unless
    the partition ends, so small groups share a call.
    """
    spread = df.repartition(parts, *keys) if parts else df.repartition(*keys)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < CHUNK_BYTES:
                continue
            table = pa.Table.from_batches(held)
            cut = _last_group(table, keys)
            if cut:
                yield from fn(table.slice(0, cut))
                rest = table.slice(cut).combine_chunks()
                held = rest.to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield from fn(pa.Table.from_batches(held))
        released()

    return spread.sortWithinPartitions(*keys).mapInArrow(run, schema)


def streamed(df: DataFrame, keys: list[str], then: list[str], fn, schema: str, parts: int | None = None) -> DataFrame:
    """``fn(batches) -> iterable of RecordBatch`` over partitions of whole groups of ``keys``, sorted by them and by ``then``, nulls first.

    Nothing holds a group whole, so a group may be larger than memory.
    """
    spread = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return spread.sortWithinPartitions(*keys, *then).mapInArrow(fn, schema)


def _last_group(table: pa.Table, keys: list[str]) -> int:
    """The row at which the last group of a sorted table begins."""
    n, start = table.num_rows, 0
    for k in keys:
        col = table.column(k).slice(start)
        last = col[len(col) - 1].as_py()
        lo, hi = 0, len(col) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if col[mid].as_py() == last:
                hi = mid
            else:
                lo = mid + 1
        start += lo
    return start if start < n else 0


def bucket_count(df: DataFrame, least: int, each: int = 4 << 20, most: int = 1 << 16) -> int:
    """How many buckets the rows of ``df`` are dealt to: one for ``each`` bytes of its estimated size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 55 else max(least, min(most, size // each))  # rows without files have no estimate


def group_starts(*cols: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal keys in sorted columns, with the length at the end."""
    n = len(cols[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for c, f in zip(cols, schema)], schema=schema)
