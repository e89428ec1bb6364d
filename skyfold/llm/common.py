"""Shared helpers: the cluster's shared folder, written tables, packed byte
blobs, and vectorised word and shingle hashing.

Nothing here keeps state between executors.  Intermediate tables go to the
folder that ``spark.checkpoint.dir`` names, so that a lost executor costs a
re-read and never a wrong result.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised hashing takes at a time.
CHUNK_BYTES = 1 << 20
#: Rows of text that one step of a Python worker handles.
CHUNK_ROWS = 1000


# --------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, one on a single machine (tests) sets a temporary
    folder as its checkpoint folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="skyfold-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Tables written to the shared folder by one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str, packed: bool = False) -> DataFrame:
        """Write ``df`` as Parquet and read it back: its lineage ends here.

        ``packed``: its blobs are compressed already; a codec would only hold
        buffers of their size outside the heap.
        """
        writer = df.write.mode("overwrite")
        if packed:
            writer = writer.option("compression", "uncompressed")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_unique(work: Workspace, left: DataFrame, right: DataFrame, on: str, name: str, how: str = "inner", hot_rows: int = 2000) -> DataFrame:
    """``left`` joined with ``right``, in which ``on`` is unique, for any skew of ``left``.

    Keys that more than ``hot_rows`` rows of ``left`` hold are few (at most rows /
    ``hot_rows``, and never more than a million): their rows of ``right`` are
    broadcast, and the rest is shuffled.  ``left`` must be a written table.
    """
    counts = left.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    ranked = counts.orderBy(F.desc("_n"), on).limit(1_000_000).select(on)
    hot = work.save(right.join(F.broadcast(ranked), on, "left_semi"), name)
    if hot.isEmpty():
        return left.join(right, on, how)
    often = left.join(F.broadcast(hot), on)
    seldom = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right, on, how)
    return often.unionByName(seldom)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_KEPT: list[dict] = []


def kept_by_worker(cache: dict) -> dict:
    """Mark a module's cache as one that a reused Python worker can do without."""
    _KEPT.append(cache)
    return cache


def lean(*needed: dict) -> None:
    """Give back what earlier tasks of a reused Python worker left behind, but
    for the caches that are ``needed`` next.

    Steps call this before they begin, those with large arrays also at their end.
    """
    for cache in _KEPT:
        if not any(cache is n for n in needed):
            cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to give back


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


# ------------------------------------------------------------------ byte blobs
def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string: a header of lengths, then their bytes."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], dtype="<u8")
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of :func:`pack`, read in place."""
    view = memoryview(blob)
    n = int(np.frombuffer(view[:8], dtype="<u8")[0])
    sizes = np.frombuffer(view[8 : 8 + 8 * n], dtype="<u8")
    at, out = 8 + 8 * n, []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(view[at : at + size], dtype=kind))
        at += size
    return out


def column_blobs(table: pa.Table, name: str) -> Iterator[bytes]:
    for chunk in table.column(name).chunks:
        for value in chunk:
            yield value.as_buffer()


# ------------------------------------------------------------- hashing of words
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CODE[_SPACE] = 0
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_BASE = 0xD6E8FEB86659FD93


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_chunks(column: pa.Array, rows: int = CHUNK_ROWS * 8, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row starts and end) of runs of rows.

    A run holds at least one row, whole; null texts have no bytes.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype="<i8")[column.offset : column.offset + n + 1] if n else np.zeros(1, "<i8")
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = max(lo + 1, min(hi, lo + rows, n))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word ``[^\\x20\\x09-\\x0D]+``; rows part words."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    ink = ~_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    cut = edges[:-1][np.diff(edges) > 0]
    first[cut] = ink[cut]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[edges[1:][np.diff(edges) > 0] - 1] = ink[edges[1:][np.diff(edges) > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(edges, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo = int(starts[0])
    span = data[lo:]
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(span), dtype=np.int64)
    place -= np.repeat(starts - lo, lengths)
    inside = place < np.repeat(ends - starts, lengths)
    powers = _powers(int((ends - starts).max()) + 1)
    place[~inside] = 0
    terms = _CODE[span] * powers[place]
    terms[~inside] = 0
    out = np.add.reduceat(terms, starts - lo)
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the ``n``-word shingles; a row with fewer words has one."""
    c = np.uint64(0x9FB21C651E98DF25)
    per = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(per) - per
    hashes, owner = [], []
    if len(words) >= n:
        acc = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            acc = acc * c + words[j : len(words) - n + 1 + j]
        whole = rows[: len(words) - n + 1] == rows[n - 1 :]
        hashes.append(mix(acc[whole] + np.uint64(n)))
        owner.append(rows[: len(words) - n + 1][whole])
    for k in range(1, n):
        short = np.flatnonzero(per == k)
        if len(short):
            acc = words[first[short]].copy()
            for j in range(1, k):
                acc = acc * c + words[first[short] + j]
            hashes.append(mix(acc + np.uint64(k)))
            owner.append(short)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owner)


def by_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), ordered by row and then by hash."""
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order].astype(np.uint16), kind="stable")]
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]
