"""Shared helpers of the training-data operators: tables, shared storage, byte-level text arrays.

Text is handled as UTF-8 bytes in numpy wherever Python is needed: a batch of documents is one byte
array plus offsets, so word splitting and hashing are whole-array operations with memory bounded by
the slice size, not by the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by a Python worker; longer single texts are a slice of their own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/velum-shared"


#: Paths written within each open :func:`scratch`, the innermost last.
_WRITTEN: list[list[str]] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/velum-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.velum_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` gave and nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.velum_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Operators' intermediate tables written inside are deleted at the end, when their results have been used.

    Yields a function that takes tables of :func:`materialise` which stay. Not for several threads at once.
    """
    mine: list[str] = []
    stays: set[str] = set()
    _WRITTEN.append(mine)
    try:
        yield lambda t: stays.add(t.velum_path)
    finally:
        _WRITTEN.remove(mine)
        for path in mine:
            if path not in stays:
                _delete(spark, path)


def string(c: Column | str) -> Column:
    """Text with null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def text_slices(batch: pa.RecordBatch, max_bytes: int = SLICE_BYTES, column: int = -1) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about ``max_bytes`` each in the given column, the last by default (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column % batch.num_columns)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 of all rows end to end, null as empty; row i is bytes[offsets[i]:offsets[i+1]]."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,000 rows, so that an executor and its workers hold few texts at once.

    It is the one setting that this package makes, as the number of rows is set nowhere else, and every operator that runs Python makes
    it. A value that the session was given, also 10,000, stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, "2000")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function after which the worker gives freed memory back: workers live on and do other operators' tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, sizes: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups, from rows of which those with equal first ``keys`` columns (integers) stand together: as many groups as
    reach ``limit`` in the column ``sizes``, one at least."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)], 1)
        cuts = np.append(0, np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1)
        ends = np.concatenate([[0], np.cumsum(batch.column(sizes).to_numpy(zero_copy_only=False).astype(np.int64))])
        taken = 0
        for cut in cuts.tolist():
            if size + ends[cut] - ends[taken] >= limit and (cut > 0 or (own[0] != last).any()):
                if cut > taken:
                    held.append(batch.slice(taken, cut - taken))
                yield joined()
                held, size, taken = [], 0, cut
        held.append(batch.slice(taken))
        size += int(ends[-1] - ends[taken])
        last = own[-1]
    if held:
        yield joined()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def stream64(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words for a seed."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = stream64(11, 256) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    with np.errstate(over="ignore"):
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _POWERS[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of a byte array, for :func:`range_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of bytes[start:end] for each pair; equal bytes give equal hashes at any place."""
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * _powers(_BASE_INV, int(prefix.shape[0]))[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words are runs of bytes that are no separators, within a row; first[i]:first[i+1] are row i's."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True  # a row's first byte
    begins = begins[:-1]
    prior = np.empty(len(data), bool)
    prior[0] = False
    prior[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (begins | ~prior))
    follows = np.empty(len(data), bool)  # the next byte ends the word
    follows[-1] = True
    follows[:-1] = ~inside[1:] | begins[1:]
    ends = np.flatnonzero(inside & follows) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row number of each element, from the rows' bounds."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k-window of a row's hashes; rows with fewer have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j, r in enumerate(stream64(seed, k) | np.uint64(1)):
            h += hashes[j : j + n] * r
    row = rows_of(first)
    whole = row[:n] == row[k - 1 :]
    return mix64(h[whole]), row[:n][whole]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
