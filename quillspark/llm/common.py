"""What several operators share: scratch tables, folds, and word hashing on whole Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BLOCK_BYTES = 4 << 20  # text bytes that one round of numpy temporaries covers
WORD_BLOCK = 1 << 20
ROWS_PER_BATCH = 1000
_MUL = 0x9E3779B97F4A7C15 | 1
_SCRATCH: list[list[tuple[SparkSession, str]]] = []  # a list for each thread, so that operators that run at once leave each other's tables alone
_LOCAL = threading.local()


# --- scratch tables --------------------------------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is named and all runs on this machine (as in tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _own() -> list[tuple[SparkSession, str]]:
    if not hasattr(_LOCAL, "made"):
        _LOCAL.made = []
        _SCRATCH.append(_LOCAL.made)
    return _LOCAL.made


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there, and every executor can read it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _own().append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete this thread's scratch tables made after position `since`, but for the last `keep`: nothing reads them any more."""
    made = _own()
    end = len(made) - keep
    for owner, path in made[since:end]:
        _delete(owner, path)
    del made[since:end]


def mark() -> int:
    return len(_own())


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in (x for made in _SCRATCH for x in made):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before the interpreter does
            return


def bounded(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to ROWS_PER_BATCH rows, so that long texts don't pile up in a worker."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ROWS_PER_BATCH:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return df


@functools.cache
def single_threaded() -> None:
    """Hold this process's matrix products to one thread: a task has one core, and threads beyond it only wait in loops."""
    try:
        from threadpoolctl import threadpool_limits

        threadpool_limits(1, "blas")
        return
    except ImportError:
        pass
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (a null key is in no fold)."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n


# --- Arrow batches ---------------------------------------------------------------------------


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += U64(32)
_LOWER += U64(1)
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, WORD_BLOCK + 1)
        inverse = pow(_MUL, -1, 1 << 64)
        up, down = np.full(size, _MUL, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of each row's words (runs of bytes of a kind; [^\\x20\\x09-\\x0D]+ unless given), and the row's first word's index (n + 1 of them)."""
    word = kind[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: a polynomial over its bytes from prefix sums, then mixed with its length."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + WORD_BLOCK, side="right")))
        seg = _LOWER[data[base : ends[to - 1]]]
        up, down = _powers(len(seg) + 1)
        sums = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum(seg * up[: len(seg)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * U64(0xD6E8FEB86659FD93)
        at = to
    return mixed(out)


def hashed_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (first row, end row, hashes of their words, each row's first word within them)."""
    data, offsets = buffers(column)
    for a, b in blocks(offsets):
        own = data[offsets[a] : offsets[b]]
        starts, ends, firsts = word_bounds(own, offsets[a : b + 1] - offsets[a])
        yield a, b, word_hashes(own, starts, ends), firsts


def rng_constants(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * U64(_MUL) + U64(seed))
