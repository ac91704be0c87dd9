"""Registry and small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.session import checkpoint_dir

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}

#: ASCII white space: what separates words in most of the contracts.
SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (lower() would touch every script)."""
    return F.translate(c, _UPPER, _LOWER)


def words(c: Column, pattern: str = SPACE) -> Column:
    """The words between runs of `pattern`; null text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), pattern), lambda w: w != "")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, one for each call, so
    that no run ever reads what another has left."""
    return f"{checkpoint_dir(spark).rstrip('/')}/fitlake-llm/{name}-{uuid.uuid4().hex}"


#: Spark deletes a statement's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, clear: bool = False) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: computed
    once, lineage cut, and safe when an executor is lost.  With `clear` the
    files of its shuffles go as soon as it is written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    was = spark.conf.get(CLEANUP, None)
    if clear:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clear:
            spark.conf.set(CLEANUP, was or "false")
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """`name`, with as many underscores as make it none of `columns`."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Lets go of what finished jobs have left: Spark deletes a shuffle's files
    once the driver has collected the frames that refer to it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch: with texts of 100 kB a batch still is 50 MB.
BATCH_ROWS = 512


def for_python(df: DataFrame) -> DataFrame:
    """`df`, about to be read by Python workers: keeps their batches small, so
    that long texts do not fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def trimmed(run: Callable) -> Callable:
    """`run` for mapInArrow, after which the worker, which may idle beside the
    workers of the next stages, gives back the memory that it no longer uses."""
    def out(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: it keeps its own counsel
            pass
    return out


# --- word hashes of whole Arrow batches ---------------------------------
# A word's hash is a polynomial over its bytes (random 64-bit value for each
# byte, odd base, modulo 2**64) and a final mixing step; prefix sums give all
# words of a block of texts in a few vector operations.

_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators for words of letters and digits: all of ASCII but 0-9, A-Z, a-z.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: Bytes of text that are hashed at a time (one text at least).
BLOCK_BYTES = 1 << 20
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, BLOCK_BYTES)
        for key, base in (("p", _P), ("q", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[key] = np.cumprod(a)
    return _POW["p"][:n], _POW["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shifts and multiplications)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_blocks(col: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about
    BLOCK_BYTES; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return
    _, ob, db = col.buffers()
    off = np.frombuffer(ob, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(db, np.uint8) if db is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK_BYTES, "right")) - 1)
        j = min(j, len(col))
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text of each word), A-Z folded to a-z, for words
    between the bytes marked in `between` (ASCII white space)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _FOLD[data]
    full = ~between[data]
    cut = np.ones(n + 1, bool)  # before byte i there is no byte of the same word
    cut[1:n] = ~full[:-1]
    cut[off[(off > 0) & (off < n)]] = True
    starts = np.flatnonzero(full & cut[:-1])
    last = np.ones(n, bool)  # after byte i there is none
    last[:-1] = ~full[1:] | cut[1:n]
    ends = np.flatnonzero(full & last) + 1
    p, q = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * p, out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * _ODD[0])
    return h, np.searchsorted(off, starts, "right") - 1


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text (or of the whole text, as
    one, if it has fewer); none for a text without words."""
    if len(h) == 0:
        return h
    m = min(k, len(h))
    n = len(h) - m + 1
    s = np.full(n, m, np.uint64)
    for j in range(m):
        s += h[j:j + n] * _ODD[1 + j]
    return mix(s)


def sequence_hash(h: np.ndarray) -> int:
    """One 64-bit hash (signed) of a sequence of word hashes."""
    p, _ = _powers(len(h))
    v = mix((h * p).sum(dtype=np.uint64, keepdims=True) + _ODD[2:3] * np.array([len(h)], np.uint64))
    return int(v.view(np.int64)[0])
