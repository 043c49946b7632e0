"""What the operators of this folder share: scratch tables, words of texts as numpy arrays, samples."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once (a longer text is handled alone).
CHUNK_BYTES = 1 << 18
#: Bytes of rows that the JVM and a Python worker hold as one Arrow batch, at most (a larger row is a batch of its own).
BATCH_BYTES = 8 << 20
#: The separators of words: space, and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64
NULL_ID = (1 << 63) - 1
_SCRATCH: list[str] = []
#: Small tables of a task (a few MB); they go when it ends.
_KNOWN: dict = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder all executors share: spark.checkpoint.dir; a local one only where that is unset and all executors are
    in this machine's one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/corpuslens-scratch"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release_scratch(spark: SparkSession, paths: list[str] | None = None, unless_read_by: DataFrame | None = None) -> None:
    """Delete tables that this process has written (all so far, or those given): when no result that reads them is needed
    any more. Those that `unless_read_by` reads stay."""
    needed = {p for p in _SCRATCH if any(p.split("/")[-1] in f for f in unless_read_by.inputFiles())} if unless_read_by is not None else set()
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for p in [p for p in _SCRATCH if (paths is None or p in paths) and p not in needed]:
        _SCRATCH.remove(p)
        path = hadoop(p)
        path.getFileSystem(conf).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete the scratch tables behind these results of materialise(): nothing that is still to run reads them."""
    for df in tables:
        files = df.inputFiles()
        release_scratch(df.sparkSession, [p for p in _SCRATCH if any(p.split("/")[-1] in f for f in files)])


def scratch_tables() -> list[str]:
    return list(_SCRATCH)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage is cut, a lost executor loses nothing, and
    the shuffles that made it go from the executors' disks."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    drop_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files once the driver has collected the plan that made them; left to itself that is when
    its heap is full, by which time the shuffles of all steps lie on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Fewer rows in an Arrow batch while an action runs on wide rows; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most from now on in this session (lower settings stay): texts differ in length by
    orders of magnitude, so a number of rows bounds nothing."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = int(spark.conf.get(key).rstrip("b"))
    if not 0 < before <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system: a worker lives on after its task."""
    _KNOWN.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """The function of a task, after which its worker holds no more than before."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def documents(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only what an operator needs, under names of its own: did (null: the largest long), dk (33 bits that tell
    different texts under one id apart), text (null stays null), and the columns given."""
    bounded_batches(df.sparkSession)
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(F.col(text_col)).bitwiseAND((1 << 33) - 1).alias("dk"),
        F.col(text_col).cast("string").alias("text"),
        *more,
    )


def public_id(c: Column | str) -> Column:
    """The id as it was before documents()."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != F.lit(NULL_ID), c)


def is_held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, chosen by a hash of key; all rows if there are fewer."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(1709)), F.lit(1 << 30)) < int((1 << 30) * rows / total))


# --- texts as arrays -------------------------------------------------------------------------------------------------


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row begins (one more for the end); null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1, offset=8 * col.offset)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes together stay within the limit, one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def text_chunks(batches, col: str = "text", limit: int = CHUNK_BYTES):
    """(rows of the batch, their bytes, their offsets) for every chunk of every batch."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, off = buffers(batch.column(batch.schema.get_field_index(col)))
        for a, b in chunks(off, limit):
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of its first word (one more for the end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~SEPARATORS[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    cut[0] = cut[n] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | cut[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _KNOWN.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 2), base, dtype=U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= CHUNK_BYTES + 2:
            _KNOWN[base] = have
    return have[:n]


_P, _R = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span: a polynomial's prefix sums, shifted back to the origin."""
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_inverse(base), len(values) + 1)[starts])


def byte_values(fold: bool = False) -> np.ndarray:
    """A random 64-bit number for every byte; fold: A-Z as a-z."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
    if fold:
        values[65:91] = values[97:123]
    return values


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    if fold not in _KNOWN:
        _KNOWN[fold] = byte_values(fold)
    return spans_hash(_KNOWN[fold][data], starts, ends, _P)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words (of word hashes), rows not regarded."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    at = np.arange(n)
    return spans_hash(words, at, at + k, _R)
