"""What the operators share: the shared folder, hold-out rule and byte-level word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the word and shingle hashes.
WORD_BASE = 0x9E3779B97F4A7C15 | 1
MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a
    local master (tests) may go without it and then gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="skyecho-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/skyecho/{what}-{uuid.uuid4().hex}"


#: Removes the shuffles of a query as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: the lineage ends there, and a
    lost executor costs no more than reading it again. The shuffles that made it go."""
    spark = df.sparkSession
    path = scratch(spark, what)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned and nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clashing(df: DataFrame, *names: str, prefix: str | None = None) -> None:
    """The one rule for names: an input may not have columns that the operator adds, in any case of letters."""
    own = {n.lower() for n in names}
    bad = [c for c in df.columns if c.lower() in own or (prefix and c.lower().startswith(prefix))]
    if bad:
        raise ValueError(f"the input has columns that the operator adds: {', '.join(bad)}; rename them first")


#: Bytes of an Arrow batch of texts: a worker and the executor hold several copies of one.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at BATCH_BYTES, unless they already end before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def blocks(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to about ``most``; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_blocks(column: pa.Array, most: int) -> Iterator[tuple[slice, list[bytes]]]:
    """A text column as UTF-8 (null: empty) in parts of about ``most`` bytes, one at a time."""
    for part in blocks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
        yield part, [t or b"" for t in column.slice(part.start, part.stop - part.start).cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit avalanche hash, on unsigned 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_powers: np.ndarray | None = None


def powers(n: int) -> np.ndarray:
    """WORD_BASE to the power 0 .. n - 1, modulo 2^64."""
    global _powers
    if _powers is None or len(_powers) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, U64)
        out[0] = 1
        have = 1
        while have < size:
            step = min(have, size - have)
            out[have : have + step] = out[:step] * U64(pow(WORD_BASE, have, 1 << 64))
            have += step
        _powers = out
    return _powers[:n]


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for many non-empty, ordered, disjoint segments.

    A polynomial in the values, by one cumulative sum over the whole array.
    """
    if not len(starts):
        return np.empty(0, U64)
    n = len(data)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * powers(n)[::-1], out=total[1:])
    # sum of value * base^(n - 1 - j), brought to the same exponent by base^(n - end) 's inverse
    inverse = pow(WORD_BASE, -1, 1 << 64)
    value = (total[ends] - total[starts]) * _inverse_powers(n + 1, inverse)[n - ends]
    return mix64(value ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


_inverses: np.ndarray | None = None


def _inverse_powers(n: int, inverse: int) -> np.ndarray:
    global _inverses
    if _inverses is None or len(_inverses) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, U64)
        out[0] = 1
        have = 1
        while have < size:
            step = min(have, size - have)
            out[have : have + step] = out[:step] * U64(pow(inverse, have, 1 << 64))
            have += step
        _inverses = out
    return _inverses[:n]


#: Bytes that part words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, and each text's first
    place in them (one more at the end). Words are runs of bytes other than
    ASCII white space; A-Z count as a-z."""
    joined = b" ".join(texts).lower() + b" "
    data = np.frombuffer(joined, np.uint8)
    space = IS_SPACE[data]
    word = ~space
    begins = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], word[:-1])))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return segment_hashes(data, begins, ends), np.searchsorted(begins, offsets)


_owner = ""
_dropped: list = []


def drops(clear: object) -> None:
    """Registers what empties an operator's memory in a Python worker."""
    _dropped.append(clear)


def trim() -> None:
    """Gives freed memory back to the system; else it stays with the worker, also while that is idle."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def enter(owner: str) -> None:
    """Called by a task: what a worker remembers for other operators goes, so that it holds one operator's at a time."""
    global _owner
    if owner != _owner:
        for clear in _dropped:
            clear()
        if _owner:
            import gc

            gc.collect()
            trim()
        _owner = owner
