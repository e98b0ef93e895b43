"""Shared pieces of the training-data operators: shared-folder tables, vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one (tests) gets a temporary one; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="archivolt-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/archivolt-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "__rid") -> DataFrame:
    """A written table of df with a number of its own for each row: what is joined on it can't mix up or lose rows, whatever ids they hold."""
    return table(df.withColumn(name, F.monotonically_increasing_id()))


def drop_table(df: DataFrame) -> None:
    """Delete a table of table() that nothing needs any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs now, not at its next periodic collection."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


#: Spark's setting for the bytes of an Arrow batch, and what the operators on texts set it to: a batch is held several times, by Spark and by Python.
BATCH_BYTES, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(spark: SparkSession) -> None:
    """Batches of long texts hold fewer rows, unless the session was started with a bound of its own."""
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, BYTES)


def give_back() -> None:
    """What this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(work: Callable) -> Callable:
    """work for mapInArrow; at its end a task gives back what it has freed, as the process is kept for other tasks."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def crc_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def bounded_sample(rows: DataFrame, by: str, per: int, hashed: str = "h", buckets: int = 64, few: bool = True) -> DataFrame:
    """Of each value of `by` the rows of the `per` smallest hashes, repeated rows once: at most per rows a value.

    Hashes are ranked in buckets first and then together, so that a value with most of the rows is not one task's; only
    the rows up to the last chosen hash move, whatever else they hold. few: the caller knows that `by` has so few values
    that one hash of each can be sent to all tasks; else they are joined.
    """
    rank = lambda *keys: F.dense_rank().over(Window.partitionBy(*keys).orderBy(hashed))
    first = rows.select(by, hashed, F.pmod(F.col(hashed), F.lit(buckets)).alias("__b")).withColumn("__r", rank(by, "__b")).filter(F.col("__r") <= per).select(by, hashed).distinct()
    top = first.withColumn("__r", rank(by)).filter(F.col("__r") <= per).groupBy(by).agg(F.max(hashed).alias("__top"))
    return rows.join(F.broadcast(top) if few else top, by).filter(F.col(hashed) <= F.col("__top")).drop("__top").dropDuplicates([by, hashed])


# --- texts of an Arrow batch as one byte array -------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C55


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inv = pow(_P, -1, 1 << 64)
    with np.errstate(over="ignore"):
        out = []
        for base in (_P, inv):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: (first row, end row, bytes, offsets of its rows). Nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word: a run without the six ASCII spaces inside one row."""
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial modulo 2^64.

    Spans of more than `limit` bytes are taken in turns: a hash does not depend on where its span is.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(buf) > limit and len(starts) > 1:
        out, order, i = np.empty(len(starts), np.uint64), np.argsort(starts, kind="stable"), 0
        a, b = starts[order], np.maximum.accumulate(ends[order])
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(b, a[i] + limit, "right")))
            part, base = order[i:j], int(a[i])
            out[part] = span_hashes(buf[base : int(b[j - 1])], starts[part] - base, ends[part] - base, limit)
            i = j
        return out
    bits = max(20, int(len(buf)).bit_length())
    up, down = _powers(bits)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ngram_hashes(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a row, and the index of each one's first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out += hashes[j : m + j]
    keep = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(out[keep]), keep


def shingles(column: pa.Array, n: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, row of each) of the word n-grams; a row of fewer words has one, of all of them."""
    for i, j, buf, offsets in slices(column):
        starts, ends, rows = words(buf, offsets)
        hashes = span_hashes(buf, starts, ends)
        grams, first = ngram_hashes(hashes, rows, n)
        of = rows[first]
        count = np.bincount(rows, minlength=j - i)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            at = np.searchsorted(rows, short)
            extra = np.empty(len(short), np.uint64)
            for k, (a, c) in enumerate(zip(at, count[short])):
                h = np.zeros(1, np.uint64)
                for x in hashes[a : a + c]:
                    h = mix(h * np.uint64(31) + x)
                extra[k] = h[0]
            grams, of = np.concatenate([grams, extra]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            grams, of = grams[order], of[order]
        yield i, j, grams, of


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def document_key():
    """128 bits for rows (doc_id, text): rows that agree in both share it, nulls included."""
    told = [F.col(c).isNull().cast("string") for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat_ws(":", *told, F.col("doc_id").cast("string"), "text").cast("binary")))
