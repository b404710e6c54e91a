"""Shared plumbing: table reads, shared-folder tables, Arrow text buffers and vectorised hashing.

Conventions of every operator here, unless its docstring says otherwise:

* a null text counts as the empty text;
* a row whose id (doc_id, page_id, vec_id) is null takes no part and gives no row;
* columns other than those an operator names are ignored, whatever they are called;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deleted from texts before exact comparison, and what separates words: blank, tab, LF, VT, FF, CR.
BLANKS = b" \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone, without rows that have no id."""
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more
    )


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{name}{i or ''}" for i in range(len(taken) + 1)) if n.lower() not in taken)


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, one of our own, but on a local master alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, *folders: str) -> DataFrame:
        """df, written and to be read anew. folders: columns by whose values the files lie in folders."""
        self.n += 1
        path = f"{self.at}/t{self.n}"
        (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.skein_path = path
        return kept

    def drop(self, *dfs: DataFrame) -> None:
        """Removes tables that nothing lazy reads any more."""
        for df in dfs:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.skein_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds what one Arrow batch of whole texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def release() -> None:
    """Gives the driver's memory of a finished fit back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of what nothing refers to any more: it acts when the driver collects."""
    gc.collect()
    spark._jvm.System.gc()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end, and where each value starts in them (one more for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, starts - starts[0]


def values(column: pa.Array) -> Iterator[bytes]:
    data, at = utf8(column)
    whole = data.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield whole[a:b]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Odd multipliers of the polynomial hash: its base, and the base's inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out[:n]


#: Tokens of more bytes are hashed one by one.
LONG_TOKEN = 256


def hash_tokens(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end] that depends on those bytes alone.

    Eight bytes at a time go into a state that is mixed through after each of them, so the hash is no polynomial of the
    bytes: sums that cancel out for two tokens of one hash have no place in it.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    out = mix(size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    rows, at = np.flatnonzero((size > 0) & (size <= LONG_TOKEN)), 0
    while len(rows):
        left = np.minimum(size[rows] - at, 8).astype(np.uint64)
        block = eight[starts[rows] + at] << (np.uint64(64) - (left << np.uint64(3)))  # bytes behind the token shifted out
        out[rows] = mix(out[rows] ^ block)
        at += 8
        rows = rows[size[rows] > at]
    for i in np.flatnonzero(size > LONG_TOKEN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of every text in an Arrow buffer: bytes (A-Z lower-cased), starts, ends, and how many words each text has."""
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~blank
    first = inside[:-1].copy()
    if len(first):
        first[1:] &= blank[:-1]
        cuts = at[:-1][(at[:-1] < at[1:])]
        first[cuts] = inside[cuts]  # a text's first byte never continues the one before
    starts = np.flatnonzero(first)
    last = inside[:-1].copy()
    if len(last):
        last[:-1] &= blank[1:]
        cuts = at[1:][(at[:-1] < at[1:])] - 1
        last[cuts] = inside[cuts]
    ends = np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, at))
    return data, starts, ends, counts


#: Places of the filters below: the most rows that one broadcasts.
FILTER_PLACES = 1 << 20


def place(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_PLACES))


def sieve(df: DataFrame, ids: DataFrame, *keys: str, keep: bool = True) -> DataFrame:
    """Rows of df whose keys hash to a place that some row of ids hashes to (keep), or don't (not keep).

    A filter of at most FILTER_PLACES rows, whatever the size of ids: every row that has a match is kept, few others are
    as long as ids is small, and the join that follows then moves no more than those.
    """
    at = unused(df, "_place")
    marks = ids.select(place(*keys).alias(at)).distinct()
    return df.withColumn(at, place(*keys)).join(F.broadcast(marks), at, "left_semi" if keep else "left_anti").drop(at)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs, columns as they are, less those with an id in dropped (doc_id). Only rows near a dropped one are shuffled."""
    docs = docs.where(F.col("doc_id").isNotNull())
    far = sieve(docs, dropped, "doc_id", keep=False)
    near = sieve(docs, dropped, "doc_id").join(dropped.select("doc_id"), "doc_id", "left_anti")
    return far.select(docs.columns).unionByName(near.select(docs.columns))
