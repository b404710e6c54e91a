"""Exact dedup through an extendible-hash index on shared files.

Texts are equal when identical once every blank, tab, LF, VT, FF and CR is deleted.

1. Each document's key is a 64-bit hash of its normalised bytes. Copies that a task meets close to one another are compared
   there, byte by byte, and stand behind one representative, so a text that a third of all rows share travels a few times
   a task.
2. The index: representatives are put into the buckets of an extendible hash, each bucket a folder of files in the shared
   folder. The directory addresses buckets by a key's leading bits. A bucket that holds more than its capacity is split on
   the next bit, its files are read and written anew, and the directory doubles where the bucket was as deep as it is;
   this goes on until no bucket is overfull but those of a single key, which no bit can split.
3. Owner tasks take buckets, ranges of keys, from their files. An owner reads its keys in order and chains the entries of
   one key; a key of one entry has no copies and is done with.
4. The texts of chained entries are compared, byte by byte, along their chain: texts of equal keys but different bytes
   stay apart. Long chains are dealt out in parts, whose heads then meet once more.
5. Of each group the row with the most code points in its original text stays, then the smallest doc_id.

Nulls count as empty texts and are copies of one another. A row with a null doc_id takes no part. Rows that repeat an
id are rows of their own. Other columns are ignored.

As a stage of the pipeline, one row of each group stays: of rows that share the id that stays, one whose text is the
group's longest, the first by its other columns.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import common

#: Entries a bucket holds before it splits (the driver holds two numbers a bucket, so very large tables ask for more);
#: entries of one key that are compared in one go.
CAPACITY, CHAIN = 1 << 15, 4096
#: Bytes of texts that a task remembers to compare the next ones with.
REMEMBERED = 16 << 20
KEY_BITS = 64

ENTRY = "doc_id long, key long, copy_of long, copy_sha string, n_points long, text_sha256 string"


class Directory:
    """Buckets by (depth, prefix): each holds the keys that begin with those bits. 2**depth slots share the buckets; a slot's
    bucket is the one whose prefix it begins with, so slots need no list of their own."""

    def __init__(self, capacity: int = CAPACITY, depth: int = 0):
        self.capacity, self.depth = capacity, depth
        self.buckets = [(depth, p) for p in range(1 << depth)]  # in order of their key ranges

    def starts(self) -> np.ndarray:
        """The least key, unsigned, of each bucket."""
        return np.array([p << (KEY_BITS - d) for d, p in self.buckets], np.uint64)

    def bucket(self, key: int) -> int:
        return bisect.bisect_right([p << (KEY_BITS - d) for d, p in self.buckets], key) - 1

    def split(self, overfull: list[tuple[int, int]]) -> None:
        """Each of these buckets makes way for the two of the next bit."""
        gone = set(overfull)
        if any(d == self.depth for d, _ in gone):
            self.depth += 1  # the directory doubles
        self.buckets = [b for d, p in self.buckets for b in ([(d + 1, 2 * p), (d + 1, 2 * p + 1)] if (d, p) in gone else [(d, p)])]


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first: dict[int, list[tuple[int, bytes, str]]] = {}
    held = 0
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        keys, shas, points, copy_of, copy_sha = [], [], [], [], []
        for doc_id, raw in zip(ids, common.values(batch.column("text")), strict=True):
            text = raw.translate(None, common.BLANKS)
            key, sha = xxhash.xxh3_64_intdigest(text), hashlib.sha256(text).hexdigest()
            for head_id, head_text, head_sha in first.setdefault(key, []):
                if head_text == text:
                    break
            else:
                head_id, head_sha = doc_id, sha
                first[key].append((doc_id, text, sha))
                held += len(text) + 200
            view = np.frombuffer(raw, np.uint8)
            points.append(len(raw) - int(np.count_nonzero((view & 0xC0) == 0x80)))
            keys.append(key - (1 << 64) if key >> 63 else key)
            shas.append(sha)
            copy_of.append(head_id)
            copy_sha.append(head_sha)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(copy_of, pa.int64()), pa.array(copy_sha, pa.string()), pa.array(points, pa.int64()), pa.array(shas, pa.string())],
            names=["doc_id", "key", "copy_of", "copy_sha", "n_points", "text_sha256"],
        )
        if held > REMEMBERED:
            first, held = {}, 0


INDEXED = "copy_of long, copy_sha string, key long"


def _routed(starts: np.ndarray, depths: np.ndarray):
    """Entries with the bucket that the directory sends them to, as its least key and its depth."""

    def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(starts, batch.column("key").to_numpy().view(np.uint64), side="right") - 1
            names = ["copy_of", "copy_sha", "key"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(starts[at].view(np.int64)), pa.array(depths[at])], names=[*names, "start", "depth"])

    return routed


def build_index(spark: SparkSession, reps: DataFrame, scratch: common.Scratch, capacity: int = CAPACITY) -> tuple[Directory, DataFrame]:
    """The directory, and the entries (copy_of, copy_sha, key, start, depth) that stand in the buckets' files.

    The first depth follows from the number of entries, as if keys were spread evenly; splits do the rest.
    """
    n = reps.count()
    directory = Directory(capacity, max(0, (n // capacity).bit_length()))
    todo, done = reps.select("copy_of", "copy_sha", "key"), []
    while True:
        starts = directory.starts()
        depths = np.array([d for d, _ in directory.buckets], np.int32)
        sent = todo.mapInArrow(_routed(starts, depths), f"{INDEXED}, start long, depth int")
        files = scratch.keep(sent.repartition("start").sortWithinPartitions("start", "key"), "start")
        held = files.groupBy("start", "depth").agg(F.count("*").alias("n"), (F.min("key") < F.max("key")).alias("several"))
        overfull = [(r["start"], r["depth"]) for r in held.where((F.col("n") > capacity) & F.col("several")).collect()]  # a row a bucket at most
        if not overfull:
            done.append(files)
            break
        split = spark.createDataFrame(overfull, "start long, depth int").select("start")
        done.append(files.join(F.broadcast(split), "start", "left_anti"))
        directory.split([(d, (s % (1 << KEY_BITS)) >> (KEY_BITS - d) if d else 0) for s, d in overfull])
        todo = files.join(F.broadcast(split), "start", "left_semi").select("copy_of", "copy_sha", "key")
    entries = done[0]
    for more in done[1:]:
        entries = entries.unionByName(more)
    return directory, entries


CHAINED = "copy_of long, copy_sha string, key long, start long, links long"


def _owned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's buckets, in order of their keys: the entries that share their key, with their number in the chain so far.

    Of a chain the first entry alone is held, until a second one shows that it is none's only.
    """
    at, first, links = None, None, 0
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("copy_of", "copy_sha", "key", "start")), strict=True):
            if (row[3], row[2]) != at:
                at, first, links = (row[3], row[2]), row, 1
                continue
            if links == 1:
                out.append((*first, 0))
            out.append((*row, links))
            links += 1
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["copy_of", "copy_sha", "key", "start", "links"])


BODY = "copy_of long, copy_sha string, key long, start long, part long, body binary"


def _normalised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [raw.translate(None, common.BLANKS) for raw in common.values(batch.column("text"))]
        names = ["copy_of", "copy_sha", "key", "start", "part"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.binary())], names=[*names, "body"])


HEADED = "copy_of long, copy_sha string, head_of long, head_sha string, key long, start long, body binary"


def _chains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their chains' parts; the heads of one part are all that is held. A head's row keeps its body."""
    at, heads = None, []
    for batch in batches:
        out = []
        for start, key, part, copy_of, sha, body in zip(*(batch.column(c).to_pylist() for c in ("start", "key", "part", "copy_of", "copy_sha", "body")), strict=True):
            if (start, key, part) != at:
                at, heads = (start, key, part), []
            for head, head_sha, text in heads:
                if text == body:
                    out.append((copy_of, sha, head, head_sha, key, start, None))
                    break
            else:
                heads.append((copy_of, sha, body))
                out.append((copy_of, sha, copy_of, sha, key, start, body))
        cols = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["copy_of", "copy_sha", "head_of", "head_sha", "key", "start", "body"])


def _compared(rows: DataFrame) -> DataFrame:
    order = ["start", "key", "part"]
    return rows.repartition(*order).sortWithinPartitions(*order, "copy_of", "copy_sha").mapInArrow(_chains, HEADED)


def copies(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, chain: int = CHAIN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    common.small_batches(spark)
    scratch, source = common.Scratch(spark, "exactdedup"), common.documents(docs)
    entries = scratch.keep(source.mapInArrow(_entries, ENTRY))
    rep = ["copy_of", "copy_sha"]
    reps = entries.groupBy(*rep, "key").agg(F.max(F.struct("n_points", (-F.col("doc_id")).alias("lowest"))).alias("best"), F.count("*").alias("n"))
    reps = scratch.keep(reps)
    _, index = build_index(spark, reps, scratch, capacity)
    owners = index.repartition("start").sortWithinPartitions("start", "key", *rep)
    chained = scratch.keep(owners.mapInArrow(_owned, CHAINED))

    part = F.floor(F.col("links") / chain).alias("part")
    wanted = chained.select(*rep, "key", "start", part)
    texts = common.sieve(source.withColumnRenamed("doc_id", "copy_of"), chained, "copy_of").join(wanted, "copy_of").mapInArrow(_normalised, BODY)
    texts = texts.where(F.sha2("body", 256) == F.col("copy_sha")).dropDuplicates(rep)  # an id may stand on several rows: the one meant
    near = scratch.keep(_compared(texts))
    # The heads of a chain's parts meet; where a chain is one part, its heads are done with.
    long_chains = chained.where(F.col("links") >= chain).select("start", "key").distinct()
    heads = near.where("body is not null").join(long_chains, ["start", "key"], "left_semi").withColumn("part", F.lit(0).cast("long"))
    far = _compared(heads.select(*rep, "key", "start", "part", "body")).select(F.col("copy_of").alias("head_of"), F.col("copy_sha").alias("head_sha"), F.struct("head_of", "head_sha").alias("top"))
    found = near.select(*rep, "head_of", "head_sha").join(far, ["head_of", "head_sha"], "left")
    found = found.select(*rep, F.coalesce("top", F.struct("head_of", "head_sha")).alias("head"))

    reps = reps.join(found, rep, "left").withColumn("head", F.coalesce("head", F.struct(F.col("copy_of").alias("head_of"), F.col("copy_sha").alias("head_sha"))))
    reps = scratch.keep(reps)
    groups = reps.groupBy("head").agg((-F.max("best")["lowest"]).alias("keep_id"), F.sum("n").alias("group_size"))
    told = reps.select(*rep, "head").join(groups, "head").select(*rep, "keep_id", "group_size")
    return entries.join(told, rep).select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group."""
    scratch = common.Scratch(spark, "exactdedup")
    told = scratch.keep(copies(spark, docs))
    # An id that stands on one row tells the row; of an id on several, the texts' hashes say which rows are meant.
    several = scratch.keep(told.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    dropped = told.where("not kept").select("doc_id").unionByName(several).distinct()
    body = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "").cast("binary"), 256)
    sha, nth, n_points = (common.unused(docs, x) for x in ("_sha", "_nth", "_points"))
    kept = told.where("kept").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias(f"{sha}_id"), F.col("text_sha256").alias(f"{sha}_of")).distinct()
    rows = common.sieve(docs.where(F.col("doc_id").isNotNull()), several, "doc_id").withColumn(sha, body).withColumn(n_points, F.char_length(F.coalesce("text", F.lit(""))))
    rows = rows.join(kept, (F.col("doc_id") == F.col(f"{sha}_id")) & (F.col(sha) == F.col(f"{sha}_of")))
    order = Window.partitionBy(sha, "doc_id").orderBy(F.desc(n_points), *(F.col(c).cast("string") for c, kind in docs.dtypes if kind != "void"))
    one = rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return common.without(docs, dropped).unionByName(one.select(docs.columns))
