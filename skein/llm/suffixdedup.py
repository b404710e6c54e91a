"""Exact substring dedup over a sparse suffix array.

Every byte covered by a WINDOW-byte string that also starts anywhere else, in any text or the same one, is removed.
Strings are judged on the input. Texts are UTF-8 bytes, a null text is empty, matches never cross texts.

Sorting each of the corpus's suffixes by WINDOW bytes is out of reach, and not needed: each window is known by its anchor,
the position in it whose first LEAD bytes hash lowest (the leftmost of equals). Equal windows have their anchors at the
same offset, so only suffixes at anchors, one in about (WINDOW - LEAD) / 2 bytes, have to be sorted:

1. Anchors: a sliding minimum over each text gives its anchors, and for each the run of windows it stands for.
2. Suffix sort: suffixes at anchors are range-partitioned by their whole lead with sampled splitters, a salt behind it
   lets a lead that a third of all rows share spread over many buckets. Equal leads lie side by side in this order, so a
   class in several buckets is an end of each. A bucket sorts its suffixes by multikey
   quicksort (three-way partitions on eight bytes at a time) and finds the classes of equal leads; the classes at the ends
   of buckets are compared across the boundaries. A suffix with a lead of its own has no repeated window and goes.
3. Runs: the hull of a run is all the bytes its windows cover. Runs of equal hulls are copies: all their windows repeat.
   Counts come from partial aggregates, so copies in any number meet in no task.
4. Edges: where a class holds different hulls, one run a hull goes on. Its windows are judged in chunks by their distance
   to the anchor, first large ones, then small: a chunk whose common core is unique holds no repeated window; all windows
   of a chunk whose hull repeats are repeated; the windows of other chunks are counted one by one.
5. Each text's intervals are merged and cut out.

Equality of hulls and windows is equality of 128-bit hashes; cores have 64 bits, where a false match only costs a look.
Rows that repeat an id are texts of their own (a row is known by its id and a hash of its text); a row with a null doc_id
takes no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

WINDOW, LEAD = 400, 64
#: Suffixes in a bucket, on the average at most.
SUFFIXES = 200_000
#: Windows of neighbouring distances to their anchor that are judged together.
LARGE, CHUNK = 176, 16
#: Texts are read in blocks of so many window starts; a position in a block takes 24 bits of a sort key.
BLOCK, PLACE = 1 << 23, np.uint64((1 << 24) - 1)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


SUFFIX = "doc_id long, uid long, anchor long, first long, last long, hull1 long, hull2 long, lead binary"
CLASSED = "doc_id long, uid long, anchor long, first long, last long, hull1 long, hull2 long, class long, alone boolean, mixed boolean, edge boolean"

_powers: list[np.ndarray] = []


def _halves(data: bytes, *, seed: int = 0) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data, seed)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def lead_hashes(data: np.ndarray, lead: int) -> np.ndarray:
    """A hash of data[i : i + lead] for every i."""
    n = len(data)
    if n < lead:
        return np.zeros(0, np.uint64)
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [common.powers(common.BASE, n), common.powers(common.UNBASE, n)]
    letters = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[data] * _powers[0][:n], out=total[1:])
    return common.mix((total[lead:] - total[: n - lead + 1]) * _powers[1][: n - lead + 1])


def runs(data: np.ndarray, window: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each run of windows that share an anchor, for one text."""
    width, out = window - lead + 1, []
    for base in range(0, max(len(data) - window + 1, 0), BLOCK):
        part = data[base : base + BLOCK + window - 1]
        key = lead_hashes(part, lead)
        key = key & ~PLACE | np.arange(len(key), dtype=np.uint64)
        least = sliding_minimum(key, width)
        begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        end = np.concatenate([begin[1:], [len(least)]]) - 1
        out.append(np.stack([(least[begin] & PLACE).astype(np.int64), begin, end]) + base)
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 3


def _suffixes(window: int, lead: int):
    def suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, uid, text in zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), common.values(batch.column("text")), strict=True):
                anchors, first, last = runs(np.frombuffer(text, np.uint8), window, lead)
                for a, s, e in zip(anchors.tolist(), first.tolist(), last.tolist(), strict=True):
                    rows.append((doc_id, uid, a, s, e, *_halves(text[s : e + window], seed=a - s), text[a : a + lead]))
                if len(rows) > 50_000:
                    yield _batch(rows, SUFFIX)
                    rows = []
            yield _batch(rows, SUFFIX)

    return suffixes


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def multikey_quicksort(tokens: np.ndarray, small: int = 1024) -> np.ndarray:
    """The order of rows of tokens. A segment is parted in three by a pivot's token at its depth; the rows equal there go
    on at the next depth. Small segments are finished by one sort of the tokens that are left."""
    n, depth = tokens.shape
    order, todo = np.arange(n), [(0, n, 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2 or d == depth:
            continue
        rows = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = rows[np.lexsort(tokens[rows, d:].T[::-1])]
            continue
        t = tokens[rows, d]
        pivot = np.sort(t[:: max(1, len(t) // 9)])[4]
        less, same = t < pivot, t == pivot
        a, b = lo + int(less.sum()), hi - int((t > pivot).sum())
        order[lo:a], order[a:b], order[b:hi] = rows[less], rows[same], rows[t > pivot]
        todo += [(lo, a, d), (a, b, d + 1), (b, hi, d)]
    return order


def _bucket(lead: int):
    """Sorts one bucket; keeps the suffixes whose lead is not alone, and those at the bucket's ends."""

    def bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        raw = b"".join(table.column("lead").to_pylist())
        tokens = np.frombuffer(raw, ">u8").reshape(-1, lead // 8).astype(np.uint64)
        order = multikey_quicksort(tokens)
        tokens = tokens[order]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]).any(axis=1)])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        hull = table.column("hull1").to_numpy()[order]
        starts = np.flatnonzero(new)
        mixed = np.minimum.reduceat(hull, starts) != np.maximum.reduceat(hull, starts)
        edge = np.zeros(len(size), bool)
        edge[[0, -1]] = True
        keep = np.flatnonzero((size[group] > 1) | edge[group])
        group = group[keep]
        names = [xxhash.xxh3_64_intdigest(tokens[i].tobytes()) for i in starts]
        classes = np.array(names, np.uint64).view(np.int64)[group]
        out = table.take(pa.array(order[keep])).drop_columns(["lead"])
        for name, values in (("class", classes), ("alone", size[group] == 1), ("mixed", mixed[group] | edge[group]), ("edge", edge[group])):
            out = out.append_column(name, pa.array(values))
        yield from out.to_batches()

    return bucket


def _contexts(window: int):
    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, uid, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), common.values(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                for r in wanted:
                    rows.append((doc_id, uid, r["anchor"], r["first"], r["last"], r["n"] == 1, text[r["first"] : r["last"] + window]))
            yield _batch(rows, CONTEXT)

    return contexts


CONTEXT = "doc_id long, uid long, anchor long, first long, last long, needed boolean, body binary"
CORE = "doc_id long, uid long, first long, needed boolean, large int, core long"
PART = "doc_id long, uid long, first long, a long, b long, needed boolean, core long, hull1 long, hull2 long"
SINGLE = "doc_id long, uid long, start long, needed boolean, hash1 long, hash2 long"


def _core(body: bytes, anchor: int, first: int, near: int, far: int, window: int) -> int:
    """What all windows share that start near to far bytes before the anchor."""
    return _halves(body[anchor - near - first : anchor - far - first + window], seed=near << 10 | far)[0]


def _large(window: int, lead: int):
    def large(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, uid, anchor, first, last, needed, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range((anchor - last) // LARGE, (anchor - first) // LARGE + 1):
                    core = _core(body, anchor, first, i * LARGE, min(i * LARGE + LARGE - 1, window - lead), window)
                    rows.append((doc_id, uid, first, needed, i, core))
            yield _batch(rows, CORE)

    return large


def _chunks(window: int):
    """Parts of runs, cut where the distance to the anchor passes a multiple of CHUNK, of the large chunks still open."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "uid", "anchor", "first", "last", "needed", "body", "open")
        for batch in batches:
            rows = []
            for doc_id, uid, anchor, first, last, needed, body, large in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                for chunk in range((anchor - last) // CHUNK, (anchor - first) // CHUNK + 1):
                    near, far = chunk * CHUNK, chunk * CHUNK + CHUNK - 1
                    if near // LARGE not in large:
                        continue
                    a, b = max(first, anchor - far), min(last, anchor - near)
                    hull = _halves(body[a - first : b - first + window], seed=(anchor - a) << 10 | (anchor - b))
                    rows.append((doc_id, uid, first, a, b, needed, _core(body, anchor, first, near, far, window), *hull))
            yield _batch(rows, PART)

    return chunks


def _singles(window: int):
    def singles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "uid", "anchor", "first", "body", "parts")
        for batch in batches:
            rows = []
            for doc_id, uid, anchor, first, body, parts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                for p in parts:
                    for s in range(p["a"], p["b"] + 1):
                        rows.append((doc_id, uid, s, p["needed"], *_halves(body[s - first : s - first + window], seed=anchor - s)))
            yield _batch(rows, SINGLE)

    return singles


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), common.values(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            spans = merged([(x["a"], x["b"]) for x in spans or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((doc_id, len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        yield _batch(rows, RESULT)


def repeated_spans(spark: SparkSession, docs: DataFrame, scratch: common.Scratch, window: int = WINDOW, lead: int = LEAD) -> DataFrame:
    """(doc_id, uid, a, b): bytes a to b of that text are covered by repeated windows. docs: doc_id, uid, text."""
    suffixes = scratch.keep(docs.mapInArrow(_suffixes(window, lead), SUFFIX))
    salt = F.xxhash64("doc_id", "uid", "anchor")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // SUFFIXES))
    classed = scratch.keep(suffixes.repartitionByRange(buckets, "lead", salt).mapInArrow(_bucket(lead), CLASSED))
    scratch.drop(suffixes)

    # Across boundaries: a lead that ends one bucket and begins others. Two rows a bucket at most come here.
    ends = classed.where("edge").groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    runs_of = classed.where("not alone").unionByName(classed.where("alone").join(ends, "class", "left_semi"))

    name = ["hull1", "hull2"]
    hulls = runs_of.where("mixed").groupBy(*name).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "uid", "anchor", "first", "last")).alias("r"))
    hulls = scratch.keep(hulls.select(*name, "n", "r.*"))
    copies = runs_of.where("mixed").join(hulls.where("n > 1").select(*name), name, "left_semi").unionByName(runs_of.where("not mixed"))
    spans = [copies.select("doc_id", "uid", F.col("first").alias("a"), (F.col("last") + window).alias("b"))]

    wanted = hulls.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("anchor", "first", "last", "n")).alias("runs"))
    contexts = scratch.keep(common.sieve(docs, hulls, "doc_id", "uid").join(wanted, ["doc_id", "uid"]).mapInArrow(_contexts(window), CONTEXT))

    def still_open(cores: DataFrame, *by: str) -> DataFrame:
        """Rows whose core others have too, some of them in need of an answer."""
        common_ = cores.groupBy(*by).agg(F.count("*").alias("_n"), F.max("needed").alias("_some")).where("_n > 1 and _some").select(*by)
        return cores.join(common_, list(by), "left_semi")

    key = ["doc_id", "uid", "first"]
    large = still_open(contexts.mapInArrow(_large(window, lead), CORE), "core").groupBy(*key).agg(F.collect_list("large").alias("open"))
    cut = scratch.keep(still_open(contexts.join(large, key).mapInArrow(_chunks(window), PART), "core"))
    parts = cut
    again = parts.groupBy(*name).agg(F.count("*").alias("n"), F.min(F.struct(*key, "a", "b", "needed")).alias("p"))
    parts = scratch.keep(parts.join(again.select(*name, (F.col("n") > 1).alias("again"), F.col("p").alias("of")), name))
    scratch.drop(cut)
    spans.append(parts.where("needed and again").select("doc_id", "uid", "a", (F.col("b") + window).alias("b")))
    # A part whose hull repeats is settled, and stands, once, as a partner for the windows of others.
    left = parts.where("needed and not again").select("core").distinct()
    once = ~F.col("again") | (F.struct(*key, "a", "b", "needed") == F.col("of"))
    partners = parts.where(once).join(left, "core", "left_semi")
    partners = partners.groupBy(*key).agg(F.collect_list(F.struct("a", "b", (F.col("needed") & ~F.col("again")).alias("needed"))).alias("parts"))
    singles = scratch.keep(contexts.join(partners, key).mapInArrow(_singles(window), SINGLE))
    hashes = ["hash1", "hash2"]
    twice = singles.groupBy(*hashes).agg(F.count("*").alias("n"), F.max("needed").alias("some")).where("n > 1 and some").select(*hashes)
    found = singles.where("needed").join(twice, hashes, "left_semi")
    spans.append(found.select("doc_id", "uid", F.col("start").alias("a"), (F.col("start") + window).alias("b")))
    out = scratch.keep(spans[0].unionByName(spans[1]).unionByName(spans[2]))
    scratch.drop(contexts, classed, hulls, parts, singles)
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, lead: int = LEAD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    common.small_batches(spark)
    scratch = common.Scratch(spark, "suffixdedup")
    rows = common.documents(docs).withColumn("uid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(spark, rows, scratch, window, lead)
    common.release_shuffles(spark)
    by_text = scratch.keep(spans.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    key, columns = ["doc_id", "uid"], ["doc_id", "text", "spans"]
    cut = common.sieve(rows, by_text, *key).join(by_text, key, "left").select(*columns)
    whole = common.sieve(rows, by_text, *key, keep=False).withColumn("spans", F.lit(None).cast("array<struct<a:bigint,b:bigint>>"))
    return cut.unionByName(whole.select(*columns)).mapInArrow(_cut, RESULT)
