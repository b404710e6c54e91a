"""SimHash near-dedup by a self-join of the binary trie of fingerprints.

A fingerprint has a bit for each of 64 places: 1 if it is set in over half of the hashes of the text's shingles (three
words, A-Z lower-cased, repeats included). Documents link where fingerprints differ in at most three bits.

1. Texts become fingerprints in one pass; rows of one fingerprint are one node from there on.
2. The upper trie: prefixes of the fingerprints, parted bit by bit until none holds more than a share of them. The driver
   holds these prefixes alone: some 64 of them, and for very large tables two for each PREFIX_MOST fingerprints.
3. Each prefix meets those that it is within reach of, found by the same join of tries. Of two prefixes one is the host
   (a hash says which); the other's fingerprints visit it. A host's own fingerprints are in all its parts, each with some
   of its visitors, so that no group is larger than GUESTS + 1 prefixes.
4. In each group the host's trie is joined with itself (in part 0) and with its visitors' trie: pairs of nodes are walked
   down together, the bits that they differ in are added up, and a pair beyond the budget is dropped. What the group gives
   is a star a class, not its pairs.
5. Stars of all groups are put together as connected components. The least doc_id of a component is its name.

Nulls, empty texts and texts of blanks have the fingerprint zero, and link like any other. Rows without an id take no
part; rows that repeat an id are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common, graph, trie

SHINGLE, SEED, DIFFERENCE = 3, 42, 3
#: Prefixes at least; fingerprints of one at most; visiting prefixes of a part.
PREFIXES, PREFIX_MOST, GUESTS = 64, 1 << 20, 6
#: Bits of a prefix that one count looks at.
STRIDE = 8
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 16


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes; counts: how long the runs are, zero for an empty one."""
    ones = np.zeros((len(counts), trie.BITS), np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    for k in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[k : k + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        rows = of[k : k + BLOCK]
        firsts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        ones[rows[firsts]] += np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(texts: pa.Array) -> np.ndarray:
    data, starts, ends, counts = common.words(*common.utf8(texts))
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])  # words set one blank apart: a shingle is a slice from its first word to its last one's end
    spaced, inside = np.full(int(to[-1]), 32, np.uint8), np.arange(int(size.sum()))
    before = np.cumsum(size) - size
    spaced[inside + np.repeat(to[:-1] - before, size)] = data[inside + np.repeat(starts - before, size)]
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    begin = np.arange(int(n.sum())) + np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n)
    last = begin + np.repeat(np.minimum(counts, SHINGLE), n)
    whole = memoryview(spaced.tobytes())
    hashed = [xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(to[begin].tolist(), (to[last] - 1).tolist(), strict=True)]
    return majority(np.array(hashed, np.uint64), n)


def _fingerprinted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text")).view(np.int64))], names=["doc_id", "print"])


def upper(nodes: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefixes as 64-bit words, depths), in order: every fingerprint begins with one of them, none holds over its share.

    Prefixes are counted STRIDE bits deeper at a time, and only those that are too full: the driver gets at most 2**STRIDE
    counts for each of these.
    """
    most = min(max(-(-total // PREFIXES), 32), PREFIX_MOST)
    done: list[tuple[int, int]] = []
    full, depth = [0], 0
    while full:
        deeper = depth + STRIDE
        head = F.shiftrightunsigned("print", trie.BITS - deeper).alias("head")
        counted = nodes.select(head)
        if depth:
            counted = counted.join(F.broadcast(nodes.sparkSession.createDataFrame(pd.DataFrame({"at": full}))), F.shiftrightunsigned("head", STRIDE) == F.col("at"), "left_semi")
        counts = {r["head"] % (1 << trie.BITS): r["n"] for r in counted.groupBy("head").agg(F.count("*").alias("n")).collect()}
        levels = [counts]
        for _ in range(STRIDE):
            above: dict[int, int] = {}
            for head, n in levels[-1].items():
                above[head >> 1] = above.get(head >> 1, 0) + n
            levels.append(above)
        levels.reverse()
        parting, full = sorted(levels[0]), []
        for bits, level in enumerate(levels[1:], depth + 1):  # a node that is too full, or the root, makes way for its children
            children = [c for p in parting for c in (2 * p, 2 * p + 1) if c in level]
            parting = [c for c in children if level[c] > most and bits < trie.BITS]
            done += [(c << (trie.BITS - bits), bits) for c in children if level[c] <= most or bits == trie.BITS]
        full, depth = parting, deeper
    done.sort()
    return np.array([w for w, _ in done], np.uint64), np.array([d for _, d in done], np.int64)


def _reach(words: np.ndarray, depths: np.ndarray, budget: int):
    """The visits to each prefix given by number: (prefix, host, part)."""

    def reach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = trie.Trie(words, depths)
        for batch in batches:
            hosts = np.sort(batch.column("host").to_numpy())
            i, k = trie.pairs(trie.Trie(words[hosts], depths[hosts]), whole, budget)
            host, guest = hosts[i], k
            low, high = np.minimum(host, guest), np.maximum(host, guest)
            even = common.mix((low * len(words) + high).astype(np.uint64)) & np.uint64(1) == 0
            visits = (host != guest) & (np.where(even, low, high) == host)
            host, guest = host[visits], guest[visits]
            order = np.lexsort((guest, host))
            host, guest = host[order], guest[order]
            part = (np.arange(len(host)) - np.searchsorted(host, host)) // GUESTS
            parts = np.maximum(1, -(-np.bincount(np.searchsorted(hosts, host), minlength=len(hosts)) // GUESTS))
            own = np.repeat(hosts, parts)
            own_part = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in ((guest, own), (host, own), (part, own_part))], names=["prefix", "host", "part"])

    return reach


def _prefixed(words: np.ndarray):
    def prefixed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(words, batch.column("print").to_numpy().view(np.uint64), side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("print"), pa.array(at.astype(np.int64))], names=["print", "prefix"])

    return prefixed


def _stars(budget: int):
    def stars(key: tuple, group: pa.Table) -> pa.Table:
        word, at_home = group.column("print").to_numpy().view(np.uint64), group.column("own").to_numpy(zero_copy_only=False)
        own, guests = np.sort(word[at_home]), np.sort(word[~at_home])
        labels = trie.classes(own, guests, key[1].as_py() == 0, budget)
        both = np.concatenate([own, guests]).view(np.int64)
        linked = labels != np.arange(len(labels))
        return pa.table({"a": both[linked], "b": both[labels[linked]]})

    return stars


def linked_classes(spark: SparkSession, nodes: DataFrame, scratch: common.Scratch, budget: int = DIFFERENCE) -> DataFrame:
    """(node, component) of every fingerprint (print, distinct) that links with another; component is one of its class."""
    total = nodes.count()
    if not total:
        return spark.createDataFrame([], "node long, component long")
    words, depths = upper(nodes, total)
    prefixed = nodes.select("print").mapInArrow(_prefixed(words), "print long, prefix long")
    tasks = min(len(words), int(spark.conf.get("spark.sql.shuffle.partitions")))
    hosts = spark.range(0, len(words), 1, tasks).withColumnRenamed("id", "host")
    visits = hosts.mapInArrow(_reach(words, depths, budget), "prefix long, host long, part long")
    met = visits.join(prefixed, "prefix").select("host", "part", (F.col("prefix") == F.col("host")).alias("own"), "print")
    stars = met.groupBy("host", "part").applyInArrow(_stars(budget), "a long, b long")
    return graph.components(scratch.keep(stars.distinct()), scratch)


def near_duplicates(spark: SparkSession, docs: DataFrame, budget: int = DIFFERENCE) -> DataFrame:
    """A row per document: doc_id, print (64 bits as a long), component_id (the smallest doc_id that links lead to)."""
    common.small_batches(spark)
    scratch = common.Scratch(spark, "simhash")
    prints = scratch.keep(common.documents(docs).mapInArrow(_fingerprinted, "doc_id long, print long"))
    nodes = scratch.keep(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    members = linked_classes(spark, nodes, scratch, budget).withColumnRenamed("node", "print")
    found = nodes.join(members, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.keep(found.join(least, "component").select("print", "component_id"))
    return prints.join(named, "print").select("doc_id", "print", "component_id")
