"""Ranked lexical search: each shard of documents is searched by WAND, and the shards' heaps are merged.

A term is a maximal run of digits, letters and non-ASCII code points, A-Z lower-cased. The score of a document for an item is
a sum over the item's terms, in whole numbers: BM25's shape with k1 and b given below, lengths in per cent of the average.

1. The items' terms are marked in a filter of 2**20 places. One pass over the documents counts their terms and keeps, of each,
   those that the filter lets through: a row a document, written to the shared folder.
2. Counts and frequencies are taken over all documents; a term that the filter let through by chance drops out there.
3. Items are taken in blocks of so many (item, term) pairs, so what a task is sent of them is bounded. In a task, documents
   gather into shards; a shard has postings by term, cut into windows of documents, and the greatest impact of each
   list in each window.
4. WAND, a window at a time. Windows come in order of what their lists can add up to. The lists of a window stand in order
   of their greatest impact: the pivot is the first at which the sum of impacts reaches the heap's threshold. A document
   before it in all its lists can't be in the heap, so only lists from the pivot on give documents; the lists before it are
   looked up for those alone whose score so far and the impacts still open reach the threshold. A window whose lists
   together don't reach it ends the shard.
5. A task goes on from shard to shard with the same heaps, and gives its best; the best of all tasks are ranked.

Null texts have no terms; rows without an id take no part; documents that repeat an id are ranked each on its own; rows of
one item_id are one item. Other columns are ignored. An item without terms, or none of whose terms any document has, gives
no row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import common

#: On lower-cased UTF-8: every byte of a code point from 0x80 on is 0x80 or more.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BEST = 50
#: Weights are in thousandths; the share of a document's length is in per cent, k1 in tenths of a thousandth and so on.
WEIGHT, GAIN, SATURATION, K1, B = 1000, 1_000_000_000, 1000, 20, 50
#: (item, term) pairs of a block; documents of a window; documents and postings of a shard.
BLOCK, WINDOW, SHARD_DOCS, SHARD_POSTINGS = 1 << 17, 2048, 1 << 16, 1 << 22
PLACES = common.FILTER_PLACES


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, t.decode()) for i, raw in zip(batch.column("item_id").to_pylist(), common.values(batch.column("text")), strict=True) for t in set(TERM.findall(raw.lower()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item_id", "term"])


def _counted(marks: np.ndarray):
    mask = PLACES - 1

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, at, terms, tfs = [], [0], [], []
            for raw in common.values(batch.column("text")):
                found = Counter(TERM.findall(raw.lower()))
                sizes.append(found.total())
                for term, tf in found.items():
                    if marks[zlib.crc32(term) & mask]:
                        terms.append(term)
                        tfs.append(tf)
                at.append(len(terms))
            offsets = pa.array(at, pa.int32())
            words = pa.array(terms, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return counted


class Shard:
    """Postings of some documents, in order of their ids, in windows of `window`."""

    def __init__(self, doc_ids: np.ndarray, n_terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, window: int = WINDOW):
        order = np.argsort(doc_ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = place[doc]
        self.doc_ids, self.window, self.scored = doc_ids[order], window, 0
        self.windows = max(1, -(-len(order) // window))
        cell = term * self.windows + doc // window
        by = np.lexsort((doc, cell))
        self.doc, self.impact, cell = doc[by], impact[by], cell[by]
        self.at = np.searchsorted(cell, np.arange(n_terms * self.windows + 1))
        self.most = np.zeros(n_terms * self.windows, np.int64)
        firsts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        if len(firsts):
            self.most[cell[firsts]] = np.maximum.reduceat(self.impact, firsts)

    def search(self, terms: np.ndarray, heap: tuple[np.ndarray, np.ndarray], k: int = BEST) -> tuple[np.ndarray, np.ndarray]:
        """heap, (scores, doc_ids) of at most k with the best first, after these documents."""
        cells = terms[:, None] * self.windows + np.arange(self.windows)
        most = self.most[cells]
        reach = most.sum(axis=0)
        threshold = max(1, int(heap[0][-1])) if len(heap[0]) == k else 1
        for w in np.argsort(-reach, kind="stable").tolist():
            if reach[w] < threshold:
                break
            lists = np.argsort(most[:, w], kind="stable")
            lists = lists[np.count_nonzero(most[:, w] == 0) :]
            open_ = np.cumsum(most[lists, w])
            pivot = int(np.searchsorted(open_, threshold))
            bounds = [(int(self.at[c]), int(self.at[c + 1])) for c in cells[lists, w].tolist()]
            base, score = w * self.window, np.zeros(self.window, np.int64)
            for a, b in bounds[pivot:]:
                score[self.doc[a:b] - base] += self.impact[a:b]
            near = np.flatnonzero(score)
            for j in range(pivot - 1, -1, -1):
                near = near[score[near] + open_[j] >= threshold]
                a, b = bounds[j]
                docs = self.doc[a:b] - base
                at = np.minimum(np.searchsorted(docs, near), b - a - 1)
                hit = docs[at] == near
                score[near[hit]] += self.impact[a:b][at[hit]]
            near = near[score[near] >= threshold]
            self.scored += len(near)
            if not len(near):
                continue
            scores, ids = np.concatenate([heap[0], score[near]]), np.concatenate([heap[1], self.doc_ids[base + near]])
            best = np.lexsort((ids, -scores))[:k]
            heap = scores[best], ids[best]
            if len(best) == k:
                threshold = int(heap[0][-1])
        return heap


def impacts(n_docs: int, n_terms: int, n: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of postings: n, the length of the document; tf, the occurrences; weight, that of the term."""
    share = 100 - B + B * n * n_docs // n_terms
    return weight * (GAIN * tf // (SATURATION * tf + K1 * share))


def _searched(items: dict[int, list[int]], terms: list[str], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The best k documents of a task for each item. items: the numbers of their terms."""

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        asked = {i: np.array(ts, np.int64) for i, ts in items.items()}
        heaps = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in items}
        held: list[tuple[np.ndarray, ...]] = []
        n_held = [0, 0]

        def search() -> None:
            ids, lengths, doc, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = Shard(ids, len(terms), doc, term, impacts(n_docs, n_terms, lengths[doc], tf, weights[term]))
            for i, ts in asked.items():
                heaps[i] = shard.search(ts, heaps[i], k)
            held.clear()
            n_held[:] = [0, 0]

        for batch in batches:
            lists, tfs = batch.column("terms"), batch.column("tfs")
            coded = lists.flatten().dictionary_encode()
            known = np.array([number.get(t, -1) for t in coded.dictionary.to_pylist()] or [-1], np.int64)
            term = known[coded.indices.to_numpy()]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())) + n_held[0]
            keep = term >= 0
            held.append((batch.column("doc_id").to_numpy(), batch.column("n").to_numpy(), doc[keep], term[keep], tfs.flatten().to_numpy()[keep]))
            n_held[0] += batch.num_rows
            n_held[1] += int(keep.sum())
            if n_held[0] >= SHARD_DOCS or n_held[1] >= SHARD_POSTINGS:
                search()
        if held:
            search()
        counts = [len(h[0]) for h in heaps.values()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(heaps), np.int64), counts)), *(pa.array(np.concatenate([h[j] for h in heaps.values()] or [np.zeros(0, np.int64)])) for j in (1, 0))], names=["item_id", "doc_id", "score"])

    return searched


def rank(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents of the highest scores above 0, ties by doc_id."""
    common.small_batches(spark)
    scratch = common.Scratch(spark, "wand")
    texts = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = scratch.keep(texts.mapInArrow(_item_terms, "item_id long, term string").distinct())
    marks = np.zeros(PLACES, bool)
    for r in asked.select((F.crc32(F.col("term").cast("binary")) % PLACES).alias("place")).distinct().collect():  # at most PLACES rows
        marks[r["place"]] = True
    vectors = common.documents(docs).mapInArrow(_counted(marks), "doc_id long, n long, terms array<string>, tfs array<long>")
    vectors = scratch.keep(vectors.where("n > 0"))
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    if n_docs:
        frequency = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(WEIGHT * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
        weighed = scratch.keep(asked.join(frequency, "term").select("item_id", "term", weight.alias("w")).where("w > 0"))
        blocks = max(1, -(-weighed.count() // BLOCK))
        for b in range(blocks):
            pairs = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas()  # some BLOCK pairs
            terms = pairs.groupby("term")["w"].first()
            number = {t: i for i, t in enumerate(terms.index)}
            of = {int(i): [number[t] for t in g] for i, g in pairs.groupby("item_id")["term"]}
            if of:
                out = out.unionByName(vectors.mapInArrow(_searched(of, list(number), terms.to_numpy().astype(np.int64), n_docs, n_terms, k), "item_id long, doc_id long, score long"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
