"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are dealt to lists by their nearest centroid (k-means on a bounded sample; every vector is indexed). A query
probes the lists of its nearest centroids. In a list, vectors lie rotated by a random orthogonal matrix, in blocks of
columns: after each block a candidate's partial distance, scaled to all dimensions, is tested against the query's
current 10th distance; where the test says the full distance can hardly be smaller, the candidate is abandoned. Those
that survive all blocks are measured exactly, in double precision, on the original vectors.

Lists larger than SALT rows are dealt out in parts, so a list that holds a third of all rows (one very common vector, say)
is scanned by many tasks. Queries meet a part as a stream; a part's vectors are all that a task holds.

How many lists a query probes is chosen from the sample: the fewest in which its own nearest neighbours lie for TARGET of
them. Tight clusters take a few lists, vectors spread evenly over a sphere most of them. A query meets FLOOR candidates at
least, so in small tables it meets all. Lists grow in number with the root of the table, up to a quarter of the sample.

Nearest first by Euclidean distance, ties to the smaller vec_id. A vector that is null, zero, or holds a null or a
component that is not finite takes no part; nor does one whose length is not the table's most frequent one, or whose
vec_id is null. An id is one point: of rows that repeat it, the one whose vector comes first in order counts. With fewer
candidates than asked for, all are given.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import common

#: The most vectors that centroids are fitted on, rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12
#: The share of the sample's neighbours that must lie in the lists probed, how many of the sample ask, and the fewest
#: candidates that a query meets.
TARGET, ASKING, FLOOR = 0.97, 500, 2000
SALT, BLOCK, CHUNK = 4096, 16, 512
#: How many standard deviations beyond its estimate a candidate's distance must lie to be abandoned.
EPSILON = 2.1


def valid(vectors: DataFrame, scratch: common.Scratch) -> DataFrame:
    """vec_id, v of the vectors that take part. Only rows whose id may repeat are shuffled."""
    v = F.col("embedding").cast("array<double>")
    df = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    df = df.where(fine)
    sizes = df.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    df = df.where(F.size("v") == (sizes[0]["d"] if sizes else 0))
    again = scratch.keep(df.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
    one = common.sieve(df, again, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    return common.sieve(df, again, "vec_id", keep=False).unionByName(one)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        for j in range(k):
            mine = x[near == j]
            centres[j] = mine.mean(axis=0) if len(mine) else x[rng.integers(len(x))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    out = []
    for a in range(0, len(x), 4096):
        d = (centres**2).sum(axis=1) - 2 * x[a : a + 4096] @ centres.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def lists_needed(x: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET) -> int:
    """The fewest lists, nearest first, that hold the target share of the k nearest neighbours of the first rows of x."""
    asking = x[:ASKING]
    square = (x**2).sum(axis=1)
    list_of = nearest(x, centres, 1)[:, 0]
    places = []
    for a in range(0, len(asking), 64):
        q = asking[a : a + 64]
        d = square - 2 * q @ x.T
        d[np.arange(len(q)), np.arange(a, a + len(q))] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1), axis=1)[:, :k] if len(x) > 1 else np.zeros((len(q), 0), np.int64)
        place = np.argsort(nearest(q, centres, len(centres)), axis=1)
        places.append(np.take_along_axis(place, list_of[near], axis=1).ravel())
    places = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))))]) + 1 if len(places) else 1


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class Scan:
    """One part of a list, ready for queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.x, self.k, self.d = ids, x, k, x.shape[1]
        rotated = (x @ turn).astype(np.float32)
        self.blocks = [np.ascontiguousarray(rotated[:, a : a + BLOCK]) for a in range(0, self.d, BLOCK)]
        self.scanned = self.full = 0

    def query(self, query_id: int, q: np.ndarray, q_rotated: np.ndarray) -> list[tuple[int, float]]:
        best, kept = np.inf, []
        for a in range(0, len(self.ids), CHUNK):
            alive = np.arange(a, min(a + CHUNK, len(self.ids)))
            partial, seen = np.zeros(len(alive), np.float32), 0
            for block in self.blocks:
                width = block.shape[1]
                difference = block[alive] - q_rotated[seen : seen + width]
                partial = partial + np.einsum("ij,ij->i", difference, difference)
                seen += width
                self.scanned += len(alive) * width
                if seen < self.d and np.isfinite(best):
                    bound = best * (seen / self.d) * (1 + EPSILON / np.sqrt(seen)) ** 2
                    near = partial <= bound
                    alive, partial = alive[near], partial[near]
                    if not len(alive):
                        break
            self.full += len(alive)
            if len(alive):
                kept.append((alive, partial))
                if np.isfinite(best):
                    kept[-1] = tuple(c[partial <= best * 1.0001 + 1e-6] for c in kept[-1])
                every = np.concatenate([p for _, p in kept])
                if len(every) > self.k:  # one more than wanted: the query's own row may be among them
                    best = float(np.partition(every, self.k)[self.k])
        rows = np.concatenate([r for r, _ in kept]) if kept else np.zeros(0, np.int64)
        rows = rows[self.ids[rows] != query_id]
        difference = self.x[rows] - q
        score = np.sqrt(np.einsum("ij,ij->i", difference, difference))
        order = np.lexsort((self.ids[rows], score))[: self.k]
        return [(int(self.ids[rows[i]]), float(score[i])) for i in order]


FOUND = "query_id long, vec_id long, score double"


def _scan(turn: np.ndarray, k: int):
    """Rows come part by part, the part's vectors before the queries."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, xs, ready = None, [], [], None
        for batch in batches:
            out = []
            x = _matrix(batch.column("v"))
            part = batch.column("list").to_numpy().astype(np.int64) * (1 << 32) + batch.column("part").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            vec = batch.column("vec_id").to_numpy()
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for rows in np.split(np.arange(len(part)), cuts) if len(part) else ():
                if part[rows[0]] != at:
                    at, ids, xs, ready = part[rows[0]], [], [], None
                if not asks[rows[0]]:
                    ids.append(vec[rows])
                    xs.append(x[rows])
                elif ids:
                    ready = ready or Scan(np.concatenate(ids), np.concatenate(xs), turn, k)
                    for i, turned in zip(rows, (x[rows] @ turn).astype(np.float32), strict=True):
                        out += [(int(vec[i]), *hit) for hit in ready.query(int(vec[i]), x[i], turned)]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return scan


def _listed(centres: np.ndarray):
    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest(_matrix(batch.column("v")), centres, 1)[:, 0] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32))], names=["vec_id", "v", "list"])

    return listed


def _probes(centres: np.ndarray, sizes: np.ndarray, n_lists: int, least_rows: int):
    def probes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = nearest(_matrix(batch.column("v")), centres, len(centres)) if batch.num_rows else np.zeros((0, 1), np.int64)
            lists = [row[: max(n_lists, int(np.searchsorted(np.cumsum(sizes[row]), least_rows)) + 1)].tolist() for row in order]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(lists, pa.list_(pa.int32()))], names=["vec_id", "v", "lists"])

    return probes


def search(spark: SparkSession, vectors: DataFrame, asks, k: int = 10, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score. asks: the condition, on vec_id, of the rows that are queries."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    scratch = common.Scratch(spark, "ann")
    rows = valid(vectors, scratch)
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # bounded by SAMPLE
    x = _matrix(sample.column("v").combine_chunks()) if n else np.zeros((0, 1))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A list for every few hundred vectors, about as many as a list has rows in the end.
    k_lists = int(min(len(x) // 4 or 1, max(1, round(np.sqrt(n)))))
    centres = kmeans(x, k_lists)
    n_lists = lists_needed(x, centres, k, target)
    turn = rotation(x.shape[1])

    listed = scratch.keep(rows.mapInArrow(_listed(centres), "vec_id long, v array<double>, list int"))
    counts = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    sizes = np.array([counts.get(i, 0) for i in range(k_lists)])
    parts = F.element_at(F.array(*(F.lit(int(-(-s // SALT)) or 1) for s in sizes)), F.col("list") + 1)
    kept = listed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).withColumn("asks", F.lit(False))
    asked = listed.where(asks).select("vec_id", "v").mapInArrow(_probes(centres, sizes, n_lists, FLOOR), "vec_id long, v array<double>, lists array<int>")
    asked = asked.select("vec_id", "v", F.explode("lists").alias("list"))
    asked = asked.select("vec_id", "v", "list", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("asks"))
    met = kept.select("list", "part", "asks", "vec_id", "v").unionByName(asked)
    met = met.repartition("list", "part").sortWithinPartitions("list", "part", "asks", "vec_id")
    found = met.mapInArrow(_scan(turn, k), FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
