"""Breadth-first walks of many tasks at once, and over which link each node was first reached."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import held
from skein.operators.lineage import cut, numbered

#: Tasks whose places in the frontier one row of a node holds.
TASKS = 1024
#: Links of a part; links of a node beyond which it is in several parts; (link, task) pairs that are looked at at a time.
PART, HUB, CHUNK = 1 << 18, 1 << 16, 1 << 21
#: Levels after which what was seen is one table again.
FOLD = 8


def _least(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the least value of each; none is below 0."""
    if not len(key):
        return key, value
    span = int(value.max()) + 1
    if (int(key.max()) + 1) * span < 1 << 63:  # both in one number, which sorts faster
        key, value = np.divmod(np.sort(key * span + value), span)
    else:
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], value[first]


def _step(n_tasks: int, n_links: int):
    def step(links: pa.Table, frontier: pa.Table) -> pa.Table:
        """Of each (task, node) that the frontier reaches, the link of the earliest frontier node, the first of its links."""
        order = np.lexsort((links.column("l").to_numpy(), links.column("s").to_numpy()))
        s, d, l = (links.column(c).to_numpy()[order] for c in ("s", "d", "l"))
        lists = frontier.column("at").combine_chunks()
        offsets, inside = lists.offsets.to_numpy(), lists.flatten()
        task, place = inside.field("t").to_numpy(), inside.field("place").to_numpy()
        offsets = offsets - (offsets[0] if len(offsets) else 0)
        node = frontier.column("n").to_numpy()
        first, leaving = np.searchsorted(s, node), np.searchsorted(s, node, side="right") - np.searchsorted(s, node)
        row = np.repeat(np.arange(len(node)), leaving)  # of each link that leaves the frontier
        link = np.arange(len(row)) + np.repeat(first - (np.cumsum(leaving) - leaving), leaving)
        width = np.diff(offsets)[row] if len(node) else row
        ends = np.cumsum(width)
        found, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            w = width[at:to]
            of = np.repeat(link[at:to], w)
            who = np.arange(len(of)) + np.repeat(offsets[row[at:to]] - (np.cumsum(w) - w), w)
            # Links of a node lie in their order here, so a place in the frontier and a link's index decide.
            found.append(_least(d[of] * n_tasks + task[who], place[who] * len(s) + of))
            at = to
        keys, values = _least(*(np.concatenate(x) for x in zip(*found, strict=True)))
        place, of = np.divmod(values, max(1, len(s)))
        return pa.table({"t": keys % n_tasks, "d": keys // n_tasks, "code": place * n_links + (l[of] if len(s) else of)})

    return step


def provenance(seeds: DataFrame, links_: DataFrame, by: str = "task_id", wanted: DataFrame | None = None, through=None) -> DataFrame:
    """(task_id, node, why, level): the reason of the link over which a breadth-first walk first reaches a node.

    Order decides: the earlier node of the frontier, then the earlier of its links. seeds: (task_id, id, rank). A frontier has
    a row a node (and TASKS tasks), with the places that it has in the tasks' frontiers, so links are read once a level.
    The walk ends when a level reaches nothing new. With wanted (task_id, node), rows of these alone. Where the graph fits,
    groups of tasks hold it (operators/held.py). through: more links, not written out (graph.Through).
    """
    spark = seeds.sparkSession
    seeds = cut(seeds.select(by, "id", "rank"))
    if through is not None:
        if (walked := held.reach_through(seeds, links_.where("w <> 0"), through, by, wanted)) is not None:
            return walked
        links_ = links_.unionByName(through.links())
    links = cut(numbered(links_.where("w <> 0").select("src", "dst", "reason", "ord"), "l", "src", "ord", "dst", "reason"))
    tasks = cut(numbered(seeds.select(by).distinct(), "t", by))
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).unionByName(seeds.select(F.col("id").alias("node")))
    numbers = cut(numbered(nodes.distinct(), "n", "node"))
    if (walked := held.reach(seeds, links, numbers, tasks, by, wanted)) is not None:
        return walked
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_links = max(1, links.count())
    parts = max(partitions, -(-n_links // PART))
    hubs = cut(links.groupBy("src").agg(F.least(F.lit(parts), F.ceil(F.count("*") / HUB)).cast("int").alias("fan")).where("fan > 1").join(numbers, F.col("src") == F.col("node")).select("n", "fan"))
    in_part = lambda node, i: F.pmod(node + i, F.lit(parts)).cast("int").alias("part")
    ends = links.join(numbers.toDF("src", "s"), "src").join(numbers.toDF("dst", "d"), "dst").join(hubs.toDF("s", "fan"), "s", "left")
    moves = ends.select(in_part(F.col("s"), F.pmod("l", F.coalesce("fan", F.lit(1)))), "s", "d", "l")
    moves = moves.repartition(partitions, "part").sortWithinPartitions("part").persist(StorageLevel.MEMORY_AND_DISK)
    step = _step(tasks.count(), n_links)  # a place in the frontier and a link are one number, which orders both

    def ranked(found: DataFrame, *order: str) -> DataFrame:
        return found.withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy(*order)).cast("bigint"))

    start = seeds.join(tasks, by).join(numbers, F.col("id") == F.col("node"))
    new = cut(ranked(start, "rank", "id").select("t", "n", "place", F.lit(None).cast("long").alias("l")))
    seen = new.select("t", "n", "l", F.lit(0).alias("level"))
    for level in itertools.count(1):
        frontier = new.groupBy("n", F.floor(F.col("t") / TASKS).alias("block")).agg(F.collect_list(F.struct("t", "place")).alias("at")).join(hubs, "n", "left")
        frontier = frontier.withColumn("i", F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1))).select(in_part(F.col("n"), F.col("i")), "n", "at")
        reached = moves.groupBy("part").cogroup(frontier.groupBy("part")).applyInArrow(step, "t long, d long, code long")
        found = reached.groupBy("t", F.col("d").alias("n")).agg(F.min("code").alias("code")).join(seen.select("t", "n"), ["t", "n"], "left_anti")
        new = cut(ranked(found, "code").select("t", "n", "place", (F.col("code") % n_links).alias("l")))
        if new.isEmpty():
            break
        seen = seen.unionByName(new.select("t", "n", "l", F.lit(level).alias("level")))
        if level % FOLD == 0:
            seen = cut(seen)
    moves.unpersist()
    why = F.when(F.col("level") == 0, F.lit("seed")).otherwise(F.col("reason")).alias("why")
    out = seen.join(links.select("l", "reason"), "l", "left").join(numbers, "n").join(tasks, "t").select(by, "node", why, "level")
    return out if wanted is None else out.join(wanted.select(by, "node").distinct(), [by, "node"], "left_semi")
