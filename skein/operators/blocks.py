"""Weighted walks of many tasks at once: sparse moves times blocks of task vectors.

The scores of WIDTH tasks at a node are one row, (node, block, scores). Moves are dealt out to parts by their source, and
packed, in order of their destination, once: a part of at most some PART moves is a row. A round is one join of parts and
blocks with what was sent to them: it adds up what the part's nodes have got, multiplies the part's moves with it, and sends
on a row a (destination, block). So the rows in state are at most nodes x ceil(tasks / WIDTH), and moves are read once a
round and block, not once a task.

Tasks may differ in some weights: an overlay (task, src, dst, w) is added to the moves' weights for that task alone. The
base and its sums are kept once; a task's own rows correct what they touch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.lineage import cut, numbered

WIDTH = 64
#: Moves of a part; moves of a source beyond which it is dealt out to several parts; moves that are multiplied at a time.
PART, HUB, CHUNK = 1 << 17, 1 << 16, 1 << 14
#: Rounds after which what was sent is written as a table.
EVERY = 8
#: What a message is: a share of a node's score; a share of the mass that a block's moves have carried; a row of the
#: restart vector, which a part sends to itself.
SCORE, CARRIED, RESTART = 0, 1, 2
#: Scores travel as the bytes of WIDTH doubles, which no step between two rounds has to take apart.
MESSAGE = "part int, node long, block int, kind int, scores binary"
STATE = "node long, block int, scores array<double>"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    if not len(whole):
        return np.zeros((0, WIDTH))
    first = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset]
    return np.frombuffer(whole.buffers()[2], np.uint8)[first : first + 8 * WIDTH * len(whole)].view(np.float64).reshape(-1, WIDTH)


def _packed(m: np.ndarray) -> pa.Array:
    whole = pa.py_buffer(np.ascontiguousarray(m, np.float64))
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(0, m.size * 8 + 1, WIDTH * 8, dtype=np.int32)), whole])


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, WIDTH), pa.int32()), pa.array(m.ravel()))


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("scores").flatten().to_numpy().reshape(-1, WIDTH)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _packed(rows)], names=batch.schema.names)


def _sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, and the sums of their rows."""
    if not len(keys):
        return keys, rows
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[firsts], np.add.reduceat(rows, firsts, axis=0)


def _settled(messages: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and their scores; nodes and rows of the restart vector. All messages are of one part and block.

    All mass that moves don't carry returns to the restart vector; a task's mass is 1.
    """
    node, kind = messages.column("node").to_numpy(), messages.column("kind").to_numpy()
    rows = _matrix(messages.column("scores"))
    back = 1 - rows[kind == CARRIED].sum(axis=0)
    score, restart = kind == SCORE, kind == RESTART
    nodes, x = _sums(np.concatenate([node[score], node[restart]]), np.concatenate([rows[score], rows[restart] * back]))
    return nodes, x, node[restart], rows[restart]


#: Columns of packed moves: the base's, an overlay's, and what scales a source's score to make room for its overlay.
PACKED = {"base": ("src", "dst", "fan", "p"), "own": ("src", "dst", "fan", "slot", "p"), "less": ("src", "slot", "p")}


def _pack(kind: str, *keys: str):
    names = PACKED[kind]

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("dst" if "dst" in names else "src").to_numpy(), kind="stable")
        columns = {c: rows.column(c).to_numpy()[order].astype("<f8" if c == "p" else "<i8").tobytes() for c in names}
        return pa.table({**{k: [v] for k, v in zip(keys, key, strict=True)}, kind: pa.array([columns], pa.struct([(c, pa.binary()) for c in names]))})

    return pack


def _packed_type(kind: str) -> str:
    return f"{kind} struct<{', '.join(f'{c}:binary' for c in PACKED[kind])}>"


def _unpacked(moves: pa.Table, kind: str) -> list[np.ndarray]:
    """The arrays of a part; empty ones where it has none."""
    row = (moves.column(kind)[0].as_py() if moves.num_rows else None) or {}
    return [np.frombuffer(row.get(c) or b"", "<f8" if c == "p" else "<i8") for c in PACKED[kind]]


def _at(nodes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are among nodes, and where these stand there."""
    at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
    known = np.flatnonzero(nodes[at] == wanted)
    return known, at[known]


def _product(nodes: np.ndarray, x: np.ndarray, moves: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Destinations, in how many parts each is, and what they get."""
    if not len(nodes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDTH))
    src, slot, p = _unpacked(moves, "less")
    known, at = _at(nodes, src)
    x[at, slot[known]] *= p[known]
    src, dst, fan, p = _unpacked(moves, "base")
    known, at = _at(nodes, src)
    dst, fan, p = dst[known], fan[known], p[known]
    src, own_dst, own_fan, slot, q = _unpacked(moves, "own")
    known, own_at = _at(nodes, src)
    own_dst, own_fan, slot, q = own_dst[known], own_fan[known], slot[known], q[known]
    to, first = np.unique(np.concatenate([dst, own_dst]), return_index=True)
    y = np.zeros((len(to), WIDTH))
    for k in range(0, len(dst), CHUNK):
        keys, sums = _sums(dst[k : k + CHUNK], x[at[k : k + CHUNK]] * p[k : k + CHUNK, None])
        y[np.searchsorted(to, keys)] += sums
    np.add.at(y, (np.searchsorted(to, own_dst), slot), x[own_at, slot] * q)
    return to, np.concatenate([fan, own_fan])[first], y


def _step(parts: int):
    def step(key: tuple, moves: pa.Table, messages: pa.Table) -> pa.Table:
        part, block = (k.as_py() for k in key)
        nodes, x, at, restart = _settled(messages)
        to, fan, y = _product(nodes, x, moves)
        each, copied = np.repeat(to, fan), np.repeat(y, fan, axis=0)  # a hub gets its scores in each of its parts
        nth = np.arange(len(each)) - np.repeat(np.cumsum(fan) - fan, fan)
        n_carried = parts if len(to) else 0
        carried = np.repeat(y.sum(axis=0)[None, :], n_carried, axis=0)
        counts = [len(each), n_carried, len(at)]
        return pa.table({
            "part": pa.array(np.concatenate([(each + nth) % parts, np.arange(n_carried), np.full(len(at), part)]).astype(np.int32)),
            "node": pa.array(np.concatenate([each, np.full(n_carried, -1), at]).astype(np.int64)),
            "block": pa.array(np.full(sum(counts), block, np.int32)),
            "kind": pa.array(np.repeat(np.array([SCORE, CARRIED, RESTART], np.int32), counts)),
            "scores": _packed(np.concatenate([copied, carried, restart])),
        })

    return step


def _state(parts: int):
    """What the messages come to, told by the first part of each node."""

    def state(key: tuple, messages: pa.Table) -> pa.Table:
        part, block = (k.as_py() for k in key)
        nodes, x, *_ = _settled(messages)
        mine = nodes % parts == part
        return pa.table({"node": pa.array(nodes[mine]), "block": pa.array(np.full(int(mine.sum()), block, np.int32)), "scores": _lists(x[mine])})

    return state


class Vectors:
    """rows: (node, block, scores), a row a node and block; tasks: (by, t), their numbers from 0. Task t is number t % WIDTH
    of block t // WIDTH."""

    def __init__(self, by: str, tasks: DataFrame, rows: DataFrame):
        self.by, self.tasks, self.rows = by, tasks, rows

    def scores(self) -> DataFrame:
        """(by, node, score) of scores other than 0."""
        each = self.rows.select("node", "block", F.posexplode("scores").alias("slot", "score")).where("score <> 0")
        return each.withColumn("t", F.col("block").cast("long") * WIDTH + F.col("slot")).join(self.tasks, "t").select(self.by, "node", "score")


def _slots(t: str = "t") -> tuple:
    return F.floor(F.col(t) / WIDTH).cast("int").alias("block"), (F.col(t) % WIDTH).cast("int").alias("slot")


def _dense(rows: DataFrame) -> DataFrame:
    """(node, block, scores) of rows (node, t, mass)."""
    each = rows.groupBy("node", "t").agg(F.sum("mass").alias("mass")).select("node", *_slots(), "mass")
    filled = F.map_from_entries(F.collect_list(F.struct("slot", "mass")))
    packed = each.groupBy("node", "block").agg(filled.alias("m"))
    return packed.select("node", "block", F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("scores"))


class _Moves:
    """Moves (s, d, w), numbers of nodes, as shares of their source's weight times damping, packed by part; with the rows of an
    overlay (t, s, d, w). hubs: (s, fan), sources in more than one part. back: destinations are sources of the next round."""

    def __init__(self, moves: DataFrame, overlay: DataFrame | None, blocks: DataFrame, damping: float, back: bool, hub: int):
        spark = moves.sparkSession
        n = moves.count()
        self.parts = max(1, -(-n // PART))
        most = max(hub, -(-2 * n // self.parts))
        total = cut(moves.groupBy("s").agg(F.sum("w").alias("total"), F.least(F.lit(self.parts), F.ceil(F.count("*") / most)).cast("int").alias("fan")))
        self.hubs = total.where("fan > 1").select("s", "fan")
        fans = self.hubs.select(F.col("s").alias("d"), F.col("fan").alias("to_fan"))
        with_fans = lambda df: df.join(total, "s").join(fans, "d", "left")
        part = F.pmod(F.col("s") + F.pmod("d", "fan"), F.lit(self.parts)).cast("int").alias("part")
        move = (part, F.col("s").alias("src"), F.col("d").alias("dst"), F.coalesce("to_fan", F.lit(1)).alias("fan") if back else F.lit(1).alias("fan"))
        share = (damping * F.col("w") / F.col("total")).alias("p")
        base = with_fans(moves).select(*move, share).groupBy("part").applyInArrow(_pack("base", "part"), f"part int, {_packed_type('base')}")
        every = spark.range(self.parts).select(F.col("id").cast("int").alias("part")).crossJoin(F.broadcast(blocks))  # (part, block): a row of the result
        rows = every.join(base, "part", "left")
        keys = ("part", "block")
        if overlay is not None:
            own = with_fans(overlay.groupBy("t", "s", "d").agg(F.sum("w").alias("w"))).select(*move, *_slots(), share)
            less = overlay.groupBy("t", "s").agg(F.sum("w").alias("w")).join(total, "s").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
            less = less.select(F.pmod(F.col("s") + F.col("i"), F.lit(self.parts)).cast("int").alias("part"), F.col("s").alias("src"), *_slots(), (F.col("total") / (F.col("total") + F.col("w"))).alias("p"))
            for kind, df in (("own", own), ("less", less)):
                rows = rows.join(df.groupBy(*keys).applyInArrow(_pack(kind, *keys), f"part int, block int, {_packed_type(kind)}"), list(keys), "left")
        else:
            rows = rows.withColumns({kind: F.lit(None).cast(_packed_type(kind).split(" ", 1)[1]) for kind in ("own", "less")})
        self.rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)

    def messages(self, rows: DataFrame, kind: int) -> DataFrame:
        """rows (node, block, scores), sent to each part of their node."""
        spread = rows.join(self.hubs.withColumnRenamed("s", "node"), "node", "left")
        spread = spread.withColumn("i", F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1)))
        return spread.select(F.pmod(F.col("node") + F.col("i"), F.lit(self.parts)).cast("int").alias("part"), "node", "block", F.lit(kind).alias("kind"), "scores").mapInArrow(_sent, MESSAGE)

    def round(self, messages: DataFrame) -> DataFrame:
        return self.rows.groupBy("part", "block").cogroup(messages.groupBy("part", "block")).applyInArrow(_step(self.parts), MESSAGE)

    def state(self, messages: DataFrame) -> DataFrame:
        return messages.groupBy("part", "block").applyInArrow(_state(self.parts), STATE)


def _named(numbers: DataFrame, *columns: str) -> list[DataFrame]:
    return [numbers.select(F.col("node").alias(c), F.col("n").alias(c[0])) for c in columns]


def walk(start: DataFrame, moves: DataFrame, damping: float, iterations: int, tolerance: float | None, by: str = "task_id", overlay: DataFrame | None = None, everywhere: tuple[DataFrame, DataFrame] | None = None, hub: int = HUB) -> Vectors:
    """Personalised PageRank after `iterations` rounds, or where no task of a block moved by the tolerance any more.

    start: (by, node, mass), summing to 1 a task. moves: (src, dst, w). overlay: (by, src, dst, w), sources that have moves.
    everywhere: tasks (by) that start at all of some nodes (node) alike. A share 1 - damping of all mass, and what is at nodes
    without moves, returns to the start.
    """
    moves = cut(moves.where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    start = cut(start.where("mass > 0").select(by, "node", "mass"))
    known, nodes = start.select(by), moves.select(F.col("src").alias("node")).unionByName(moves.select(F.col("dst").alias("node"))).unionByName(start.select("node"))
    if everywhere is not None:
        known, nodes = known.unionByName(everywhere[0].select(by)), nodes.unionByName(everywhere[1].select("node"))
    tasks = cut(numbered(known.distinct(), "t", by))
    numbers = cut(numbered(nodes.distinct(), "n", "node"))
    s, d = _named(numbers, "src", "dst")
    if overlay is not None:
        overlay = cut(overlay.join(tasks, by).join(s, "src").join(d, "dst").select("t", "s", "d", "w"))
    blocks = tasks.select(_slots()[0]).distinct()
    dealt = _Moves(cut(moves.join(s, "src").join(d, "dst").select("s", "d", "w")), overlay, blocks, damping, True, hub)
    first = _dense(start.join(tasks, by).join(numbers, "node").select(F.col("n").alias("node"), "t", "mass"))
    if everywhere is not None:
        at = cut(everywhere[1].select("node").distinct().join(numbers, "node").select(F.col("n").alias("node")))
        level = _dense(everywhere[0].select(by).distinct().join(tasks, by).select(F.lit(0).alias("node"), "t", F.lit(1.0 / max(1, at.count())).alias("mass")))
        first = first.unionByName(at.crossJoin(F.broadcast(level.select("block", "scores"))))  # a row a block
    messages, before, done = cut(dealt.messages(first, RESTART)), None, []
    for i in range(1, iterations + 1):
        messages = dealt.round(messages)
        if i % EVERY and i < iterations:
            continue
        messages = cut(messages)
        if tolerance is None or i == iterations:
            continue
        now = cut(dealt.state(messages))
        if before is not None:
            apart = F.aggregate(F.zip_with("scores", F.coalesce("was", F.array_repeat(F.lit(0.0), WIDTH)), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda x, y: x + y)
            gaps = now.join(before.withColumnRenamed("scores", "was"), ["node", "block"], "left").groupBy("block").agg(F.sum(apart).alias("gap"))
            still = [r["block"] for r in gaps.where(F.col("gap") >= tolerance).collect()]  # numbers of blocks
            done.append(now.where(~F.col("block").isin(still)))
            messages, now = messages.where(F.col("block").isin(still)), now.where(F.col("block").isin(still))
            if not still:
                break
        before = now
    rows = dealt.state(messages)
    for other in done:
        rows = rows.unionByName(other)
    rows = cut(rows.withColumnRenamed("node", "n").join(numbers, "n").select("node", "block", "scores"))
    dealt.rows.unpersist()
    return Vectors(by, tasks, rows)


def spread(vectors: Vectors, moves: DataFrame, overlay: DataFrame | None = None) -> Vectors:
    """Scores times moves (src, dst, w), once and without return: each source's score in the shares of its weights. dst may
    be of any kind; overlay as in walk()."""
    moves = cut(moves.where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    sources, targets = cut(numbered(moves.select(F.col("src").alias("node")).distinct(), "n", "node")), cut(numbered(moves.select(F.col("dst").alias("node")).distinct(), "n", "node"))
    (s,), (d,) = _named(sources, "src"), _named(targets, "dst")
    if overlay is not None:
        overlay = cut(overlay.join(vectors.tasks, vectors.by).join(s, "src").join(d, "dst").select("t", "s", "d", "w"))
    dealt = _Moves(cut(moves.join(s, "src").join(d, "dst").select("s", "d", "w")), overlay, vectors.tasks.select(_slots()[0]).distinct(), 1.0, False, HUB)
    sent = dealt.messages(vectors.rows.join(sources, "node").select(F.col("n").alias("node"), "block", "scores"), SCORE)
    got = cut(dealt.state(dealt.round(sent).where(F.col("kind") == SCORE)))
    dealt.rows.unpersist()
    return Vectors(vectors.by, vectors.tasks, got.withColumnRenamed("node", "n").join(targets, "n").select("node", "block", "scores"))
