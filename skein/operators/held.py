"""Walks that hold the graph: a task of the job walks for some tasks of the batch over all moves, and sends nothing between rounds.

Between rounds, blocks.py and reach.py move a row a (node, block of tasks): on a graph whose links lead anywhere, that is nearly
a row a link, and forty rounds of it are hundreds of times the input. Here the moves are packed once, a number of 32 bits and a
byte for the weight each, and every group of tasks gets them once. So what moves is groups x packed moves, whatever the rounds.

Calls by name (graph.Through) are walked by way of their names: each name is two nodes more, one for either direction, which pass
on in the same round what reaches them. A name of n callers and m declarations then has n + m moves, where n * m are meant.

A group holds the moves and its own vectors, so both have bounds: LINKS, and STATE bytes for a group's vectors. Graphs beyond
them, for which even a single task's vectors are too large, are walked as before: fits() tells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.lineage import cut, numbered

#: Links that a group may hold (5 bytes each); bytes of a group's vectors; tasks of a group at most.
LINKS, STATE, TASKS = 1 << 26, 1 << 29, 64
#: Links of a packed row; moves that are multiplied, or links that are looked at, at a time.
PART, CHUNK, LOOK = 1 << 17, 1 << 15, 1 << 22
#: Bytes of a group's vectors that a part's moves start from, and moves of a destination from there that make it worth while.
TILE, DENSE = 1 << 20, 8
#: Rounds between two looks at what still moves. Weights that are told by a byte.
EVERY, CODES = 8, 256


def width(n_nodes: int, n_tasks: int, cores: int) -> int:
    """Tasks of a group: no more than its vectors (four of doubles a task) have room for, and groups for all cores."""
    return max(1, min(TASKS, STATE // (32 * max(1, n_nodes)), -(-n_tasks // max(1, cores))))


def fits(n_nodes: int, n_links: int) -> bool:
    return n_links <= LINKS and 32 * n_nodes <= STATE


def _pack(run: str, *columns: tuple[str, str]):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        """The column `run` as its distinct values, in order, and how many rows each has; the others in that order."""
        order = np.lexsort((rows.column("nth").to_numpy(), rows.column(run).to_numpy()))
        value, size = np.unique(rows.column(run).to_numpy(), return_counts=True)
        out = {"run": value.astype("<i4"), "size": size.astype("<i4")} | {c: rows.column(c).to_numpy()[order].astype(kind) for c, kind in columns}
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in out.items()}})

    return pack


def packed(rows: DataFrame, part: Column, run: str, nth: str, *columns: tuple[str, str]) -> DataFrame:
    """rows in packed rows (part, run, size, a binary a column), in the order of run and nth; written, as each group reads them."""
    schema = ", ".join(["part int, run binary, size binary", *(f"{c} binary" for c, _ in columns)])
    kept = rows.select(part.cast("int").alias("part"), run, F.col(nth).alias("nth"), *(c for c, _ in columns if c != run))
    return cut(kept.groupBy("part").applyInArrow(_pack(run, *columns), schema))


def _arrays(rows: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    """The packed arrays of a column, part by part, where they lie."""
    return [np.frombuffer(rows.column(name)[int(i)].as_buffer(), kind) for i in np.argsort(rows.column("part").to_numpy(), kind="stable")]


def _to_groups(whole: DataFrame, rows: DataFrame, tasks: DataFrame, each: int, step, schema: str) -> DataFrame:
    """What each group of tasks makes of all packed rows and its own rows."""
    blocks = cut(tasks.select(_grouped(each)).distinct())
    n = 16 * max(1, blocks.count())  # so that few groups meet in a partition
    spread = whole.crossJoin(F.broadcast(blocks)).repartition(n, "block")  # a row a group
    return cut(spread.groupBy("block").cogroup(rows.repartition(n, "block").groupBy("block")).applyInArrow(step, schema))


def _walk(n: int, m: int, weights: list[float] | None, damping: float, iterations: int, tolerance: float | None, limit: int | None):
    def walk(key: tuple, moves: pa.Table, start: pa.Table) -> pa.Table:
        """(t, n, score) of the group's tasks: moves are by destination, so a round adds up runs of them. From n on there are
        m names, which no part has among other destinations."""
        if not start.num_rows:
            return pa.table({"t": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        tasks, slot = np.unique(start.column("t").to_numpy(), return_inverse=True)
        mass = start.column("mass").to_numpy()
        at = start.column("n").to_numpy()
        known = None if weights is None else np.array(weights)
        parts = list(zip(*(_arrays(moves, c, k) for c, k in (("run", "<i4"), ("size", "<i4"), ("s", "<i4"), ("w", "<f8" if known is None else "<u1"))), strict=True))
        of = lambda w: w if known is None else known[w]
        into = [p for p in parts if p[0][0] >= n]
        parts = [p for p in parts if p[0][0] < n]
        total = np.zeros(n + m)
        for *_, s, w in parts:
            for k in range(0, len(s), LOOK):
                total += np.bincount(s[k : k + LOOK], of(w[k : k + LOOK]), n + m)
        for to, size, s, w in into:  # a move to a name weighs what the name passes on
            total[:n] += np.bincount(s, of(w) * np.repeat(total[to], size), n)
        total = total[:n]
        each = np.divide(damping, total, out=np.zeros(n), where=total > 0)
        leaving = damping * (total > 0)

        def runs(parts):
            for to, size, s, w in parts:
                ends = np.cumsum(size)
                for k in range(0, len(s), CHUNK):
                    a, b = np.searchsorted(ends, k, side="right"), np.searchsorted(ends, min(k + CHUNK, len(s)), side="left") + 1
                    yield to[a:b], np.maximum(ends[a:b] - size[a:b] - k, 0), s[k : k + CHUNK], of(w[k : k + CHUNK])

        def moved(x: np.ndarray, parts, out: np.ndarray) -> None:
            for to, first, s, w in runs(parts):
                s, even = s.astype(np.int64), (w == 1).all()
                for score, into_ in zip(x, out, strict=True):  # a task at a time: runs of one vector add up fastest
                    got = score.take(s, mode="clip")
                    into_[to] += np.add.reduceat(got if even else got * w, first)

        result = []
        live = np.arange(len(tasks))
        x = np.zeros((len(tasks), n))
        np.add.at(x, (slot, at), mass)
        start_at, start_slot, start_mass, before = at, slot, mass, None

        def settled(columns: np.ndarray) -> None:
            for c in columns:
                score = x[c]
                nodes = np.flatnonzero(score > 0)
                if limit is not None:
                    nodes = _best(nodes, score[nodes], answers, limit)
                result.append((np.full(len(nodes), tasks[live[c]]), nodes, score[nodes]))

        answers = np.ones(n, bool)
        if limit is not None:
            span = start.column("hidden")[0].as_py()  # nodes [from, to) are no answers
            answers[span["a"] : span["b"]] = False
        for i in range(1, iterations + 1):
            carried = x @ leaving
            x *= each
            y = np.zeros_like(x)
            if m:
                x = np.concatenate([x, np.zeros((len(x), m))], axis=1)
                moved(x, into, x)
            moved(x, parts, y)
            np.add.at(y, (start_slot, start_at), start_mass * (1 - carried)[start_slot])
            x = y
            if i % EVERY or tolerance is None or i == iterations:
                continue
            if before is not None:
                still = np.abs(x - before).sum(axis=1) >= tolerance
                if not still.all():
                    settled(np.flatnonzero(~still))
                    place = np.cumsum(still) - 1
                    keep = still[start_slot]
                    start_at, start_mass, start_slot = start_at[keep], start_mass[keep], place[start_slot[keep]]
                    x, live = x[still], live[still]
                    if not len(live):
                        break
            before = x.copy()
        settled(np.arange(len(live)))
        t, nodes, score = (np.concatenate(c) for c in zip(*result, strict=True))
        return pa.table({"t": pa.array(t, pa.int64()), "n": pa.array(nodes, pa.int64()), "score": pa.array(score)})

    return walk


def _best(nodes: np.ndarray, score: np.ndarray, answers: np.ndarray, limit: int) -> np.ndarray:
    """Nodes, in their order, that can be among the `limit` best by score of six digits, then number. A score so near the
    middle of two such values that rounding could go either way stays whatever its rank."""
    shown = answers[nodes]
    nodes, scaled = nodes[shown], score[shown] * 1e6
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6
    sure = np.flatnonzero(~near)
    rounded = np.floor(scaled[sure] + 0.5)
    if len(sure) > limit:
        bound = np.partition(rounded, len(sure) - limit)[len(sure) - limit]
        above = rounded > bound
        ties = np.flatnonzero(rounded == bound)[: limit - int(above.sum())]  # nodes ascend
        above[ties] = True
        sure = sure[above]
    return np.sort(nodes[np.concatenate([sure, np.flatnonzero(near)])])


def _grouped(each: int) -> Column:
    return F.floor(F.col("t") / each).cast("int").alias("block")


def walk(start: DataFrame, moves: DataFrame, damping: float, iterations: int, tolerance: float | None, by: str = "task_id", limit: int | None = None, hidden: str | None = None, through=None) -> DataFrame | None:
    """(by, node, score) of blocks.walk()'s scores above 0, or None where the graph doesn't fit. With limit: of each task at
    least those that are among its best so many, by score of six digits, then node; nodes that begin with `hidden` left out.
    through: more moves, not written out (graph.Through)."""
    spark = moves.sparkSession
    moves = cut(moves.where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    start = cut(start.where("mass > 0").select(by, "node", "mass"))
    nodes = moves.select(F.col("src").alias("node")).unionByName(moves.select(F.col("dst").alias("node"))).unionByName(start.select("node"))
    if through is not None:
        nodes = nodes.unionByName(_ends(through))
    numbers = cut(numbered(nodes.distinct(), "n", "node"))
    n_nodes, n_moves = numbers.count(), moves.count()
    passed, n_names = _passed(through, numbers, n_nodes) if through is not None else (None, 0)
    n_passed = passed.count() if through is not None else 0
    if not fits(n_nodes + n_names, n_moves + n_passed):
        return None
    tasks = cut(numbered(start.select(by).distinct(), "t", by))
    each = width(n_nodes + n_names, tasks.count(), spark.sparkContext.defaultParallelism)
    weights = moves.select("w") if passed is None else moves.select("w").unionByName(passed.select("w"))
    weights = sorted(r["w"] for r in weights.distinct().limit(CODES + 1).collect())
    weights = weights if len(weights) <= CODES else None
    code = F.col("w") if weights is None else F.array_position(F.array(*map(F.lit, weights)), F.col("w")).cast("int") - 1 if weights else F.lit(0)
    by_number = moves.join(numbers.toDF("src", "s"), "src").join(numbers.toDF("dst", "d"), "dst").select("s", "d", code.alias("w"))
    # Where destinations have many moves, a part's start from few sources, whose scores stay at hand.
    n_all, n_links = max(1, n_nodes + n_names), n_moves + n_passed
    tiles = max(1, min(-(-n_all * 8 * each // TILE), n_links // (DENSE * n_all)))
    slices = max(1, -(-n_links // (tiles * PART)))
    part = F.floor(F.col("s") * tiles / n_all) * slices + F.pmod("d", F.lit(slices))
    if passed is not None:
        by_number = by_number.unionByName(passed.select("s", "d", code.alias("w")))
        part = F.when(F.col("d") < n_nodes, part).otherwise(-1 - part)
    whole = packed(by_number, part, "d", "s", ("s", "<i4"), ("w", "<f8" if weights is None else "<u1"))
    span = numbers.where(F.startswith("node", F.lit(hidden))) if hidden else numbers.limit(0)
    span = span.agg(F.coalesce(F.min("n"), F.lit(0).cast("long")).alias("a"), F.coalesce(F.max("n") + 1, F.lit(0).cast("long")).alias("b")).select(F.struct("a", "b").alias("hidden"))
    rows = start.join(tasks, by).join(numbers, "node").crossJoin(F.broadcast(span)).select(_grouped(each), "t", "n", "mass", "hidden")  # one row
    got = _to_groups(whole, rows, tasks, each, _walk(n_nodes, n_names, weights, damping, iterations, tolerance, limit), "t long, n long, score double")
    return got.join(tasks, "t").join(numbers, "n").select(by, "node", "score")


def _ends(through) -> DataFrame:
    return through.callers.select(F.col("id").alias("node")).unionByName(through.declared.select(F.col("id").alias("node"))).distinct()


def _passed(through, numbers: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(s, d, w) from callers to names to declarations, and back; and how many names there are: r has n + 2 r, and n + 2 r + 1
    on the way back."""
    of = lambda df: cut(df.join(numbers.toDF("id", "n"), "id").select("n", "r"))
    callers, declared = of(through.callers), of(through.declared)
    move = lambda df, s, d, w: df.select(s.alias("s"), d.alias("d"), F.lit(float(w)).alias("w"))
    ahead, back = n + 2 * F.col("r"), n + 2 * F.col("r") + 1
    out = callers.select(F.col("n").alias("s"), F.col("n").alias("d"), F.lit(0.0).alias("w")).limit(0)
    if through.forward > 0:
        out = out.unionByName(move(callers, F.col("n"), ahead, 1)).unionByName(move(declared, ahead, F.col("n"), through.forward))
    if through.backward > 0:
        out = out.unionByName(move(declared, F.col("n"), back, 1)).unionByName(move(callers, back, F.col("n"), through.backward))
    names = callers.select("r").unionByName(declared.select("r")).agg(F.coalesce(F.max("r") + 1, F.lit(0))).first()[0]
    return out, 2 * names


def _reach(n: int, asked: bool):
    def reach(key: tuple, links: pa.Table, start: pa.Table) -> pa.Table:
        """(t, n, l, level) of what each task's walk first reaches over link l; with asked, of the nodes asked for."""
        to = np.concatenate([np.zeros(0, np.int32), *_arrays(links, "d", "<i4")])
        first = np.zeros(n + 1, np.int64)
        for run, size in zip(_arrays(links, "run", "<i4"), _arrays(links, "size", "<i4"), strict=True):
            first[run + 1] += size
        first = np.cumsum(first)
        task, node, place = (start.column(c).to_numpy() for c in ("t", "n", "place"))
        out = []
        at = np.empty(n, np.int64)
        for t in np.unique(task):
            mine = np.flatnonzero(task == t)
            seeds = mine[place[mine] > 0]
            frontier = node[seeds[np.argsort(place[seeds], kind="stable")]]
            seen = np.zeros(n, bool)
            seen[frontier] = True
            found = []
            level = 0
            left = node[mine[place[mine] == 0]] if asked else None
            while len(frontier) and not (asked and seen[left].all()):  # once all that is asked for is seen, nothing new counts
                level += 1
                ends, new, k = np.cumsum(first[frontier + 1] - first[frontier]), [], 0
                while k < len(frontier):  # some LOOK links at a time, in the order of the frontier
                    stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + LOOK, side="right")))
                    some = frontier[k:stop]
                    leaving = first[some + 1] - first[some]
                    link = np.arange(leaving.sum()) + np.repeat(first[some] - (np.cumsum(leaving) - leaving), leaving)
                    link = link[~seen[to[link]]]
                    reached = to[link]
                    at[reached[::-1]] = np.arange(len(reached))[::-1]  # the first place of each node stays
                    link = link[at[reached] == np.arange(len(reached))]
                    seen[to[link]] = True
                    new.append(link)
                    k = stop
                link = np.concatenate(new)
                frontier = to[link].astype(np.int64)
                found.append((frontier, link, np.full(len(link), level)))
            if not found:
                continue
            nodes, link, levels = (np.concatenate(c) for c in zip(*found, strict=True))
            if asked:
                keep = np.isin(nodes, node[mine[place[mine] == 0]])
                nodes, link, levels = nodes[keep], link[keep], levels[keep]
            out.append((np.full(len(nodes), t), nodes, link, levels))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"t": pa.array(columns[0], pa.int64()), "n": pa.array(columns[1], pa.int64()), "l": pa.array(columns[2], pa.int64()), "level": pa.array(columns[3], pa.int32())})

    return reach


def reach(seeds: DataFrame, links: DataFrame, numbers: DataFrame, tasks: DataFrame, by: str, wanted: DataFrame | None) -> DataFrame | None:
    """(by, node, why, level) as of reach.provenance(), or None where the graph doesn't fit. links: (src, dst, reason, l), l
    their number in the order of src; numbers: (node, n), in the order of node; tasks: (by, t)."""
    spark = links.sparkSession
    n_nodes, n_links = numbers.count(), links.count()
    if not fits(n_nodes, n_links):
        return None
    each = width(n_nodes, tasks.count(), spark.sparkContext.defaultParallelism)
    ends = links.join(numbers.toDF("src", "s"), "src").join(numbers.toDF("dst", "d"), "dst").select("l", "s", "d")
    whole = packed(ends, F.floor(F.col("l") / PART), "s", "l", ("d", "<i4"))
    place = lambda df, x: df.join(tasks, by).join(numbers, "node").select(_grouped(each), "t", "n", x.cast("long").alias("place"))
    ordered = seeds.withColumnRenamed("id", "node").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("s"))
    rows = place(ordered.select(by, F.posexplode("s").alias("i", "x")).select(by, "i", F.col("x")["node"].alias("node")), F.col("i") + 1)
    if wanted is not None:
        rows = rows.unionByName(place(wanted.select(by, "node"), F.lit(0)))
    got = _to_groups(whole, rows, tasks, each, _reach(n_nodes, wanted is not None), "t long, n long, l long, level int")
    far = got.join(links.select("l", F.col("dst").alias("node"), F.col("reason").alias("why")), "l").join(tasks, "t").select(by, "node", "why", "level")
    near = seeds.select(by, F.col("id").alias("node"), F.lit("seed").alias("why"), F.lit(0).alias("level"))
    if wanted is not None:
        near = near.join(wanted.select(by, "node").distinct(), [by, "node"], "left_semi")
    return near.unionByName(far)


#: Classes of a written link: before all calls, a call's way back, a call, after all calls.
BEFORE, BACK, AHEAD, AFTER = range(4)


def _reach_through(n: int, m: int, n_links: int, asked: bool):
    def reach(key: tuple, links: pa.Table, start: pa.Table) -> pa.Table:
        """(t, n, l, s, back, level) of what each task's walk first reaches, over link l or, where that is -1, by a call of s.

        A name is passed once: the first of the frontier that comes to it reaches all that lies behind it. What decides is the
        place in the frontier, then the place among a node's links: BEFORE by l, calls by caller and called, AFTER by l.
        """
        by_name = links.column("part").to_numpy() < 0
        own, names = links.filter(pa.array(~by_name)), links.filter(pa.array(by_name))

        def rows_of(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
            to = np.concatenate([np.zeros(0, np.int32), *_arrays(table, "d", "<i4")])
            first = np.zeros(size + 1, np.int64)
            for run, many in zip(_arrays(table, "run", "<i4"), _arrays(table, "size", "<i4"), strict=True):
                first[run + 1] += many
            return to, np.cumsum(first)

        to, first = rows_of(own, n)
        kind = np.concatenate([np.zeros(0, np.uint8), *_arrays(own, "c", "<u1")])
        through, begin = rows_of(names, n + m)
        calls, span = n_links, 2 * n_links + 3 * n  # where the codes of calls begin, and how many codes there are

        def call(u: np.ndarray, v: np.ndarray, back: np.ndarray) -> np.ndarray:
            """The place of u's call of v among u's calls, or of v's call of u."""
            return calls + v + n * np.where(back, np.where(v < u, 0, 2), 1)

        def expanded(frontier: np.ndarray, starts: np.ndarray):
            """(place, index) of the rows of the frontier's nodes, some LOOK at a time."""
            ends, k = np.cumsum(starts[frontier + 1] - starts[frontier]), 0
            while k < len(frontier):
                stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + LOOK, side="right")))
                some = frontier[k:stop]
                leaving = starts[some + 1] - starts[some]
                yield np.repeat(np.arange(k, stop), leaving), np.arange(leaving.sum()) + np.repeat(starts[some] - (np.cumsum(leaving) - leaving), leaving)
                k = stop

        at = np.empty(n + m, np.int64)

        def firsts(x: np.ndarray) -> np.ndarray:
            """Which are the first of their value."""
            at[x[::-1]] = np.arange(len(x))[::-1]
            return at[x] == np.arange(len(x))

        def least(v: np.ndarray, code: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.argsort(code, kind="stable")
            order = order[firsts(v[order])]
            return tuple(x[order] for x in (v, code, *more))

        task, node, place = (start.column(c).to_numpy() for c in ("t", "n", "place"))
        out = []
        for t in np.unique(task):
            mine = np.flatnonzero(task == t)
            seeds = mine[place[mine] > 0]
            wanted = node[mine[place[mine] == 0]]
            frontier = node[seeds[np.argsort(place[seeds], kind="stable")]]
            seen, passed, level = np.zeros(n, bool), np.zeros(m, bool), 0
            seen[frontier] = True
            while len(frontier) and not (asked and seen[wanted].all()):
                level += 1
                new = []
                for p, link in expanded(frontier, first):
                    unseen = ~seen[to[link]]
                    p, link = p[unseen], link[unseen]
                    v, c = to[link].astype(np.int64), kind[link]
                    code = np.where(c == BEFORE, link, np.where(c == AFTER, calls + 3 * n + link, call(frontier[p], v, c == BACK)))
                    new.append(least(v, p * span + code, link, frontier[p], c == BACK))
                for p, row in expanded(frontier, begin):
                    name = through[row].astype(np.int64)
                    fresh = ~passed[name - n]
                    p, name = p[fresh], name[fresh]
                    one = firsts(name)
                    p, name = p[one], name[one]
                    passed[name - n] = True
                    for i, row in expanded(name, begin):
                        v = through[row].astype(np.int64)
                        unseen = ~seen[v]
                        i, v = i[unseen], v[unseen]
                        u, back = frontier[p[i]], (name[i] - n) % 2 == 1
                        new.append(least(v, p[i] * span + call(u, v, back), np.full(len(v), -1), u, back))
                v, _, link, u, back = least(*(np.concatenate(x) for x in zip(*new, strict=True)))
                seen[v] = True
                frontier = v
                keep = np.isin(v, wanted) if asked else slice(None)
                out.append([x[keep] for x in (np.full(len(v), t), v, link, u, back, np.full(len(v), level))])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())
        return pa.table({c: pa.array(x.astype(bool) if k == pa.bool_() else x, k) for c, x, k in zip(("t", "n", "l", "s", "back", "level"), columns, kinds, strict=True)})

    return reach


def reach_through(seeds: DataFrame, links_: DataFrame, through, by: str, wanted: DataFrame | None) -> DataFrame | None:
    """(by, node, why, level) as of reach.provenance() over links_ and the calls of through, or None where the graph doesn't
    fit, or where ids hold what separates them in a link's ord."""
    spark = links_.sparkSession
    if not _ends(through).where(F.contains("node", F.lit("|"))).isEmpty():
        return None
    key = lambda c: F.concat(F.col(c), F.lit("|"))  # noqa: E731  the order of callers in a link's ord
    links = cut(numbered(links_.select("src", "dst", "reason", "ord"), "l", key("src"), "ord", "dst", "reason"))
    tasks = cut(numbered(seeds.select(by).distinct(), "t", by))
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).unionByName(seeds.select(F.col("id").alias("node"))).unionByName(_ends(through))
    numbers = cut(numbered(nodes.distinct(), "n", key("node")))
    n_nodes, n_links = numbers.count(), links.count()
    passed, n_names = _passed(through, numbers, n_nodes)
    n_passed = passed.count()
    if not fits(n_nodes + n_names, n_links + n_passed):
        return None
    each = width(n_nodes + n_names, tasks.count(), spark.sparkContext.defaultParallelism)
    call = F.startswith("ord", F.lit(through.ord))
    kind = F.when(call, F.when(F.endswith("ord", F.lit("|1")), BACK).otherwise(AHEAD)).when(F.col("ord") < through.ord, BEFORE).otherwise(AFTER)
    ends = links.join(numbers.toDF("src", "s"), "src").join(numbers.toDF("dst", "d"), "dst").select("l", "s", "d", kind.alias("c"), F.floor(F.col("l") / PART).alias("part"))
    rows_each = max(1, (n_nodes + n_names) * PART // max(1, n_passed))
    named = passed.select(F.col("d").alias("l"), "s", "d", F.lit(0).alias("c"), (F.floor(F.col("s") / rows_each) - (n_nodes + n_names) // rows_each - 1).alias("part"))
    whole = packed(ends.unionByName(named), F.col("part"), "s", "l", ("d", "<i4"), ("c", "<u1"))
    place = lambda df, x: df.join(tasks, by).join(numbers, "node").select(_grouped(each), "t", "n", x.cast("long").alias("place"))
    ordered = seeds.withColumnRenamed("id", "node").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("s"))
    rows = place(ordered.select(by, F.posexplode("s").alias("i", "x")).select(by, "i", F.col("x")["node"].alias("node")), F.col("i") + 1)
    if wanted is not None:
        rows = rows.unionByName(place(wanted.select(by, "node"), F.lit(0)))
    got = _to_groups(whole, rows, tasks, each, _reach_through(n_nodes, n_names, n_links, wanted is not None), "t long, n long, l long, s long, back boolean, level int")
    own = got.join(links.select("l", F.col("dst").alias("node"), F.col("reason").alias("why")), "l").join(tasks, "t").select(by, "node", "why", "level")
    called = through.reasons(got.where("l < 0").join(numbers.toDF("src", "s"), "s").join(numbers.toDF("dst", "n"), "n"))
    called = called.join(tasks, "t").select(by, F.col("dst").alias("node"), F.col("reason").alias("why"), "level")
    near = seeds.select(by, F.col("id").alias("node"), F.lit("seed").alias("why"), F.lit(0).alias("level"))
    if wanted is not None:
        near = near.join(wanted.select(by, "node").distinct(), [by, "node"], "left_semi")
    return near.unionByName(own).unionByName(called)
