"""Walks in blocks of tasks, interval joins by bins, the sweep for nested gold, blocked packing and dense search, each
against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import blocks, gold, intervals, names, reach, retrieval
from skein.operators import packing as P

MOVES, START = "src string, dst string, w double", "task_id long, node string, mass double"


def plain_walk(start, moves, own, damping, rounds):
    """{(task, node): score}, each task by itself."""
    out = {}
    for task, mass in start.items():
        weights = dict(moves)
        for (t, a, b), w in own.items():
            if t == task:
                weights[a, b] += w
        total = {}
        for (a, _), w in weights.items():
            total[a] = total.get(a, 0) + w
        x = dict(mass)
        for _ in range(rounds):
            y, carried = {}, 0.0
            for (a, b), w in weights.items():
                if x.get(a):
                    y[b] = y.get(b, 0) + damping * x[a] * w / total[a]
                    carried += damping * x[a] * w / total[a]
            for n, m in mass.items():
                y[n] = y.get(n, 0) + (1 - carried) * m
            x = y
        out |= {(task, n): s for n, s in x.items() if s}
    return out


@pytest.fixture(scope="module")
def world():
    rng = random.Random(11)
    nodes = [f"n{i:02d}" for i in range(50)]
    moves = {(rng.choice(nodes[:40]), rng.choice(nodes)): rng.randint(1, 9) / 2 for _ in range(160)}
    moves |= {("n00", n): 1.0 for n in nodes}  # a hub
    start = {}
    for t in range(150):
        seeds = rng.sample(nodes + ["apart"], rng.randint(1, 4))
        start[t * 7] = {n: 1 / len(seeds) for n in seeds}
    own = {}
    for t in list(start)[::3]:
        for a, b in rng.sample(sorted(moves), 4):
            own[t, a, b] = rng.randint(1, 20) / 4
    return nodes, moves, start, own


def frames(spark, moves, start, own):
    return (
        spark.createDataFrame([(a, b, w) for (a, b), w in moves.items()] + [("n00", "n01", 0.0)], MOVES),
        spark.createDataFrame([(t, n, m) for t, ms in start.items() for n, m in ms.items()], START),
        spark.createDataFrame([(t, a, b, w) for (t, a, b), w in own.items()], f"task_id long, {MOVES}"),
    )


@pytest.mark.parametrize("hub, part, overlaid", [(4, 40, True), (1 << 16, 1 << 17, False)])
def test_walks_of_many_tasks_equal_each_by_itself(spark, world, hub, part, overlaid, monkeypatch):
    monkeypatch.setattr(blocks, "PART", part)
    nodes, moves, start, own = world
    m, s, o = frames(spark, moves, start, own)
    got = blocks.walk(s, m, 0.85, 9, None, overlay=o if overlaid else None, hub=hub)
    assert got.rows.count() <= (len(nodes) + 1) * -(-len(start) // blocks.WIDTH)
    assert got.rows.groupBy("node", "block").count().where("count > 1").isEmpty()
    scores = {(r["task_id"], r["node"]): r["score"] for r in got.scores().collect()}
    assert scores == pytest.approx(plain_walk(start, moves, own if overlaid else {}, 0.85, 9), abs=1e-12)


def test_blocks_stop_where_all_their_tasks_do(spark):
    n = blocks.WIDTH
    start = {t: {"lone" if t < n else "a": 1.0} for t in range(n + 3)}
    m, s, _ = frames(spark, {("a", "b"): 1.0, ("b", "a"): 1.0, ("n00", "n01"): 1.0}, start, {(0, "a", "b"): 0.0})
    got = {(r["task_id"], r["node"]): r["score"] for r in blocks.walk(s, m, 0.5, 60, 1e-9).scores().collect()}
    want = {(t, "lone"): 1.0 for t in range(n)} | {(t, x): v for t in range(n, n + 3) for x, v in (("a", 2 / 3), ("b", 1 / 3))}
    assert got == pytest.approx(want, abs=1e-8)


def test_tasks_that_start_everywhere_and_flows_to_pairs(spark, world):
    nodes, moves, start, own = world
    some = dict(list(start.items())[:5])
    m, s, o = frames(spark, moves, some, {k: w for k, w in own.items() if k[0] in some or k[0] == 42})
    lost, places = spark.createDataFrame([(42,), (9999,)], "task_id long"), spark.createDataFrame([(n,) for n in nodes[:10]], "node string")
    vectors = blocks.walk(s, m, 0.85, 5, None, overlay=o, everywhere=(lost, places))
    some |= {t: {n: 0.1 for n in nodes[:10]} for t in (42, 9999)}
    own = {k: w for k, w in own.items() if k[0] in some}
    want = plain_walk(some, moves, own, 0.85, 5)
    assert {(r["task_id"], r["node"]): r["score"] for r in vectors.scores().collect()} == pytest.approx(want, abs=1e-12)
    pair = lambda df, *more: df.select(*more, "src", F.struct("dst", F.length("dst").alias("size")).alias("dst"), "w")
    flow = {(r["task_id"], r["node"]["dst"]): r["score"] for r in blocks.spread(vectors, pair(m), pair(o, "task_id")).scores().collect()}
    expected = {}
    for t in some:
        weights = {(a, b): w + own.get((t, a, b), 0) for (a, b), w in moves.items()}
        for (a, b), w in weights.items():
            if (t, a) in want:
                expected[t, b] = expected.get((t, b), 0) + want[t, a] * w / sum(v for (x, _), v in weights.items() if x == a)
    assert flow == pytest.approx(expected, abs=1e-12)


def test_nothing_to_walk(spark):
    m, s = spark.createDataFrame([("a", "b", 1.0)], MOVES), spark.createDataFrame([], START)
    assert blocks.walk(s, m, 0.85, 3, None).scores().count() == 0
    s = spark.createDataFrame([(1, "a", 1.0)], START)
    assert [tuple(r) for r in blocks.walk(s, m.limit(0), 0.85, 3, None).scores().collect()] == [(1, "a", 1.0)]


def plain_reach(seeds, links):
    seen = {}
    for task, ids in seeds.items():
        at = {n: ("seed", 0) for n in ids}
        frontier, level = list(dict.fromkeys(ids)), 0
        while frontier:
            level += 1
            new = []
            for n in frontier:
                for dst, reason in links.get(n, []):
                    if dst not in at:
                        at[dst] = (reason, level)
                        new.append(dst)
            frontier = new
        seen |= {(task, n): v for n, v in at.items()}
    return seen


@pytest.mark.parametrize("hub, tasks", [(2, 3), (1 << 16, 1024)])
def test_reasons_of_many_tasks_equal_each_by_itself(spark, hub, tasks, monkeypatch):
    monkeypatch.setattr(reach, "HUB", hub)
    monkeypatch.setattr(reach, "TASKS", tasks)
    rng = random.Random(hub)
    nodes = [f"n{i:03d}" for i in range(120)]
    rows = sorted({(rng.choice(nodes[:100]), f"{rng.randrange(10**6):06d}", rng.choice(nodes)) for _ in range(260)})
    links = {}
    for a, o, b in rows:
        links.setdefault(a, []).append((b, f"{o}>{b}"))
    seeds = {t: rng.sample(nodes + ["apart"], 3) for t in range(0, 80, 2)}
    df = spark.createDataFrame([(a, b, 1.0, f"{o}>{b}", o) for a, o, b in rows] + [("n000", "n119", 0.0, "no weight", "")], "src string, dst string, w double, reason string, ord string")
    at = spark.createDataFrame([(t, n, i) for t, ns in seeds.items() for i, n in enumerate(ns)], "task_id long, id string, rank long")
    got = {(r["task_id"], r["node"]): (r["why"], r["level"]) for r in reach.provenance(at, df).collect()}
    assert got == plain_reach(seeds, links)


def test_a_step_in_many_chunks_is_the_step_in_one(monkeypatch):
    rng = np.random.default_rng(2)
    n = 400
    links = pa.table({"s": rng.integers(0, 30, n), "d": rng.integers(0, 40, n), "l": rng.permutation(n)})
    at = [[{"t": int(t), "place": int(rng.integers(0, 50))} for t in rng.choice(20, 7, replace=False)] for _ in range(12)]
    frontier = pa.table({"n": rng.choice(30, 12, replace=False), "at": pa.array(at, pa.list_(pa.struct([("t", pa.int64()), ("place", pa.int64())])))})
    step = reach._step(20, n)
    whole = step(links, frontier.slice(1))
    monkeypatch.setattr(reach, "CHUNK", 3)
    assert step(links, frontier.slice(1)).equals(whole)
    want = {}
    for s, d, l in zip(*(links.column(c).to_pylist() for c in "sdl"), strict=True):
        for node, tasks in zip(frontier.column("n").to_pylist()[1:], at[1:], strict=True):
            for x in tasks:
                if node == s:
                    want[x["t"], d] = min(want.get((x["t"], d), (99, 0)), (x["place"], l))
    places = {k: v[0] for k, v in want.items()}  # of equal places, a node's own links decide
    assert {(t, d): c // n for t, d, c in zip(*(whole.column(c).to_pylist() for c in ("t", "d", "code")), strict=True)} == places


def test_tiles_cover_a_span_once(spark):
    spans = [(s, e) for s in range(0, 20) for e in range(s - 2, 40)] + [(1, 10**6), (123_456_789, 2_000_000_000)]
    df = spark.createDataFrame(spans, "s int, e int").select("s", "e", intervals.tiles(F.col("s"), F.col("e")).alias("t"))
    for r in df.collect():
        inside = sorted((x["bin"] << x["size"], (x["bin"] + 1) << x["size"]) for x in r["t"])
        at = r["s"]
        for a, b in inside:
            assert a == at
            at = b
        assert at == max(r["e"] + 1, r["s"]) and len(inside) <= 2 * max(1, (r["e"] - r["s"] + 1).bit_length())


def test_lines_meet_the_spans_that_hold_them_and_no_others(spark):
    rng = random.Random(1)
    spans = [(rng.choice("fg"), i, (s := rng.randint(1, 90)), s + rng.choice([-1, 0, 1, 5, 60])) for i in range(150)]
    lines = [(rng.choice("fgh"), rng.randint(1, 130)) for _ in range(200)]
    got = intervals.covering(spark.createDataFrame(lines, "file string, line int"), spark.createDataFrame(spans, "file string, k int, start_line int, end_line int"), ["file"])
    assert sorted((r["file"], r["line"], r["k"]) for r in got.collect()) == sorted((f, n, k) for f, n in lines for g, k, s, e in spans if f == g and s <= n <= e)
    assert intervals.covering(spark.createDataFrame(lines, "file string, line int"), spark.createDataFrame([], "file string, start_line int, end_line int"), ["file"]).count() == 0


def test_one_file_of_very_many_spans(spark):
    """100,000 declarations in one file, in classes of a thousand lines: a line meets its class and its declaration alone."""
    n = 100_000
    small = spark.range(n).select(F.lit("f").alias("file"), F.concat(F.lit("d"), "id").alias("id"), (F.col("id") * 4 + 1).cast("int").alias("start_line"), (F.col("id") * 4 + 3).cast("int").alias("end_line"))
    large = spark.range(n // 250).select(F.lit("f").alias("file"), F.concat(F.lit("c"), "id").alias("id"), (F.col("id") * 1000).cast("int").alias("start_line"), (F.col("id") * 1000 + 999).cast("int").alias("end_line"))
    spans = small.unionByName(large)
    lines = spark.range(50_000).select(F.lit("f").alias("file"), (F.col("id") * 8 + 2).cast("int").alias("line"))
    assert intervals.covering(lines, spans, ["file"]).count() == 100_000
    got = names.innermost(lines, spans)
    assert got.where(F.col("id") == F.concat(F.lit("d"), F.floor(F.col("line") / 4).cast("string"))).count() == 50_000 == got.count()


def test_gold_that_encloses_other_gold_goes(spark):
    rng = random.Random(3)
    rows, pos = [], 0
    for task in range(3):
        for file in "fg":
            for _ in range(40):
                s = rng.randint(1, 25)
                rows.append((task, f"i{rng.randint(0, 60)}", file, s, s + rng.randint(0, 6), pos))
                pos += 1
    rows += [(9, "a", "f", 1, 9, 500), (9, "b", "f", 1, 9, 501), (9, "c", "f", 20, 30, 502), (9, "d", "f", 20, 29, 503), (9, "e", "f", 21, 30, 504)]
    touched = spark.createDataFrame(rows, "task_id long, id string, file string, start_line int, end_line int, pos long")
    enclosing = {(t, i) for t, i, f, s, e, p in rows if any(t == u and f == g and p != q and a >= s and b <= e for u, _, g, a, b, q in rows)}
    result = gold.innermost_gold(touched)
    assert {tuple(r) for r in result.collect()} == {(t, i) for t, i, *_ in rows} - enclosing
    assert "Join" not in result._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 3, 128])
def test_greedy_packing_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(t, i, rng.choice([0, 1, 5, 30, 90, 400])) for t in range(6) for i in range(60)] + [(50, 1, 101), (51, 1, 100)]
    want = []
    for t in {r[0] for r in rows}:
        left = 100
        for _, i, n in sorted(r for r in rows if r[0] == t):
            if n <= left:
                left -= n
                want.append((t, i, n))
    items = spark.createDataFrame(rows, "task_id long, i int, n int")
    assert sorted(map(tuple, P.skip_greedy(items, 100, "task_id", [F.col("i")], "n", ["i", "n"], block).collect())) == sorted(want)
    assert P.skip_greedy(items.where("n > 100"), 100, "task_id", [F.col("i")], "n", ["i", "n"], block).collect() == []


def test_windows_credit_what_they_hold_whole_at_no_tokens(spark):
    files = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(1, 21)))], "file string, text string")
    spans = spark.createDataFrame([("alpha", "f", 1, 4), ("straddler", "f", 8, 12), ("beta", "f", 16, 18)], "id string, file string, start_line int, end_line int")
    for size, want in ((10, {"alpha", "beta"}), (5, {"alpha", "beta"}), (20, {"alpha", "beta", "straddler"}), (2, set())):
        w = names.windows(files, size)
        taken = w.select(F.lit(1).alias("task_id"), "file", "chunk")
        got = P.credited(taken, names.contained(w, spans)).collect()
        assert {r["id"] for r in got} == want and all(r["tokens"] == 0 and r["why"] == "chunk:f" for r in got)


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    q, v = rng.normal(size=(9, 8)), rng.normal(size=(300, 8))
    v[10:14] = v[3]  # ties
    v[20] = 0
    tests = [i % 4 == 0 for i in range(300)]
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = unit(q) @ unit(v).T * np.where(tests, 0.3, 1.0)
    queries = spark.createDataFrame([(t, x.tolist()) for t, x in enumerate(q)] + [(99, None)], "task_id long, q array<double>")
    vectors = spark.createDataFrame([(f"i{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("null", None)], "id string, v array<double>").repartition(3)
    flags = spark.createDataFrame([(f"i{i:03d}", t) for i, t in enumerate(tests)] + [("null", False)], "id string, is_test boolean")
    for block in (1024, 2):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        for limit in (5, 1, None):
            got = {}
            for r in retrieval.dense(queries, vectors, limit, flags, 0.3).collect():
                got.setdefault(r["task_id"], []).append((r["rank"], r["id"]))
            for t in range(9):
                order = sorted(range(300), key=lambda i: (-round(scores[t][i], 6), i))[:limit]
                assert [i for _, i in sorted(got[t])] == [f"i{i:03d}" for i in order]
            assert set(got) == set(range(9))


def test_few_scores_leave_a_task_of_the_dense_search():
    rng = np.random.default_rng(7)
    batches = [pa.RecordBatch.from_pydict({"id": [f"{b}-{i}" for i in range(500)], "v": [x.tolist() for x in rng.normal(size=(500, 4))], "factor": np.ones(500)}) for b in range(6)]
    out = list(retrieval._nearest(pa.array(range(20)), retrieval._unit(rng.normal(size=(20, 4))), 10)(iter(batches)))
    assert sum(b.num_rows for b in out) == 200
