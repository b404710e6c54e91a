"""Walks that hold the graph: against plain Python, against the walks in blocks, and what they move."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import held
from tests.test_blocks import MOVES, START, plain_reach, plain_walk


def shuffled(spark):
    """Bytes that all stages so far have written for a shuffle."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def random_graph(seed, n, links):
    rng = random.Random(seed)
    nodes = [f"file:{i}" if i % 25 == 0 else f"n{i:05d}" for i in range(n)]
    moves = {(rng.choice(nodes[: n - n // 9]), rng.choice(nodes)): rng.choice([1.0, 0.5, 0.8, 2.3]) for _ in range(links)}
    moves |= {(nodes[0], x): 1.0 for x in nodes}
    start = {t: {x: 1 / k for x in rng.sample(nodes + ["apart"], k)} for t in range(0, 90, 2) for k in [rng.randint(1, 5)]}
    return nodes, moves, start


def frames(spark, moves, start):
    return spark.createDataFrame([(a, b, w) for (a, b), w in moves.items()], MOVES), spark.createDataFrame([(t, x, m) for t, ms in start.items() for x, m in ms.items()], START)


@pytest.mark.parametrize("part, chunk, codes", [(40, 7, 256), (1 << 17, 1 << 15, 2)])
def test_scores_equal_each_task_by_itself(spark, part, chunk, codes, monkeypatch):
    for name, value in (("PART", part), ("CHUNK", chunk), ("CODES", codes), ("LOOK", 16)):
        monkeypatch.setattr(held, name, value)
    _, moves, start = random_graph(part, 60, 200)
    m, s = frames(spark, moves, start)
    got = {(r["task_id"], r["node"]): r["score"] for r in held.walk(s, m, 0.85, 9, None).collect()}
    assert got == pytest.approx(plain_walk(start, moves, {}, 0.85, 9), abs=1e-12)


def test_graphs_that_do_not_fit_are_walked_in_blocks(spark, monkeypatch):
    _, moves, start = random_graph(5, 40, 90)
    m, s = frames(spark, moves, start)
    links = m.withColumns({"reason": F.concat("src", "dst"), "ord": F.col("dst")})
    seeds = s.select("task_id", F.col("node").alias("id"), F.lit(1).alias("rank"))
    wanted = s.select("task_id").distinct().crossJoin(m.select(F.col("dst").alias("node")).distinct().limit(9))

    def both():
        scores = {(r["task_id"], r["node"]): r["score"] for r in G.pagerank(s, m).collect()}
        return scores, *(sorted(map(tuple, G.provenance(seeds, links, wanted=w).collect())) for w in (None, wanted))

    here = both()
    monkeypatch.setattr(held, "LINKS", 3)
    assert held.walk(s, m, 0.85, 3, None) is None
    there = both()
    assert here[0] == pytest.approx(there[0], abs=1e-7) and here[1:] == there[1:]
    assert set(here[2]) < set(here[1]) and here[2]


def test_reasons_look_at_few_links_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(held, "LOOK", 5)
    monkeypatch.setattr(held, "PART", 16)
    rng = random.Random(4)
    nodes = [f"n{i:03d}" for i in range(80)]
    rows = sorted({(rng.choice(nodes[:70]), f"{rng.randrange(10**6):06d}", rng.choice(nodes)) for _ in range(220)})
    links = {}
    for a, o, b in rows:
        links.setdefault(a, []).append((b, f"{o}>{b}"))
    seeds = {t: rng.sample(nodes + ["apart"], 3) for t in range(0, 40, 2)}
    df = spark.createDataFrame([(a, b, 1.0, f"{o}>{b}", o) for a, o, b in rows], "src string, dst string, w double, reason string, ord string")
    at = spark.createDataFrame([(t, x, i) for t, xs in seeds.items() for i, x in enumerate(xs)], "task_id long, id string, rank long")
    assert {(r["task_id"], r["node"]): (r["why"], r["level"]) for r in G.provenance(at, df).collect()} == plain_reach(seeds, links)


def test_with_a_limit_the_best_are_the_same(spark):
    from skein.plans.graph_queries import best

    _, moves, start = random_graph(8, 300, 900)
    m, s = frames(spark, moves, start)
    want = sorted(map(tuple, best(G.pagerank(s, m), 7).collect()))
    some = G.pagerank(s, m, limit=7, hidden="file:")
    assert sorted(map(tuple, best(some, 7).collect())) == want
    assert some.count() < 2 * len(want)


def test_scores_between_two_roundings_stay():
    nodes, score = np.arange(9), np.array([5e-7, 4e-6, 3e-6, 2.5e-6, 2e-6, 2e-6, 2e-6, 1e-6, 9e-6])
    assert held._best(nodes, score, nodes != 8, 3).tolist() == [0, 1, 2, 3, 4]


def test_walks_move_little_between_rounds(spark):
    """Links that lead anywhere: a row a link, block and round would be over 100 MB here."""
    rng = np.random.default_rng(1)
    pairs = {(f"n{a:05d}", f"n{b:05d}"): 1.0 for a, b in rng.integers(0, 3000, (20_000, 2))}
    start = {t: {f"n{t:05d}": 1.0} for t in range(64)}
    m, s = frames(spark, pairs, start)
    before = shuffled(spark)
    assert G.pagerank(s, m, limit=20).count() >= 64 * 20
    assert shuffled(spark) - before < 10_000_000
