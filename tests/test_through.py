"""Calls by name that aren't written out: against the same calls written out, and what the walks over them move."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import held
from skein.operators import names as N
from tests.test_held import shuffled

SYMBOLS = "id string, name string, file string, start_line int, end_line int, is_test boolean"


def made(spark, seed, n, words, each):
    """Symbols of ten lines, the names that each calls, other edges, and seeds."""
    rng = random.Random(seed)
    ids = [f"d{i:04d}" for i in range(n)]
    rows = [(x, f"w{rng.randrange(words)}", f"f{i % 4}", 10 * i + 1, 10 * i + 9, i % 5 == 0) for i, x in enumerate(ids)]
    symbols = spark.createDataFrame(rows, SYMBOLS).cache()
    calls = spark.createDataFrame([(r[2], r[3] + rng.randrange(9), f"w{rng.randrange(words + 5)}") for r in rows for _ in range(each)] + [("f0", 1, rows[0][1])], "file string, line int, name string").cache()
    kinds = ("CONTAINS", "EXTENDS", "OVERRIDES", "IMPORTS")
    others = spark.createDataFrame(list({(rng.choice(ids), rng.choice(ids), rng.choice(kinds)) for _ in range(n)}), "from_id string, to_id string, kind string").cache()
    seeds = spark.createDataFrame([(t, x, i + 1, rng.random()) for t in range(12) for i, x in enumerate(rng.sample(ids, 1 + t % 4))], "task_id long, id string, rank long, score double").cache()
    return symbols, calls, others, seeds


def through_of(symbols, calls, most=8):
    callers, declared, written = N.calls_through(calls, symbols, most)
    return G.Through(callers, declared, symbols.select("id", "name", "is_test")), written


def test_calls_are_those_that_are_written_out(spark):
    symbols, calls, _, _ = made(spark, 1, 90, 25, 6)
    for most in (3, 20):
        through, written = through_of(symbols, calls, most)
        want = {tuple(r) for r in N.name_calls(calls, symbols, most).collect()}
        got = [tuple(r) for r in through.edges().unionByName(written).collect()]
        assert len(want) > 100 and set(got) == want and written.count() and through.edges().where("from_id = to_id").isEmpty()


@pytest.mark.parametrize("seed, look, links", [(2, 1 << 22, 1 << 26), (3, 7, 1 << 26), (4, 16, 3)])
def test_walks_equal_those_over_written_calls(spark, seed, look, links, monkeypatch):
    for name, value in (("LOOK", look), ("LINKS", links), ("PART", 200 if seed == 3 else held.PART), ("TILE", 300 if seed == 3 else held.TILE), ("DENSE", 1)):
        monkeypatch.setattr(held, name, value)
    symbols, calls, others, seeds = made(spark, seed, 80, 30, 4)
    through, written = through_of(symbols, calls)
    weights = G.weight_table(spark, SAME_FILE=0.2 if seed == 2 else 0.0)
    beside = G.links(symbols, others.unionByName(written), weights).cache()
    whole = G.links(symbols, others.unionByName(N.name_calls(calls, symbols, 8)), weights).cache()
    start = G.restart(seeds, symbols).cache()
    score = lambda df: {(r["task_id"], r["node"]): r["score"] for r in df.collect()}
    want = score(G.pagerank(start, whole))
    assert score(G.pagerank(start, beside, through=through)) == pytest.approx(want, abs=1e-12 if links > 3 else 1e-7)
    rows = lambda df: sorted(map(tuple, df.select("task_id", "node", "why", "level").collect()))
    reached = rows(G.provenance(seeds, whole))
    assert rows(G.provenance(seeds, beside, through=through)) == reached and max(r[3] for r in reached) >= 3
    wanted = start.select("task_id").distinct().crossJoin(symbols.select(F.col("id").alias("node")).where("substring(id, 5, 1) < '4'")).cache()
    assert rows(G.provenance(seeds, beside, wanted=wanted, through=through)) == rows(G.provenance(seeds, whole, wanted=wanted))
    assert {"called-by", "caller-of", "test-of", "seed"} <= {r[2].split(":")[0] for r in reached}


def test_a_name_is_sent_once_for_all_its_pairs(spark):
    """Before, each pair of a caller and a declaration was a row of a link either way: 60,000 here."""
    n, names = 600, 20
    ids = [f"d{i:04d}" for i in range(n)]
    symbols = spark.createDataFrame([(x, f"w{i}" if i < names else f"v{i % names}", "f", i, i, False) for i, x in enumerate(ids)], SYMBOLS)
    callers = spark.createDataFrame([(x, i % names) for i, x in enumerate(ids)] + [(x, (i + 7) % names) for i, x in enumerate(ids)], "id string, r long").cache()
    declared = spark.createDataFrame([(f"t{r:02d}{k}", r) for r in range(names) for k in range(50)], "id string, r long").cache()
    symbols = symbols.unionByName(declared.select("id", F.lit("x").alias("name"), F.lit("g").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(False).alias("is_test"))).cache()
    through = G.Through(callers, declared, symbols.select("id", "name", "is_test"))
    start = spark.createDataFrame([(1, "d0000", 1.0)], "task_id long, node string, mass double").cache()
    beside = G.links(symbols, spark.createDataFrame([], "from_id string, to_id string, kind string"), G.weight_table(spark)).cache()
    whole = beside.unionByName(through.links()).cache()
    assert whole.count() - beside.count() == 2 * 1200 * 50

    def moved(f):
        before = shuffled(spark)
        out = {(r["node"], round(r["score"], 9)) for r in f().collect()}
        return out, shuffled(spark) - before

    (a, most), (b, least) = moved(lambda: G.pagerank(start, whole)), moved(lambda: G.pagerank(start, beside, through=through))
    assert a == b and least < most / 4
