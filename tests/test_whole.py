"""Queries that ask for every task, and other inputs on which a part of the job used to be left out."""

import pytest
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import incremental as I
from skein.plans import views as V
from skein.plans.registry import ORACLES, QUERIES
from tests.test_oracles import SF


@pytest.mark.parametrize("name", ["bfs_why", "files_first_hit", "chunk_bm25_pack", "repo_map_edges", "repo_map_rank", "repo_map_defs"])
def test_every_task_is_asked_for(spark, name):
    tasks = {r["task_id"] for r in QUERIES[name](spark, SF).select("task_id").distinct().collect()}
    assert len(tasks) > 10 and tasks == {r["item_id"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").collect()}


def test_no_query_of_a_part_is_registered():
    assert not [n for n in QUERIES if n.endswith("_all") and n != "links_all"]
    assert not [n for n, sql in ORACLES.items() if "task_id <" in sql or "l_orderkey <" in sql or "pos % 10 = 0" in sql]


def test_walks_and_closures_of_long_chains(spark):
    n = 151
    nodes = [f"n{i:04d}" for i in range(n)]
    links = spark.createDataFrame([(a, b, 1.0, "next", "1") for a, b in zip(nodes, nodes[1:])], "src string, dst string, w double, reason string, ord string")
    seen = G.provenance(spark.createDataFrame([(1, nodes[0], 1)], "task_id long, id string, rank long"), links).collect()
    assert sorted((r["node"], r["level"]) for r in seen) == [(x, i) for i, x in enumerate(nodes)]
    edges = spark.createDataFrame([(a, b, "CONTAINS") for a, b in zip(nodes, nodes[1:])], "from_id string, to_id string, kind string")
    assert G.descendants(edges).count() == n * (n - 1) // 2
    some = spark.createDataFrame([(nodes[110],), (nodes[150],)], "id string")
    assert {(r["id"], r["descendant"]) for r in G.descendants(edges, some).collect()} == {(nodes[110], x) for x in nodes[111:]}
    (up,) = G.ancestors(edges, some.where(F.col("id") == nodes[150])).collect()
    assert up["ancestors"] == nodes[:150]


def test_each_task_stops_at_its_own_round(spark):
    """A task whose mass has nowhere to go is done at once; another's goes on."""
    start = spark.createDataFrame([(1, "lone", 1.0), (2, "a", 1.0)], "task_id long, node string, mass double")
    moves = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, w double")
    got = {(r["task_id"], r["node"]): r["score"] for r in G.pagerank(start, moves, iterations=200).collect()}
    total = sum(0.85**k for k in range(3))
    assert got[1, "lone"] == 1.0 and all(abs(got[2, x] - 0.85**k / total) < 1e-6 for k, x in enumerate("abc"))


def test_diffs_of_all_line_items(spark, tmp_path):
    """A supplier's item in an order is one hunk: lines of the old side, but for files made anew."""
    want = set()
    header: dict[tuple, str] = {}
    late = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") + 1000)
    late.write.parquet(f"{tmp_path}/lineitem.parquet")
    items = late.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").collect()
    for s, o, n, p, q in sorted(items, key=lambda r: (r[1], r[2])):
        header[s, o] = "" if n == 3 else f"src{p % 5}/{'test/T' if n == 2 else 'F'}{p % 7}.kt"
        if header[s, o]:
            count = 1 if n == 1 else int(q % 4)
            want |= {(f"{s}/{o}", header[s, o], line) for line in (range(p, p + count) if count else (p, p + 1))}
    got = QUERIES["diff_lines"](spark, str(tmp_path)).select("key", "file", "line").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(int(k.split("/")[1]) >= 2000 for k, _, _ in want)
    files = QUERIES["test_path_filter"](spark, str(tmp_path)).select("key", "file").collect()
    assert sorted(map(tuple, files)) == sorted({(k, f) for k, f, _ in want if "/test" not in f})
    assert 0 < QUERIES["mined_tasks"](spark, str(tmp_path)).count() <= 40


@pytest.mark.parametrize("name", ["arm_bm25_stubs", "chunk_embed_pack"])
def test_packs_have_every_task(spark, name):
    tasks = QUERIES[name](spark, SF).select("task_id").distinct().count()
    assert tasks == spark.read.parquet(f"{SF}/benchmark.parquet").count()


def test_gold_of_more_passages_than_10_000(spark, tmp_path):
    texts = [f"p{i} passage number n{i} of\tmany q{i} here" if i % 50 else f"short{i}x\n" for i in range(10_100)]
    held = [*range(0, 10_100, 97), 10_099, 10_050]
    docs = [(i, f"some words zz{texts[i]}yy and more") for i in held] + [(20_000, None), (20_001, "")]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, V.gold(spark, str(tmp_path)).select("task_id", "id").collect()))
    assert got == sorted({(t, f"d{i:07d}") for i, text in docs if text for t, passage in enumerate(texts) if passage in text})


def test_roots_under_more_exclusions_than_10_000(spark):
    excluded = [f"/r/{i:05d}" for i in range(10_100)] + [""]
    paths = [f"/r/{i:05d}{end}" for i in range(0, 10_100, 50) for end in ("", "/a/b", "x")] + ["other", None, "/r", "r//a"]
    roots = spark.createDataFrame([(p,) for p in paths], "path string")
    for some in (excluded, excluded[:-1], ["r/"]):
        got = I.without_excluded(roots, spark.createDataFrame([(x,) for x in some], "path string")).collect()
        want = [p for p in paths if p is None or not any(p == x or p.startswith(x + "/") for x in some)]
        assert sorted(str(r["path"]) for r in got) == sorted(map(str, want))
