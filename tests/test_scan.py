"""Terms, tokens and lines by classes of bytes: as by matches, and without a match a term."""

import random

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph as G
from skein.operators import retrieval as R
from skein.operators import scan

ODD = [None, "", " ", "a", "HTTPServer2x A1b AB1c aB", "İé𝒳 naïve-Café_x", "one\n\ntwo\n", "x" * 50, "Ab\tCD\r\n9Z9z"]


def texts(n):
    rng = random.Random(n)
    return ODD + ["".join(rng.choice("aAbBZz09_ \n\t\ré𝒳-.") for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(n)]


def test_terms_tokens_and_lines_are_those_of_the_expressions(spark, monkeypatch):
    for piece in (7, 1 << 22):
        monkeypatch.setattr(scan, "PIECE", piece)
        monkeypatch.setattr(scan, "BATCH", 9 * piece)
        d = spark.createDataFrame([(i, t) for i, t in enumerate(texts(400))], "doc_id long, text string").repartition(3)
        listed = d.withColumn("terms", T.terms(F.col("text")))
        bag = lambda index: {(r["doc_id"], r["len"], tuple(sorted(zip(r["terms"], r["tfs"], strict=True)))) for r in index.collect()}
        assert bag(R.index_of_texts(d)) == bag(R.index(listed))
        held = lambda rows: {(r["term"], r["n"], r["n"] <= 5 and tuple(sorted(r["keys"]))) for r in rows.collect()}
        assert held(R.holders_in_texts(d, 5)) == held(R.holders(listed, 5))
        got = d.mapInArrow(scan.named, "doc_id long, name string, tokens int, n_lines int")
        want = listed.select("doc_id", F.try_element_at("terms", F.lit(1)), T.token_count(F.col("text")), F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_symbols_edges_and_index_match_no_term_by_term(spark, monkeypatch):
    """What bfs_why and every ppr_* query read was made by passes of a match a term."""
    from skein.plans import views as V

    def fail(*_):
        raise AssertionError("a match a term")

    monkeypatch.setattr(V.T, "terms", fail)
    monkeypatch.setattr(V.T, "token_count", fail)
    monkeypatch.setattr(V, "stored", lambda spark, name, paths, build: build())
    sf = "/root/testdata/sf0.001"
    assert V.sym(spark, sf).count() == V.index(spark, sf).count() > 0 and V.edg(spark, sf).count() > 0


def test_weighed_links_are_those_with_a_weight(spark):
    symbols = spark.createDataFrame([(x, x, "f", False) for x in "abc"], "id string, name string, file string, is_test boolean")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CONTAINS"), ("c", "a", "IMPORTS")], "from_id string, to_id string, kind string")
    none = dict.fromkeys(G.WEIGHTS, 0.0)
    for changed in ({}, none, {"CALLS": (1.0, 0.0)}, none | {"IMPORTS": 2.0}):
        every = G.links(symbols, edges, G.weight_table(spark, **changed)).where("w <> 0")
        got = G.weighed(symbols, edges, **changed)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
    shuffles = G.weighed(symbols, edges, **none)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (from_id" not in shuffles  # edges without a weight meet no symbol


def test_without_weights_no_edges_are_made(spark, monkeypatch):
    """Scores of ppr_seeds_only are the restart vector; edges were made for it all the same."""
    from skein.plans import graph_queries as GQ

    def fail(*_):
        raise AssertionError("edges")

    monkeypatch.setattr(GQ.V, "edg", fail)
    rows = GQ.ppr_seeds_only(spark, "/root/testdata/sf0.001").collect()
    start = {(r["task_id"], r["node"]) for r in GQ.restart_vector(spark, "/root/testdata/sf0.001").where("mass > 0").collect()}
    assert rows and start <= {(r["task_id"], r["node"]) for r in rows}  # of 20 seeds there, of 400 here
