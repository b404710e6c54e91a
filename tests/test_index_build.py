"""How the index of the given tables is made: rare terms without moving all postings, places in a file without moving texts."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import retrieval as R
from skein.plans import views as V
from tests.test_held import shuffled


def test_holders_of_few_and_of_many(spark):
    rng = random.Random(3)
    docs = [(i, [rng.choice(f"abcdefghij{'kl' * (i % 9 == 0)}") * rng.randint(1, 4) for _ in range(rng.randint(0, 12))]) for i in range(60)] + [(60, None), (61, ["once"])]
    want = {}
    for i, terms in docs:
        for t in set(terms or []):
            want.setdefault(t, set()).add(i)
    for partitions in (1, 7):
        got = {r["term"]: r for r in R.holders(spark.createDataFrame(docs, "doc_id long, terms array<string>").repartition(partitions), 5).collect()}
        assert {t for t, ids in want.items() if len(ids) <= 5} == {t for t, r in got.items() if r["n"] <= 5}
        for t, ids in want.items():
            if len(ids) <= 5:
                assert sorted(got[t]["keys"]) == sorted(ids) and got[t]["n"] == len(ids)


def test_symbols_and_edges_move_no_texts(spark, tmp_path):
    """Before, each text went to the task of its source, with its lines, and each of its words twice."""
    words = [f"w{i:04d}" for i in range(3000)]
    rng = random.Random(5)
    docs = [(i, "\n".join(" ".join(rng.choices(words, k=20)) for _ in range(20)), "en", f"s{i % 3}", 0) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = shuffled(spark)
    symbols = V.sym(spark, str(tmp_path)).collect()
    assert V.edg(spark, str(tmp_path)).where("kind = 'CONTAINS'").count() == 396
    assert shuffled(spark) - before < 400_000
    at = {}
    for s in sorted(symbols, key=lambda s: s["pos"]):
        start = at.get(s["file"], 0) + 1
        assert (s["start_line"], s["end_line"]) == (start, start + 19)
        at[s["file"]] = start + 20
    assert [s["id"] for s in symbols if s["is_test"]] == ["d0000007"]


def test_the_best_of_bm25_are_those_of_all_scores(spark, monkeypatch):
    """Before, every (task, document) that shares a word was shuffled, whatever the limit."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, rng.choices(words, k=rng.randint(0, 30))) for i in range(500)]
    docs += [(500 + i, docs[3][1]) for i in range(60)] + [(600, None)]  # ties
    queries = [(t, w) for t in range(30) for w in rng.choices([*words, "nowhere"], k=6)]
    d = spark.createDataFrame(docs, "doc_id long, terms array<string>").repartition(5)
    q = spark.createDataFrame(queries, "task_id long, term string")
    factors = spark.createDataFrame([(i, 0.3) for i in range(0, 600, 4)], "doc_id long, factor double")
    index = R.index(d).cache()
    whole = R.bm25(*R.postings(index), q).join(factors, "doc_id", "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0))).select("task_id", "doc_id", "score")
    show = lambda df: sorted((r["task_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in R.ranked(df, 7).collect())
    want = show(whole)
    for block, few in ((1024, 1 << 20), (4, 3)):
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        monkeypatch.setattr(R, "FACTORS", few)
        best = R.bm25_best(index, q, 7, factors)
        assert show(best) == want
    assert show(R.bm25_best(index, q, 7)) == show(R.bm25(*R.postings(index), q))
    assert best.count() <= 1.1 * 30 * 7 * 5  # partitions
    assert R.bm25_best(R.index(d.where("doc_id = 600")), q, 7).count() == 0


def test_the_densest_are_those_of_all_scores(spark):
    """Many copies, which tie, and sizes that round scores apart: what leaves the partitions holds the best of all, and is few."""
    rng = random.Random(5)
    docs = [(i, ["copy", "of", "one"] if i % 3 == 0 else [rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(1, 9))]) for i in range(1200)] + [(1200, [])]
    sizes = [(i, f"d{i:07d}", float(rng.randrange(1, 40)) if i % 3 else 3.0, 1.0 + rng.random()) for i, _ in docs]
    asked = [(t, w) for t in range(4) for w in [rng.choice("abcdefgh") * 2 for _ in range(3)] + ["copy"] * (t % 2)]
    docs = spark.createDataFrame(docs, "doc_id long, terms array<string>").repartition(3)
    sizes = spark.createDataFrame(sizes, "doc_id long, id string, x double, y double")
    queries = spark.createDataFrame(asked, "task_id long, term string")
    index = R.index(docs).localCheckpoint()
    every = R.bm25(*R.postings(index), queries).join(sizes, "doc_id")
    every = every.select("task_id", "id", "score", F.inline(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("size")) for c in "xy"))))
    found = R.bm25_densest(index, queries, 10, sizes, ["x", "y"])

    def best(rows):
        rows = rows.withColumn("density", F.round(F.round("score", 6) / F.col("size"), 9))
        nth = F.row_number().over(Window.partitionBy("task_id", "of").orderBy(F.desc("density"), "id"))
        return sorted(map(tuple, rows.withColumn("nth", nth).where("nth <= 10").select("task_id", "of", "nth", "id", "density").collect()))

    assert best(found) == best(every) and len(best(every)) == 80
    assert found.count() < every.count() / 4
