"""Ranked search against scores of all documents in plain Python; WAND against the same with other bounds."""

import collections
import math
import random
import re

import numpy as np
import pytest

from skein.llm import queries, wand
from tests.llm.fixtures import corpus, documents, with_id

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items, k=50):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n_docs, length = len(docs), sum(len(t) for _, t in docs)
    df = collections.Counter(x for _, t in docs for x in set(t))
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        rows = []
        for doc_id, t in docs:
            tf, m = collections.Counter(t), 50 + 50 * len(t) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 20 * m)) for w in words if tf[w])
            if score > 0:
                rows.append((-score, doc_id))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


ITEMS = [(1, "w1 w2 W3, w4! w5-w6"), (2, "w7 w8 w7 word"), (2, "more of w9"), (3, None), (4, ""), (5, "absent term"), (None, "w1"), (6, "É é one TWO three"), (7, " ".join(f"w{i}" for i in range(300))), (8, "the"), (9, "ab" * 40_000)]
DOCS = corpus() + [(30_000 + i, "w1 w2 tie") for i in range(70)] + [(40_000, "É"), (40_001, "a_b@c 1,000"), (5, "w1 w2 tie"), (40_002, "x" * 10 + "\x7f" + "w1")]


def benchmark(spark, rows=None):
    return spark.createDataFrame([(i, t, "x", "9") for i, t in (ITEMS if rows is None else rows)], "item_id long, text string, term string, rank string").repartition(2)


@pytest.mark.parametrize("block, shard", [(1 << 17, 1 << 16), (4, 20)])
def test_every_ranking_equals_that_of_all_scores(spark, tmp_path, block, shard, monkeypatch):
    monkeypatch.setattr(wand, "BLOCK", block)
    monkeypatch.setattr(wand, "SHARD_DOCS", shard)
    documents(spark, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op11_wand(spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == ranking(with_id(DOCS), ITEMS)


def test_a_filter_that_lets_much_through_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(wand, "PLACES", 2)
    got = wand.rank(spark, documents(spark, DOCS), benchmark(spark), 7)
    assert sorted(map(tuple, got.collect())) == ranking(with_id(DOCS), ITEMS, 7)


@pytest.mark.parametrize("docs, items", [([], ITEMS), ([(1, None), (2, "..")], ITEMS), (DOCS, [])])
def test_empty_tables(spark, docs, items):
    assert wand.rank(spark, documents(spark, docs), benchmark(spark, items)).collect() == []


def test_wand_finds_the_best_and_scores_few():
    rng = np.random.default_rng(4)
    n, n_terms = 20_000, 40
    doc, term = [], []
    for t in range(n_terms):
        held = np.flatnonzero(rng.random(n) < 0.002 * 1.18**t)
        doc.append(held)
        term.append(np.full(len(held), t))
    doc, term = np.concatenate(doc), np.concatenate(term)
    impact = (rng.integers(1, 100, len(doc)) * 1.1 ** (n_terms - term)).astype(np.int64) + 1
    ids = rng.permutation(n) // 2  # ids come twice
    shard = wand.Shard(ids, n_terms, doc, term, impact, window=512)
    for k in (1, 10, 50):
        asked = np.array(random.Random(k).sample(range(n_terms), 15))
        total = np.zeros(n, np.int64)
        np.add.at(total, doc, np.where(np.isin(term, asked), impact, 0))
        want = np.lexsort((ids, -total))[:k]
        shard.scored = 0
        empty = np.zeros(0, np.int64)
        scores, found = shard.search(asked, (empty, empty), k)
        assert scores.tolist() == total[want].tolist() and found.tolist() == ids[want].tolist()
        assert shard.scored < 0.2 * np.count_nonzero(total)
        again = shard.search(asked, (scores, found), k)  # a heap that is full of better ones
        assert again[0][0] == scores[0]
