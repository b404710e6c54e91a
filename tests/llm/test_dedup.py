import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import exactdedup, graph, ngramjoin, suffixdedup
from skein.llm.common import Scratch
from tests.llm.fixtures import corpus, documents, with_id

ROWS = with_id(corpus())


def test_directory_doubles_where_a_bucket_is_as_deep():
    d = exactdedup.Directory(capacity=1, depth=1)
    d.split([(1, 0)])
    assert d.depth == 2 and d.buckets == [(2, 0), (2, 1), (1, 1)]
    d.split([(1, 1)])  # less deep than the directory: no doubling
    assert d.depth == 2 and len(d.buckets) == 4
    assert [d.bucket(k << 62) for k in range(4)] == [0, 1, 2, 3]


def test_index_buckets_hold_their_ranges_and_no_more(spark):
    """Keys crowd under one prefix of 40 bits; one key stands in more entries than a bucket holds."""
    keys = [(1 << 63) + i for i in range(64)] + [k << 55 for k in range(1, 100)] + [7] * 50
    rows = [(i, f"s{i}", k - (1 << 64) if k >> 63 else k) for i, k in enumerate(keys)]
    reps = spark.createDataFrame(rows, "copy_of long, copy_sha string, key long")
    directory, index = exactdedup.build_index(spark, reps, Scratch(spark, "test"), capacity=8)
    assert sorted((r["copy_of"], r["copy_sha"], r["key"]) for r in index.collect()) == sorted(rows)
    held = collections.defaultdict(list)
    for r in index.collect():
        held[r["start"] % 2**64, r["depth"]].append(r["key"] % 2**64)
    for (start, depth), inside in held.items():
        assert directory.buckets[directory.bucket(inside[0])] == (depth, start >> (64 - depth) if depth else 0)
        assert all(k >> (64 - depth) == start >> (64 - depth) for k in inside if depth)
        assert len(inside) <= 8 or len(set(inside)) == 1
    assert max(directory.buckets)[0] == directory.depth == 61


@pytest.mark.parametrize("capacity, chain", [(4, 2), (1 << 15, 4096)])
def test_exact_dedup_through_small_buckets_and_long_chains(spark, capacity, chain, monkeypatch):
    monkeypatch.setattr(exactdedup, "REMEMBERED", 0)
    rows = [(i, f"text {i % 7}" + " " * (i % 5)) for i in range(150)] + [(200 + i, f"own {i}") for i in range(40)]
    got = exactdedup.copies(spark, documents(spark, rows).repartition(9), capacity, chain).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t.replace(" ", "")].append((-len(t), i))
    want = sorted((i, min(m)[1], len(m), i == min(m)[1]) for m in groups.values() for _, i in m)
    assert sorted(tuple(r)[:4] for r in got) == want


def test_a_directory_that_sends_keys_astray_loses_copies(spark, monkeypatch):
    rows = [(i, "the same") for i in range(40)]
    real = exactdedup._routed
    monkeypatch.setattr(exactdedup, "REMEMBERED", 0)
    monkeypatch.setattr(exactdedup, "_routed", lambda starts, depths: real(np.array([0], np.uint64), depths))
    docs = documents(spark, rows).repartition(8)
    assert exactdedup.copies(spark, docs).where("kept").count() == 1
    spread = lambda batches: (pa.RecordBatch.from_arrays([*b.columns, b.column("copy_of"), pa.array([0] * b.num_rows, pa.int32())], names=[*b.schema.names, "start", "depth"]) for b in batches)
    monkeypatch.setattr(exactdedup, "_routed", lambda starts, depths: spread)
    assert exactdedup.copies(spark, docs).where("kept").count() > 1


def test_exact_dedup_equals_brute_force(spark):
    got = exactdedup.copies(spark, documents(spark)).collect()
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    want = []
    for body, members in groups.items():
        keep = min(members)[1]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(body.encode()).hexdigest()) for _, i in members]
    assert sorted(map(tuple, got)) == sorted(want)


def test_keys_that_collide_are_told_apart_by_their_bytes():
    rows = pa.record_batch([pa.array([0] * 3), pa.array([7] * 3), pa.array([0] * 3), pa.array([1, 2, 3]), pa.array(["a", "b", "c"]), pa.array([b"x", b"y", b"x"])], names=["start", "key", "part", "copy_of", "copy_sha", "body"])
    (out,) = exactdedup._chains([rows])
    assert out.column("head_of").to_pylist() == [1, 2, 1] and out.column("body").to_pylist() == [b"x", b"y", None]


def test_exact_dedup_stage_tells_rows_of_one_id_apart(spark):
    rows = [(1, "kept text"), (1, "an other"), (2, "an other, no"), (3, "an  other"), (4, "kept  text "), (4, "alone"), (4, "alone")]
    out = exactdedup.stage(spark, documents(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, out)) == sorted([(4, "kept  text "), (4, "alone"), (3, "an  other"), (2, "an other, no")])


def test_exact_dedup_stage_keeps_columns(spark):
    docs = documents(spark)
    out = exactdedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    bodies = len({re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in ROWS})
    assert out.select("doc_id").distinct().count() == bodies == out.count()


@pytest.mark.parametrize("f", [exactdedup.copies, suffixdedup.remove_repeats, ngramjoin.near_duplicates])
def test_empty_table(spark, f):
    assert f(spark, documents(spark).limit(0)).collect() == []


CONTRACT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute_repeats(texts: list[bytes], window: int) -> list[tuple]:
    seen = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        spans = suffixdedup.merged([(i, i + window) for i in range(len(t) - window + 1) if seen[t[i : i + window]] > 1])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + t[at:a], b
        out.append((len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + t[at:]).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark):
    rows = [(i, t[:6000]) for i, t in ROWS]
    got = sorted(map(tuple, suffixdedup.remove_repeats(spark, documents(spark, rows)).select(CONTRACT).collect()))
    want = sorted((i, *r) for (i, _), r in zip(rows, brute_repeats([t.encode() for _, t in rows], 400), strict=True))
    assert got == want and any(r[2] for r in want)


def test_suffix_dedup_over_random_bytes_and_other_windows(spark):
    rng = random.Random(9)
    rows = []
    pool = ["".join(rng.choices("ab", k=rng.randint(80, 300))) for _ in range(12)]
    for i in range(60):
        rows.append((i, "".join(rng.choice(pool)[rng.randint(0, 60) :] for _ in range(3))))
    got = sorted(map(tuple, suffixdedup.remove_repeats(spark, documents(spark, rows), window=120, lead=16).select(CONTRACT).collect()))
    assert got == sorted((i, *r) for (i, _), r in zip(rows, brute_repeats([t.encode() for _, t in rows], 120), strict=True))


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, (5000, 4)).astype(np.uint64)
    order = suffixdedup.multikey_quicksort(tokens, small=16)
    assert sorted(order.tolist()) == list(range(5000))
    assert tokens[order].tolist() == sorted(tokens.tolist())


def brute_components(rows) -> set[tuple]:
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets: dict[int, list[set]] = collections.defaultdict(list)
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[i].append(s)
        out.append((i, len(s)))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {(i, n, find(i)) for i, n in out}


def test_ngram_join_equals_brute_force(spark):
    got = ngramjoin.near_duplicates(spark, documents(spark)).collect()
    assert len(got) == len(ROWS)
    assert set(map(tuple, got)) == brute_components(ROWS)


def test_words_of_one_polynomial_hash_are_told_apart(spark):
    plain = "a"
    for _ in range(11):
        plain += plain.translate(str.maketrans("ab", "ba"))
    pair = [plain, plain.translate(str.maketrans("ab", "ba"))]
    rows = [(i, " ".join([w] * 5)) for i, w in enumerate(pair)]
    assert set(map(tuple, ngramjoin.near_duplicates(spark, documents(spark, rows)).collect())) == {(0, 1, 0), (1, 1, 1)}


def test_ngram_join_with_frequent_shingles_and_wide_entries(spark, monkeypatch):
    """Many members of one group, far apart from one another, and texts of little but shared sentences."""
    monkeypatch.setattr(ngramjoin, "NARROW", 4)
    monkeypatch.setattr(ngramjoin, "MEMBERS", 16)
    monkeypatch.setattr(ngramjoin, "LIST", 5)
    rng = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    base, lines = rng.choices(words, k=60), [" ".join(rng.choices(words, k=9)) for _ in range(6)]
    rows = []
    for i in range(70):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(t)))
    for i in range(70, 130):
        rows.append((i, " ".join(rng.sample(lines, rng.randint(1, 4)))))
    got = ngramjoin.near_duplicates(spark, documents(spark, rows)).collect()
    assert set(map(tuple, got)) == brute_components(rows)


def test_prefixes_of_linked_sets_share_an_entry():
    rng = np.random.default_rng(4)
    levels = np.zeros(1 << ngramjoin.BUCKET_BITS, np.uint8)
    frequent = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    levels[(frequent >> np.uint64(64 - ngramjoin.BUCKET_BITS)).astype(np.int64)] = ngramjoin.TOP
    checked = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        n_often = int(rng.integers(0, n + 1))
        x = np.unique(np.concatenate([rng.choice(frequent, n_often, replace=False), rng.integers(0, 2**63, n - n_often).astype(np.uint64)]))
        drop, more = int(rng.integers(0, len(x) // 4 + 1)), int(rng.integers(0, len(x) // 4 + 1))
        y = np.unique(np.concatenate([rng.choice(x, len(x) - drop, replace=False), rng.choice(frequent, more // 2, replace=False), rng.integers(0, 2**63, more - more // 2).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if ngramjoin.links(both, len(x), len(y)):
            checked += 1
            assert len(np.intersect1d(ngramjoin.entries(x, levels), ngramjoin.entries(y, levels)))
    assert checked > 300


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (2, 1)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {tuple(r) for r in got} == {(i, 1) for i in range(1, 41)} | {(i, 100) for i in range(100, 130)}
