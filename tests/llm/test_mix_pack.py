import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from skein.llm import common, mixing, packing
from tests.llm.fixtures import corpus, documents, with_id

ROWS = with_id(corpus())


def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    out, left, budget = {}, set(names), 1.5 * sum(sizes.values())
    while left:
        level = (budget - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in left}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return out


def test_mix_meets_targets(spark):
    docs = documents(spark)
    got = mixing.mix(spark, docs).collect()
    again = mixing.mix(spark, docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    rows = {r["doc_id"]: (r["source"], r["text"]) for r in docs.where("doc_id is not null").collect()}
    sizes: dict = {}
    for r in docs.where("doc_id is not null").collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want, taken = brute_targets(sizes), {}
    assert len(got) == len(ROWS)
    for r in got:
        source = r["source"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * r["size"] and sum(p["words"] for p in r["positions"]) == r["taken"]
        assert all(0 <= p["position"] <= 1.0001 for p in r["positions"])
        taken[source] = taken.get(source, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want) and rows


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(spark, documents(spark).limit(0)).count() == 0
    got = mixing.mix(spark, documents(spark, [(1, None), (2, "")])).collect()
    assert [(r["size"], r["taken"]) for r in got] == [(0, 0), (0, 0)]


def test_mix_stage_gives_each_source_its_target(spark):
    """Rows that repeat an id, or all of a row; columns of the names that the operator works with."""
    rows = [(i, f"w{i} " * (i % 40), f"s{i % 3}", i) for i in range(90)] + [(5, "an other text of one id", "s0", 1), (7, "w7 " * 7, "s1", 7), (7, "w7 " * 7, "s1", 7), (200, None, None, 0)]
    docs = spark.createDataFrame([(i, t, s, n, n, n, n) for i, t, s, n in rows], "doc_id long, text string, source string, size long, s long, _at long, _draw long")
    drawn = mixing.mix(spark, docs, row=F.xxhash64("text")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    words: dict = {}
    for r in out.collect():
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
    for r in drawn:
        assert words.get(r["source"], 0) == r["taken"] and abs(r["taken"] - r["target"]) <= 1


def test_curriculum_order_follows_the_schedules(spark):
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    mean = {}
    for r in mixing.mix(spark, docs).collect():
        mean.setdefault(r["source"], []).extend(p["position"] for p in r["positions"])
    assert np.mean(mean["s0"]) < np.mean(mean["s1"]) < np.mean(mean["s2"])


def best_total(counts: dict[int, int], capacity: int) -> int:
    first = max(x for x, n in counts.items() if n)
    reach = {first}
    for x, n in counts.items():
        for _ in range(n - (x == first)):
            reach |= {t + x for t in reach if t + x <= capacity}
    return max(reach)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=8))
def test_each_sequence_is_as_full_as_can_be(counts):
    used = packing.fullest(counts, 30)
    assert sum(x * n for x, n in used) == best_total(counts, 30)
    assert all(n <= counts[x] for x, n in used) and max(counts) in dict(used)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=20))
def test_plan_places_every_piece_once(counts):
    places, held = packing.plan(counts, 64), {}
    for x, runs in places.items():
        ranks = [r[0] for r in runs] + [counts[x]]
        assert ranks[0] == 0 and ranks == sorted(ranks)
        for (rank, sequence, n, offset), end in zip(runs, ranks[1:], strict=True):
            for k in range(end - rank):
                held.setdefault(sequence + k // n, []).append((offset + k % n * x, x))
    for pieces in held.values():
        at = 0
        for offset, x in sorted(pieces):
            assert offset == at
            at += x
        assert at <= 64


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    got = packing.pack(spark, documents(spark)).collect()
    t = Tokenizer.from_file(packing.vocabulary())
    want = []
    for i, text in ROWS:
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want += [(i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())) for p in range(0, len(ids), 2048)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        assert sum(n for _, n in pieces) <= 2048
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0] + [n for _, n in sorted(pieces)][:-1]).tolist()
    assert len(sequences) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack(spark, documents(spark).limit(0)).count() == 0


ODD = ["Don't we'LL say 's foo.'s bar,.x ..", "x<|startoftext|>y <|ENDOFTEXT|>", "É é ǅ ΑΣ. İstanbul ﬁ ½ a b c \x1c d\x85e ×a. ÷. Ã—.", "日本語 text、です", "e.g. a--b 12.5% $x_y ''", "", "  ", "Å Ω ŉ ſ K", "àb é. É.", "<|endoftext|> a.", "nbsp here. ß.,. ÿ,"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=40)), min_size=1, max_size=4))
def test_tokens_equal_the_tokenizer_s(texts):
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, at = packing.token_ids(pa.array(texts), path)
    t = Tokenizer.from_file(path)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_units_of_one_hash_are_told_apart(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    plain = "a"
    for _ in range(11):
        plain += plain.translate(str.maketrans("ab", "ba"))
    pair = [plain, plain.translate(str.maketrans("ab", "ba"))]
    same = lambda texts: [ids[at[i] : at[i + 1]].tolist() for ids, at in [packing.token_ids(pa.array(texts), packing.vocabulary())] for i in range(len(texts))]
    assert same(pair) == [t.encode(x, add_special_tokens=False).ids for x in pair]
    real = common.hash_tokens
    monkeypatch.setattr(common, "hash_tokens", lambda *a: real(*a) % np.uint64(5))
    monkeypatch.setattr(packing, "_caches", {})
    texts = ["the quick brown fox jumps, over the lazy dog.", "zebras cross again and again", "x y z the fox"]
    for _ in range(2):
        assert same(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < 3:  # filters: rows stay as they are
            assert out.exceptAll(docs).count() == 0 and 0 < out.count() <= docs.count()
        docs = out
    assert sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect()))


def test_pipeline_stages_on_odd_rows(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, "").count() > 0, name
        assert stage(spark, docs.limit(0), "").count() == 0, name


def brute_components(texts: dict) -> dict:
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_pipeline_equals_brute_force(spark):
    """Stage by stage in plain Python, but for the classifier: its scores are taken as they are, its decision is not."""
    import hashlib

    from tokenizers import Tokenizer

    from skein.llm import quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: (r["text"] or "", r["source"]) for r in docs.collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.score(spark, docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    kept = {i: x for i, x in rows.items() if scores[i] >= 0.3}
    groups: dict = {}
    for i, (t, _) in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    kept = {min(g)[1]: kept[min(g)[1]] for g in groups.values()}
    root = brute_components({i: t for i, (t, _) in kept.items()})
    kept = {i: x for i, x in kept.items() if root[i] == i}
    sizes: dict = {}
    words = {i: re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t) for i, (t, _) in kept.items()}
    for i, (_, s) in kept.items():
        sizes[s] = sizes.get(s, 0) + len(words[i])
    t, want = Tokenizer.from_file(packing.vocabulary()), []
    for s, target in brute_targets(sizes).items():
        owed, mine = round(target), sorted((i for i in kept if kept[i][1] == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        while owed > 0 and sizes[s]:
            for i in mine:
                n = min(owed, len(words[i]))
                owed -= n
                if n:
                    ids = t.encode("".join(words[i][:n]) if n < len(words[i]) else kept[i][0], add_special_tokens=False).ids + [0]
                    want += [(i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())) for p in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    held: dict = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(held) <= -(-sum(w[3] for w in want) // 2048) + 1
