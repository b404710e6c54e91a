"""SimHash near-dedup against all pairs, and the trie join against all pairs of words."""

import random
import re

import numpy as np
import pytest
import xxhash

from skein.llm import queries, simhash, trie
from tests.llm.fixtures import corpus, documents, with_id


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(words, budget=3):
    """The least index that links lead to, of every word."""
    label = list(range(len(words)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(words)):
        for k in range(i):
            if (words[i] ^ words[k]).bit_count() <= budget:
                a, b = sorted((top(i), top(k)))
                label[b] = a
    return [top(i) for i in range(len(words))]


def crowd(rng, n, flips, base=None):
    base = rng.getrandbits(64) if base is None else base
    out = []
    for _ in range(n):
        w = base
        for b in rng.sample(range(64), rng.randint(0, flips)):
            w ^= 1 << b
        out.append(w)
    return out


def sets():
    rng = random.Random(5)
    yield [0]
    yield [0, 2**64 - 1]
    yield [rng.getrandbits(64) for _ in range(300)] + crowd(rng, 60, 5)
    yield crowd(rng, 200, 3) + crowd(rng, 100, 6, 0) + crowd(rng, 100, 6, 2**64 - 1)
    yield list(range(256))
    yield [(1 << k) - 1 for k in range(0, 65, 3)] + [(1 << k) - 1 for k in range(1, 64, 7)]


@pytest.mark.parametrize("chunk", [3, 1 << 17])
@pytest.mark.parametrize("words", [sorted(set(s)) for s in sets()])
def test_trie_join_finds_all_pairs_and_classes(words, chunk, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    a = np.array(words, np.uint64)
    for budget in (0, 3):
        i, k = trie.pairs(trie.Trie(a), trie.Trie(a[::3]), budget)
        want = {(x, y) for x in range(len(words)) for y in range(0, len(words), 3) if (words[x] ^ words[y]).bit_count() <= budget}
        assert sorted(zip(i.tolist(), (3 * k).tolist(), strict=True)) == sorted(want)
    assert trie.classes(a, a[:0], True, 3).tolist() == components(words)


def test_guests_link_with_hosts_alone():
    own, guests = np.array([15 << 8, 7 << 40], np.uint64), np.array([1, 2, 7 << 40 | 1], np.uint64)
    labels = trie.classes(np.sort(own), guests, False, 3)
    assert labels.tolist() == [0, 1, 2, 3, 1]  # two guests a bit or two apart stay apart here


def test_prefixes_of_a_trie_reach_as_far_as_the_shorter_one():
    words, depths = np.array([0, 1 << 63, 3 << 62], np.uint64), np.array([1, 2, 2])
    t = trie.Trie(words, depths)
    for budget, want in ((0, 3), (1, 9)):
        assert len(trie.pairs(t, t, budget)[0]) == want
    t = trie.Trie(np.array([0, 1 << 60, 15 << 60], np.uint64), np.array([4, 4, 4]))
    assert len(trie.pairs(t, t, 3)[0]) == 7


@pytest.mark.parametrize("prefixes, guests", [(64, 6), (4, 1), (400, 2)])
def test_components_equal_all_pairs(spark, prefixes, guests, monkeypatch):
    monkeypatch.setattr(simhash, "PREFIXES", prefixes)
    monkeypatch.setattr(simhash, "GUESTS", guests)
    rng = random.Random(prefixes)
    words = [rng.getrandbits(64) for _ in range(200)] + crowd(rng, 150, 6) + crowd(rng, 60, 4, 0)
    for w in words[:40]:
        words.append(w ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    words = list(dict.fromkeys(words))
    nodes = spark.createDataFrame([((w - (1 << 64) if w >> 63 else w), i) for i, w in enumerate(words)], "print long, least long")
    from skein.llm.common import Scratch

    got = {r["node"] % 2**64: r["component"] % 2**64 for r in simhash.linked_classes(spark, nodes, Scratch(spark, "test")).collect()}
    label = components(words)
    groups, want = {}, {}
    for w, c in zip(words, label, strict=True):
        want.setdefault(c, set()).add(w)
        groups.setdefault(got.get(w, w), set()).add(w)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_prefixes_cover_all_and_none_is_too_full(spark):
    rng = random.Random(8)
    words = list({*(rng.getrandbits(64) for _ in range(500)), *crowd(rng, 3000, 5), *range(200)})
    nodes = spark.createDataFrame([((w - (1 << 64) if w >> 63 else w),) for w in words], "print long")
    starts, depths = simhash.upper(nodes, len(words))
    held = np.bincount(np.searchsorted(starts, np.array(words, np.uint64), side="right") - 1, minlength=len(starts))
    assert held.min() > 0 and held.max() <= max(32, -(-len(words) // simhash.PREFIXES))
    for w in words:
        at = int(np.searchsorted(starts, np.uint64(w), side="right")) - 1
        assert w >> (64 - int(depths[at])) == int(starts[at]) >> (64 - int(depths[at]))


def test_query_equals_all_pairs_on_odd_rows(spark, tmp_path):
    extra = [(20_000 + i, t) for i, t in enumerate(["a b", "A  B", "a\nb c", "É b c", "é b c", "x" * 5000, "one two three four", "One two\tthree\x0bfour"])] + [(7, "an id that stands twice, with another text")]
    rows = corpus() + extra
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    rows = with_id(rows)
    prints = [fingerprint(t) for _, t in rows]
    label = components(prints)
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, i), i)
    want = sorted((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, label, strict=True))
    got = queries.op13_simhash(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark, documents(spark, [])).collect() == []
