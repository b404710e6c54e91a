"""Fill-in-middle against the rule in plain Python, and the machine against what it is to tell."""

import hashlib
import random
import re

import numpy as np
import pytest

from skein.llm import fim, queries
from tests.llm.fixtures import corpus, documents, with_id

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def rule(doc_id, text, rate=50, suffix_first=80):
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = UNIT.findall(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["<", "<P", "<P>", "a <S>", "x<M>y", "<<P>>", "< P>", "<P >", "<X>", "<é>", "é<P>", "a<", ">b", "P>", "a b c d", "　x y", "😀 😀😀\n\n€ é", " a", "a ", "\t", "\x0b\x0cz", "\x00 \x1f \x85", "a" * 511 + "<P>" + "b" * 600, "a" * 510 + "<P>", "é" * 255 + "€<M>", ("word " * 7 + "<S") * 300]


def test_every_text_is_cut_as_the_rule_says(spark):
    rows = with_id(corpus()) + [(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(-5, "below zero is an id too"), (2**62, "and so is a large one")]
    for rate, suffix_first in ((50, 80), (100, 0), (100, 100)):
        got = fim.transform(spark, documents(spark, rows), rate=rate, suffix_first=suffix_first)
        got = got.withColumn("text", fim.restored(got["form"], got["output"])).collect()
        assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr) == sorted(((i, *rule(i, t, rate, suffix_first)) for i, t in rows), key=repr)
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(rows)


def test_query_has_nulls_repeated_rows_and_digests(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in with_id(corpus()):
        n, form, p, m, out = rule(i, t)
        want.append((i, n, form, p, m, *(hashlib.sha256(x.encode()).hexdigest() for x in (out, t))))
    got = queries.op12_fim(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_empty_table(spark):
    assert fim.transform(spark, documents(spark, [])).collect() == []


@pytest.mark.parametrize("lane", [1, 2, 3, 7, 64])
def test_lanes_tell_what_one_scan_from_the_start_tells(lane, monkeypatch):
    monkeypatch.setattr(fim, "LANE", lane)
    rng = random.Random(lane)
    texts = ["".join(rng.choices(["<", "P", "S", ">", " ", "\n", "a", "é", "€", "😀"], k=rng.randint(0, 40))) for _ in range(200)]
    data = b"".join(b"\xff" + t.encode() for t in texts)
    state, want = fim.START, []
    for b in data:
        want.append(int(fim.EMIT[state * 256 + b]))
        state = fim.STEP[state * 256 + b].astype(int)
    got = fim.scan(np.frombuffer(data, np.uint8))
    assert got.tolist() == want
    assert int(np.count_nonzero(got & fim.POINT)) == sum(map(len, texts))
    assert int(np.count_nonzero(got & fim.SENTINEL)) == sum(len(re.findall("<[PSM]>", t)) for t in texts)
    assert int(np.count_nonzero(got & fim.UNIT_END)) == sum(len(UNIT.findall(t)) - 1 for t in texts if t)
