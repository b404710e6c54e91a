"""Inputs on which a part of the job used to be left out."""

import random
import textwrap

import pytest

from skein.llm import licence, suffixdedup, urlfilter
from tests.llm.fixtures import documents
from tests.llm.test_dedup import CONTRACT, brute_repeats


def test_suffix_dedup_finds_pairs_of_leads_among_many_under_one_prefix(spark):
    rng = random.Random(4)
    marks = lambda n: "".join("a" * 39 + f"{rng.getrandbits(32):08x}" for _ in range(n))
    rows = []
    for i in range(0, 120, 2):  # two documents share a passage, and no third has it
        passage = marks(6)
        rows += [(i, marks(3) + passage + marks(2)), (i + 1, marks(2) + passage + marks(4))]
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, suffixdedup.remove_repeats(spark, documents(spark, rows), window=120, lead=32).select(CONTRACT).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted((i, *r) for (i, _), r in zip(rows, brute_repeats([t.encode() for _, t in rows], 120), strict=True))


NOTICES = {
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
}


@pytest.mark.parametrize("width", [28, 40, 72, 79])
def test_wrapped_notices_are_found_once(spark, width):
    rows = []
    for i, text in enumerate(NOTICES.values()):
        body = [f" * {x}" for x in ["Copyright (c) 2020 the writers", *textwrap.wrap(text, width)]]
        rows.append((i, "\n".join(["/*", *body, " *", " * Nothing else is said here.", " */"])))
    rows.append((9, "The permission slip is free.\nTo any person who modifies\nthe public terms of a program\nhe is free to charge."))
    got = [(r["doc_id"], r["family"]) for r in licence.scan(spark, documents(spark, rows)).collect() if r["family"] != "unknown"]
    assert sorted(got) == list(enumerate(NOTICES))


def test_url_words_beyond_50_000_are_counted(spark):
    names = ["".join("bcdfghjklmnp"[i // 12**k % 12] for k in range(5)) for i in range(51_000)]
    urls = [f"http://{w}-{w}.example.com/{w}/{i}" for i, w in enumerate(names)]
    urls += ["http://rareword-quaint.com/x", "http://quaintrareword.com/y", "http://casino-quaint.com/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    delimited = spark.createDataFrame([(t,) for u in urls for t in urlfilter.runs(*urlfilter.split_url(u))[2]], "token string")
    counts = {r["token"] for r in urlfilter.unigrams(spark, delimited, None).collect()}
    assert {"quaint", "rareword", *names} <= counts and not any(w.isdigit() for w in counts)
    (row,) = urlfilter.judge(spark, pages).where(f"page_id = {len(names) + 1}").collect()
    assert row["words"] == ["quaint", "rareword"]


def test_no_run_is_made_of_half_a_notice_that_stands_on_one_line(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    lines = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    rows = [(10 * k + n, f"{words}\n{' '.join(words.split()[:n])}\n{line}") for k, line in enumerate(lines) for n in range(1, 10)]
    got = {(r["doc_id"] // 10, r["family"]) for r in licence.scan(spark, documents(spark, rows)).collect() if r["family"] != "unknown"}
    assert got == {(0, "gpl-3.0"), (1, "cc-by-nc")}
