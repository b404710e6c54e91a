"""Licence scan: texts of no template, and the whole scan against a version in plain Python."""

import math
import re
import textwrap

from skein.llm import licence
from tests.llm.fixtures import documents

GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software."""

# Neither templates nor texts of the fit or its calibration.
LICENSED = [
    ("apache-2.0", "All sources here come under the Apache License, Version 2.0"), ("apache-2.0", "Parts are licensed under the Apache License, Version 2.0, as noted."), ("apache-2.0", "// Licensed under the Apache License, Version 2.0 by the team"),
    ("mit", "Our code is MIT licensed and released under the MIT License."), ("mit", "You get it under the terms of the MIT License"), ("mit", "# Licensed under the MIT license, see LICENSE in the root"), ("mit", "License: MIT License"),
    ("gpl-2.0", "The driver is licensed under the GNU General Public License, version 2, without exception."), ("gpl-2.0", "The module is GNU General Public License v2 only code"), ("gpl-2.0", GPL2),
    ("gpl-3.0", "The tool is licensed under the GNU General Public License, version 3, by its author."), ("gpl-3.0", "GNU General Public License v3 or later applies"), ("gpl-3.0", GPL2.replace("software;", "software:").replace("Foundation; either version 2", "Foundation, either version 3")),
    ("lgpl", "This codec is licensed under the GNU Lesser General Public License, version 2.1 or later"), ("lgpl", "Linking is allowed under the GNU Lesser General Public License"), ("agpl-3.0", "Our service is licensed under the GNU Affero General Public License, version 3 since May"), ("agpl-3.0", "The GNU Affero General Public License covers the server"),
    ("bsd", "The kernel is released under the BSD 2-Clause License by its committers"), ("bsd", "Everything else is under the BSD 3-Clause License"), ("isc", "The daemon is released under the ISC License"), ("isc", "The ISC License covers the parser"),
    ("mpl-2.0", "The engine is subject to the terms of the Mozilla Public License, v. 2.0, like the rest"), ("mpl-2.0", "Mozilla Public License 2.0 for all add-ons"), ("mpl-1.1", 'The contents of this file are subject to the Mozilla Public License\nVersion 1.1 (the "License"); you may not use this file except in\ncompliance with the License.'), ("epl-2.0", "The plug-in comes with the Eclipse Public License 2.0"),
    ("epl-2.0", "It is made available under the Eclipse Public License 2.0 by the committers"), ("zlib", ZLIB), ("zlib", "The codec is under the zlib License"), ("bsl-1.0", "The header is distributed under the Boost Software License, Version 1.0 only"), ("bsl-1.0", "Boost Software License, see the file"),
    ("cddl-1.0", "The daemon is under the Common Development and Distribution License 1.0"), ("artistic-2.0", "The package is licensed under the Artistic License 2.0 by its author"), ("unlicense", "This is free and unencumbered software released into the public domain by us."), ("cc-by", "Photos are licensed under CC BY 4.0 if not marked"),
    ("cc-by", "The figures are licensed under a Creative Commons Attribution 4.0 International License"), ("cc-by-sa", "The wiki is licensed under CC BY-SA 4.0 since spring"), ("cc-by-nc", "Recordings are licensed under CC BY-NC 4.0 by the choir"), ("cc0", "Data released under CC0 1.0 Universal by the museum"),
]
UNLICENSED = [
    "This project is not licensed under the MIT license.", "The plug-in was never distributed under the Eclipse Public License 2.0.", "Since May the engine is no longer licensed under the Apache License, Version 2.0.", "The fonts are not covered by the GNU General Public License, version 3.",
    "The photographs are not available under CC BY 4.0.", "He forgot his driving licence at the hotel.", "The apache tribes lived in the south.", "MIT and Harvard signed an agreement.", "The eclipse is at noon.", "A general public outcry followed the vote.", "The foundation will publish version 2 of the report in May.",
    "Students may copy and modify the worksheet.", "The artistic director wants more time.", "We will not be liable for lost coats.", "The common development of both towns was slow.", "The warranty covers parts and labour.", "Distribution of the leaflets begins on Monday.", "Mozilla released a new browser.", "Creative people have many international friends.",
    "The boost came too late.", "A clause of the contract was struck.", "All software in the lab is up to date.", "The copyright holder could not be found.", "Permission to enter is granted by the guard.", "You should have received a letter from the bank.", "The redistribution of wealth is debated.", "This is free coffee for the public.",
]


def test_texts_of_no_template(spark):
    """Every family given is right (precision 1), four in five are given one (recall), and what is no licence gets none."""
    rows = [(i, t) for i, (_, t) in enumerate(LICENSED)] + [(1000 + i, t) for i, t in enumerate(UNLICENSED)]
    got: dict = {}
    for r in licence.scan(spark, documents(spark, rows)).collect():
        if r["confirmed"]:
            got.setdefault(r["doc_id"], []).append(r["family"])
    assert len(rows) >= 60
    assert [(UNLICENSED[i - 1000], f) for i, f in got.items() if i >= 1000] == []
    given = {i: f for i, f in got.items() if i < 1000}
    wrong = [(LICENSED[i], f) for i, f in given.items() if f != [LICENSED[i][0]]]
    assert wrong == [] and len(given) >= 0.8 * len(LICENSED), (len(given), [t for i, t in enumerate(LICENSED) if i not in given])


def plain_scan(text):
    """(paragraph, lines, family) of the confirmed paragraphs of a text, by the rules of the docstring: only paragraphs with a
    word of the gate are judged."""
    m, tokens = licence.model(), re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
    lines = (text or "").split("\n")
    words = [tokens.findall(x.lower()) for x in lines]
    gate = re.compile(r"(?i)(?<![a-z0-9])(?:" + "|".join(m.words) + r")(?![a-z0-9])")
    weight: dict = {}
    for g, f, w in m.weights:
        weight.setdefault(f, {})[g] = w
    units = []
    for i, own in enumerate(words):
        n, total = 0, 0
        for x in words[i + 1 : i + 1 + licence.LONGEST]:
            if not x or total >= licence.LONGEST:
                break
            n, total = n + 1, total + len(x)
        for taken in (1, n + 1) if n and own else (1,):
            w = [x for part in words[i : i + taken] for x in part]
            if not gate.search(lines[i] if taken == 1 else " ".join(w)):
                continue
            grams = {" ".join(w[a : a + k]) for k in (1, 2, 3) for a in range(len(w) - k + 1)}
            z = {f: m.offsets[f] + sum(v for g, v in weight.get(f, {}).items() if g in grams) for f in m.families}
            best = max(m.families[:-1], key=lambda f: z[f])
            p = 1 / sum(math.exp((v - z[best]) / m.temperature) for v in z.values())
            n_held, share = max(((len(t & grams), len(t & grams) / len(t)) for t in map(licence.grams, licence.TEMPLATES[best])), key=lambda x: x[1])
            if z[best] > z["unknown"] and p >= m.threshold and share >= licence.CONFIRM - 1e-9:
                units.append({"at": i, "lines": taken, "f": best, "share": round(share, 9), "n": n_held, "p": round(p, 6)})
    meet = lambda a, b: a["at"] < b["at"] + b["lines"] and b["at"] < a["at"] + a["lines"]
    alone = {(u["at"], u["f"]) for u in units if u["lines"] == 1}
    units = [u for u in units if u["lines"] == 1 or not any((i, u["f"]) in alone for i in range(u["at"], u["at"] + u["lines"]))]
    wide = [u for u in units if u["lines"] > 1]
    units = [u for u in units if u["lines"] == 1 or not any(o["f"] == u["f"] and meet(o, u) and (o["share"], o["at"]) > (u["share"], u["at"]) for o in wide)]
    rank = lambda u: (u["n"], u["p"], u["at"], u["lines"], u["f"])
    units = [u for u in units if not any(o["f"] != u["f"] and meet(o, u) and rank(o) > rank(u) for o in units)]
    first: dict = {}
    for u in sorted(units, key=lambda u: u["lines"]):
        first[u["at"]] = (u["at"], u["lines"], u["f"])
    return sorted(first.values())


def test_scan_equals_plain_python(spark):
    wrapped = [textwrap.fill(t, w) for ts in licence.TEMPLATES.values() for t in ts for w in (34, 61)]
    held = [t for _, t in LICENSED] + UNLICENSED
    texts = wrapped + held + ["\n".join(held[i : i + 4]) for i in range(0, len(held), 3)] + ["\n\n".join((GPL2, ZLIB, "MIT License")), "\n".join((GPL2, ZLIB)), None, "", "\n\n", "word " * 20000 + "ISC License"]
    got: dict = {}
    for r in licence.scan(spark, documents(spark, list(enumerate(texts)))).where("confirmed").collect():
        got.setdefault(r["doc_id"], []).append((r["paragraph"], r["lines"], r["family"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_scan(t), t
    assert sum(map(len, got.values())) > 100


def test_the_texts_once_named_wrongly(spark):
    mpl = next(t for f, t in LICENSED if f == "mpl-1.1")
    rows = {1: (GPL2, ["gpl-2.0"]), 2: (ZLIB, ["zlib"]), 3: (mpl, ["mpl-1.1"]), 4: ("This project is not licensed under the MIT license.", [])}
    got = licence.scan(spark, documents(spark, [(i, t) for i, (t, _) in rows.items()])).where("confirmed").collect()
    assert {i: [r["family"] for r in got if r["doc_id"] == i] for i in rows} == {i: f for i, (_, f) in rows.items()}
    m = licence.model()
    assert 0.02 < m.temperature < 10 and 0 < m.threshold < 1


def test_the_gate_loses_nothing_that_a_template_confirms(spark):
    """Pieces of templates without a word that is rare: the classifier gives them a family, so the scan does."""
    m = licence.model()
    for texts in licence.TEMPLATES.values():
        for t in map(licence.grams, texts):
            assert sum(not set(g.split(" ")) & set(m.words) for g in t) < licence.CONFIRM * len(t)
    rows = [(1, "notice shall be included in all copies or substantial portions of the"), (2, "use in source and binary forms with or without")]
    assert [licence.classify(t)[0] for _, t in rows] == ["mit", "bsd"]
    for every in (False, True):
        got = licence.scan(spark, documents(spark, rows), every).where("confirmed").collect()
        assert sorted((r["doc_id"], r["family"]) for r in got) == [(1, "mit"), (2, "bsd")]


def test_wrapped_notices_without_a_line_between(spark):
    """Both of two notices are given with every, whichever comes first; what the scan gives without it is given still."""
    long = [(f, textwrap.fill(t, 61)) for f, ts in licence.TEMPLATES.items() for t in ts if len(t) > 120][::2]
    pairs = [((f, a), (g, b)) for i, (f, a) in enumerate(long) for g, b in long[i + 1 :: 3] if f != g]
    rows = [(i, f"{a}\n{b}") for i, ((_, a), (_, b)) in enumerate(pairs)] + [(len(pairs), f"{GPL2}\n{ZLIB}"), (len(pairs) + 1, None), (len(pairs) + 2, "")]
    docs = documents(spark, rows)
    key = lambda rows: {(r["doc_id"], r["paragraph"], r["lines"], r["family"]) for r in rows}
    got = key(licence.scan(spark, docs, every=True).where("confirmed").collect())
    assert key(licence.scan(spark, docs).where("confirmed").collect()) <= got
    families: dict = {}
    for i, _, _, f in got:
        families.setdefault(i, set()).add(f)
    missing = [(a, b) for i, ((f, a), (g, b)) in enumerate(pairs) if not {f, g} <= families.get(i, set())]
    assert missing == [] and len(pairs) > 20
    assert families[len(pairs)] == {"gpl-2.0", "zlib"}


def test_every_adds_nothing_to_texts_of_one_notice(spark):
    rows = [(i, t) for i, (_, t) in enumerate(LICENSED)] + [(1000 + i, t) for i, t in enumerate(UNLICENSED)]
    got: dict = {}
    for r in licence.scan(spark, documents(spark, rows), every=True).where("confirmed").collect():
        got.setdefault(r["doc_id"], []).append(r["family"])
    assert not any(i >= 1000 for i in got) and all(f == [LICENSED[i][0]] for i, f in got.items())
