"""Small tables with nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, score string, bucket string, n string"


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 220))) for _ in range(n)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    at = n
    for i in range(0, n, 4):  # exact copies, and copies that differ in blanks or case
        for text in (base[i], base[i].replace(" ", "\n"), base[i].upper()):
            rows.append((at, text))
            at += 1
    for i in range(0, n, 5):  # near copies: a word here and there
        for k in (1, 3, 9):
            t = base[i].split()
            for _ in range(k):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((at, " ".join(t)))
            at += 1
    passage = " ".join(rng.choices(words, k=90))
    for i in range(6):  # a passage in other surroundings
        rows.append((at, f"{base[i]} {passage} {base[-i - 1]}"))
        at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \t\n"), (at + 3, "one"), (at + 4, "one two three"), (at + 5, "ONE two three"), (at + 6, "é" * 500), (at + 7, "é" * 500 + "x"), (at + 8, "ab" * 40_000), (at + 9, "word " * 3000)]
    rows += [rows[0], (None, "no id"), (None, None)]  # a repeated row, rows without an id
    return rows


def documents(spark, rows=None):
    rows = corpus() if rows is None else rows
    full = [(i, t, None if k % 7 == 0 else "en", None if k % 11 == 0 else f"s{k % 5}", None, "x", "9", "z", "b", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def with_id(rows):
    return [(i, t or "") for i, t in rows if i is not None]
