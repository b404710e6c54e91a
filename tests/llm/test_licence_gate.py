"""The gate of the licence scan: the words it had, with few branches where none of them stands."""

import re

from pyspark.sql import functions as F

from skein.llm import licence as L


def test_the_gate_has_its_words_and_few_branches(spark):
    words = L.model().words
    new, old = ("(?i)(?<![a-z0-9])" + p + "(?![a-z0-9])" for p in (L.any_of(words), "(?:" + "|".join(words) + ")"))
    lines = [x for w in words for x in (w, w.upper(), w[:-1], w + "s", f"x{w}", f"the {w}, of_{w}.")]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select(F.col("x").rlike(new).alias("new"), F.col("x").rlike(old).alias("old"), "x").collect()
    assert all(r["new"] == r["old"] for r in rows) and any(r["new"] for r in rows) and not all(r["new"] for r in rows)
    assert L.any_of(["a", "ab", "abc", "b.c"]) == r"(?:a(?:b(?:c)?)?|b(?:\.(?:c)))"
    outer = re.sub(r"\([^()]*\)\??", "", L.any_of(words)[3:-1])
    while "(" in outer:
        outer = re.sub(r"\([^()]*\)\??", "", outer)
    assert outer.count("|") < 36  # one branch a first character, not one a word
