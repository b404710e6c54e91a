"""The packer moves no bodies that aren't shown, and tasks meet no more errors than can fit."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import packing as P
from skein.operators import rendering as R
from tests.test_held import shuffled

COLUMNS = "task_id string, rank long, id string, fq_name string, name string, file string, start_line int, signature string, tokens int, is_test boolean, score double, why string, ancestors array<string>, descendants array<string>"


def test_sizes_stand_for_bodies(spark):
    """Before, every candidate's whole body was shuffled to its task."""
    rng = random.Random(4)
    text = lambda n: " ".join("%x" % rng.getrandbits(60) for _ in range(n))
    bodies = {f"d{i:02d}": text(rng.choice((1, 4, 9, 30, 3000))) for i in range(40)}
    bodies |= {"d01": None, "d02": " \n", "d03": "  \x1c", "d04": " x", "d05": ""}
    rows = []
    for t in range(12):
        for rank, i in enumerate(rng.sample(sorted(bodies), 30), 1):
            n = int(i[1:])
            below = [f"d{x:02d}" for x in range(n + 1, n + 4)] if n % 10 == 0 else None
            rows.append((f"t{t}", rank, i, f"p.{i}", i, f"f{n % 3}", n, text(4), len((bodies[i] or "").split()), n % 7 == 0, 1.0 / rank, "w", [f"d{n // 10 * 10:02d}"] if n % 10 else None, below))
    ranked = spark.createDataFrame(rows, COLUMNS).repartition(4, "rank").cache()
    texts = spark.createDataFrame(list(bodies.items()), "id string, body string").repartition(3).cache()
    ranked.count(), texts.count()
    for options in ({}, {"full_share": 1.0}, {"full_share": 0.5, "test_share": 0.4}, {"full_share": 0.0}):
        show = lambda df: sorted(map(repr, df.select(*(c.split()[0] for c in P.SELECTED.split(", ")), "at").collect()))
        want = show(P.pack(ranked.join(texts, "id"), 300, **options))
        before = shuffled(spark)
        got = show(P.pack(ranked.join(P.sizes(texts, ranked), "id"), 300, texts, **options))
        assert got == want and ("FULL" in repr(got)) == (options.get("full_share") != 0.0)
        assert shuffled(spark) - before < 150_000


def test_errors_that_fit(spark):
    """Before, each (task, file) met every row of the file's errors, repeats included, and only then were they made distinct."""
    rng = random.Random(8)
    errors = [(f"f{rng.randrange(4)}", rng.randrange(300), f"unresolved call `t{rng.randrange(5)}`") for _ in range(3000)] + [("f1", 3, None), ("f1", None, "x"), (None, 1, "y")]
    items = [(f"t{t}", f"f{f}", 200 - t * 4) for t in range(50) for f in range(4) if (t + f) % 3]
    e = spark.createDataFrame(errors * 10, "file string, line int, message string").repartition(4).cache()
    i = spark.createDataFrame(items, "task_id string, file string, used int").cache()
    e.count(), i.count()
    line = R.diagnostic_line(F.col("file"), F.col("line"), F.col("message"))
    cost = F.sum(T.token_count(line)).over(Window.partitionBy("task_id").orderBy("file", "line", "message").rowsBetween(Window.unboundedPreceding, 0)) + T.token_count(F.lit(R.DIAGNOSTICS))
    want = i.distinct().join(e, "file").distinct().withColumn("cost", cost.cast("bigint")).where("cost <= 210 - used").select("task_id", "file", "line", "message", "cost")
    want = sorted(map(repr, want.collect()))
    before = shuffled(spark)
    assert sorted(map(repr, P.fit_errors(i, e, 210).collect())) == want and len(want) > 300
    assert shuffled(spark) - before < 400_000
