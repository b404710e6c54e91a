"""Runs that stop, files that fail, ledgers that are added to twice."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import ledger
from skein.sources import store
from skein.streaming import live


def until_silent(trials, limit):
    """{(run, seq)} of trials {run: [(seq, outcome)]} that are made."""
    out = set()
    for run, rows in trials.items():
        silent = 0
        for seq, outcome in sorted(rows):
            out.add((run, seq))
            silent = silent + 1 if outcome == "NO_ANSWER" else 0
            if silent == limit:
                break
    return out


def trials():
    rng = random.Random(9)
    out = {f"r{i}": [(s * 3, rng.choice(["NO_ANSWER", "NO_ANSWER", "RESOLVED"])) for s in range(rng.randint(1, 40))] for i in range(25)}
    return out | {"all silent": [(s, "NO_ANSWER") for s in range(9)], "three": [(s, "NO_ANSWER") for s in range(3)], "none": [(1, "UNRESOLVED")]}


@pytest.mark.parametrize("limit", [1, 4])
def test_a_run_ends_with_its_silence(spark, limit):
    all_ = trials()
    df = spark.createDataFrame([(r, s, o, "x") for r, rows in all_.items() for s, o in rows], "run string, seq long, outcome string, other string").repartition(5)
    got = ledger.stopped(df, limit)
    assert got.columns == df.columns
    assert {(r["run"], r["seq"]) for r in got.collect()} == until_silent(all_, limit)


def test_a_stream_stops_across_a_restart(spark, tmp_path):
    all_ = trials()
    for part in (0, 1):  # the first half of each run, then the query starts again and gets the rest
        rows = [(r, s, o) for r, rows in all_.items() for k, (s, o) in enumerate(sorted(rows)) if (2 * k >= len(rows)) == bool(part)]
        spark.createDataFrame(rows, "run string, seq long, outcome string").write.mode("append").json(str(tmp_path / "in"))
        kept = live.until_silent(live.watch(spark, str(tmp_path / "in"), "run string, seq long, outcome string"))
        query = kept.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {(r["run"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == until_silent(all_, 4)


def analyse(file, text):
    if "boom" in text:
        raise ValueError("no such branch")
    return {"symbols": [(file, file, file, "CLASS", 1, 2, "class", None, 3, False)], "edges": [(file, "x", "CALLS")], "errors": [(2, "odd")] * text.count("?"), "call_sites": 2, "resolved_callees": 1}


def test_files_that_fail_are_told_and_the_others_go_on(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, content in {"a.kt": b"class A", "src/b.kt": b"boom", "src/c.kt": b"\xff\xfe", "d.kts": b"?" * 90, "e.kt": b"e", "none.kt": b"", "skip.md": b"boom"}.items():
        (tmp_path / name).write_bytes(content)
    got = store.analysed(spark, str(tmp_path), analyse, notes=5)
    coverage = {r["file"]: (r["call_sites"], r["failed_files"]) for r in got["coverage"].collect()}
    assert coverage == {"a.kt": (2, 0), "src/b.kt": (0, 1), "src/c.kt": (0, 1), "d.kts": (2, 0), "e.kt": (2, 0)}
    assert sorted((r["id"], r["file"], r["start_line"]) for r in got["symbols"].collect()) == [("a.kt", "a.kt", 1), ("d.kts", "d.kts", 1), ("e.kt", "e.kt", 1)]
    assert sorted(r["from_id"] for r in got["edges"].collect()) == ["a.kt", "d.kts", "e.kt"]
    notes = got["errors"].groupBy("file").agg(F.count("*").alias("n"), F.min("message").alias("m")).collect()
    assert {r["file"]: (r["n"], r["m"].split(":")[0]) for r in notes} == {"d.kts": (5, "odd"), "src/b.kt": (1, "ValueError"), "src/c.kt": (1, "UnicodeDecodeError")}


def test_a_batch_of_trials_added_twice_is_there_once(spark, tmp_path):
    rows = spark.createDataFrame([("t", "a", "RESOLVED", 5), ("t", "b", "NO_ANSWER", 0)], store.LEDGER)
    for _ in range(2):
        store.append_ledger(rows, str(tmp_path / "led"))
    store.append_ledger(rows.withColumn("outcome", F.lit("UNRESOLVED")).unionByName(spark.createDataFrame([("u", "a", "RESOLVED", 1)], store.LEDGER)), str(tmp_path / "led"))
    assert sorted(tuple(r) for r in store.read_ledger(spark, str(tmp_path / "led")).collect()) == [("t", "a", "RESOLVED", 5), ("t", "b", "NO_ANSWER", 0), ("u", "a", "RESOLVED", 1)]
