"""Outcome ledgers: (task, arm, outcome, tokens), one row a trial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.lineage import numbered

# An outcome without an answer, and how many of them in a row end a run.
SILENCE, SILENT = "NO_ANSWER", 4


def outcome_pivot(ledger: DataFrame, outcomes: list[str]) -> DataFrame:
    """Per arm, trials of each outcome and mean tokens. The outcomes are given, so no pass is spent on finding them."""
    counts = [F.count_if(F.col("outcome") == o).alias(o.lower()) for o in outcomes]
    return ledger.groupBy("arm").agg(*counts, F.round(F.avg("tokens"), 6).alias("mean_tokens"))


def complete_tasks(ledger: DataFrame, n_arms: int) -> DataFrame:
    return ledger.groupBy("task").agg(F.count_distinct("arm").alias("n")).where(F.col("n") >= n_arms).select("task")


def complete_summary(ledger: DataFrame, n_arms: int) -> DataFrame:
    """Per arm over tasks that all arms have tried: resolved, tasks, and the percent, cut."""
    rows = ledger.join(complete_tasks(ledger, n_arms), "task", "left_semi")
    one = rows.groupBy("task", "arm").agg(F.max(F.col("outcome") == "RESOLVED").alias("ok"))
    out = one.groupBy("arm").agg(F.count_if("ok").alias("resolved"), F.count("*").alias("tasks"))
    return out.withColumn("percent", F.floor(100 * F.col("resolved") / F.col("tasks")).cast("long"))


def pairwise(ledger: DataFrame, arms: list[str]) -> DataFrame:
    """(a, b, wins): complete tasks that arm a resolves and arm b doesn't."""
    rows = ledger.join(complete_tasks(ledger, len(arms)), "task", "left_semi")
    wide = rows.groupBy("task").agg(*(F.max((F.col("arm") == a) & (F.col("outcome") == "RESOLVED")).alias(f"a{i}") for i, a in enumerate(arms)))
    pairs = [(i, j) for i in range(len(arms)) for j in range(len(arms)) if i != j]
    counts = wide.agg(*(F.count_if(F.col(f"a{i}") & ~F.col(f"a{j}")).alias(f"c{n}") for n, (i, j) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(arms[i]).alias("a"), F.lit(arms[j]).alias("b"), F.col(f"c{n}").alias("wins")) for n, (i, j) in enumerate(pairs)))
    return counts.select(F.inline(rows))


def pending(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """(task, arm) not yet tried."""
    return wanted.join(ledger.select("task", "arm"), ["task", "arm"], "left_anti")


def stopped(trials: DataFrame, limit: int = SILENT, run: str = "run", order: str = "seq") -> DataFrame:
    """The trials (run, seq, outcome, ...) that are made when a run ends with its limit-th silent answer in a row: those after
    it are not.

    Trials are numbered in order of run and seq by a range sort. A silent one counts for each of the limit places that a row
    of silence could begin at to hold it; a place that as many count for is such a row. So a long run is no one task's.
    """
    rows = numbered(trials, "_place", run, order)
    begins = F.explode(F.sequence(F.col("_place") - (limit - 1), F.col("_place"))).alias("_from")
    silent = rows.where(F.col("outcome") == SILENCE).select(run, begins).groupBy(run, "_from").agg(F.count("*").alias("_n"))
    ends = silent.where(F.col("_n") == limit).groupBy(run).agg((F.min("_from") + (limit - 1)).alias("_last"))
    return rows.join(ends, run, "left").where(F.col("_last").isNull() | (F.col("_place") <= F.col("_last"))).select(trials.columns)


def certified(record: DataFrame, gold_arm: str, bare_arm: str) -> DataFrame:
    """Tasks that the gold patch resolves and the bare checkout doesn't."""
    good = record.where((F.col("arm") == gold_arm) & (F.col("outcome") == "RESOLVED")).select("task").distinct()
    bare = record.where((F.col("arm") == bare_arm) & (F.col("outcome") == "UNRESOLVED")).select("task")
    return good.join(bare, "task", "left_semi")


def counters(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("arm").agg(F.count("*").alias("trials"), F.count_distinct("task").alias("tasks"))
