"""Gold declarations from changed lines, and how well packs and rankings find them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.intervals import covering


def touched(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, id, file, start_line, end_line, pos) of declarations that hold a changed line (task_id, file, line).

    Tasks that change one line of a file ask for it once.
    """
    lines = changed.select("task_id", "file", "line").distinct()
    spans = symbols.select("file", "id", "start_line", "end_line", "pos")
    held = covering(lines.select("file", "line").distinct(), spans, ["file"])
    return lines.join(held, ["file", "line"]).select("task_id", "id", "file", "start_line", "end_line", "pos").distinct()


def innermost_gold(touched_: DataFrame) -> DataFrame:
    """(task_id, id): touched declarations that enclose no other touched one. Of two on one range, neither stays.

    One sweep over a file's declarations from the last start to the first: a declaration encloses another if one that starts
    later ends no later, or if of those that start with it another one ends no later.
    """
    later = Window.partitionBy("task_id", "file").orderBy(F.desc("start_line")).rangeBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy("task_id", "file", "start_line").orderBy("end_line").rangeBetween(Window.unboundedPreceding, 0)
    swept = touched_.select("task_id", "id", "file", "start_line", "end_line", (F.min("end_line").over(later)).alias("_ends"), F.count("*").over(beside).alias("_beside"))
    encloses = F.coalesce(F.col("_ends") <= F.col("end_line"), F.lit(False)) | (F.col("_beside") > 1)
    return swept.groupBy("task_id", "id").agg(F.max(encloses).alias("_encloses")).where("not _encloses").select("task_id", "id")


def callers(gold: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, id) of direct callers of gold that aren't gold."""
    calls = edges.where("kind = 'CALLS'").select("from_id", F.col("to_id").alias("id"))
    return calls.join(gold, "id").select("task_id", F.col("from_id").alias("id")).distinct().join(gold, ["task_id", "id"], "left_anti")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def scores(items: DataFrame, gold: DataFrame, symbols: DataFrame, callers_: DataFrame) -> DataFrame:
    """One row a task of gold: recall, precision, file_recall, caller_recall, ndcg, gold_size.

    items: (task_id, id, file, at), at from 0 in pack order.
    """
    tasks = gold.select("task_id").distinct()
    packed = items.select("task_id", "id").distinct()
    n_gold = gold.groupBy("task_id").agg(F.count("*").alias("gold_size"))
    hits = packed.join(gold, ["task_id", "id"], "left_semi").groupBy("task_id").agg(F.count("*").alias("hits"))
    n_packed = packed.groupBy("task_id").agg(F.count("*").alias("packed"))
    gold_files = gold.join(symbols.select("id", "file"), "id").select("task_id", "file").distinct()
    found_files = gold_files.join(items.select("task_id", "file").distinct(), ["task_id", "file"], "left_semi")
    n_files = gold_files.groupBy("task_id").agg(F.count("*").alias("files"))
    n_found = found_files.groupBy("task_id").agg(F.count("*").alias("found"))
    n_callers = callers_.groupBy("task_id").agg(F.count("*").alias("callers"))
    caller_hits = packed.join(callers_, ["task_id", "id"], "left_semi").groupBy("task_id").agg(F.count("*").alias("caller_hits"))
    n_items = items.groupBy("task_id").agg(F.count("*").alias("n_items"))
    gain = items.join(gold, ["task_id", "id"], "left_semi").groupBy("task_id").agg(F.sum(1.0 / F.log2(F.col("at") + 2)).alias("dcg"))
    out = tasks
    for df in (n_gold, hits, n_packed, n_files, n_found, n_callers, caller_hits, n_items, gain):
        out = out.join(df, "task_id", "left")
    out = out.fillna(0).fillna(0.0)
    best = F.least("gold_size", "n_items")
    ideal = F.when(best > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(best, F.lit(1)) - 1), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 2))).otherwise(0.0)
    weighted = (F.col("hits") + 0.5 * F.col("caller_hits")) / (F.col("gold_size") + 0.5 * F.col("callers"))
    return out.select(
        "task_id",
        _ratio(F.col("hits"), F.col("gold_size")).alias("recall"),
        _ratio(F.col("hits"), F.col("packed")).alias("precision"),
        _ratio(F.col("found"), F.col("files")).alias("file_recall"),
        weighted.alias("caller_recall"),
        _ratio(F.col("dcg"), ideal).alias("ndcg"),
        F.col("gold_size").cast("long").alias("gold_size"),
    )


def mean_scores(scored: DataFrame, by: list[str], tokens: str = "tokens") -> DataFrame:
    """Unweighted means; tokens cut to whole numbers, gold sizes summed."""
    return scored.groupBy(*by).agg(
        *(F.avg(c).alias(c) for c in ("recall", "precision", "file_recall", "caller_recall", "ndcg")),
        F.floor(F.avg(tokens)).cast("long").alias("tokens"),
        F.sum("gold_size").alias("gold_size"),
        F.count("*").alias("tasks"),
    )


def names_target(tasks: DataFrame, gold: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, named): whether the task's text holds the name of a gold declaration."""
    idents = tasks.select("task_id", F.array_distinct(T.identifiers(F.col("text"))).alias("idents"))
    names = gold.join(symbols.select("id", "name"), "id").join(idents, "task_id")
    return names.groupBy("task_id").agg(F.max(F.array_contains("idents", F.col("name"))).alias("named"))


def best_rank(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(task_id, best_rank): the first place, from 0, of any gold; null where the ranking has none."""
    first = ranked.join(gold, ["task_id", "id"], "left_semi").groupBy("task_id").agg((F.min("rank") - 1).alias("best_rank"))
    return gold.select("task_id").distinct().join(first, "task_id", "left")


def diagnosis(best: DataFrame, packed: DataFrame, share: DataFrame) -> DataFrame:
    """One row: where recall is lost. The median is the upper one; ranks up to 50, counted from 0, are near."""
    rows = best.join(packed, "task_id", "left").join(share, "task_id", "left").fillna(False, ["packed"]).fillna(0.0, ["test_share"])
    ranks = F.sort_array(F.collect_list("best_rank"))
    return rows.agg(
        F.count("*").alias("tasks"),
        F.count("best_rank").alias("reachable"),
        F.count_if("packed").alias("packed"),
        F.try_element_at(ranks, (F.floor(F.size(ranks) / 2) + 1).cast("int")).alias("median_rank"),
        F.count_if(F.col("best_rank") <= 50).alias("near"),
        F.avg("test_share").alias("test_share"),
    )


def test_token_share(items: DataFrame) -> DataFrame:
    """(task_id, test_share): tokens of test items over the pack's tokens. items: (task_id, is_test, tokens, used)."""
    part = F.sum(F.when(F.col("is_test"), F.col("tokens")).otherwise(0))
    return items.groupBy("task_id").agg(_ratio(part, F.max("used")).alias("test_share"))
