"""How packs are written: Markdown and a JSON explanation. The packer charges for these very texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

# The layout of a pack (here, in header_text, block_text, heading_text and markdown's section titles).
DIAGNOSTICS = "\n## Diagnostics\n"
_TOKEN = re.compile(T.TOKEN)


def count_tokens(text: str) -> int:
    """Words and marks; the same counter as the column expression."""
    return sum(1 for _ in _TOKEN.finditer(text))


def header_text(tokens: int, budget: int, count: int, covered: str = "") -> str:
    return f"# Context pack\n\n{tokens} / {budget} tokens, {count} declarations.{f' {covered}.' if covered else ''}\n"


def one_line(text: str) -> str:
    return re.sub(" +", " ", " ".join(x.strip() for x in re.split("\r\n|\n|\r", text)))


def block_text(fq_name: str, file: str, start_line: int, why: str, text: str, fidelity: str) -> str:
    if fidelity == "FULL":
        return f"### {fq_name}\n`{file}:{start_line}` — {why}\n\n```kotlin\n{text}\n```\n"
    return f"- {start_line}: {one_line(text)} — {why}\n"


def heading_text(file: str) -> str:
    return f"\n`{file}`\n"


def diagnostic_line(file: Column, line: Column, message: Column) -> Column:
    return F.concat(F.lit("- `"), file, F.lit(":"), line.cast("string"), F.lit("`: "), message, F.lit("\n"))


def coverage_line(call_sites: Column, resolved: Column, attributed: Column, failed: Column) -> Column:
    """The header's words on how well calls resolved; percents are cut, not rounded."""
    rate = lambda part: F.when(call_sites == 0, F.lit(1.0)).otherwise(part / call_sites)
    text = F.format_string("%d%% of %d call sites resolved, %d%% with caller", F.floor(rate(resolved) * 100), call_sites, F.floor(rate(attributed) * 100))
    return F.when(failed > 0, F.concat(text, F.format_string(", %d files failed", failed))).otherwise(text)


def blocks(items: DataFrame) -> DataFrame:
    """items with the Markdown block of each."""
    full = F.concat(F.lit("### "), "fq_name", F.lit("\n`"), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit("` — "), "why", F.lit("\n\n```kotlin\n"), "text", F.lit("\n```\n"))
    stub = F.concat(F.lit("- "), F.col("start_line").cast("string"), F.lit(": "), T.one_line(F.col("text")), F.lit(" — "), "why", F.lit("\n"))
    return items.withColumn("block", F.when(F.col("fidelity") == "FULL", full).otherwise(stub))


def markdown(items: DataFrame, totals: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(task_id, markdown). items: task_id, at, fq_name, file, start_line, fidelity, why, text, is_test; totals: task_id,
    tokens, budget. Sections: bodies, then signatures under a heading per file, then tests; errors last."""
    rows = blocks(items)
    section = F.when(F.col("is_test"), F.lit(2)).when(F.col("fidelity") == "FULL", F.lit(0)).otherwise(F.lit(1))
    rows = rows.withColumn("section", section).withColumn("body", F.col("fidelity") == "FULL")
    by_file = rows.groupBy("task_id", "section", "body", F.when(~F.col("body"), F.col("file")).alias("under")).agg(F.min("at").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("body"), F.concat(F.lit("\n"), F.col("block"))).otherwise(F.col("block")).alias("b")))), lambda x: x["b"]), "").alias("b"))
    by_file = by_file.withColumn("b", F.when(F.col("under").isNotNull(), F.concat(F.lit("\n`"), "under", F.lit("`\n"), "b")).otherwise(F.col("b")))
    title = F.element_at(F.array(F.lit("Definitions"), F.lit("Related signatures"), F.lit("Tests likely affected")), F.col("section") + 1)
    sections = by_file.groupBy("task_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("body")).alias("o"), "first", "b"))), lambda x: x["b"]), "").alias("b"))
    sections = sections.withColumn("b", F.concat(F.lit("\n## "), title, F.lit("\n"), "b"))
    whole = sections.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "b"))), lambda x: x["b"]), "").alias("b"))
    counts = rows.groupBy("task_id").agg(F.count("*").alias("n"))
    out = totals.join(counts, "task_id", "left").join(whole, "task_id", "left")
    head = F.format_string("# Context pack\n\n%d / %d tokens, %d declarations.\n", F.col("tokens"), F.col("budget"), F.coalesce("n", F.lit(0).cast("long")))
    tail = F.lit("")
    if errors is not None:
        listed = errors.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "message"))), lambda e: diagnostic_line(e["file"], e["line"], e["message"])), "").alias("e"))
        out = out.join(listed, "task_id", "left")
        tail = F.when(F.col("e").isNotNull(), F.concat(F.lit(DIAGNOSTICS), "e")).otherwise(F.lit(""))
    text = F.concat(head, F.coalesce("b", F.lit("")), tail)
    return out.select("task_id", F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n")).alias("markdown"))


def explain(items: DataFrame, totals: DataFrame, errors: DataFrame) -> DataFrame:
    """(task_id, json): tokens and budget, the items in pack order without their texts, and the errors.

    items: task_id, at, id, name, file, start_line, why, fidelity, tokens; totals: task_id, tokens, budget; errors: task_id,
    file, line, message.
    """
    item = F.struct("id", "name", "file", F.col("start_line").alias("line"), "why", F.lower("fidelity").alias("fidelity"), "tokens")
    listed = items.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", item.alias("i")))), lambda x: x["i"]).alias("items"))
    notes = errors.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("file", "line", "message"))).alias("errors"))
    none = F.array().cast("array<struct<file:string,line:int,message:string>>")
    out = totals.join(listed, "task_id").join(notes, "task_id", "left")
    return out.select("task_id", F.to_json(F.struct("tokens", "budget", "items", F.coalesce("errors", none).alias("errors"))).alias("json"))
