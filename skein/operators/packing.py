"""Selection under a token budget: a greedy window packer and the two-pass packer with two fidelities."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import rendering as R
from skein.operators.lineage import cut

CANDIDATES, FULL_SHARE, TEST_SHARE, SECTION_OVERHEAD, CHARS_PER_TOKEN = 400, 0.15, 0.1, 12, 3.6


#: Items of a task that are folded at a time.
GREEDY_BLOCK = 128


def skip_greedy(items: DataFrame, budget: int, task: str, order: list[Column], tokens: str, columns: list[str], block: int = GREEDY_BLOCK) -> DataFrame:
    """Takes each item, in order, that still fits, and goes on past those that don't. Rows of the taken ones.

    A running sum would stop at the first that doesn't fit, so items are folded, a block of a task at a time. What doesn't
    fit into what is left of the budget never will, so a block holds the next items that fit alone, however far down they
    stand, and a task none of whose items does leaves the loop.
    """
    nth = F.row_number().over(Window.partitionBy(task).orderBy(*order)).cast("int")
    rows = cut(items.select(task, *(c for c in columns if c != task), nth.alias("_at"), F.col(tokens).cast("int").alias("_tokens")))
    start = lambda spent: F.struct(spent.alias("spent"), F.array().cast("array<int>").alias("took"))

    def step(acc, x):
        fits = acc["spent"] + x["_tokens"] <= budget
        return F.struct(F.when(fits, acc["spent"] + x["_tokens"]).otherwise(acc["spent"]).alias("spent"), F.when(fits, F.array_append(acc["took"], x["_at"])).otherwise(acc["took"]).alias("took"))

    fit = rows.select(task, "_at", "_tokens", F.lit(0).alias("_spent"), F.lit(0).alias("_last"))
    took: list[DataFrame] = []
    while True:
        fit = fit.where((F.col("_at") > F.col("_last")) & (F.col("_tokens") <= budget - F.col("_spent")))
        first = fit.withColumn("_n", F.row_number().over(Window.partitionBy(task).orderBy("_at"))).where(F.col("_n") <= block)
        listed = first.groupBy(task, "_spent").agg(F.array_sort(F.collect_list(F.struct("_at", "_tokens"))).alias("l"))
        folded = cut(listed.select(task, F.aggregate("l", start(F.col("_spent")), step).alias("f"), F.element_at("l", -1)["_at"].alias("_last")))
        if folded.isEmpty():
            break
        took.append(folded.select(task, F.explode("f.took").alias("_at")))
        fit = rows.select(task, "_at", "_tokens").join(folded.select(task, F.col("f.spent").alias("_spent"), "_last"), task)
    if not took:
        return rows.limit(0).select(task, *columns)
    return rows.join(functools.reduce(DataFrame.unionByName, took), [task, "_at"]).select(task, *columns)


def credited(taken: DataFrame, held: DataFrame) -> DataFrame:
    """(task_id, id, why, tokens): declarations (file, chunk, id) of the taken windows (task_id, file, chunk), at no tokens:
    the window's text has been paid for."""
    return taken.join(held, ["file", "chunk"]).select("task_id", "id", F.concat(F.lit("chunk:"), "file").alias("why"), F.lit(0).alias("tokens"))


def estimate(fidelity: str) -> Column:
    """Tokens an item is taken to cost when candidates are put in order (what is spent is counted exactly)."""
    if fidelity == "FULL":
        return F.greatest(F.lit(1), F.col("tokens")).cast("double")
    return F.greatest(F.lit(1.0), F.length("signature") / F.lit(CHARS_PER_TOKEN))


def density(ranked: DataFrame, fidelity: str) -> DataFrame:
    """ranked with density and its rank within the task: score by estimated token, then id."""
    rows = ranked.withColumn("density", F.round(F.col("score") / estimate(fidelity), 9))
    return rows.withColumn("density_rank", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("density"), "id")).cast("bigint"))


SELECTED = "task_id string, id string, fidelity string, why string, text string, tokens int, rank long, spent int, overhead int"


def two_pass(budget: int, full_share: float = FULL_SHARE, test_share: float = TEST_SHARE, count: Callable[[str], int] = R.count_tokens, strict: bool = False, covered: str = ""):
    """The packer of one task, for applyInPandas: bodies under their share of the budget, then signatures under all of it.

    Rows: task_id, rank, id, fq_name, name, file, start_line, signature, body (null: none), tokens, is_test, score, why,
    ancestors, descendants. At most CANDIDATES a task are looked at, so a group is small whatever the corpus. With body_tokens
    (null: no body) in place of body, these stand for it, as a block's tokens are those of its body and those around it; the
    text of what is taken is then null.
    strict: give nothing where the budget doesn't even hold the overhead (else the overhead is reported all the same).
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable").head(CANDIDATES)
        overhead = count(R.header_text(budget, budget, len(rows), covered)) + SECTION_OVERHEAD
        spendable = max(budget - overhead, 0)
        taken: dict[str, dict] = {}
        headed: set = set()
        state = {"spent": 0, "test": 0}
        sized = "body_tokens" in rows.columns
        test_limit = int(budget * test_share)

        def consider(r, fidelity: str, limit: int) -> None:
            counted = sized and fidelity == "FULL"
            text = (None if counted else r.body) if fidelity == "FULL" else r.signature
            if r.id in taken or (pd.isna(r.body_tokens) if counted else text is None or not str(text).strip()):
                return
            group = (r.is_test, r.file) if fidelity == "STUB" else None
            cost = own = count(R.block_text(r.fq_name, r.file, r.start_line, r.why, "" if counted else text, fidelity)) + (int(r.body_tokens) if counted else 0)
            if group is not None and group not in headed:
                cost += count(R.heading_text(r.file))
            if r.is_test:  # charged before the other tests, and kept even if one of them fails
                if state["test"] + cost > test_limit:
                    return
                state["test"] += cost
            nested = list(r.descendants) if fidelity == "FULL" and r.descendants is not None else []
            owners = r.ancestors if r.ancestors is not None else []
            if not nested and any(taken.get(a, {}).get("fidelity") == "FULL" for a in owners):
                return
            refund = sum(taken[d]["tokens"] for d in nested if d in taken)
            if state["spent"] - refund + cost > limit:
                return
            for d in nested:
                taken.pop(d, None)
            taken[r.id] = {"fidelity": fidelity, "why": r.why, "text": text, "tokens": own, "rank": r.rank}
            if group is not None:
                headed.add(group)
            state["spent"] += cost - refund

        for fidelity, limit in (("FULL", int(spendable * full_share)), ("STUB", spendable)):
            size = rows["tokens"].clip(lower=1).astype(float) if fidelity == "FULL" else (rows["signature"].str.len() / CHARS_PER_TOKEN).clip(lower=1.0)
            order = rows.assign(_d=(rows["score"] / size).round(9)).sort_values(["_d", "id"], ascending=[False, True], kind="stable")
            for r in order.itertuples(index=False):
                consider(r, fidelity, limit)
        if strict and overhead > budget:
            taken = {}
        out = [(rows["task_id"].iloc[0], i, t["fidelity"], t["why"], t["text"], t["tokens"], t["rank"], state["spent"], overhead) for i, t in taken.items()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SELECTED.split(", ")])

    return pack


#: Ids that every task of a job may be sent. What str.strip() leaves something of.
FEW, SHOWN = 1 << 20, r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def bodies_of(bodies: DataFrame, rows: DataFrame) -> DataFrame:
    """bodies (id, body) of the ids of rows, found where they are read: no other text is moved."""
    ids = cut(rows.select("id").distinct())
    return bodies.join(F.broadcast(ids) if ids.count() <= FEW else ids, "id", "left_semi")


def sizes(bodies: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, body_tokens) of the ids of rows; null where there is no body, or a blank one."""
    return bodies_of(bodies, rows).select("id", F.when(F.col("body").rlike(SHOWN), T.token_count(F.col("body"))).alias("body_tokens"))


def pack(ranked: DataFrame, budget: int, bodies: DataFrame | None = None, **options) -> DataFrame:
    """The selected items of each task, in pack order: bodies first, then by rank. With bodies (id, body), ranked has their
    sizes() in place of body, and the texts of those selected alone are read: most candidates' bodies are never shown."""
    top = ranked.where(F.col("rank") <= CANDIDATES)
    got = top.groupBy("task_id").applyInPandas(two_pass(budget, **options), SELECTED)
    if bodies is not None:
        got = cut(got)
        got = got.join(bodies_of(bodies, got.where("fidelity = 'FULL'")), "id", "left")
        got = got.withColumn("text", F.when(F.col("fidelity") == "FULL", F.col("body")).otherwise(F.col("text"))).select(*(c.split()[0] for c in SELECTED.split(", ")))
    order = Window.partitionBy("task_id").orderBy(F.when(F.col("fidelity") == "FULL", 0).otherwise(1), "rank", "id")
    return got.withColumn("at", F.row_number().over(order).cast("bigint") - 1)


def fit_errors(items: DataFrame, errors: DataFrame, budget: int) -> DataFrame:
    """Errors of packed files, in order of (file, line, message), as many from the head as the remainder holds.

    items: (task_id, file, used). The diagnostics section is one text, so its cost grows with each error: a running sum.
    Errors are made distinct, and added up in their file, before tasks meet them. Of a file a task meets those that would fit if
    it came first, and the one behind them: that one doesn't fit, nor does what follows it.
    """
    files = items.select("task_id", "file", "used").distinct()
    line = R.diagnostic_line(F.col("file"), F.col("line"), F.col("message"))
    head = T.token_count(F.lit(R.DIAGNOSTICS))
    each = errors.select("file", "line", "message").distinct().withColumn("_own", T.token_count(line))
    ahead = F.sum("_own").over(Window.partitionBy("file").orderBy("line", "message").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_own")
    hit = files.join(each.withColumn("_ahead", ahead), "file").where(F.col("_ahead") + head <= budget - F.col("used"))
    order = Window.partitionBy("task_id").orderBy("file", "line", "message")
    cost = F.sum("_own").over(order.rowsBetween(Window.unboundedPreceding, 0)) + head
    return hit.withColumn("cost", cost.cast("bigint")).where(F.col("cost") <= budget - F.col("used")).select("task_id", "file", "line", "message", "cost")


def totals(items: DataFrame, errors: DataFrame, budget: int) -> DataFrame:
    """(task_id, tokens, budget) of packs: what was spent, the overhead, and the diagnostics that fitted."""
    notes = errors.groupBy("task_id").agg(F.max("cost").alias("_notes"))
    used = items.groupBy("task_id").agg(F.max(F.col("spent") + F.col("overhead")).cast("long").alias("tokens"))
    return used.join(notes, "task_id", "left").select("task_id", (F.col("tokens") + F.coalesce("_notes", F.lit(0).cast("long"))).alias("tokens"), F.lit(budget).alias("budget"))
