"""Joins by name and by line: name-matched calls, enclosing declarations, line windows, the reference map of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.intervals import covering
from skein.operators.lineage import cut, numbered

MAX_DEFINITIONS, WINDOW_LINES, SELF_EDGE = 20, 40, 0.1


def file_lines(files: DataFrame) -> DataFrame:
    """(file, line, text) of files (file, text); lines count from 1."""
    return files.select("file", F.posexplode(T.lines(F.col("text"))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def bodies(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols with body: their lines; null where the file is missing or ends before they do."""
    whole = files.select("file", T.lines(F.col("text")).alias("_l"))
    body = F.when(F.col("end_line") <= F.size("_l"), F.array_join(F.slice("_l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    return symbols.join(whole, "file", "left").withColumn("body", body).drop("_l")


def innermost(marks: DataFrame, symbols: DataFrame) -> DataFrame:
    """marks (file, line, ...) with the id of the covering declaration that starts last; the first in order of ties."""
    hit = covering(marks, symbols.select("file", "id", "start_line", "end_line"), ["file"])
    last = hit.groupBy(*marks.columns).agg(F.min(F.struct(-F.col("start_line"), "id")).alias("_least"))
    return last.select(*marks.columns, F.col("_least.id").alias("id"))


def name_calls(calls: DataFrame, symbols: DataFrame, max_definitions: int | None = MAX_DEFINITIONS) -> DataFrame:
    """CALLS edges by name alone. calls: (file, line, name); a name declared in too many places says nothing."""
    declared = symbols.select(F.col("id").alias("to_id"), "name")
    if max_definitions is not None:
        declared = declared.withColumn("_n", F.count("*").over(Window.partitionBy("name"))).where(F.col("_n") <= max_definitions).drop("_n")
    callers = innermost(calls.select("file", "line", "name").distinct(), symbols).withColumnRenamed("id", "from_id")
    return callers.join(declared, "name").where("from_id <> to_id").select("from_id", "to_id", F.lit("CALLS").alias("kind")).distinct()


def calls_through(calls: DataFrame, symbols: DataFrame, max_definitions: int = MAX_DEFINITIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """name_calls() not written out: (id, r) of callers, (id, r) of what they call, and CALLS edges beside them.

    A name has a number r, and each of its callers calls each of its declarations; of those that call a name they declare
    themselves, the edges are written out, so no caller meets itself.
    """
    declared = symbols.select("id", "name").withColumn("_n", F.count("*").over(Window.partitionBy("name"))).where(F.col("_n") <= max_definitions)
    names = cut(numbered(declared.select("name").distinct(), "r", "name"))
    declared = cut(declared.join(names, "name").select("id", "r").distinct())
    known = cut(calls.join(names, "name").select("file", "line", "r"))
    at = innermost(known.select("file", "line").distinct(), symbols)
    callers = cut(known.join(at, ["file", "line"]).select("id", "r").distinct())
    own = callers.join(declared, ["id", "r"], "left_semi").withColumnRenamed("id", "from_id")
    written = own.join(declared.withColumnRenamed("id", "to_id"), "r").where("from_id <> to_id").select("from_id", "to_id", F.lit("CALLS").alias("kind")).distinct()
    return cut(callers.join(declared, ["id", "r"], "left_anti")), declared, written


def windows(files: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """(file, chunk, start_line, end_line, text): tumbling windows of lines, the last one short."""
    lines = files.select("file", T.lines(F.col("text")).alias("l"))
    cut = lines.select("file", "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size).cast("int"))).alias("chunk"))
    start = F.col("chunk") * size + 1
    piece = F.slice("l", start, F.lit(size))
    return cut.select("file", "chunk", start.alias("start_line"), (start + F.size(piece) - 1).alias("end_line"), F.array_join(piece, "\n").alias("text"))


def contained(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, chunk, id) of declarations that lie wholly in a window: the window that holds their first line holds the last."""
    firsts = symbols.select("file", "id", F.col("start_line").alias("_first"), F.col("end_line").alias("_last"))
    held = covering(firsts, chunks.select("file", "chunk", "start_line", "end_line"), ["file"], line="_first")
    return held.where("_last <= end_line").select("file", "chunk", "id")


def reference_counts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, ident, count): how often a file names a declared identifier, less its own declarations of it; above 0."""
    seen = files.select("file", F.explode(T.identifiers(F.col("text"))).alias("ident")).groupBy("file", "ident").agg(F.count("*").alias("n"))
    declared = symbols.groupBy("file", F.col("name").alias("ident")).agg(F.count("*").alias("own"))
    known = seen.join(symbols.select(F.col("name").alias("ident")).distinct(), "ident", "left_semi")
    out = known.join(declared, ["file", "ident"], "left").withColumn("count", F.col("n") - F.coalesce("own", F.lit(0)))
    return out.where("`count` > 0").select("file", "ident", "count")


NAMED = 10.0


def map_references(references: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(from_file, to_file, ident, w) of referencing files to defining ones, as for a task that names nothing; and of files
    to themselves, for what they define and no file refers to."""
    defines = symbols.select(F.col("file").alias("to_file"), F.col("name").alias("ident")).distinct()
    spread = defines.groupBy("ident").agg(F.count("*").alias("definers"))
    long_mixed = (F.length("ident") >= 8) & ((F.col("ident").rlike("[A-Z]") & F.col("ident").rlike("[a-z]")) | F.contains("ident", F.lit("_")))
    base = F.when(long_mixed, 10.0).otherwise(1.0) * F.when(F.startswith("ident", F.lit("_")), 0.1).otherwise(1.0) * F.when(F.col("definers") > 5, 0.1).otherwise(1.0)
    joined = references.select(F.col("file").alias("from_file"), "ident", "count").join(defines, "ident").join(spread, "ident")
    referred = joined.select("from_file", "to_file", "ident", (base * F.sqrt(F.col("count").cast("double"))).alias("w"))
    alone = defines.join(references.select("ident").distinct(), "ident", "left_anti")
    return referred, alone.select(F.col("to_file").alias("from_file"), "to_file", "ident", F.lit(SELF_EDGE).alias("w"))


def map_overlay(referred: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(task_id, from_file, to_file, ident, w): what a task adds to the weights of what it names."""
    asked = mentioned.where("ident is not null").select("task_id", "ident").distinct()
    return asked.join(referred, "ident").select("task_id", "from_file", "to_file", "ident", ((NAMED - 1) * F.col("w")).alias("w"))


def map_edges(references: DataFrame, symbols: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(task_id, from_file, to_file, ident, w): the map as each task sees it, written out. mentioned: (task_id, ident), and a
    row with a null ident for each task. Ranks don't need it: they take the base and the overlay."""
    referred, alone = map_references(references, symbols)
    tasks = mentioned.select("task_id").distinct()
    asked = mentioned.where("ident is not null").select("task_id", "ident").distinct().withColumn("named", F.lit(True))
    each = tasks.crossJoin(referred).join(asked, ["task_id", "ident"], "left")  # a task set against all edges: this is the result
    each = each.select("task_id", "from_file", "to_file", "ident", (F.col("w") * F.when(F.col("named"), NAMED).otherwise(1.0)).alias("w"))
    return each.unionByName(tasks.crossJoin(alone).select("task_id", "from_file", "to_file", "ident", "w"))


def map_start(symbols: DataFrame, mentioned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task_id, node, mass): files by how many mentioned names they define; and (task_id) of tasks none of whose names any
    file defines, which start at all files alike."""
    asked = mentioned.where("ident is not null").select("task_id", "ident").distinct()
    named = asked.join(symbols.select(F.col("file").alias("node"), F.col("name").alias("ident")), "ident").groupBy("task_id", "node").agg(F.count("*").alias("n"))
    start = named.select("task_id", "node", (F.col("n") / F.sum("n").over(Window.partitionBy("task_id"))).alias("mass"))
    return start, mentioned.select("task_id").distinct().join(named.select("task_id").distinct(), "task_id", "left_anti")


def map_restart(symbols: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(task_id, node, mass): files by how many mentioned names they define; where none is, all files alike."""
    tasks = mentioned.select("task_id").distinct()
    files = symbols.select("file").distinct()
    named = mentioned.where("ident is not null").distinct().join(symbols.select("file", F.col("name").alias("ident")), "ident").groupBy("task_id", "file").agg(F.count("*").alias("n"))
    every = tasks.crossJoin(files).join(named, ["task_id", "file"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("task_id"))
    share = F.when(total == 0, 1.0 / F.count("*").over(Window.partitionBy("task_id"))).otherwise(F.col("n") / total)
    return every.select("task_id", F.col("file").alias("node"), share.alias("mass"))


def map_definitions(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """(task_id, file, ident, score): a file's rank flows out along its edges to what they name."""
    share = F.col("w") / F.sum("w").over(Window.partitionBy("task_id", "from_file"))
    flow = edges.withColumn("share", share).join(rank.select("task_id", F.col("node").alias("from_file"), "score"), ["task_id", "from_file"])
    return flow.groupBy("task_id", F.col("to_file").alias("file"), "ident").agg(F.sum(F.col("score") * F.col("share")).alias("score"))
