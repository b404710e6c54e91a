"""Unified diffs and tasks made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T

MIN_MESSAGE, MAX_FILES, SCANNED = 30, 5, 400

# Where a task's repository and base commit are written.
REPOSITORY = r'repository_name\s*=\s*"([^"]+)"'
CHECKOUT = r"git checkout ([0-9a-f]{7,40})"


def changed_lines(diffs: DataFrame, key: str) -> DataFrame:
    """(key, file, line) of the old side of each diff's hunks.

    A hunk without old lines marks the line before the insertion and the one after. A file made anew has no old side:
    its header overrides the file before it rather than letting that carry on.
    """
    rows = diffs.select(key, F.posexplode(F.split("diff", "\n")).alias("at", "row"))
    file = F.when(F.startswith("row", F.lit("--- a/")), F.substr("row", F.lit(7))).when(F.startswith("row", F.lit("--- /dev/null")), F.lit(""))
    carried = F.last(file, ignorenulls=True).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    start, count = F.regexp_extract("row", T.HUNK, 1), F.regexp_extract("row", T.HUNK, 2)
    hunks = rows.withColumn("file", carried).where((start != "") & F.col("file").isNotNull() & (F.col("file") != ""))
    first = start.cast("int")
    size = F.when(count == "", F.lit(1)).otherwise(count.cast("int"))
    last = F.when(size == 0, first + 1).otherwise(first + size - 1)
    return hunks.select(key, "file", F.explode(F.sequence(first, last)).alias("line")).distinct()


def mined_tasks(commits: DataFrame, limit: int = 40, max_files: int = MAX_FILES) -> DataFrame:
    """Tasks of commits (sha, seq, message, diff), newest first: messages long enough, 1 to max_files files outside tests."""
    recent = commits.orderBy("seq").limit(SCANNED).where(F.length(F.trim("message")) >= MIN_MESSAGE)
    lines = changed_lines(recent, "sha").where(~T.is_test_path(F.col("file")))
    files = lines.groupBy("sha", "file").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    tasks = files.groupBy("sha").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "lines")))).alias("changed_lines"), F.count("*").alias("n")).where(F.col("n") <= max_files)
    out = tasks.join(recent.select("sha", "seq", "message"), "sha").orderBy("seq").limit(limit)
    return out.select(F.substring("sha", 1, 10).alias("task_id"), F.trim("message").alias("text"), F.concat("sha", F.lit("^")).alias("base_commit"), "changed_lines")


def suite_tasks(files: DataFrame, repository: str, suffix: str = ".kt") -> DataFrame:
    """Tasks of a suite's directories. files: (path, text), path as "<task>/<file in it>". Tasks lacking a file, of
    another repository, or whose fix touches nothing but tests are left out."""
    part = lambda name: F.max(F.when(F.col("rest") == name, F.col("text")))
    rows = files.select(F.substring_index("path", "/", 1).alias("task_id"), F.regexp_replace("path", "^[^/]*/", "").alias("rest"), "text")
    t = rows.groupBy("task_id").agg(part("task.toml").alias("toml"), part("instruction.md").alias("text"), part("environment/prepare.sh").alias("sh"), part("solution/fix.patch").alias("diff"))
    t = t.withColumn("repository", F.regexp_extract("toml", REPOSITORY, 1)).withColumn("base_commit", F.regexp_extract("sh", CHECKOUT, 1))
    t = t.where((F.col("repository") == repository) & F.col("text").isNotNull() & (F.col("base_commit") != "") & F.col("diff").isNotNull())
    lines = changed_lines(t.select("task_id", "diff"), "task_id").where(F.endswith("file", F.lit(suffix)) & ~T.is_test_path(F.col("file")))
    by_file = lines.groupBy("task_id", "file").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    changed = by_file.groupBy("task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "lines")))).alias("changed_lines"))
    return t.join(changed, "task_id").select("task_id", "text", "base_commit", "changed_lines").orderBy("task_id")
