"""Index files, the per-commit store, ledgers and contexts on disk."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.operators import incremental
from skein.operators.lineage import cut

VERSION = 1
_INDEX = (
    "stamps map<string,string>, classpath array<string>, index struct<"
    "symbols:array<struct<id:string,fqName:string,name:string,kind:string,file:string,startLine:int,endLine:int,signature:string,doc:string,tokens:int,isTest:boolean>>,"
    "edges:array<struct<from:string,to:string,kind:string>>,"
    "errors:array<struct<file:string,line:int,message:string>>,"
    "fileCoverage:map<string,struct<callSites:int,resolvedCallees:int,attributedToCaller:int,failedFiles:int>>>, _corrupt_record string"
)


def read_index_json(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """symbols, edges, errors, coverage and stamps of a JSON index; None where there is none or it can't be read."""
    try:
        raw = spark.read.schema(_INDEX).option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=True).persist()
        if raw.where("index is not null and _corrupt_record is null").isEmpty():
            return None
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    symbols = raw.select(F.inline("index.symbols")).toDF(*[c.split()[0] for c in schema.SYMBOLS.split(", ")])
    edges = raw.select(F.inline("index.edges")).toDF("from_id", "to_id", "kind")
    errors = raw.select(F.inline("index.errors"))
    coverage = raw.select(F.explode("index.fileCoverage").alias("file", "c")).select("file", "c.*").toDF(*[c.split()[0] for c in schema.COVERAGE.split(", ")])
    stamps = raw.select(F.explode("stamps").alias("file", "stamp"))
    return {"symbols": symbols, "edges": edges, "errors": errors, "coverage": coverage, "stamps": stamps}


TABLES = {"symbols": schema.SYMBOLS, "edges": f"{schema.EDGES}, file string", "errors": schema.ERRORS, "coverage": schema.COVERAGE, "touched": "file string"}
MANIFEST = "base string, depth int, commit string"
#: Deltas on a snapshot before the next commit is written whole again.
DEPTH = 8


def _by_file(index: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with a file in each row: an edge goes by the file of what it comes from (none: the empty name)."""
    if "edges" not in index or "symbols" not in index:
        return index
    owner = index["symbols"].groupBy(F.col("id").alias("from_id")).agg(F.max("file").alias("file"))
    edges = index["edges"].select("from_id", "to_id", "kind").join(owner, "from_id", "left").select("from_id", "to_id", "kind", F.coalesce("file", F.lit("")).alias("file"))
    return {**index, "edges": edges}


def _prints(tables: dict[str, DataFrame]) -> DataFrame:
    """(file, print): what all rows of a file come to, in whatever order they stand."""
    rows = [df.select("file", F.xxhash64(F.lit(n), *sorted(c for c in df.columns if c != "file")).cast("decimal(38,0)").alias("h")) for n, df in sorted(tables.items())]
    return functools.reduce(DataFrame.unionByName, rows).groupBy("file").agg(F.struct(F.sum("h"), F.count("*")).alias("print"))


def _write(tables: dict[str, DataFrame], root: str, commit: str, base: str | None, depth: int) -> None:
    """One folder a table, a partition a commit, under the version of the schema. A commit written again replaces itself."""

    def put(name: str, df: DataFrame) -> None:
        rows = df.withColumn("commit", F.lit(commit)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy("commit").parquet(f"{root}/v{VERSION}/{name}")

    for name, df in tables.items():
        put(name, df)
    spark = next(iter(tables.values())).sparkSession  # last: the commit is there once all of its tables are
    put("commits", spark.createDataFrame([(base, depth)], "base string, depth int"))


def write_index(index: dict[str, DataFrame], root: str, commit: str) -> None:
    """A snapshot: all rows of all tables."""
    _write(_by_file(index), root, commit, None, 0)


def write_delta(index: dict[str, DataFrame], root: str, commit: str, base: str) -> None:
    """The commit as what differs from a stored one: rows of files that have other rows than there, and the names of these
    files (of a file that is gone there is the name alone). What is written is in proportion to such files; every DEPTH-th
    delta on a snapshot is a snapshot in its turn, so no chain grows longer."""
    spark = index["symbols"].sparkSession
    depth = _manifest(spark, root, base)["depth"] + 1
    if depth > DEPTH:
        return write_index(index, root, commit)
    tables, before = _by_file(index), _by_file(read_index(spark, root, base))
    now, was = _prints({n: tables[n] for n in before}), _prints(before).withColumnRenamed("print", "was")
    touched = cut(now.join(was, "file", "full").where(~F.col("print").eqNullSafe(F.col("was"))).select("file"))
    return _write({**{n: tables[n].join(touched, "file", "left_semi") for n in before}, "touched": touched}, root, commit, base, depth)


def _table(spark: SparkSession, root: str, name: str, columns: str) -> DataFrame:
    try:
        return spark.read.schema(columns).parquet(f"{root}/v{VERSION}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], columns)
        raise


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(commit) of the store: those whose manifest is there."""
    return _table(spark, root, "commits", MANIFEST).select("commit")


def _manifest(spark: SparkSession, root: str, commit: str) -> dict:
    found = _table(spark, root, "commits", MANIFEST).where(F.col("commit") == commit).first()
    if found is None:
        raise KeyError(f"the store has no commit {commit}")
    return found.asDict()


def index_at(spark: SparkSession, root: str, commit: str, changes: Callable[[DataFrame], DataFrame], index: Callable[[DataFrame | None], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The index of a commit: read if the store has it, else patched from the nearest commit that is near enough, else built.

    changes: of stored commits (commit), (commit, base, file) of the files that differ between them and this one. index: the
    tables of some files, or of all (None). What is not read is written.
    """
    stored = commits(spark, root)
    if stored.where(F.col("commit") == commit).isEmpty():
        differ = changes(stored)
        near = incremental.nearest(differ.groupBy("commit", "base").agg(F.count("*").alias("n_changed"))).first()
        base = read_index(spark, root, near["base"]) if near else None
        if base and incremental.worth_reusing(near["n_changed"], base["symbols"].select("file").distinct().count()):
            write_delta(incremental.patched(base, differ.where(F.col("base") == near["base"]).select("file"), index), root, commit, near["base"])
        else:
            write_index(index(None), root, commit)
    return read_index(spark, root, commit)


def read_index(spark: SparkSession, root: str, commit: str) -> dict[str, DataFrame]:
    """The tables of one commit. Of its chain of deltas and the snapshot below them, the last commit that touched a file has
    its rows; the partitions of the chain alone are read."""
    chain = [_manifest(spark, root, commit)]
    while chain[-1]["base"] is not None:
        chain.append(_manifest(spark, root, chain[-1]["base"]))
    order = {m["commit"]: at for at, m in enumerate(reversed(chain))}
    place = F.coalesce(*(F.when(F.col("commit") == c, F.lit(at)) for c, at in order.items()))
    kinds = {n: c for n, c in TABLES.items() if n != "touched"}
    out = {n: _table(spark, root, n, f"{c}, commit string").where(F.col("commit").isin(list(order))) for n, c in kinds.items()}
    if len(chain) > 1:
        later = [c for c, at in order.items() if at]
        last = _table(spark, root, "touched", f"{TABLES['touched']}, commit string").where(F.col("commit").isin(later)).groupBy("file").agg(F.max(place).alias("_last"))
        out = {n: df.withColumn("_place", place).join(last, "file", "left").where(F.col("_place") == F.coalesce("_last", F.lit(0))) for n, df in out.items()}
    whole = {"symbols": schema.SYMBOLS, "edges": schema.EDGES, "errors": schema.ERRORS, "coverage": schema.COVERAGE}
    return {n: df.select([c.split()[0] for c in whole[n].split(", ")]) for n, df in out.items()}


def read_files(spark: SparkSession, path: str, glob: str = "*.{kt,kts}") -> DataFrame:
    """(file, text) of a source tree, paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return raw.select(F.regexp_replace("path", f"^(file:)?/*{path.strip('/')}/", "").alias("file"), F.col("content").cast("string").alias("text"))


ANALYSIS = "file string, symbols array<struct<%s>>, edges array<struct<%s>>, errors array<struct<line:int,message:string>>, call_sites int, resolved_callees int, attributed_to_caller int, failed_files int"


def analysed(spark: SparkSession, path: str, analyse: Callable[[str, str], dict], glob: str = "*.{kt,kts}", notes: int = incremental.NOTES) -> dict[str, DataFrame]:
    """symbols, edges, errors and coverage of a source tree, file by file: one that fails costs no other its place.

    analyse: of (file, text) a dict of symbols and edges (tuples as in the schema, symbols without their file), errors (line,
    message; the first `notes` are kept) and the three counts of call sites. A file that can't be read, isn't UTF-8 or that
    analyse() raises on has a row of coverage with failed_files 1, an error on line 1, and nothing else. Files are listed
    without being opened; what can't be read is what the listing has and the reader, which passes over it, hasn't. An
    empty file gives nothing.
    """
    source = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    name = F.regexp_replace("path", f"^(file:)?/*{path.strip('/')}/", "").alias("file")
    listed = source().load(path).select(name)
    got = source().option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(path).select(name, "content")

    def one(file: str, content: bytes | None) -> tuple:
        try:
            found = analyse(file, content.decode("utf-8"))
            symbols = [(*s[:4], file, *s[4:]) for s in found.get("symbols", ())]
            return file, symbols, list(found.get("edges", ())), list(found.get("errors", ()))[:notes], *(int(found.get(c, 0)) for c in ("call_sites", "resolved_callees", "attributed_to_caller")), 0
        except Exception as e:  # whatever a file brings about is told of that file, and the others go on  # noqa: BLE001
            return file, [], [], [(1, f"{type(e).__name__}: {e}"[:200])], 0, 0, 0, 1

    def each(batches):
        for batch in batches:
            yield pd.DataFrame([one(f, c) for f, c in zip(batch["file"], batch["content"], strict=True)], columns=["file", "symbols", "edges", "errors", "call_sites", "resolved_callees", "attributed_to_caller", "failed_files"])

    kind = ANALYSIS % tuple(s.replace(", ", ",").replace(" ", ":") for s in (schema.SYMBOLS, schema.EDGES))
    told = cut(listed.join(got, "file", "left").mapInPandas(each, kind))
    return {
        "symbols": told.select(F.inline("symbols")),
        "edges": told.select(F.inline("edges")),
        "errors": told.select("file", F.inline("errors")).select("file", "line", "message"),
        "coverage": told.select("file", "call_sites", "resolved_callees", "attributed_to_caller", "failed_files"),
    }


LEDGER = "task string, arm string, outcome string, tokens long"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated ledger; rows of fewer than two columns are ignored."""
    return spark.read.schema(LEDGER).csv(path, sep="\t").where("task is not null and arm is not null")


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds trials; a (task, arm) that the ledger has already stays as it is, so a batch may be added again."""
    new = rows.select("task", "arm", "outcome", "tokens").dropDuplicates(["task", "arm"])
    try:
        new = new.join(read_ledger(rows.sparkSession, path).select("task", "arm"), ["task", "arm"], "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.select("task", "arm", "outcome", "tokens").write.mode("append").csv(path, sep="\t")


def write_contexts(markdown: DataFrame, path: str) -> None:
    """Each task's context beside the run, a folder a task and arm. markdown: (task_id, arm, markdown)."""
    markdown.select("task_id", "arm", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("task_id", "arm").text(path)


def report(means: DataFrame) -> DataFrame:
    """(at, line) of a Markdown table of arms by budgets. means: (arm, budget, recall)."""
    cell = F.format_string("%d=%.1f%%", F.col("budget"), 100.0 * F.col("recall"))
    rows = means.groupBy("arm").agg(F.array_sort(F.collect_list(F.struct("budget", cell.alias("c")))).alias("l"))
    return rows.select("arm", F.concat(F.lit("| "), F.rpad("arm", 20, " "), F.lit(" | "), F.array_join(F.transform("l", lambda x: x["c"]), " | "), F.lit(" |")).alias("line"))
