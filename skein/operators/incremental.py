"""An index kept up to date: stamps, what is dirty, who refers to it, and the merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.lineage import cut, numbered

REUSE_SHARE, NOTES = 0.35, 20
#: Bytes of build files, and of library names, that one hash or list is made of: they stand in one row.
ONE_ROW = 256 << 20


def stamps(files: DataFrame) -> DataFrame:
    """(file, stamp): SHA-256 of each file's content."""
    return files.select("file", F.sha2(F.col("text").cast("binary"), 256).alias("stamp"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One hash over all build files, in order of path, path before content; files under build/ or .gradle/ don't count.

    The hash is of the texts end to end, so they meet in one row: more than ONE_ROW bytes of them fail, with a message.
    """
    kept = files.where(~F.col("file").rlike(r"(^|/)(build|\.gradle)/"))
    listed = F.array_sort(F.collect_list(F.struct("file", "text")))
    _bounded(kept, F.octet_length("file") + F.octet_length("text"), "build files")
    return kept.agg(F.sha2(F.array_join(F.transform(listed, lambda x: F.concat(x["file"], x["text"])), "").cast("binary"), 256).alias("fingerprint"))


def _bounded(rows: DataFrame, size: Column, what: str) -> None:
    if (total := rows.agg(F.sum(size)).first()[0] or 0) > ONE_ROW:
        raise ValueError(f"{total} bytes of {what} are more than one row holds ({ONE_ROW})")


def classpath_identity(jars: DataFrame) -> DataFrame:
    """The sorted name:length list of libraries, at most ONE_ROW bytes."""
    _bounded(jars, F.octet_length("name") + 24, "library names")
    return jars.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", F.col("length").cast("string")))), "\n").alias("identity"))


def dirty(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change) of stamps that differ on either side: added, removed or changed."""
    both = old.select("file", F.col("stamp").alias("was")).join(new.select("file", F.col("stamp").alias("now")), "file", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("file", change.alias("change"))


def worth_reusing(n_changed: int, n_indexed: int) -> bool:
    return n_indexed > 0 and n_changed <= REUSE_SHARE * n_indexed


def reusable(changes: DataFrame) -> DataFrame:
    """Rows (..., n_changed, n_indexed) whose base is worth patching."""
    return changes.where((F.col("n_indexed") > 0) & (F.col("n_changed") <= F.lit(REUSE_SHARE) * F.col("n_indexed")))


def referrers_to_removed(symbols: DataFrame, edges: DataFrame, changed: DataFrame, survivors: DataFrame) -> DataFrame:
    """Files, not changed themselves, with an edge to a declaration of a changed file that is gone."""
    gone = symbols.join(changed, "file", "left_semi").select("id").join(survivors.select("id"), "id", "left_anti")
    pointing = edges.join(gone.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id"))
    return pointing.join(symbols.select("id", "file"), "id").select("file").distinct().join(changed, "file", "left_anti")


def newly_declared(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """(name) that fresh symbols have and base's don't."""
    return fresh.select("name").distinct().join(base.select("name"), "name", "left_anti")


def patched(base: dict[str, DataFrame], changed: DataFrame, index: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """base after the files in changed (file) did change: these are indexed anew, and so are the unchanged files whose edges
    point at a declaration that is gone, or whose unresolved calls name one that is new. index: the tables of some files."""
    changed = cut(changed.select("file").distinct())
    fresh = {k: cut(df) for k, df in index(changed).items()}
    to_removed = referrers_to_removed(base["symbols"], base["edges"], changed, fresh["symbols"])
    to_added = referrers_to_added(base["errors"], changed, newly_declared(base["symbols"], fresh["symbols"]))
    extra = cut(to_removed.unionByName(to_added).distinct())
    return merge(base, changed.unionByName(extra), fresh, index(extra))


def referrers_to_added(errors: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Files, not changed themselves, whose unresolved calls name something now declared. fresh: newly_declared()."""
    asked = errors.select("file", T.unresolved_callee(F.col("message")).alias("name")).where("name is not null")
    return asked.join(fresh.select("name"), "name", "left_semi").select("file").distinct().join(changed, "file", "left_anti")


def merge(base: dict[str, DataFrame], dirty_files: DataFrame, fresh: dict[str, DataFrame], repaired: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """symbols, edges, errors and coverage: what base has of clean files, all of fresh, and of repaired. Edges go by the
    file they come from; one whose source base doesn't know is kept."""
    if repaired is not None:
        fresh = {k: df.unionByName(repaired[k]) if k in repaired else df for k, df in fresh.items()}
    gone = dirty_files.select("file").distinct()
    clean = {k: base[k].join(gone, "file", "left_anti") for k in ("symbols", "errors", "coverage") if k in base}
    owners = base["symbols"].join(gone, "file", "left_semi").select(F.col("id").alias("from_id")).distinct()
    out = {k: df.unionByName(fresh[k]) for k, df in clean.items()}
    out["edges"] = base["edges"].join(owners, "from_id", "left_anti").unionByName(fresh["edges"]).distinct()
    return out


def nearest(changes: DataFrame) -> DataFrame:
    """(commit, base, n_changed): of each commit's cached ones, that with the fewest changed files, then by name."""
    best = changes.groupBy("commit").agg(F.min(F.struct("n_changed", "base")).alias("m"))
    return best.select("commit", "m.base", "m.n_changed")


def coverage_fold(coverage: DataFrame) -> DataFrame:
    return coverage.agg(*(F.sum(c).alias(c) for c in ("call_sites", "resolved_callees", "attributed_to_caller", "failed_files")))


def coverage_rates(coverage: DataFrame) -> DataFrame:
    """coverage with callee_rate and caller_rate, 1.0 without call sites."""
    rate = lambda c: F.when(F.col("call_sites") == 0, F.lit(1.0)).otherwise(F.col(c) / F.col("call_sites"))
    return coverage.withColumns({"callee_rate": rate("resolved_callees"), "caller_rate": rate("attributed_to_caller")})


def first_notes(errors: DataFrame, limit: int = NOTES) -> DataFrame:
    """The first notes of each file, in the order they were made (seq)."""
    nth = F.row_number().over(Window.partitionBy("file").orderBy("seq"))
    return errors.withColumn("_n", nth).where(F.col("_n") <= limit).drop("_n")


def canonical_edges(edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Distinct edges with ord, from 0: by kind, then by ends."""
    at = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    rows = edges.select("from_id", "to_id", "kind").distinct().withColumn("_kind", at)
    return numbered(rows, "ord", "_kind", "from_id", "to_id").drop("_kind")


def without_excluded(roots: DataFrame, excluded: DataFrame) -> DataFrame:
    """Roots (path) that are not equal to or under an excluded path: each path that a root lies within is a key."""
    pieces = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), "/"))
    within = roots.where("path is not null").select("path").distinct().select("path", F.explode(above).alias("_x"))
    return roots.join(within.join(excluded.select(F.col("path").alias("_x")), "_x", "left_semi").select("path"), "path", "left_anti").select(*roots.columns)


def distinct_roots(main: DataFrame, test: DataFrame) -> DataFrame:
    return main.unionByName(test).distinct()


def relocated(roots: DataFrame, head: Column, checkout: Column, conventional: DataFrame) -> DataFrame:
    """Roots under one checkout moved to another, with the conventional ones."""
    moved = F.when(F.startswith("path", head), F.concat(checkout, F.substr("path", F.length(head) + 1))).otherwise(F.col("path"))
    return roots.select(moved.alias("path")).unionByName(conventional).distinct()
