"""The typed graph: links, personalised PageRank, breadth-first provenance, closures."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import held
from skein.operators.blocks import walk
from skein.operators.lineage import cut, numbered
from skein.operators.reach import provenance  # noqa: F401  part of this module's names
from skein.schema import EDGE_KINDS, WEIGHTS

DAMPING, ITERATIONS, TOLERANCE = 0.85, 40, 1e-8
# Fixed value: the class that all others extend.
ROOT_CLASS = "kotlin.Any"
#: Levels of a walk after which the parts seen so far are written as one table.
FOLD = 8


def positions(symbols: DataFrame) -> DataFrame:
    """symbols with pos, their canonical order (id, file, start_line), from 0."""
    return numbered(symbols, "pos", "id", "file", "start_line")


def last_by_id(symbols: DataFrame) -> DataFrame:
    """Ids may repeat; the last in canonical order (of equals, the last by its other columns) answers for an id."""
    rest = [c for c in symbols.columns if c not in ("id", "file", "start_line")]
    last = symbols.groupBy("id").agg(F.max(F.struct("file", "start_line", *rest)).alias("s"))
    return last.select("id", "s.*").select(symbols.columns)


def resolved(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges both of whose ends are symbols."""
    ids = symbols.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id", "kind")


def incoming(edges: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("kind") == kind).join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("to_id", "from_id")


def outgoing(edges: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("kind") == kind).join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select("from_id", "to_id")


def _weights(changed: dict[str, float | tuple[float, float]]) -> dict[str, tuple[float, float]]:
    return dict(WEIGHTS) | {kind.upper(): w if isinstance(w, tuple) else (w, w) for kind, w in changed.items()}


def weighted_kinds(changed: dict[str, float | tuple[float, float]]) -> list[str]:
    """Kinds of edges that have a weight in a direction."""
    return [k for k, w in _weights(changed).items() if any(w) and k in EDGE_KINDS]


def weight_table(spark: SparkSession, **changed: float | tuple[float, float]) -> DataFrame:
    """(kind, forward, backward). calls=0.0 sets both directions, CALLS=(1.0, 0.0) each."""
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in _weights(changed).items()], "kind string, forward double, backward double")


def file_node(file) -> F.Column:
    return F.concat(F.lit("file:"), file)


def links(symbols: DataFrame, edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(src, dst, w, reason, ord): each edge both ways, and a star around each file.

    ord orders a node's links: its file first, then edges in canonical order, forward before backward.
    """
    s = symbols.select("id", "name", "file", "is_test")
    same = F.broadcast(weights.where("kind = 'SAME_FILE'").select(F.col("forward").alias("w")))
    star = s.crossJoin(same)
    name = T.basename(F.col("file"))
    to_file = star.select(F.col("id").alias("src"), file_node(F.col("file")).alias("dst"), "w", F.concat(F.lit("in:"), name).alias("reason"), F.lit("0").alias("ord"))
    from_file = star.select(file_node(F.col("file")).alias("src"), F.col("id").alias("dst"), "w", F.concat(F.lit("same-file:"), name).alias("reason"), F.concat(F.lit("0"), F.col("id")).alias("ord"))
    return to_file.unionByName(from_file).unionByName(edge_links(symbols, edges, weights))


def edge_links(symbols: DataFrame, edges: DataFrame, weights: DataFrame) -> DataFrame:
    """links() without the stars around files."""
    s = symbols.select("id", "name", "is_test")
    w = F.broadcast(weights)  # a row for each kind
    ordinal = F.lit(0)
    for i, kind in enumerate(EDGE_KINDS):
        ordinal = F.when(F.col("kind") == kind, F.lit(i)).otherwise(ordinal)
    e = edges.join(w, "kind").join(s.select(F.col("id").alias("from_id"), F.col("name").alias("from_name"), F.col("is_test").alias("from_test")), "from_id")
    e = e.join(s.select(F.col("id").alias("to_id"), F.col("name").alias("to_name")), "to_id")
    key = F.concat(F.lit("1"), ordinal.cast("string"), F.lit("|"), F.col("from_id"), F.lit("|"), F.col("to_id"))
    pick = lambda options: F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in options.items()))
    forward = pick({"CALLS": F.lit("called-by:"), "CONTAINS": F.lit("member-of:"), "EXTENDS": F.lit("supertype-of:"), "OVERRIDES": F.lit("overridden-by:"), "IMPORTS": F.lit("imported-by:"), "REFERENCES_TYPE": F.lit("referenced-by:")})
    caller = F.when(F.col("from_test"), F.lit("test-of:")).otherwise(F.lit("caller-of:"))
    backward = pick({"CALLS": caller, "CONTAINS": F.lit("declares:"), "EXTENDS": F.lit("impl-of:"), "OVERRIDES": F.lit("impl-of:"), "IMPORTS": F.lit("imports:"), "REFERENCES_TYPE": F.lit("type-ref:")})
    ahead = e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("forward").alias("w"), F.concat(forward, "from_name").alias("reason"), F.concat(key, F.lit("|0")).alias("ord"))
    back = e.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), F.col("backward").alias("w"), F.concat(backward, "to_name").alias("reason"), F.concat(key, F.lit("|1")).alias("ord"))
    return ahead.unionByName(back)


@dataclass(frozen=True)
class Through:
    """CALLS edges that aren't written out: each of callers (id, r) calls each of declared (id, r) of the same number r, from
    0. Nobody is both for one r, and of symbols (id, name, is_test) each has a row.

    A walk over n callers and m declarations of a name passes n + m links there, not n * m.
    """

    callers: DataFrame
    declared: DataFrame
    symbols: DataFrame
    forward: float = WEIGHTS["CALLS"][0]
    backward: float = WEIGHTS["CALLS"][1]
    #: What the ord of their links begins with.
    ord: str = f"1{EDGE_KINDS.index('CALLS')}|"

    def edges(self) -> DataFrame:
        pairs = self.callers.select(F.col("id").alias("from_id"), "r").join(self.declared.select(F.col("id").alias("to_id"), "r"), "r")
        return pairs.select("from_id", "to_id", F.lit("CALLS").alias("kind")).distinct()

    def links(self) -> DataFrame:
        """Written out."""
        return edge_links(self.symbols, self.edges(), weight_table(self.symbols.sparkSession, CALLS=(self.forward, self.backward)))

    def reasons(self, steps: DataFrame) -> DataFrame:
        """steps (src, dst, back, ...) with the reason of their link, as links() has it."""
        s = self.symbols
        steps = steps.join(s.select(F.col("id").alias("src"), F.col("name").alias("_name")), "src").join(s.select(F.col("id").alias("dst"), F.col("is_test").alias("_test")), "dst")
        kind = F.when(~F.col("back"), "called-by:").when(F.col("_test"), "test-of:").otherwise("caller-of:")
        return steps.withColumn("reason", F.concat(kind, "_name")).drop("_name", "_test")


def weighed(symbols: DataFrame, edges: DataFrame, **changed: float | tuple[float, float]) -> DataFrame:
    """links() that have a weight: edges of kinds that have none are left out before they meet symbols."""
    some = edges.where(F.col("kind").isin(weighted_kinds(changed)))
    return links(symbols, some, weight_table(symbols.sparkSession, **changed)).where("w <> 0")


def supertype_edges(symbols: DataFrame) -> DataFrame:
    """EXTENDS edges of symbols (id, supertypes): to each supertype but the root of all classes."""
    return symbols.select(F.col("id").alias("from_id"), F.explode("supertypes").alias("to_id")).where(F.col("to_id") != ROOT_CLASS).select("from_id", "to_id", F.lit("EXTENDS").alias("kind"))


def type_edges(symbols: DataFrame) -> DataFrame:
    """REFERENCES_TYPE edges of symbols (id, kind, return_type, parameter_types, receiver_type): functions to all three,
    constructors to parameters, properties to their type. Types that don't resolve are null."""
    one = lambda c: F.array(F.col(c))
    types = F.when(F.col("kind") == "FUNCTION", F.concat(one("return_type"), "parameter_types", one("receiver_type"))).when(F.col("kind") == "CONSTRUCTOR", F.col("parameter_types")).when(F.col("kind") == "PROPERTY", one("return_type"))
    return symbols.select(F.col("id").alias("from_id"), F.explode(F.array_compact(types)).alias("to_id"), F.lit("REFERENCES_TYPE").alias("kind"))


def out_weight(links_: DataFrame) -> DataFrame:
    return links_.groupBy("src").agg(F.sum("w").alias("out_weight"))


def restart(seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, node, mass): seed scores as shares; a task none of whose seeds is a symbol has no rows."""
    known = seeds.join(symbols.select("id").distinct(), "id", "left_semi")
    return known.select("task_id", F.col("id").alias("node"), (F.col("score") / F.sum("score").over(Window.partitionBy("task_id"))).alias("mass"))


def pagerank(start: DataFrame, moves: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float | None = TOLERANCE, by: str = "task_id", limit: int | None = None, hidden: str | None = None, through: Through | None = None) -> DataFrame:
    """(task, node, score) of personalised PageRank, all tasks at once: groups of tasks that hold the graph
    (operators/held.py), or, where it is too large, blocks of tasks that are sent along it (operators/blocks.py).

    start: (task, node, mass), summing to 1 a task. moves: (src, dst, w). Mass at nodes without outgoing weight returns to
    the restart vector, as does the share 1 - damping of all other mass. With limit, at least the nodes that are among a
    task's best so many, by score of six digits, then node, those that begin with `hidden` left out. through: more moves, not written out.
    """
    scores = held.walk(start, moves, damping, iterations, tolerance, by, limit, hidden, through)
    if scores is None and through is not None:
        moves = moves.select("src", "dst", "w").unionByName(through.links().select("src", "dst", "w"))
    return walk(start, moves, damping, iterations, tolerance, by).scores() if scores is None else scores


def descendants(contains: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, descendant): the transitive closure of CONTAINS; with ids, of these alone.

    All of it: paths of up to twice the length in each round, until a round adds none, so a chain of n takes log n rounds.
    Of some ids: a walk down from them, level by level.
    """
    edges = contains.select(F.col("from_id").alias("parent"), F.col("to_id").alias("child")).distinct()
    if ids is not None:
        edges = cut(edges)
        return _walk(edges, edges.withColumnRenamed("parent", "id").join(ids.select("id").distinct(), "id", "left_semi"))
    paths, known = cut(edges.toDF("id", "descendant")), -1
    while (n := paths.count()) > known:
        known = n
        longer = paths.join(paths.toDF("descendant", "below"), "descendant").select("id", F.col("below").alias("descendant"))
        paths = cut(paths.unionByName(longer).distinct())
    return paths


def _walk(edges: DataFrame, first: DataFrame) -> DataFrame:
    """(id, descendant) reached along edges (parent, child) from the pairs (id, child) of first."""
    frontier = cut(first.select("id", F.col("child").alias("descendant")).distinct())
    reached = frontier
    for level in itertools.count(1):
        step = frontier.join(edges, F.col("descendant") == F.col("parent")).select("id", F.col("child").alias("descendant")).distinct()
        frontier = cut(step.join(reached, ["id", "descendant"], "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
        if level % FOLD == 0:
            reached = cut(reached)


def ancestors(contains: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, ancestors array) along owners; where a child has several, the last in order owns it. With ids, of these alone."""
    owner = contains.groupBy("to_id").agg(F.max("from_id").alias("from_id"))
    if ids is None:
        pairs = descendants(owner.select("from_id", "to_id")).select(F.col("descendant").alias("id"), F.col("id").alias("above"))
    else:  # the same walk, upwards
        pairs = descendants(owner.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), ids).select("id", F.col("descendant").alias("above"))
    return pairs.groupBy("id").agg(F.array_sort(F.collect_list("above")).alias("ancestors"))
