"""Queries of the typed graph: links, PageRank, provenance, closures, and the ablations of the link weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators.lineage import cut, numbered
from skein.plans import views as V
from skein.plans.registry import query
from skein.plans.retrieval_queries import SEED_VIEWS, seeds, seeds_sql
from skein.plans.views import with_views
from skein.schema import EDGE_KINDS, EDGES, WEIGHTS

#: Arms that change link weights: kind -> weight (both directions, or forward and backward).
ABLATIONS: dict[str, dict] = {
    "default": {},
    "minus_calls": {"CALLS": 0.0},
    "minus_callers": {"CALLS": (1.0, 0.0)},
    "minus_impls": {"EXTENDS": 0.0, "OVERRIDES": 0.0},
    "minus_contains": {"CONTAINS": 0.0},
    "minus_samefile": {"SAME_FILE": 0.0},
    "plus_imports": {"IMPORTS": 1.0},
    "plus_references": {"REFERENCES_TYPE": 1.0},
}
NONE = {k: 0.0 for k in WEIGHTS}


def links(spark: SparkSession, d: str, changed: dict | None = None) -> DataFrame:
    return G.links(*V.graph(spark, d), G.weight_table(spark, **(changed or {})))


def weights_sql(changed: dict) -> str:
    table = dict(WEIGHTS) | {k: v if isinstance(v, tuple) else (v, v) for k, v in changed.items()}
    return "(VALUES " + ", ".join(f"('{k}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for k, (a, b) in table.items()) + ") AS w(kind, f, b)"


def links_sql(changed: dict | None = None) -> str:
    w = weights_sql(changed or {})
    ordinal = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{i}'" for i, k in enumerate(EDGE_KINDS)) + " END"
    ahead = "CASE kind WHEN 'CALLS' THEN 'called-by:' WHEN 'CONTAINS' THEN 'member-of:' WHEN 'EXTENDS' THEN 'supertype-of:' WHEN 'OVERRIDES' THEN 'overridden-by:' WHEN 'IMPORTS' THEN 'imported-by:' ELSE 'referenced-by:' END"
    back = "CASE kind WHEN 'CALLS' THEN CASE WHEN a.is_test THEN 'test-of:' ELSE 'caller-of:' END WHEN 'CONTAINS' THEN 'declares:' WHEN 'EXTENDS' THEN 'impl-of:' WHEN 'OVERRIDES' THEN 'impl-of:' WHEN 'IMPORTS' THEN 'imports:' ELSE 'type-ref:' END"
    star = f"(SELECT f AS w FROM {w} WHERE kind = 'SAME_FILE')"
    both = f"FROM edg JOIN {w} USING (kind) JOIN sym a ON a.id = from_id JOIN sym b ON b.id = to_id"
    key = f"'1' || {ordinal} || '|' || from_id || '|' || to_id"
    return f"""links AS MATERIALIZED (SELECT id AS src, 'file:' || file AS dst, w, 'in:' || file AS reason, '0' AS ord FROM sym, {star}
        UNION ALL SELECT 'file:' || file, id, w, 'same-file:' || file, '0' || id FROM sym, {star}
        UNION ALL SELECT from_id, to_id, w.f, {ahead} || a.name, {key} || '|0' {both}
        UNION ALL SELECT to_id, from_id, w.b, {back} || b.name, {key} || '|1' {both})"""


@query(with_views("SELECT from_id, to_id, kind FROM edg WHERE from_id IN (SELECT id FROM sym) AND to_id IN (SELECT id FROM sym)", "edg", "sym"))
def edge_resolve(spark: SparkSession, d: str) -> DataFrame:
    return G.resolved(V.edg(spark, d), V.sym(spark, d))


@query(with_views("SELECT kind, count(*) AS n FROM edg GROUP BY kind", "edg"))
def edge_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.edg(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(with_views("SELECT to_id, from_id FROM edg WHERE kind = 'CALLS' AND to_id IN (SELECT id FROM sym)", "edg", "sym"))
def incoming(spark: SparkSession, d: str) -> DataFrame:
    """Callers of every declaration."""
    return G.incoming(V.edg(spark, d), V.sym(spark, d).select("id"), "CALLS")


@query(with_views("SELECT from_id, to_id FROM edg WHERE kind = 'CONTAINS' AND from_id IN (SELECT id FROM sym)", "edg", "sym"))
def outgoing(spark: SparkSession, d: str) -> DataFrame:
    return G.outgoing(V.edg(spark, d), V.sym(spark, d).select("id"), "CONTAINS")


@query(with_views(f"WITH {links_sql()} SELECT src, dst, w, reason, ord FROM links", "edg", "sym"))
def links_all(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d)


@query(with_views(f"WITH {links_sql()} SELECT src, round(sum(w), 6) AS out_weight FROM links GROUP BY src", "edg", "sym"))
def out_weight(spark: SparkSession, d: str) -> DataFrame:
    return G.out_weight(links(spark, d)).withColumn("out_weight", F.round("out_weight", 6))


@query(with_views("""SELECT name, s.* FROM (SELECT name, max_by(struct_pack(id := id, file := file, start_line := start_line, nth := nth), nth) AS s
    FROM (SELECT *, row_number() OVER (ORDER BY id, file, start_line) - 1 AS nth FROM sym) GROUP BY name)""", "sym"))
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names in place of ids, for they repeat: the last position answers."""
    rows = numbered(V.sym(spark, d).select("name", "id", "file", "start_line"), "nth", "id", "file", "start_line")
    return rows.groupBy("name").agg(F.max_by(F.struct("id", "file", "start_line", "nth"), "nth").alias("s")).select("name", "s.*")


_RESTART = "start AS (SELECT task_id, id AS node, score / sum(score) OVER (PARTITION BY task_id) AS mass FROM seeds WHERE id IN (SELECT id FROM sym))"


@query(with_views(f"WITH {seeds_sql()}, {_RESTART} SELECT task_id, node, round(mass, 6) AS mass FROM start", *SEED_VIEWS))
def restart_vector(spark: SparkSession, d: str) -> DataFrame:
    s = V.sym(spark, d)
    return G.restart(seeds(spark, d, symbols=s), s).withColumn("mass", F.round("mass", 6))


def rank_sql(by: str = "task_id", iterations: int = 40, damping: float = 0.85) -> str:
    """PageRank over start (by, node, mass) and links: one recursive step carries links, returns and restarts alike."""
    return f"""moves AS MATERIALIZED (SELECT src, dst, sum(w) / sum(sum(w)) OVER (PARTITION BY src) AS p FROM links WHERE w > 0 GROUP BY src, dst),
        step AS MATERIALIZED (SELECT CAST(NULL AS BIGINT) AS t, src, dst, {damping} * p AS p FROM moves),
        r AS (SELECT 0 AS it, {by} AS t, node, mass AS score FROM start
          UNION ALL SELECT it + 1, t, node, sum(score) FROM (
            SELECT r.it, r.t, m.dst AS node, r.score * m.p * {damping} AS score FROM r JOIN moves m ON m.src = r.node
            UNION ALL SELECT r.it, r.t, s.node, r.score * s.mass * (CASE WHEN r.node IN (SELECT src FROM moves) THEN {1 - damping} ELSE 1.0 END) FROM r JOIN start s ON s.{by} = r.t)
          WHERE it < {iterations} GROUP BY it, t, node)"""


_BEST = "SELECT task_id, node, score, rank FROM (SELECT t AS task_id, node, round(score, 6) AS score, row_number() OVER (PARTITION BY t ORDER BY round(score, 6) DESC, node) AS rank FROM r WHERE it = {0} AND node NOT LIKE 'file:%' AND score > 0) WHERE rank <= {1}"


def best(scores: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """Declarations by score, those above 0, files left out."""
    order = Window.partitionBy(*(by or ["task_id"])).orderBy(F.desc("score"), "node")
    rows = scores.where("score > 0 and node not like 'file:%'").withColumn("score", F.round("score", 6))
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)


def ranked(spark: SparkSession, d: str, changed: dict, limit: int, n_seeds: int = 20) -> DataFrame:
    s = V.sym(spark, d)
    # Where no kind of edge has a weight the walk takes none, so edges are not made for it.
    e = V.edg(spark, d) if G.weighted_kinds(changed) else spark.createDataFrame([], EDGES)
    start = G.restart(seeds(spark, d, limit=n_seeds, symbols=s), s)
    return best(G.pagerank(start, G.weighed(s, e, **changed), limit=limit, hidden="file:"), limit)


def _ranked_sql(changed: dict, limit: int, seeds_limit: int = 20) -> str:
    return with_views(f"WITH {seeds_sql(limit=seeds_limit)}, {links_sql(changed)}, {_RESTART}, {rank_sql()} " + _BEST.format(40, limit), *SEED_VIEWS, "edg", recursive=True)


@query(_ranked_sql({}, 50))
def ppr_default(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d, {}, 50)


@query(_ranked_sql(NONE, 50, 400))
def ppr_seeds_only(spark: SparkSession, d: str) -> DataFrame:
    """Without weights all mass comes back: scores are the restart vector."""
    return ranked(spark, d, NONE, 50, 400)


for _arm, _changed in ABLATIONS.items():
    if _arm != "default":

        def _ablation(spark: SparkSession, d: str, changed=_changed) -> DataFrame:
            return ranked(spark, d, changed, 20)

        query(_ranked_sql(_changed, 20), name=f"ppr_{_arm}")(_ablation)


def bfs_views(levels: int) -> str:
    """Level by level: the earliest link of the earliest frontier node that reaches what no level before has."""
    parts = ["l0 AS MATERIALIZED (SELECT task_id, id AS node, 'seed' AS why, row_number() OVER (PARTITION BY task_id ORDER BY rank, id) AS ord FROM seeds)"]
    for i in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT task_id, node FROM l{j}" for j in range(i))
        parts.append(f"""l{i} AS MATERIALIZED (SELECT task_id, node, m.reason AS why, row_number() OVER (PARTITION BY task_id ORDER BY m.o, m.l) AS ord FROM (
            SELECT f.task_id, k.dst AS node, min({{'o': f.ord, 'l': k.ord, 'reason': k.reason}}) AS m FROM l{i - 1} f JOIN links k ON k.src = f.node AND k.w <> 0
            WHERE (f.task_id, k.dst) NOT IN ({seen}) GROUP BY ALL))""")
    union = " UNION ALL ".join(f"SELECT task_id, node, why, {i} AS level FROM l{i}" for i in range(levels + 1))
    return ", ".join(parts) + f", walk AS ({union})"


@query(with_views(f"WITH {seeds_sql()}, {links_sql()}, {bfs_views(10)} SELECT * FROM walk", *SEED_VIEWS, "edg"))
def bfs_why(spark: SparkSession, d: str) -> DataFrame:
    s, e = V.graph(spark, d)
    return G.provenance(seeds(spark, d, symbols=s), G.weighed(s, e))


@query(with_views("""WITH c AS (SELECT from_id AS p, to_id AS c FROM edg WHERE kind = 'CONTAINS'), d AS (SELECT p AS id, c AS descendant FROM c UNION ALL SELECT d.id, c.c FROM d JOIN c ON c.p = d.descendant)
    SELECT DISTINCT id, descendant FROM d""", "edg", recursive=True))
def descendants(spark: SparkSession, d: str) -> DataFrame:
    return G.descendants(V.edg(spark, d).where("kind = 'CONTAINS'"))


@query(with_views("""WITH c AS (SELECT max(from_id) AS p, to_id AS c FROM edg WHERE kind = 'CONTAINS' GROUP BY to_id), d AS (SELECT p AS id, c AS descendant FROM c UNION ALL SELECT d.id, c.c FROM d JOIN c ON c.p = d.descendant)
    SELECT descendant AS id, array_to_string(list_sort(list(DISTINCT id)), ' ') AS ancestors FROM d GROUP BY descendant""", "edg", recursive=True))
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return G.ancestors(V.edg(spark, d).where("kind = 'CONTAINS'")).select("id", F.array_join("ancestors", " ").alias("ancestors"))
