"""DuckDB SQL of the two-pass packer: a fold over a task's candidates, one step of a recursive query each."""

from __future__ import annotations

from skein.operators import packing as P
from skein.operators import rendering as R
from skein.plans.graph_queries import _RESTART, bfs_views, links_sql, rank_sql
from skein.plans.retrieval_queries import SEED_VIEWS, seeds_sql
from skein.plans.views import id_sql, with_views
from skein.schema import EDGE_KINDS  # noqa: F401  the order of kinds that links_sql writes down


def _count(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[A-Za-z0-9]+|[^A-Za-z0-9 \\n\\t\\r]'))"


#: Closures of CONTAINS: what lies below a declaration, and its owners (of several, the last).
CLOSURES = """below_pairs AS (SELECT from_id AS id, to_id AS d FROM edg WHERE kind = 'CONTAINS' UNION SELECT p.id, e.to_id FROM below_pairs p JOIN edg e ON e.from_id = p.d AND e.kind = 'CONTAINS'),
    owner AS MATERIALIZED (SELECT to_id AS id, max(from_id) AS up FROM edg WHERE kind = 'CONTAINS' GROUP BY to_id),
    above_pairs AS (SELECT id, up FROM owner UNION SELECT p.id, o.up FROM above_pairs p JOIN owner o ON o.id = p.up),
    below AS MATERIALIZED (SELECT id, list(d) AS nested FROM below_pairs GROUP BY id), above AS MATERIALIZED (SELECT id, list(up) AS owners FROM above_pairs GROUP BY id)"""


def pack_views(budget: int, full_share: float = P.FULL_SHARE, test_share: float = P.TEST_SHARE) -> str:
    """packed (the items of pack()) from ranked (task_id, id, score, rank, why), sym and edg. Recursive."""
    full = "'### ' || fq_name || chr(10) || '`' || file || ':' || start_line || '` — ' || why || chr(10) || chr(10) || '```kotlin' || chr(10) || body || chr(10) || '```' || chr(10)"
    stub = "'- ' || start_line || ': ' || signature || ' — ' || why || chr(10)"
    heading = "chr(10) || '`' || file || '`' || chr(10)"
    fixed = R.count_tokens(R.header_text(budget, budget, 1)) + P.SECTION_OVERHEAD
    spendable = max(budget - fixed, 0)
    return f"""{CLOSURES},
    cand AS MATERIALIZED (SELECT CAST(task_id AS VARCHAR) AS task_id, r.id, score, rank, why, fq_name, file, start_line, signature, s.tokens AS size, is_test, d.text AS body, coalesce(nested, CAST([] AS VARCHAR[])) AS nested, coalesce(owners, CAST([] AS VARCHAR[])) AS owners
      FROM ranked r JOIN sym s ON s.id = r.id JOIN (SELECT {id_sql('doc_id')} AS id, text FROM documents) d ON d.id = r.id LEFT JOIN below b ON b.id = r.id LEFT JOIN above a ON a.id = r.id WHERE rank <= {P.CANDIDATES}),
    entry AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY fid, density DESC, id) AS nth FROM (
      SELECT task_id, id, 1 AS fid, {_count(full)} AS own, CAST(NULL AS VARCHAR) AS grp, 0 AS head, is_test, {int(spendable * full_share)} AS most, nested, owners, body AS text, round(score / greatest(1, size), 9) AS density FROM cand
      UNION ALL SELECT task_id, id, 2, {_count(stub)}, is_test || ':' || file, {_count(heading)}, is_test, {spendable}, CAST([] AS VARCHAR[]), owners, signature, round(score / greatest(1.0, length(signature) / CAST({P.CHARS_PER_TOKEN} AS DOUBLE)), 9) FROM cand)),
    fold AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS tested, CAST([] AS STRUCT(id VARCHAR, fid INTEGER, own BIGINT)[]) AS taken, CAST([] AS VARCHAR[]) AS headed FROM entry
      UNION ALL SELECT task_id, n + 1, CASE WHEN taking THEN spent - refund + cost ELSE spent END, tested + CASE WHEN is_test AND NOT passed_over THEN cost ELSE 0 END,
        CASE WHEN taking THEN list_append(list_filter(taken, lambda t: NOT list_contains(nested, t.id)), struct_pack(id := id, fid := fid, own := CAST(own AS BIGINT))) ELSE taken END,
        CASE WHEN taking AND grp IS NOT NULL THEN list_append(headed, grp) ELSE headed END
      FROM (SELECT *, NOT passed_over AND NOT (len(nested) = 0 AND enclosed) AND spent - refund + cost <= most AS taking
        FROM (SELECT *, text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' OR list_contains(list_transform(taken, lambda t: t.id), id) OR (is_test AND tested + cost > {int(budget * test_share)}) AS passed_over
          FROM (SELECT f.task_id, f.n, f.spent, f.tested, f.taken, f.headed, x.id, x.fid, x.own, x.grp, x.is_test, x.most, x.nested, x.text, x.own + CASE WHEN x.grp IS NOT NULL AND NOT list_contains(f.headed, x.grp) THEN x.head ELSE 0 END AS cost,
              coalesce(list_sum(list_transform(list_filter(f.taken, lambda t: list_contains(x.nested, t.id)), lambda t: t.own)), 0) AS refund,
              list_has_any(x.owners, list_transform(list_filter(f.taken, lambda t: t.fid = 1), lambda t: t.id)) AS enclosed
            FROM fold f JOIN entry x ON x.task_id = f.task_id AND x.nth = f.n + 1)))),
    packed AS (SELECT task_id, t.id AS id, CASE t.fid WHEN 1 THEN 'FULL' ELSE 'STUB' END AS fidelity, why, CASE t.fid WHEN 1 THEN body ELSE signature END AS text, CAST(t.own AS INT) AS tokens, CAST(rank AS BIGINT) AS rank, CAST(spent AS INT) AS spent, {fixed} AS overhead,
        row_number() OVER (PARTITION BY task_id ORDER BY t.fid, rank, t.id) - 1 AS at
      FROM (SELECT task_id, spent, unnest(taken) AS t FROM (SELECT task_id, arg_max(spent, n) AS spent, arg_max(taken, n) AS taken FROM fold GROUP BY task_id)) JOIN cand c USING (task_id) WHERE c.id = t.id)"""


def pack_sql(ranked: str, *views: str, budget: int, final: str = " SELECT * FROM packed", **options) -> str:
    """The pack of ranked, the SQL (or several views, the last named ranked) of (task_id, id, score, rank, why)."""
    return with_views(f"WITH {ranked}, {pack_views(budget, **options)}{final}", *dict.fromkeys((*views, "sym", "edg")), recursive=True)


#: Rankings.
BM25 = "ranked AS (SELECT * FROM (SELECT task_id, {0} AS id, round(score, 6) AS score, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 6) DESC, doc_id) AS rank, 'bm25' AS why FROM bm) WHERE rank <= {1})".format(id_sql("doc_id"), P.CANDIDATES)


def searched(limit: int) -> str:
    return f"""hit AS (SELECT * FROM (SELECT task_id, {id_sql('doc_id')} AS id, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) WHERE rank <= {limit}),
        ranked AS (SELECT task_id, id, 1.0 / rank AS score, rank, 'bm25' AS why FROM hit)"""


NAMED_EDGES = """known AS MATERIALIZED (SELECT name FROM sym GROUP BY name),
    word AS (SELECT DISTINCT 'd' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents),
    call AS MATERIALIZED (SELECT DISTINCT file, start_line AS line, name FROM (SELECT * FROM word WHERE name IN (SELECT name FROM known)) w JOIN (SELECT id, file, start_line FROM sym) USING (id)),
    caller AS MATERIALIZED (SELECT c.file, line, c.name, arg_min(s.id, (-start_line, s.id)) AS from_id FROM call c JOIN sym s ON s.file = c.file AND line BETWEEN start_line AND end_line GROUP BY ALL),
    edg AS MATERIALIZED (SELECT * FROM real_edg WHERE kind <> 'CALLS' UNION ALL SELECT DISTINCT from_id, id, 'CALLS' FROM caller JOIN (SELECT id, name FROM sym WHERE name IN (SELECT name FROM sym GROUP BY name HAVING count(*) <= 20)) USING (name) WHERE from_id <> id)"""


def engine(changed: dict | None = None, n_seeds: int = 20, penalty: float = 0.3, dense: bool = False) -> str:
    """Seeds, PageRank, provenance: ranked."""
    walk = bfs_views(10)
    best = f"""best AS (SELECT * FROM (SELECT t AS task_id, node AS id, round(score, 6) AS score, row_number() OVER (PARTITION BY t ORDER BY round(score, 6) DESC, node) AS rank FROM r WHERE it = 40 AND node NOT LIKE 'file:%' AND score > 0) WHERE rank <= {P.CANDIDATES})"""
    return f"{seeds_sql(penalty, n_seeds, dense)}, {links_sql(changed)}, {_RESTART}, {rank_sql()}, {best}, {walk}, ranked AS (SELECT b.task_id, id, score, b.rank, coalesce(why, 'related') AS why FROM best b LEFT JOIN (SELECT task_id, node, why FROM walk) w ON w.task_id = b.task_id AND w.node = b.id)"


ENGINE_VIEWS = (*SEED_VIEWS, "edg")
