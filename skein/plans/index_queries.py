"""Queries of names, lines, diffs, gold, metrics, ledgers and index upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import schema
from skein.functions import text as T
from skein.operators import gold as Gd
from skein.operators import incremental as I
from skein.operators import ledger as L
from skein.operators import names as N
from skein.operators import packing as P
from skein.operators import rendering as Re
from skein.operators import retrieval as R
from skein.operators.blocks import Vectors, spread, walk
from skein.operators.lineage import cut
from skein.plans import views as V
from skein.plans.registry import query
from skein.plans.views import id_sql, with_views
from skein.sources import diffs as D

# Names and lines. Files are the documents, as files of their own.


def files(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select(V.doc_id(F.col("doc_id")).alias("file"), "text")


_FILES = f"(SELECT {id_sql('doc_id')} AS file, string_split(text, chr(10)) AS l FROM documents)"


@query(f"""SELECT file, c AS chunk, c * 40 + 1 AS start_line, least(c * 40 + 40, len(l)) AS end_line, sha256(array_to_string(l[c * 40 + 1 : c * 40 + 40], chr(10))) AS text
    FROM (SELECT file, l, CAST(unnest(generate_series(0, (len(l) - 1) // 40)) AS INT) AS c FROM {_FILES})""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return N.windows(files(spark, d)).withColumn("text", F.sha2(F.col("text").cast("binary"), 256))


_SPANS = f"SELECT {id_sql('event_id')} AS id, {id_sql('user_id % 200')} AS file, CAST(event_id % 60 + 1 AS INT) AS s, CAST(event_id % 60 + 1 + event_id % 7 AS INT) AS e FROM events"


def spans(spark: SparkSession, d: str) -> DataFrame:
    """(id, file, start_line, end_line, name, pos): declarations, of events, on the files above."""
    e = V.table(spark, d, "events")
    start = F.col("event_id") % 60 + 1
    return e.select(V.doc_id(F.col("event_id")).alias("id"), V.doc_id(F.col("user_id") % 200).alias("file"), start.cast("int").alias("start_line"), (start + F.col("event_id") % 7).cast("int").alias("end_line"), F.concat(F.lit("n"), (F.col("event_id") % 300).cast("string")).alias("name"), F.col("event_id").alias("pos"))


@query(f"""SELECT c.file, chunk, id FROM (SELECT file, CAST(unnest(generate_series(0, (len(l) - 1) // 40)) AS INT) AS chunk, len(l) AS n FROM {_FILES}) c JOIN ({_SPANS}) s USING (file)
    WHERE s >= chunk * 40 + 1 AND e <= least(chunk * 40 + 40, n)""")
def chunk_contains(spark: SparkSession, d: str) -> DataFrame:
    return N.contained(N.windows(files(spark, d)), spans(spark, d))


_CALLS = f"SELECT {id_sql('l_partkey % 200')} AS file, CAST(l_linenumber * 9 % 61 + 1 AS INT) AS line, 'n' || CAST(l_partkey % 320 AS VARCHAR) AS name FROM lineitem"
_INNER = f"(SELECT file, line, name, arg_min(id, (-s, id)) AS id FROM (SELECT DISTINCT * FROM ({_CALLS})) c JOIN ({_SPANS}) s USING (file) WHERE line BETWEEN s AND e GROUP BY file, line, name)"


def call_sites(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem")
    return li.select(V.doc_id(F.col("l_partkey") % 200).alias("file"), (F.col("l_linenumber") * 9 % 61 + 1).cast("int").alias("line"), F.concat(F.lit("n"), (F.col("l_partkey") % 320).cast("string")).alias("name"))


@query(f"SELECT file, line, name, id FROM {_INNER}")
def innermost(spark: SparkSession, d: str) -> DataFrame:
    return N.innermost(call_sites(spark, d).distinct(), spans(spark, d))


def _names_sql(cap: int | None) -> str:
    few = f"WHERE (SELECT count(*) FROM events y WHERE y.event_id % 300 = x.event_id % 300) <= {cap}" if cap else ""
    return f"""SELECT DISTINCT c.id AS from_id, d.id AS to_id, 'CALLS' AS kind FROM {_INNER} c
        JOIN (SELECT {id_sql('event_id')} AS id, 'n' || CAST(event_id % 300 AS VARCHAR) AS name FROM events x {few}) d USING (name) WHERE c.id <> d.id"""


@query(_names_sql(None))
def name_calls(spark: SparkSession, d: str) -> DataFrame:
    return N.name_calls(call_sites(spark, d), spans(spark, d), None)


@query(_names_sql(33))
def name_calls_capped(spark: SparkSession, d: str) -> DataFrame:
    return N.name_calls(call_sites(spark, d), spans(spark, d), 33)


@query(r"SELECT conv_id, turn, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '[^ -~]', ' ', 'g'), '([a-z]{4,}) ', '\1(', 'g'), '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) AS name FROM conversations")
def called_names(spark: SparkSession, d: str) -> DataFrame:
    """Names before a bracket, of conversations whose longer words are given one."""
    c = V.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.explode(T.called(F.regexp_replace(F.regexp_replace("text", "[^ -~]", " "), "([a-z]{4,}) ", "$1("))).alias("name"))


# The reference map: files are sources, identifiers are symbol names, references are those in the documents' texts.

_REFS = """refs AS MATERIALIZED (SELECT file, ident, n - coalesce(own, 0) AS count FROM (SELECT source AS file, ident, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS ident FROM documents) GROUP BY ALL)
    LEFT JOIN (SELECT file, name AS ident, count(*) AS own FROM sym GROUP BY ALL) USING (file, ident) WHERE ident IN (SELECT name FROM sym) AND n - coalesce(own, 0) > 0)"""
_ASKED = "asked AS MATERIALIZED (SELECT DISTINCT task_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS ident FROM tsk)"
_DEFS = "defs AS (SELECT DISTINCT file AS to_file, name AS ident FROM sym)"
_MAP = f"""{_REFS}, {_ASKED}, {_DEFS}, tasks AS (SELECT DISTINCT task_id FROM asked), e AS MATERIALIZED (
    SELECT task_id, r.file AS from_file, to_file, ident, CASE WHEN length(ident) >= 8 AND ((regexp_matches(ident, '[A-Z]') AND regexp_matches(ident, '[a-z]')) OR contains(ident, '_')) THEN 10.0 ELSE 1.0 END
      * CASE WHEN starts_with(ident, '_') THEN 0.1 ELSE 1.0 END * CASE WHEN definers > 5 THEN 0.1 ELSE 1.0 END * sqrt(CAST(count AS DOUBLE)) * CASE WHEN a.ident IS NOT NULL THEN 10.0 ELSE 1.0 END AS w
    FROM refs r JOIN defs USING (ident) JOIN (SELECT ident, count(*) AS definers FROM defs GROUP BY ident) USING (ident) CROSS JOIN tasks LEFT JOIN asked a USING (task_id, ident)
    UNION ALL SELECT task_id, to_file, to_file, ident, CAST(0.1 AS DOUBLE) FROM defs CROSS JOIN tasks WHERE ident NOT IN (SELECT ident FROM refs))"""
_MAPSTART = """start AS MATERIALIZED (SELECT task_id, file AS node, CASE WHEN sum(n) OVER w = 0 THEN 1.0 / count(*) OVER w ELSE CAST(n AS DOUBLE) / sum(n) OVER w END AS mass
    FROM (SELECT task_id, file, coalesce(n, 0) AS n FROM tasks CROSS JOIN (SELECT DISTINCT file FROM sym) LEFT JOIN (SELECT task_id, file, count(*) AS n FROM asked JOIN sym ON name = ident GROUP BY ALL) USING (task_id, file)) WINDOW w AS (PARTITION BY task_id))"""


def source_files(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select(F.col("source").alias("file"), "text")


def asked(spark: SparkSession, d: str) -> DataFrame:
    t = V.tsk(spark, d)
    return t.select("task_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(T.identifiers(F.col("text"))))).alias("ident"))


def map_edges(spark: SparkSession, d: str) -> DataFrame:
    s = V.sym(spark, d)
    return N.map_edges(N.reference_counts(source_files(spark, d), s), s, asked(spark, d))


@query(with_views(f"WITH {_REFS} SELECT * FROM refs", "sym"))
def ref_counts(spark: SparkSession, d: str) -> DataFrame:
    return N.reference_counts(source_files(spark, d), V.sym(spark, d))


@query(with_views(f"WITH {_MAP} SELECT task_id, from_file, to_file, ident, round(w, 6) AS w FROM e", "sym", "tsk"))
def repo_map_edges(spark: SparkSession, d: str) -> DataFrame:
    return map_edges(spark, d).withColumn("w", F.round("w", 6))


def map_rank(spark: SparkSession, d: str) -> tuple[Vectors, DataFrame, DataFrame]:
    """Ranks of files after exactly 30 rounds; the map's edges, and what each task adds to them."""
    s = cut(V.sym(spark, d).select("file", "name"))
    referred, alone = N.map_references(N.reference_counts(source_files(spark, d), s), s)
    referred, mentioned = cut(referred), cut(asked(spark, d))
    edges, overlay = referred.unionByName(alone), cut(N.map_overlay(referred, mentioned))
    start, lost = N.map_start(s, mentioned)
    move = lambda df, *more: df.select(*more, F.col("from_file").alias("src"), F.col("to_file").alias("dst"), "w")
    ranks = walk(start, move(edges), 0.85, 30, None, overlay=move(overlay, "task_id"), everywhere=(lost, s.select(F.col("file").alias("node"))))
    return ranks, edges, overlay


def map_definitions(spark: SparkSession, d: str) -> DataFrame:
    """(task_id, file, ident, score): a file's rank flows out along its edges to what they name."""
    ranks, edges, overlay = map_rank(spark, d)
    move = lambda df, *more: df.select(*more, F.col("from_file").alias("src"), F.struct("to_file", "ident").alias("dst"), "w")
    found = spread(ranks, move(edges), move(overlay, "task_id")).scores()
    return found.select("task_id", F.col("node.to_file").alias("file"), F.col("node.ident").alias("ident"), "score")


_MAPRANK = """m AS MATERIALIZED (SELECT task_id, from_file, to_file, sum(w) / sum(sum(w)) OVER (PARTITION BY task_id, from_file) AS p FROM e GROUP BY task_id, from_file, to_file),
    r AS (SELECT 0 AS it, task_id, node, mass AS score FROM start UNION ALL SELECT it + 1, task_id, node, sum(score) FROM (
      SELECT r.it, r.task_id, m.to_file AS node, r.score * m.p * 0.85 AS score FROM r JOIN m ON m.task_id = r.task_id AND m.from_file = r.node
      UNION ALL SELECT r.it, r.task_id, s.node, r.score * s.mass * CASE WHEN (r.task_id, r.node) IN (SELECT task_id, from_file FROM m) THEN 0.15 ELSE 1.0 END FROM r JOIN start s USING (task_id))
      WHERE it < 30 GROUP BY it, task_id, node)"""


@query(with_views(f"WITH {_MAP}, {_MAPSTART}, {_MAPRANK} SELECT task_id, node, round(score, 6) AS score FROM r WHERE it = 30 AND round(score, 6) > 0", "sym", "tsk", recursive=True))
def repo_map_rank(spark: SparkSession, d: str) -> DataFrame:
    return map_rank(spark, d)[0].scores().withColumn("score", F.round("score", 6)).where("score > 0")


@query(with_views(f"""WITH {_MAP}, {_MAPSTART}, {_MAPRANK}, f AS (SELECT task_id, to_file AS file, ident, sum(score * w / ow) AS score FROM (SELECT *, sum(w) OVER (PARTITION BY task_id, from_file) AS ow FROM e)
    JOIN (SELECT task_id, node AS from_file, score FROM r WHERE it = 30) USING (task_id, from_file) GROUP BY ALL)
    SELECT * FROM (SELECT task_id, file, ident, round(score, 6) AS score, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 6) DESC, '(' || file || ', ' || ident || ')') AS rank FROM f) WHERE rank <= 50""", "sym", "tsk", recursive=True))
def repo_map_defs(spark: SparkSession, d: str) -> DataFrame:
    out = map_definitions(spark, d).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("task_id").orderBy(F.desc("score"), F.concat(F.lit("("), "file", F.lit(", "), "ident", F.lit(")")))
    return out.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 50")


# Diffs and gold.

_DIFF = r"""rows AS (SELECT key, generate_subscripts(l, 1) AS nth, unnest(l) AS row FROM (SELECT key, string_split(diff, chr(10)) AS l FROM dif)),
    f AS (SELECT *, last_value(CASE WHEN starts_with(row, '--- a/') THEN row[7:] WHEN starts_with(row, '--- /dev/null') THEN '' END IGNORE NULLS) OVER (PARTITION BY key ORDER BY nth ROWS UNBOUNDED PRECEDING) AS file,
      regexp_extract(row, '^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@', 1) AS s, regexp_extract(row, '^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@', 2) AS c FROM rows),
    changed AS (SELECT DISTINCT key, file, CAST(unnest(generate_series(CAST(s AS INT), CAST(s AS INT) + CASE WHEN c = '' THEN 0 WHEN c = '0' THEN 1 ELSE CAST(c AS INT) - 1 END)) AS INT) AS line FROM f WHERE s <> '' AND file <> '')"""


@query(with_views(f"WITH {_DIFF} SELECT * FROM changed", "dif"))
def diff_lines(spark: SparkSession, d: str) -> DataFrame:
    return D.changed_lines(V.dif(spark, d), "key")


@query(with_views(f"WITH {_DIFF} SELECT DISTINCT key, file FROM changed WHERE NOT contains(file, '/test') AND NOT contains(file, '/androidTest')", "dif"))
def test_path_filter(spark: SparkSession, d: str) -> DataFrame:
    return D.changed_lines(V.dif(spark, d), "key").where(~T.is_test_path(F.col("file"))).select("key", "file").distinct()


@query(with_views(f"""WITH scanned AS (SELECT key, o, s FROM dif ORDER BY o, s LIMIT 400), {_DIFF}, t AS (SELECT key, count(DISTINCT file) AS n, count(*) AS lines FROM changed WHERE NOT contains(file, '/test') GROUP BY key HAVING count(DISTINCT file) <= 5)
    SELECT md5(key)[1:10] AS task_id, n AS files, lines FROM t JOIN scanned USING (key) ORDER BY o, s LIMIT 40""", "dif"))
def mined_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Of all commits; that the first 400 are scanned for 40 tasks is the miner's own rule."""
    commits = V.dif(spark, d).select(F.md5("key").alias("sha"), "seq", F.rpad("key", 31, "x").alias("message"), "diff")
    t = D.mined_tasks(commits, 40)
    lines = F.aggregate(F.map_values("changed_lines"), F.lit(0).cast("long"), lambda s, x: s + F.size(x))
    return t.select("task_id", F.size("changed_lines").cast("long").alias("files"), lines.alias("lines"))


_TOUCHED = "touched AS (SELECT DISTINCT task_id, id, s.file, start_line, end_line, pos FROM chg c JOIN sym s ON s.file = c.file AND line BETWEEN start_line AND end_line)"


@query(with_views(f"WITH {_TOUCHED} SELECT task_id, id FROM touched", "chg", "sym"))
def gold_lines(spark: SparkSession, d: str) -> DataFrame:
    return Gd.touched(V.chg(spark, d), V.sym(spark, d)).select("task_id", "id")


_TSPANS = f"t AS (SELECT DISTINCT task_id, id, s.file, s AS start_line, e AS end_line, id AS pos FROM (SELECT l_orderkey % 40 AS task_id, {id_sql('l_partkey % 200')} AS file, CAST(l_linenumber * 8 AS INT) AS line FROM lineitem) c JOIN ({_SPANS}) s ON s.file = c.file AND line BETWEEN s AND e)"


@query(f"WITH {_TSPANS} SELECT DISTINCT task_id, id FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.task_id = a.task_id AND b.file = a.file AND b.pos <> a.pos AND a.start_line <= b.start_line AND a.end_line >= b.end_line)")
def gold_innermost(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem")
    changed = li.select((F.col("l_orderkey") % 40).alias("task_id"), V.doc_id(F.col("l_partkey") % 200).alias("file"), (F.col("l_linenumber") * 8).cast("int").alias("line"))
    return Gd.innermost_gold(Gd.touched(changed, spans(spark, d)))


_CALLERS = "callers AS (SELECT DISTINCT task_id, from_id AS id FROM edg JOIN gold ON id = to_id WHERE kind = 'CALLS' AND (task_id, from_id) NOT IN (SELECT task_id, id FROM gold))"


@query(with_views(f"WITH {_CALLERS} SELECT * FROM callers", "edg", "gold"))
def gold_callers(spark: SparkSession, d: str) -> DataFrame:
    return Gd.callers(V.gold(spark, d), V.edg(spark, d))


# Metrics, over the 20 best of BM25 as the pack.

_ITEMS = f"items AS MATERIALIZED (SELECT task_id, {id_sql('doc_id')} AS id, file, is_test, tokens, place FROM (SELECT task_id, doc_id, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 6) DESC, doc_id) - 1 AS place FROM bm) JOIN sym ON pos = doc_id WHERE place < 20)"
_SCORES = f"""{_CALLERS}, {_ITEMS}, g AS (SELECT task_id, count(*) AS gold_size FROM gold GROUP BY 1),
    h AS (SELECT task_id, count(*) AS hits, sum(1.0 / log2(place + 2)) AS dcg FROM items JOIN gold USING (task_id, id) GROUP BY 1), n AS (SELECT task_id, count(*) AS n FROM items GROUP BY 1),
    gf AS (SELECT DISTINCT task_id, file FROM gold JOIN sym USING (id)), ff AS (SELECT task_id, count(*) AS files, count(*) FILTER ((task_id, file) IN (SELECT task_id, file FROM items)) AS found FROM gf GROUP BY 1),
    ca AS (SELECT task_id, count(*) AS callers, count(*) FILTER ((task_id, id) IN (SELECT task_id, id FROM items)) AS ch FROM callers GROUP BY 1),
    scores AS (SELECT task_id, coalesce(hits, 0) / gold_size AS recall, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE coalesce(hits, 0) / n END AS precision, coalesce(found, 0) / files AS file_recall,
      (coalesce(hits, 0) + 0.5 * coalesce(ch, 0)) / (gold_size + 0.5 * coalesce(callers, 0)) AS caller_recall,
      coalesce(dcg, 0) / list_sum(list_transform(generate_series(0, least(gold_size, n) - 1), lambda i: 1.0 / log2(i + 2))) AS ndcg, gold_size
      FROM g LEFT JOIN h USING (task_id) LEFT JOIN n USING (task_id) LEFT JOIN ff USING (task_id) LEFT JOIN ca USING (task_id))"""


def items(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.retrieval import ranked

    top = ranked(V.bm_best(spark, d, 20), 20).withColumn("at", F.col("rank") - 1)
    return top.join(V.sym(spark, d).select(F.col("pos").alias("doc_id"), "id", "file", "is_test", "tokens"), "doc_id")


def scored(spark: SparkSession, d: str) -> DataFrame:
    g = V.gold(spark, d)
    return Gd.scores(items(spark, d), g, V.sym(spark, d), Gd.callers(g, V.edg(spark, d)))


METRIC_VIEWS = ("edg", "gold", "bm", "sym")


def _metric(name: str, column: str) -> None:
    def one(spark: SparkSession, d: str) -> DataFrame:
        return scored(spark, d).select("task_id", F.round(column, 6).alias(column))

    query(with_views(f"WITH {_SCORES} SELECT task_id, round({column}, 6) AS {column} FROM scores", *METRIC_VIEWS), name=name)(one)


for _n, _c in (("m_recall", "recall"), ("m_precision", "precision"), ("m_file_recall", "file_recall"), ("m_caller_recall", "caller_recall"), ("m_ndcg", "ndcg")):
    _metric(_n, _c)

_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("recall", "precision", "file_recall", "caller_recall", "ndcg"))


def _means(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "file_recall", "caller_recall", "ndcg")})


@query(with_views(f"WITH {_SCORES}, tk AS (SELECT task_id, sum(tokens) AS tokens FROM items GROUP BY 1) SELECT 'bm25' AS arm, {_MEANS}, CAST(floor(avg(tokens)) AS BIGINT) AS tokens, CAST(sum(gold_size) AS BIGINT) AS gold_size, count(*) AS tasks FROM scores JOIN tk USING (task_id)", *METRIC_VIEWS))
def m_mean(spark: SparkSession, d: str) -> DataFrame:
    tokens = items(spark, d).groupBy("task_id").agg(F.sum("tokens").alias("tokens"))
    return _means(Gd.mean_scores(scored(spark, d).join(tokens, "task_id").withColumn("arm", F.lit("bm25")), ["arm"]))


@query(with_views(f"""WITH {_SCORES}, tk AS (SELECT task_id, sum(tokens) AS tokens FROM items GROUP BY 1), nm AS (SELECT task_id, bool_or(list_contains(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), name)) AS named FROM gold JOIN sym USING (id) JOIN tsk USING (task_id) GROUP BY 1)
    SELECT named, {_MEANS}, CAST(floor(avg(tokens)) AS BIGINT) AS tokens, CAST(sum(gold_size) AS BIGINT) AS gold_size, count(*) AS tasks FROM scores JOIN tk USING (task_id) JOIN nm USING (task_id) GROUP BY named""", *METRIC_VIEWS, "tsk"))
def m_slices(spark: SparkSession, d: str) -> DataFrame:
    tokens = items(spark, d).groupBy("task_id").agg(F.sum("tokens").alias("tokens"))
    named = Gd.names_target(V.tsk(spark, d), V.gold(spark, d), V.sym(spark, d))
    return _means(Gd.mean_scores(scored(spark, d).join(tokens, "task_id").join(named, "task_id"), ["named"]))


@query(with_views(f"""WITH {_ITEMS}, b AS (SELECT task_id, min(place) AS best FROM gold LEFT JOIN items USING (task_id, id) GROUP BY 1), sh AS (SELECT task_id, sum(CASE WHEN is_test THEN tokens ELSE 0 END) / sum(tokens) AS share FROM items GROUP BY 1),
    x AS (SELECT * FROM b LEFT JOIN sh USING (task_id)) SELECT count(*) AS tasks, count(best) AS reachable, count(*) FILTER (best < 5) AS packed, list_sort(list(best) FILTER (best IS NOT NULL))[count(best) // 2 + 1] AS median_rank,
    count(*) FILTER (best <= 50) AS near, round(avg(coalesce(share, 0)), 6) AS test_share FROM x""", "gold", "bm", "sym"))
def diagnosis(spark: SparkSession, d: str) -> DataFrame:
    it = items(spark, d)
    best = Gd.best_rank(it, V.gold(spark, d))
    packed = best.select("task_id", (F.coalesce("best_rank", F.lit(99)) < 5).alias("packed"))
    total = it.withColumn("used", F.sum("tokens").over(Window.partitionBy("task_id")))
    return Gd.diagnosis(best, packed, Gd.test_token_share(total)).withColumn("test_share", F.round("test_share", 6))


# Ledgers.

ARMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_COMPLETE = "complete AS (SELECT task FROM led GROUP BY task HAVING count(DISTINCT arm) >= 5)"


@query(with_views("SELECT arm, count(*) FILTER (outcome = 'RESOLVED') AS resolved, count(*) FILTER (outcome = 'UNRESOLVED') AS unresolved, count(*) FILTER (outcome = 'NOT_APPLIED') AS not_applied, round(avg(tokens), 6) AS mean_tokens FROM led GROUP BY arm", "led"))
def ledger_pivot(spark: SparkSession, d: str) -> DataFrame:
    return L.outcome_pivot(V.led(spark, d), list(schema.OUTCOMES[:3]))


@query(with_views(f"WITH {_COMPLETE}, o AS (SELECT task, arm, bool_or(outcome = 'RESOLVED') AS ok FROM led WHERE task IN (SELECT task FROM complete) GROUP BY ALL) SELECT arm, count(*) FILTER (ok) AS resolved, count(*) AS tasks, CAST(floor(100 * count(*) FILTER (ok) / count(*)) AS BIGINT) AS percent FROM o GROUP BY arm", "led"))
def ledger_complete(spark: SparkSession, d: str) -> DataFrame:
    return L.complete_summary(V.led(spark, d), 5)


@query(with_views(f"""WITH {_COMPLETE}, o AS (SELECT task, arm, bool_or(outcome = 'RESOLVED') AS ok FROM led WHERE task IN (SELECT task FROM complete) GROUP BY ALL)
    SELECT x.arm AS a, y.arm AS b, count(*) FILTER (x.ok AND NOT y.ok) AS wins FROM o x JOIN o y USING (task) WHERE x.arm <> y.arm GROUP BY ALL""", "led"))
def ledger_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return L.pairwise(V.led(spark, d), ARMS)


@query(with_views("SELECT task, arm FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS task FROM customer) CROSS JOIN (SELECT DISTINCT arm FROM led) WHERE (task, arm) NOT IN (SELECT task, arm FROM led)", "led"))
def ledger_resume(spark: SparkSession, d: str) -> DataFrame:
    arms = spark.createDataFrame([(a,) for a in ARMS], "arm string")
    return L.pending(V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("task")).crossJoin(F.broadcast(arms)), V.led(spark, d))


_CHAIN = 5  # commits: a snapshot and deltas on it


@query(with_views("""WITH v AS (SELECT *, (SELECT max(k) FROM range(0, 5) t(k) WHERE k % (s.pos % 5 + 2) = 0) AS last FROM sym s)
    SELECT v.id, v.id || '.kt' AS file, v.tokens + last AS tokens, count(e.to_id) AS n_edges FROM v LEFT JOIN edg e ON e.from_id = v.id AND e.kind = 'CONTAINS' WHERE NOT (pos % 7 = 3) GROUP BY ALL""", "sym", "edg"))
def store_chain(spark: SparkSession, d: str) -> DataFrame:
    """The last commit of a chain of deltas: symbols as files of their own. A file changes with every commit whose number its
    own period divides, and of every seventh the file is gone by then."""
    from skein.operators.lineage import shared_dir
    from skein.sources import store

    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    s, e = V.graph(spark, d)
    names = [c.split()[0] for c in schema.SYMBOLS.split(", ")]
    edges = cut(e.where("kind = 'CONTAINS'"))
    errors, coverage = spark.createDataFrame([], schema.ERRORS), spark.createDataFrame([], schema.COVERAGE)
    for k in range(_CHAIN):
        version = F.floor(F.lit(k) / (F.col("pos") % 5 + 2)) * (F.col("pos") % 5 + 2)  # the last commit that changed it
        now = s.where(~((F.col("pos") % 7 == 3) & (F.lit(k) >= 2))).withColumns({"file": F.concat("id", F.lit(".kt")), "tokens": (F.col("tokens") + version).cast("int")})
        index = {"symbols": now.select(names), "edges": edges, "errors": errors, "coverage": coverage}
        if k:
            store.write_delta(index, root, f"c{k:02d}", f"c{k - 1:02d}")
        else:
            store.write_index(index, root, "c00")
    last = store.read_index(spark, root, f"c{_CHAIN - 1:02d}")
    held = last["symbols"].join(last["edges"].groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n_edges")), "id", "left")
    return held.select("id", "file", F.col("tokens").cast("long").alias("tokens"), F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"))


@query("""WITH t AS (SELECT CAST(o_custkey % 100 AS VARCHAR) || o_orderpriority AS run, o_orderkey AS seq, CASE WHEN floor(o_totalprice) % 3 = 0 THEN 'NO_ANSWER' ELSE 'UNRESOLVED' END AS outcome FROM orders),
    n AS (SELECT *, row_number() OVER w AS nth, count(*) FILTER (outcome = 'NO_ANSWER') OVER (PARTITION BY run ORDER BY seq ROWS 3 PRECEDING) AS silent FROM t WINDOW w AS (PARTITION BY run ORDER BY seq)),
    s AS (SELECT run, min(nth) AS last FROM n WHERE silent = 4 GROUP BY run) SELECT run, seq, outcome FROM n LEFT JOIN s USING (run) WHERE last IS NULL OR nth <= last""")
def ledger_stop(spark: SparkSession, d: str) -> DataFrame:
    """Runs, of orders, that end with their fourth silent answer in a row."""
    o = V.table(spark, d, "orders")
    outcome = F.when(F.floor("o_totalprice") % 3 == 0, F.lit(L.SILENCE)).otherwise(F.lit("UNRESOLVED"))
    return L.stopped(o.select(F.concat((F.col("o_custkey") % 100).cast("string"), "o_orderpriority").alias("run"), F.col("o_orderkey").alias("seq"), outcome.alias("outcome")))


@query(with_views("SELECT DISTINCT task FROM led WHERE arm = '1-URGENT' AND outcome = 'RESOLVED' AND task IN (SELECT task FROM led WHERE arm = '5-LOW' AND outcome = 'UNRESOLVED')", "led"))
def certified(spark: SparkSession, d: str) -> DataFrame:
    return L.certified(V.led(spark, d), "1-URGENT", "5-LOW")


@query(with_views("SELECT arm, count(*) AS trials, count(DISTINCT task) AS tasks FROM led GROUP BY arm", "led"))
def ledger_counters(spark: SparkSession, d: str) -> DataFrame:
    return L.counters(V.led(spark, d))


# Upkeep of an index.


@query(with_views("SELECT * FROM stm_old", "stm_old"))
def stamps(spark: SparkSession, d: str) -> DataFrame:
    return I.stamps(files(spark, d))


@query(with_views("SELECT coalesce(o.file, n.file) AS file, CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'removed' ELSE 'changed' END AS change FROM stm_old o FULL JOIN stm_new n ON o.file = n.file WHERE o.stamp IS DISTINCT FROM n.stamp", "stm_old", "stm_new"))
def dirty_files(spark: SparkSession, d: str) -> DataFrame:
    return I.dirty(V.stm_old(spark, d), V.stm_new(spark, d))


_DIRTY = "ch AS (SELECT DISTINCT file FROM sym WHERE file IN ('src0', 'src1', 'src2'))"


def _changed(spark: SparkSession, d: str) -> DataFrame:
    return V.sym(spark, d).where(F.col("file").isin("src0", "src1", "src2")).select("file").distinct()


@query(with_views(f"WITH {_DIRTY}, gone AS (SELECT id FROM sym WHERE file IN (SELECT file FROM ch) AND pos % 3 = 0) SELECT DISTINCT file FROM edg JOIN sym ON id = from_id WHERE to_id IN (SELECT id FROM gone) AND file NOT IN (SELECT file FROM ch)", "sym", "edg"))
def ref_removed(spark: SparkSession, d: str) -> DataFrame:
    s = V.sym(spark, d)
    return I.referrers_to_removed(s, V.edg(spark, d), _changed(spark, d), s.where("pos % 3 <> 0"))


@query(with_views("SELECT DISTINCT file FROM err WHERE message IN ('unresolved call `t1`', 'unresolved call `t4`') AND file NOT IN ('src0', 'src1', 'src2')", "err"))
def ref_added(spark: SparkSession, d: str) -> DataFrame:
    fresh = spark.createDataFrame([("t1",), ("t4",)], "name string")
    changed = spark.createDataFrame([("src0",), ("src1",), ("src2",)], "file string")
    return I.referrers_to_added(V.err(spark, d), changed, fresh)


def merged(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    s, e = V.sym(spark, d).drop("pos"), V.edg(spark, d)
    fresh = s.where(F.col("file").isin("src0", "src1")).withColumn("name", F.concat(F.lit("new_"), "name"))
    none = spark.createDataFrame([], schema.ERRORS)
    base = {"symbols": s, "edges": e, "errors": V.err(spark, d).drop("seq")}
    new = e.where("kind = 'CONTAINS'").join(fresh.select(F.col("id").alias("from_id")), "from_id", "left_semi").select("from_id", "to_id", "kind")
    return I.merge(base, _changed(spark, d), {"symbols": fresh, "edges": new, "errors": none})


@query(with_views("SELECT id, CASE WHEN file IN ('src0', 'src1') THEN 'new_' || name ELSE name END AS name, file FROM sym WHERE file <> 'src2'", "sym"))
def index_merge(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d)["symbols"].select("id", "name", "file")


@query(with_views("""SELECT DISTINCT from_id, to_id, kind FROM edg WHERE from_id NOT IN (SELECT id FROM sym WHERE file IN ('src0', 'src1', 'src2'))
    OR (kind = 'CONTAINS' AND from_id IN (SELECT id FROM sym WHERE file IN ('src0', 'src1')))""", "sym", "edg"))
def index_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d)["edges"]


@query(with_views("SELECT CAST(sum(call_sites) AS BIGINT) AS call_sites, CAST(sum(resolved_callees) AS BIGINT) AS resolved_callees, CAST(sum(attributed_to_caller) AS BIGINT) AS attributed_to_caller, CAST(sum(failed_files) AS BIGINT) AS failed_files FROM cov", "cov"))
def coverage_fold(spark: SparkSession, d: str) -> DataFrame:
    return I.coverage_fold(V.cov(spark, d))


@query(with_views("SELECT *, round(CASE WHEN call_sites = 0 THEN 1.0 ELSE resolved_callees / call_sites END, 6) AS callee_rate, round(CASE WHEN call_sites = 0 THEN 1.0 ELSE attributed_to_caller / call_sites END, 6) AS caller_rate FROM cov", "cov"))
def coverage_rates(spark: SparkSession, d: str) -> DataFrame:
    return I.coverage_rates(V.cov(spark, d)).withColumns({c: F.round(c, 6) for c in ("callee_rate", "caller_rate")})


@query(with_views("""SELECT file, CAST(floor(CASE WHEN call_sites = 0 THEN 1.0 ELSE resolved_callees / call_sites END * 100) AS BIGINT) || '% of ' || call_sites || ' call sites resolved, ' || CAST(floor(CASE WHEN call_sites = 0 THEN 1.0 ELSE attributed_to_caller / call_sites END * 100) AS BIGINT)
    || '% with caller' || CASE WHEN failed_files > 0 THEN ', ' || failed_files || ' files failed' ELSE '' END AS line FROM cov""", "cov"))
def coverage_line(spark: SparkSession, d: str) -> DataFrame:
    return V.cov(spark, d).select("file", Re.coverage_line(*(F.col(c) for c in ("call_sites", "resolved_callees", "attributed_to_caller", "failed_files"))).alias("line"))


@query(with_views("SELECT file, line, message, seq FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) AS n FROM err) WHERE n <= 20", "err"))
def error_cap(spark: SparkSession, d: str) -> DataFrame:
    return I.first_notes(V.err(spark, d))


@query(with_views("SELECT from_id, to_id, kind, row_number() OVER (ORDER BY list_position(['CONTAINS','CALLS','EXTENDS','OVERRIDES','IMPORTS','REFERENCES_TYPE'], kind), from_id, to_id) - 1 AS ord FROM (SELECT DISTINCT * FROM edg)", "edg"))
def canonical_order(spark: SparkSession, d: str) -> DataFrame:
    return I.canonical_edges(V.edg(spark, d), schema.EDGE_KINDS)


_ROOTS = "SELECT DISTINCT '/repo/' || replace(replace(p_brand, '#', '/'), 'Brand', 'b') || '/' || p_size AS path FROM part"


def _roots(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    return p.select(F.concat(F.lit("/repo/"), F.regexp_replace(F.regexp_replace("p_brand", "#", "/"), "Brand", "b"), F.lit("/"), F.col("p_size").cast("string")).alias("path")).distinct()


@query(f"SELECT path FROM ({_ROOTS}) WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('/repo/b/1'), ('/repo/b/12'), ('/repo/b/23/7')) x(e) WHERE path = e OR starts_with(path, e || '/'))")
def excluded_roots(spark: SparkSession, d: str) -> DataFrame:
    return I.without_excluded(_roots(spark, d), spark.createDataFrame([("/repo/b/1",), ("/repo/b/12",), ("/repo/b/23/7",)], "path string"))


@query(f"SELECT path FROM ({_ROOTS}) UNION SELECT path || '/test' FROM ({_ROOTS}) WHERE path LIKE '%1'")
def distinct_roots(spark: SparkSession, d: str) -> DataFrame:
    r = _roots(spark, d)
    return I.distinct_roots(r, r.where("path like '%1'").select(F.concat("path", F.lit("/test")).alias("path")))


@query("SELECT sha256(string_agg(p || t, '' ORDER BY p)) AS fingerprint FROM (SELECT 'm' || lpad(CAST(item_id AS VARCHAR), 4, '0') || CASE WHEN item_id % 5 = 0 THEN '/build/x' ELSE '/x.kts' END AS p, text AS t FROM benchmark) WHERE p NOT LIKE '%/build/%'")
def build_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    b = V.table(spark, d, "benchmark")
    path = F.concat(F.lit("m"), F.lpad(F.col("item_id").cast("string"), 4, "0"), F.when(F.col("item_id") % 5 == 0, "/build/x").otherwise("/x.kts"))
    return I.fingerprint(b.select(path.alias("file"), "text"))


@query("SELECT string_agg(s_name || ':' || CAST(s_suppkey * 3 AS VARCHAR), chr(10) ORDER BY s_name || ':' || CAST(s_suppkey * 3 AS VARCHAR)) AS identity FROM supplier")
def classpath_identity(spark: SparkSession, d: str) -> DataFrame:
    return I.classpath_identity(V.table(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") * 3).alias("length")))


@query("SELECT c AS commit, m.b AS base, m.n AS n_changed FROM (SELECT o_custkey AS c, min({'n': n, 'b': b}) AS m FROM (SELECT o_custkey, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey)")
def nearest_base(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("commit"), F.col("o_orderpriority").alias("base")).agg(F.count("*").alias("n_changed"))
    return I.nearest(o)


@query(with_views("SELECT id, name, CASE WHEN end_line - start_line + 1 <= 2 THEN signature END AS sig, file LIKE '%1%' AS touched FROM sym WHERE kind IN ('CLASS','FUNCTION','PROPERTY')", "sym"))
def indexable(spark: SparkSession, d: str) -> DataFrame:
    s = V.sym(spark, d).where(F.col("kind").isin("CLASS", "FUNCTION", "PROPERTY"))
    return s.select("id", "name", F.when(F.col("end_line") - F.col("start_line") + 1 <= 2, F.col("signature")).alias("sig"), F.col("file").contains("1").alias("touched"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || '(' || p_type || ',?)' WHEN 1 THEN p_name || '.<init>(this:' || p_brand || ',' || p_type || ',?)' ELSE p_name END AS id FROM part")
def symbol_ids(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "FUNCTION").when(F.col("p_size") % 3 == 1, "CONSTRUCTOR").otherwise("PROPERTY")
    receiver = F.when(F.col("p_size") % 3 == 1, F.col("p_brand"))
    return p.select("p_partkey", T.symbol_id(kind, F.col("p_name"), receiver, F.array("p_type", F.lit(None).cast("string"))).alias("id"))


@query(with_views("SELECT DISTINCT s.id AS from_id, i.to_id, 'IMPORTS' AS kind FROM sym s JOIN (SELECT DISTINCT file, 'ext:' || kind AS to_id FROM sym) i USING (file)", "sym"))
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """A file's imports by its declarations."""
    s = V.sym(spark, d)
    imports = s.select("file", F.concat(F.lit("ext:"), "kind").alias("to_id")).distinct()
    return s.join(imports, "file").select(F.col("id").alias("from_id"), "to_id", F.lit("IMPORTS").alias("kind")).distinct()


# Packing.

_DENSE = """SELECT task_id, id, fidelity, density, density_rank FROM (SELECT task_id, id, fidelity, density, row_number() OVER (PARTITION BY task_id, fidelity ORDER BY density DESC, id) AS density_rank FROM (
    SELECT task_id, s.id, 'FULL' AS fidelity, round(round(score, 6) / greatest(1, tokens), 9) AS density FROM bm JOIN sym s ON pos = doc_id
    UNION ALL SELECT task_id, s.id, 'STUB', round(round(score, 6) / greatest(1.0, length(signature) / CAST(3.6 AS DOUBLE)), 9) FROM bm JOIN sym s ON pos = doc_id)) WHERE density_rank <= 30"""


@query(with_views(_DENSE, "bm", "sym"))
def pack_density(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["FULL", "STUB"]
    sizes = V.sym(spark, d).select(F.col("pos").alias("doc_id"), "id", *(P.estimate(f).alias(f) for f in kinds))
    near = R.bm25_densest(V.index(spark, d), V.asked(spark, d), 30, sizes, kinds)
    rows = near.withColumnRenamed("of", "fidelity").withColumn("density", F.round(F.round("score", 6) / F.col("size"), 9))
    order = Window.partitionBy("task_id", "fidelity").orderBy(F.desc("density"), "id")
    rows = rows.withColumn("density_rank", F.row_number().over(order).cast("bigint")).where("density_rank <= 30")
    return rows.select("task_id", "id", "fidelity", "density", "density_rank")


@query(with_views(f"""WITH {_ITEMS}, f AS (SELECT DISTINCT task_id, file FROM items), c AS (SELECT task_id, file, line, message, sum(len(regexp_extract_all('- `' || file || ':' || line || '`: ' || message || chr(10), '[A-Za-z0-9]+|[^A-Za-z0-9 \\n\\t\\r]')))
    OVER (PARTITION BY task_id ORDER BY file, line, message) + 3 AS cost FROM (SELECT DISTINCT task_id, file, line, message FROM f JOIN err USING (file))) SELECT task_id, file, line, message, CAST(cost AS BIGINT) AS cost FROM c WHERE cost <= 400""", "bm", "sym", "err"))
def pack_errors(spark: SparkSession, d: str) -> DataFrame:
    used = items(spark, d).select("task_id", "file", F.lit(1600).alias("used"))
    return P.fit_errors(used, V.err(spark, d).drop("seq"), 2000)
