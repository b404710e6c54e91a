"""The composite retrievers: each ranks declarations or windows for the tasks and packs them under one budget.

All arms share the packer, the token counter, the budget and the task texts; they differ in how they rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph as G
from skein.operators import names as N
from skein.operators import packing as P
from skein.operators import retrieval as R
from skein.operators.lineage import cut
from skein.plans import graph_queries as GQ
from skein.plans import index_queries as IQ
from skein.plans import pack_sql as S
from skein.plans import retrieval_queries as RQ
from skein.plans import views as V
from skein.plans.registry import query
from skein.plans.views import terms_sql, with_views
from skein.protocols import DenseSeeds

BUDGET, FILES = 4000, 10


def pack_ranked(spark: SparkSession, d: str, ranked: DataFrame, budget: int = BUDGET, index: tuple[DataFrame, DataFrame] | None = None, **options) -> DataFrame:
    """ranked (task_id, id, score, rank, why) with all that the packer asks for, packed."""
    symbols, edges = index or V.graph(spark, d)
    texts = V.table(spark, d, "documents").select(V.doc_id(F.col("doc_id")).alias("id"), F.col("text").alias("body"))
    top = ranked.where(F.col("rank") <= P.CANDIDATES).withColumn("task_id", F.col("task_id").cast("string"))
    top = cut(top)
    contains = edges.where("kind = 'CONTAINS'")
    below = G.descendants(contains, top).groupBy("id").agg(F.collect_list("descendant").alias("descendants"))
    top = top.join(symbols.drop("pos"), "id").join(P.sizes(texts, top), "id").join(G.ancestors(contains, top), "id", "left").join(below, "id", "left")
    return P.pack(top, budget, texts, **options)


def engine(spark: SparkSession, d: str, changed: dict | None = None, edges: DataFrame | None = None, n_seeds: int = R.SEEDS, penalty: float = R.TEST_PENALTY, dense: bool | DenseSeeds = False, through: G.Through | None = None, **options) -> DataFrame:
    """Seeds, PageRank over the typed graph, provenance, pack. dense: as for seeds(). through: calls beside the edges."""
    index = s, e = V.graph(spark, d)
    links = G.links(s, e if edges is None else edges, G.weight_table(spark, **(changed or {})))
    seeds = cut(RQ.seeds(spark, d, penalty, n_seeds, dense, s))
    scores = cut(GQ.best(G.pagerank(G.restart(seeds, s), links, limit=P.CANDIDATES, hidden="file:", through=through), P.CANDIDATES))
    why = G.provenance(seeds, links, wanted=scores, through=through).select("task_id", "node", "why")
    ranked = scores.join(why, ["task_id", "node"], "left").select("task_id", F.col("node").alias("id"), "score", "rank", F.coalesce("why", F.lit("related")).alias("why"))
    return pack_ranked(spark, d, ranked, index=index, **options)


def named_edges(spark: SparkSession, d: str) -> tuple[DataFrame, G.Through]:
    """The index's edges with calls matched by name in place of resolved ones: those that are written out, and the others."""
    s = V.sym(spark, d)
    words = V.table(spark, d, "documents").select(V.doc_id(F.col("doc_id")).alias("id"), F.explode(F.array_distinct(T.identifiers(F.col("text")))).alias("name"))
    calls = words.join(s.select(F.col("name")).distinct(), "name", "left_semi").join(s.select("id", "file", F.col("start_line").alias("line")), "id").select("file", "line", "name")
    callers, declared, written = N.calls_through(calls, s)
    return cut(V.edg(spark, d).where("kind <> 'CALLS'").unionByName(written)), G.Through(callers, declared, s.select("id", "name", "is_test"))


def searched(spark: SparkSession, d: str, limit: int) -> DataFrame:
    """(task_id, id, rank, score, why): plain BM25, worth 1/rank."""
    ranks = RQ.search_channel(spark, d, 1.0, limit)
    return ranks.select("task_id", "id", "rank", (1.0 / F.col("rank")).alias("score"), F.lit("bm25").alias("why"))


def files_by_hit(ranked: DataFrame, symbols: DataFrame, limit: int = FILES) -> DataFrame:
    """(task_id, file, rank): files in order of their best declaration."""
    first = ranked.join(symbols.select("id", "file"), "id").groupBy("task_id", "file").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("task_id").orderBy("first", "file")
    return first.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit).select("task_id", "file", "rank")


@query(S.pack_sql(S.engine(), *S.ENGINE_VIEWS, budget=BUDGET))
def arm_default(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d)


@query(S.pack_sql(S.engine(), *S.ENGINE_VIEWS, budget=BUDGET, full_share=0.0))
def arm_all_stubs(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, full_share=0.0)


@query(S.pack_sql(S.engine(penalty=1.0), *S.ENGINE_VIEWS, budget=BUDGET))
def arm_seed_tests(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, penalty=1.0)


@query(S.pack_sql(S.engine(dense=True), *S.ENGINE_VIEWS, budget=BUDGET))
def arm_embed_seeds(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, dense=True)


@query(S.pack_sql(S.engine(GQ.NONE, 400), *S.ENGINE_VIEWS, budget=BUDGET))
def arm_seeds_only(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, changed=GQ.NONE, n_seeds=400)


_ABLATED = [arm for arm in GQ.ABLATIONS if arm != "default"]
for _arm in _ABLATED:

    def _ablation(spark: SparkSession, d: str, changed=GQ.ABLATIONS[_arm]) -> DataFrame:
        return engine(spark, d, changed=changed)

    query(S.pack_sql(S.engine(GQ.ABLATIONS[_arm]), *S.ENGINE_VIEWS, budget=BUDGET), name=f"arm_{_arm}")(_ablation)


@query(S.pack_sql(S.engine(), *S.ENGINE_VIEWS, budget=BUDGET, full_share=1.0))
def level2_engine(spark: SparkSession, d: str) -> DataFrame:
    """The second level's arms pack bodies alone: this one, BM25, chunk_bm25_pack, and none, which gives no context."""
    return engine(spark, d, full_share=1.0)


@query(S.pack_sql(S.searched(600), "bm", budget=BUDGET, full_share=1.0))
def level2_bm25(spark: SparkSession, d: str) -> DataFrame:
    return pack_ranked(spark, d, searched(spark, d, 600), full_share=1.0)


@query(with_views("SELECT CAST(task_id AS VARCHAR) AS task_id, '' AS context, CAST(0 AS BIGINT) AS tokens FROM tsk", "tsk"))
def level2_none(spark: SparkSession, d: str) -> DataFrame:
    return V.tsk(spark, d).select(F.col("task_id").cast("string").alias("task_id"), F.lit("").alias("context"), F.lit(0).cast("long").alias("tokens"))


_NAMES_ONLY = S.pack_sql(f"{S.NAMED_EDGES}, {S.engine()}", *S.ENGINE_VIEWS, budget=BUDGET).replace("edg AS MATERIALIZED (SELECT DISTINCT", "real_edg AS MATERIALIZED (SELECT DISTINCT", 1)


@query(_NAMES_ONLY)
def arm_names_only(spark: SparkSession, d: str) -> DataFrame:
    edges, through = named_edges(spark, d)
    return engine(spark, d, edges=edges, through=through)


@query(S.pack_sql(S.engine(), *S.ENGINE_VIEWS, budget=BUDGET, test_share=0.0))
def arm_without_tests(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, test_share=0.0)


@query(S.pack_sql(S.searched(600), "bm", budget=BUDGET, full_share=0.0))
def arm_bm25_stubs(spark: SparkSession, d: str) -> DataFrame:
    return pack_ranked(spark, d, searched(spark, d, 600), full_share=0.0)


@query(S.pack_sql(S.searched(600), "bm", budget=BUDGET, full_share=0.3))
def arm_bm25_bodies(spark: SparkSession, d: str) -> DataFrame:
    return pack_ranked(spark, d, searched(spark, d, 600), full_share=0.3)


_FILE_DUMP = f"""{S.searched(200).split("ranked AS")[0]}f AS (SELECT task_id, file, row_number() OVER (PARTITION BY task_id ORDER BY first, file) AS f FROM (SELECT task_id, file, min(rank) AS first FROM hit JOIN sym USING (id) GROUP BY ALL)),
    ranked AS (SELECT task_id, id, 1.0 / f AS score, row_number() OVER (PARTITION BY task_id ORDER BY f, start_line, id) AS rank, 'file' AS why FROM f JOIN sym USING (file) WHERE f <= {FILES})"""


@query(S.pack_sql(_FILE_DUMP, "bm", "sym", budget=BUDGET, full_share=1.0))
def arm_file_dump(spark: SparkSession, d: str) -> DataFrame:
    s = V.sym(spark, d)
    files = files_by_hit(searched(spark, d, 200), s)
    order = Window.partitionBy("task_id").orderBy(F.col("f"), "start_line", "id")
    ranked = files.withColumnRenamed("rank", "f").join(s.select("id", "file", "start_line"), "file")
    ranked = ranked.withColumn("rank", F.row_number().over(order).cast("bigint")).select("task_id", "id", "rank", (1.0 / F.col("f")).alias("score"), F.lit("file").alias("why"))
    return pack_ranked(spark, d, ranked, full_share=1.0)


_REPO_MAP = f"""{IQ._MAP}, {IQ._MAPSTART}, {IQ._MAPRANK}, flow AS (SELECT task_id, to_file AS file, ident, round(sum(score * w / ow), 9) AS score FROM (SELECT *, sum(w) OVER (PARTITION BY task_id, from_file) AS ow FROM e)
    JOIN (SELECT task_id, node AS from_file, score FROM r WHERE it = 30) USING (task_id, from_file) GROUP BY ALL),
    ranked AS (SELECT task_id, id, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, '(' || file || ', ' || ident || ')', id) AS rank, 'repo-map' AS why FROM flow JOIN (SELECT id, file, name AS ident FROM sym) USING (file, ident))"""


@query(S.pack_sql(_REPO_MAP, "sym", "tsk", budget=BUDGET, full_share=0.0))
def arm_repo_map(spark: SparkSession, d: str) -> DataFrame:
    found = IQ.map_definitions(spark, d).withColumn("score", F.round("score", 9))
    s = V.sym(spark, d).select("id", "file", F.col("name").alias("ident"))
    pair = F.concat(F.lit("("), "file", F.lit(", "), "ident", F.lit(")"))
    order = Window.partitionBy("task_id").orderBy(F.desc("score"), pair, "id")
    ranked = found.join(s, ["file", "ident"]).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return pack_ranked(spark, d, ranked.select("task_id", "id", "score", "rank", F.lit("repo-map").alias("why")), full_share=0.0)


_HITS = f"""SELECT task_id, file, rank FROM (SELECT task_id, file, row_number() OVER (PARTITION BY task_id ORDER BY first, file) AS rank FROM (SELECT task_id, file, min(r) AS first FROM (
    SELECT task_id, doc_id, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM bm) JOIN sym ON pos = doc_id WHERE r <= 200 GROUP BY ALL)) WHERE rank <= {FILES}"""


@query(with_views(_HITS, "bm", "sym"))
def files_first_hit(spark: SparkSession, d: str) -> DataFrame:
    return files_by_hit(searched(spark, d, 200), V.sym(spark, d))


def chunk_scores(spark: SparkSession, d: str) -> DataFrame:
    """(task_id, key, score) of BM25 over windows, path and text; only windows that score."""
    w = N.windows(IQ.files(spark, d)).withColumn("key", F.concat("file", F.lit("#"), F.lpad(F.col("chunk").cast("string"), 6, "0")))
    terms = T.terms(F.concat_ws("\n", "file", "text"))
    q = V.tsk(spark, d).select("task_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return R.bm25_of(w.select("key", terms.alias("terms")), q, key="key")


def shown(file: F.Column, start: F.Column, text: F.Column) -> F.Column:
    """A window as a reader is shown it. Fixed value: the heading and the fence around the text."""
    return F.concat(F.lit("### "), file, F.lit(":"), start.cast("string"), F.lit("\n\n```kotlin\n"), text, F.lit("\n```\n"))


def pack_chunks(spark: SparkSession, d: str, scores: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Windows by score, then file and place, greedily: (task_id, key, score, tokens, file, chunk) of those taken; and all
    (file, chunk, id) of declarations that windows hold whole."""
    w = N.windows(IQ.files(spark, d)).withColumn("key", F.concat("file", F.lit("#"), F.lpad(F.col("chunk").cast("string"), 6, "0")))
    sized = w.withColumn("tokens", T.token_count(shown(F.col("file"), F.col("start_line"), F.col("text")))).select("key", "file", "chunk", "tokens")
    rows = scores.withColumn("score", F.round("score", 6)).join(sized, "key")
    taken = P.skip_greedy(rows, budget, "task_id", [F.desc("score"), F.col("key")], "tokens", ["key", "score", "tokens", "file", "chunk"])
    return taken, N.contained(w, IQ.spans(spark, d))


def with_credits(taken: DataFrame, held: DataFrame) -> DataFrame:
    """(task_id, key, score, tokens, credited): taken windows with the number of declarations that they are credited with."""
    counts = held.groupBy("file", "chunk").agg(F.count("*").alias("credited"))
    return taken.join(counts, ["file", "chunk"], "left").select("task_id", "key", "score", "tokens", F.coalesce("credited", F.lit(0).cast("long")).alias("credited"))


_WINDOWS = f"""w AS MATERIALIZED (SELECT file || '#' || lpad(CAST(c AS VARCHAR), 6, '0') AS key, file, c AS chunk, c * 40 + 1 AS ws, least(c * 40 + 40, len(l)) AS we, file || chr(10) || array_to_string(l[c * 40 + 1 : c * 40 + 40], chr(10)) AS body
    FROM (SELECT file, l, CAST(unnest(generate_series(0, (len(l) - 1) // 40)) AS INT) AS c FROM {IQ._FILES})),
    wt AS MATERIALIZED (SELECT key, {terms_sql('body')} AS t FROM w), wp AS MATERIALIZED (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(t) AS term FROM wt) GROUP BY ALL),
    ws AS (SELECT task_id, key, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(t) / al))), 6) AS score
      FROM (SELECT task_id, term, count(*) AS times FROM q GROUP BY ALL) JOIN wp USING (term) JOIN (SELECT term, count(*) AS df FROM wp GROUP BY term) USING (term) JOIN wt USING (key),
      (SELECT count(*) AS n, avg(len(t)) AS al FROM wt) GROUP BY task_id, key),
    held AS MATERIALIZED (SELECT w.file, w.chunk, w.key, s.id FROM w JOIN ({IQ._SPANS}) s ON s.file = w.file AND (s.s - 1) // 40 = w.chunk WHERE s.e <= w.we),
    wk AS MATERIALIZED (SELECT w.key, len(regexp_extract_all('### ' || w.file || ':' || w.ws || chr(10) || chr(10) || '```kotlin' || chr(10) || body[len(w.file) + 2 :] || chr(10) || '```' || chr(10), '[A-Za-z0-9]+|[^A-Za-z0-9 \\n\\t\\r]')) AS tokens, coalesce(n, 0) AS credited
      FROM w LEFT JOIN (SELECT key, count(*) AS n FROM held GROUP BY key) c ON c.key = w.key),
    l AS (SELECT task_id, list(struct_pack(k := key, t := tokens) ORDER BY score DESC, key) AS items FROM ws JOIN wk USING (key) GROUP BY task_id),
    p AS (SELECT task_id, list_reduce(list_prepend(struct_pack(spent := CAST(0 AS BIGINT), took := CAST([] AS VARCHAR[]), k := '', t := CAST(0 AS BIGINT)), list_transform(items, lambda x: struct_pack(spent := CAST(0 AS BIGINT), took := CAST([] AS VARCHAR[]), k := x.k, t := CAST(x.t AS BIGINT)))),
      lambda a, x: CASE WHEN a.spent + x.t <= {BUDGET} THEN struct_pack(spent := a.spent + x.t, took := list_append(a.took, x.k), k := x.k, t := x.t) ELSE struct_pack(spent := a.spent, took := a.took, k := x.k, t := x.t) END) AS f FROM l)"""


@query(with_views(f"WITH {_WINDOWS} SELECT task_id, key, score, CAST(tokens AS INT) AS tokens, credited FROM (SELECT task_id, unnest(f.took) AS key FROM p) JOIN ws USING (task_id, key) JOIN wk USING (key)", "q"))
def chunk_bm25_pack(spark: SparkSession, d: str) -> DataFrame:
    return with_credits(*pack_chunks(spark, d, chunk_scores(spark, d)))


@query(with_views(f"WITH {_WINDOWS} SELECT task_id, id, 'chunk:' || file AS why, CAST(0 AS INT) AS tokens FROM (SELECT task_id, unnest(f.took) AS key FROM p) JOIN held USING (key)", "q"))
def chunk_bm25_items(spark: SparkSession, d: str) -> DataFrame:
    """The declarations that the taken windows are credited with, as items of the pack."""
    return P.credited(*pack_chunks(spark, d, chunk_scores(spark, d)))


_BY_VECTOR = _WINDOWS[: _WINDOWS.index("ws AS (SELECT task_id")] + "ws AS (SELECT task_id, key, score FROM dense JOIN (SELECT file, key FROM w) ON file = id),\n    " + _WINDOWS[_WINDOWS.index("held AS MATERIALIZED") :]


@query(with_views(f"WITH {RQ.dense_sql(1.0, 2**31 - 1)}, {_BY_VECTOR} SELECT task_id, key, score, CAST(tokens AS INT) AS tokens, credited FROM (SELECT task_id, unnest(f.took) AS key FROM p) JOIN ws USING (task_id, key) JOIN wk USING (key)", "sym"))
def chunk_embed_pack(spark: SparkSession, d: str) -> DataFrame:
    """Windows by their document's vector; every window has a score."""
    near = RQ.dense_channel(spark, d, None).select("task_id", F.col("id").alias("file"), "score")
    w = N.windows(IQ.files(spark, d)).select("file", F.concat("file", F.lit("#"), F.lpad(F.col("chunk").cast("string"), 6, "0")).alias("key"))
    return with_credits(*pack_chunks(spark, d, near.join(w, "file").select("task_id", "key", "score")))


@query(with_views(r"""WITH t AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'other/x' ELSE 'own/x' END AS repo, CASE WHEN s_suppkey % 5 = 0 THEN 'src/test/T.kt' WHEN s_suppkey % 7 = 0 THEN 'A.md' ELSE 'src/A' || CAST(s_suppkey % 3 AS VARCHAR) || '.kt' END AS f FROM supplier)
    SELECT 't' || lpad(CAST(k AS VARCHAR), 6, '0') AS task_id, 'abcdef' || CAST(k % 10 AS VARCHAR) AS base_commit, f AS file, CAST(k + 1 AS INT) AS line FROM t WHERE repo = 'own/x' AND f LIKE '%.kt' AND NOT contains(f, '/test')"""))
def suite_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of a suite, its directories made of suppliers."""
    from skein.sources.diffs import suite_tasks as read

    s, k = V.table(spark, d, "supplier"), F.col("s_suppkey")
    task = F.concat(F.lit("t"), F.lpad(k.cast("string"), 6, "0"))
    file = F.when(k % 5 == 0, "src/test/T.kt").when(k % 7 == 0, "A.md").otherwise(F.concat(F.lit("src/A"), (k % 3).cast("string"), F.lit(".kt")))
    parts = F.array(
        F.struct(F.lit("task.toml").alias("p"), F.when(k % 4 == 0, 'repository_name = "other/x"').otherwise('repository_name = "own/x"').alias("t")),
        F.struct(F.lit("instruction.md").alias("p"), F.col("s_name").alias("t")),
        F.struct(F.lit("environment/prepare.sh").alias("p"), F.concat(F.lit("git checkout abcdef"), (k % 10).cast("string")).alias("t")),
        F.struct(F.lit("solution/fix.patch").alias("p"), F.concat(F.lit("--- a/"), file, F.format_string("\n@@ -%d +%d @@", k + 1, k + 1)).alias("t")),
    )
    files = s.select(task.alias("task"), F.inline(parts)).select(F.concat("task", F.lit("/"), "p").alias("path"), F.col("t").alias("text"))
    out = read(files, "own/x").select("task_id", "base_commit", F.explode("changed_lines").alias("file", "lines"))
    return out.select("task_id", "base_commit", "file", F.explode("lines").alias("line"))
