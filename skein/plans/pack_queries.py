"""Queries of packs: the two-pass packer over the best of BM25, how packs are written, and how they are explained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import packing as P
from skein.operators import rendering as Re
from skein.operators.lineage import cut
from skein.operators.retrieval import ranked
from skein.plans import pack_sql as S
from skein.plans import views as V
from skein.plans.registry import query

BUDGET = 2000


def bodies(spark: SparkSession, d: str) -> DataFrame:
    """(id, body): whole texts."""
    return V.table(spark, d, "documents").select(V.doc_id(F.col("doc_id")).alias("id"), F.col("text").alias("body"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 400 best of BM25 with all that the packer asks for; of bodies their sizes."""
    top = cut(ranked(V.bm_best(spark, d, P.CANDIDATES), P.CANDIDATES).withColumn("id", V.doc_id(F.col("doc_id"))))
    contains = V.edg(spark, d).where("kind = 'CONTAINS'")
    above = G.ancestors(contains, top)
    below = G.descendants(contains, top).groupBy("id").agg(F.collect_list("descendant").alias("descendants"))
    top = top.join(V.sym(spark, d).withColumnRenamed("pos", "doc_id").drop("id"), "doc_id").join(P.sizes(bodies(spark, d), top), "id")
    top = top.join(above, "id", "left").join(below, "id", "left")
    return top.withColumn("task_id", F.col("task_id").cast("string")).withColumn("why", F.lit("bm25"))


@query(S.pack_sql(S.BM25, "bm", budget=BUDGET))
def pack_two_pass(spark: SparkSession, d: str) -> DataFrame:
    return P.pack(candidates(spark, d), BUDGET, bodies(spark, d))


@query(S.pack_sql(S.BM25, "bm", budget=BUDGET, test_share=0.0))
def pack_tests_capped(spark: SparkSession, d: str) -> DataFrame:
    return P.pack(candidates(spark, d), BUDGET, bodies(spark, d), test_share=0.0)


def packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with their declarations' columns, the errors that fit, and totals."""
    got = cut(P.pack(candidates(spark, d), BUDGET, bodies(spark, d)))
    items = got.join(V.sym(spark, d).select("id", "fq_name", "name", "file", "start_line", "is_test"), "id")
    items = cut(items)
    used = items.select("task_id", "file", (F.col("spent") + F.col("overhead")).alias("used"))
    errors = cut(P.fit_errors(used, V.err(spark, d).drop("seq"), BUDGET))
    return items, errors, P.totals(items, errors, BUDGET)


_LINE = "'- `' || file || ':' || line || '`: ' || message || chr(10)"
_ERRORS = f"""full_items AS MATERIALIZED (SELECT p.*, fq_name, name, file, start_line, is_test FROM packed p JOIN sym USING (id)),
    fitted AS MATERIALIZED (SELECT * FROM (SELECT task_id, file, line, message, used, sum({S._count(_LINE)}) OVER (PARTITION BY task_id ORDER BY file, line, message) + 3 AS cost
      FROM (SELECT DISTINCT task_id, file, line, message, spent + overhead AS used FROM full_items JOIN err USING (file))) WHERE cost <= {BUDGET} - used),
    totals AS (SELECT task_id, CAST(max(spent + overhead) + coalesce(max(cost), 0) AS BIGINT) AS tokens, count(DISTINCT full_items."at") AS n FROM full_items LEFT JOIN (SELECT task_id, max(cost) AS cost FROM fitted GROUP BY task_id) USING (task_id) GROUP BY task_id)"""
_ONE_LINE = "regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), ' '), ' +', ' ', 'g')"
_BLOCKS = f"""block AS (SELECT *, CASE WHEN is_test THEN 3 WHEN fidelity = 'FULL' THEN 1 ELSE 2 END AS section, fidelity = 'STUB' AS stub, CASE WHEN fidelity = 'STUB' THEN file END AS under,
      CASE fidelity WHEN 'FULL' THEN chr(10) || '### ' || fq_name || chr(10) || '`' || file || ':' || start_line || '` — ' || why || chr(10) || chr(10) || '```kotlin' || chr(10) || text || chr(10) || '```' || chr(10) ELSE '- ' || start_line || ': ' || {_ONE_LINE} || ' — ' || why || chr(10) END AS b FROM full_items),
    by_file AS (SELECT task_id, section, stub, min("at") AS first, coalesce(chr(10) || '`' || under || '`' || chr(10), '') || string_agg(b, '' ORDER BY "at") AS b FROM block GROUP BY task_id, section, stub, under),
    whole AS (SELECT task_id, string_agg(b, '' ORDER BY section) AS b FROM (SELECT task_id, section, chr(10) || '## ' || ['Definitions', 'Related signatures', 'Tests likely affected'][section] || chr(10) || string_agg(b, '' ORDER BY stub, first) AS b FROM by_file GROUP BY task_id, section) GROUP BY task_id),
    notes AS (SELECT task_id, chr(10) || '## Diagnostics' || chr(10) || string_agg({_LINE}, '' ORDER BY file, line, message) AS e FROM fitted GROUP BY task_id)"""


@query(S.pack_sql(S.BM25, "bm", "err", budget=BUDGET, final=f""", {_ERRORS}, {_BLOCKS}
    SELECT task_id, regexp_replace('# Context pack' || chr(10) || chr(10) || tokens || ' / {BUDGET} tokens, ' || n || ' declarations.' || chr(10) || b || coalesce(e, ''), '\\s+$', '') || chr(10) AS markdown
    FROM totals JOIN whole USING (task_id) LEFT JOIN notes USING (task_id)"""))  # fmt: skip
def pack_markdown(spark: SparkSession, d: str) -> DataFrame:
    items, errors, totals = packed(spark, d)
    return Re.markdown(items, totals, errors)


@query(S.pack_sql(S.BM25, "bm", "err", budget=BUDGET, final=f""", {_ERRORS},
    i AS (SELECT task_id, list(struct_pack(id := id, name := name, file := file, line := start_line, why := why, fidelity := lower(fidelity), tokens := tokens) ORDER BY "at") AS items FROM full_items GROUP BY task_id),
    e AS (SELECT task_id, list(struct_pack(file := file, line := line, message := message) ORDER BY file, line, message) AS errors FROM fitted GROUP BY task_id)
    SELECT task_id, CAST(to_json(struct_pack(tokens := tokens, budget := {BUDGET}, items := items, errors := coalesce(errors, []))) AS VARCHAR) AS json FROM totals JOIN i USING (task_id) LEFT JOIN e USING (task_id)"""))  # fmt: skip
def pack_explain(spark: SparkSession, d: str) -> DataFrame:
    items, errors, totals = packed(spark, d)
    return Re.explain(items, totals, errors)
