"""Queries of what an indexer takes from sources: kinds, names, signatures, bodies, edges by type, paths and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.functions import text as T
from skein.operators import graph as G
from skein.operators import incremental as I
from skein.operators import names as N
from skein.operators.lineage import cut
from skein.plans import views as V
from skein.plans.index_queries import _FILES, _SPANS, files, spans
from skein.plans.registry import query
from skein.plans.views import with_views

_DECLARED = "CASE p_partkey % 4 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'CONSTRUCTOR' WHEN 2 THEN 'PROPERTY' ELSE 'FUNCTION' END"
_CLASS_KIND = "CASE p_size % 6 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'INTERFACE' WHEN 2 THEN 'OBJECT' WHEN 3 THEN 'COMPANION_OBJECT' WHEN 4 THEN 'ENUM_CLASS' ELSE 'ANONYMOUS_OBJECT' END"


@query(f"""SELECT p_partkey, CASE WHEN d = 'CLASS' THEN CASE WHEN c = 'INTERFACE' THEN 'INTERFACE' WHEN c LIKE '%OBJECT' THEN 'OBJECT' ELSE 'CLASS' END ELSE d END AS kind
    FROM (SELECT p_partkey, {_DECLARED} AS d, {_CLASS_KIND} AS c FROM part)""")
def kinds(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    return p.select("p_partkey", T.kind_of(F.expr(_DECLARED), F.expr(_CLASS_KIND)).alias("kind"))


@query(f"SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'id' || p_partkey ELSE p_brand || '.' || CASE WHEN {_DECLARED} = 'CONSTRUCTOR' THEN '<init>' ELSE p_type END END AS fq_name FROM part")
def fq_names(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    container = F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))
    return p.select("p_partkey", T.fq_name(F.expr(_DECLARED), container, F.col("p_type"), F.concat(F.lit("id"), F.col("p_partkey").cast("string"))).alias("fq_name"))


#: Declarations whose default arguments, literals and types hold what would begin a body elsewhere.
_HEADS = """CASE p_partkey % 6 WHEN 0 THEN 'fun f' || p_partkey || '(a: Int = ' || p_size || ', b: () -> Unit = { x }): String' WHEN 1 THEN 'class C' || p_partkey || '(val a: String = "{=", val c: Char = ''{'') : B(1 == 2)'
    WHEN 2 THEN 'val v' || p_partkey || ': Map<String, (Int) -> Int>' WHEN 3 THEN '@A(x = [1, 2]) fun <T> T.g' || p_partkey || '() where T : B' WHEN 4 THEN 'interface I' || p_partkey ELSE 'abstract fun h' || p_partkey || '(p: Int)' END"""
_BODIES = "CASE p_partkey % 6 WHEN 0 THEN ' = a.let { it == 1 }' WHEN 1 THEN ' { val x = 1 }' WHEN 2 THEN ' = mapOf()' WHEN 3 THEN ' { }' ELSE '' END"


@query(f"SELECT p_partkey, {_HEADS} AS signature FROM part")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    doc = F.expr("CASE WHEN p_size % 2 = 0 THEN '/** Says {a = b}. */\n  ' ELSE '' END")
    text = F.concat(doc, F.expr(_HEADS.replace("''{''", "\\'{\\'")), F.expr(_BODIES))
    return V.table(spark, d, "part").select("p_partkey", T.signature(text).alias("signature"))


@query(r"SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS doc FROM documents")
def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", T.doc_line(F.col("text")).alias("doc"))


@query(r"SELECT conv_id, turn, regexp_replace(text, '[ \t\n\f\r\v]+', ' ', 'g')[1:40] AS callee FROM conversations")
def callee_texts(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.callee_text(F.col("text")).alias("callee"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'other/' || p_partkey || '.kt' WHEN p_size % 3 = 1 THEN 'src/' || p_partkey || '.kt' ELSE '/repository/' || p_partkey || '.kt' END AS file FROM part")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.expr("CASE WHEN p_size % 3 = 0 THEN concat('C:\\\\repo\\\\other\\\\', p_partkey, '.kt') WHEN p_size % 3 = 1 THEN concat('/repo/src/', p_partkey, '.kt') ELSE concat('/repository/', p_partkey, '.kt') END")
    root = F.when(F.col("p_size") % 3 == 0, F.lit("C:/repo/")).otherwise(F.lit("/repo"))
    return V.table(spark, d, "part").select("p_partkey", T.relative_path(path, root).alias("file"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE 'diff --git a/x b/x' || chr(10) || rtrim(regexp_replace(text, '[^ -~]|`', ' ', 'g')) || chr(10) END AS diff FROM conversations""")
def reply_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of turns: a fenced diff, a bare one, none."""
    body = F.concat(F.lit("diff --git a/x b/x\n"), F.regexp_replace("text", "[^ -~]|`", " "))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here:\n```diff\n"), body, F.lit("\n```\nDone."))).when(F.col("turn") % 3 == 1, F.concat(F.lit("So be it. "), body)).otherwise("no change")
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.diff_in(reply).alias("diff"))


@query(f"""SELECT id, CASE WHEN e <= len(l) THEN sha256(array_to_string(l[s : e], chr(10))) END AS body FROM ({_SPANS}) LEFT JOIN
    (SELECT file, CASE WHEN l[-1] = '' AND len(l) > 1 THEN l[1 : len(l) - 1] ELSE l END AS l FROM {_FILES}) f USING (file)""")
def symbol_bodies(spark: SparkSession, d: str) -> DataFrame:
    return N.bodies(spans(spark, d), files(spark, d)).select("id", F.sha2(F.col("body").cast("binary"), 256).alias("body"))


@query("SELECT 's' || s_suppkey AS from_id, n_name AS to_id, 'EXTENDS' AS kind FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def extends_edges(spark: SparkSession, d: str) -> DataFrame:
    s = V.table(spark, d, "supplier").join(V.table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return G.supertype_edges(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.array("n_name", F.lit(G.ROOT_CLASS)).alias("supertypes")))


@query(f"""WITH t AS (SELECT 'p' || p_partkey AS from_id, {_DECLARED} AS kind, p_brand AS r, [p_type, CASE WHEN p_size % 2 = 0 THEN p_container END] AS ps, CASE WHEN p_size % 3 = 0 THEN p_mfgr END AS rc FROM (SELECT *, 'k' || p_size AS p_container, 'm' || p_size AS p_mfgr FROM (SELECT p_partkey, p_brand, p_type, p_size FROM part)))
    SELECT from_id, to_id, 'REFERENCES_TYPE' AS kind FROM (SELECT from_id, unnest(CASE kind WHEN 'FUNCTION' THEN list_concat([r], ps, [rc]) WHEN 'CONSTRUCTOR' THEN ps WHEN 'PROPERTY' THEN [r] END) AS to_id FROM t) WHERE to_id IS NOT NULL""")
def type_edges(spark: SparkSession, d: str) -> DataFrame:
    p, size = V.table(spark, d, "part"), F.col("p_size").cast("string")
    params = F.array(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("k"), size)))
    s = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.expr(_DECLARED).alias("kind"), F.col("p_brand").alias("return_type"), params.alias("parameter_types"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("m"), size)).alias("receiver_type"))
    return G.type_edges(s)


@query("SELECT o_custkey AS commit, o_orderpriority AS base, count(*) AS n_changed, o_custkey % 40 AS n_indexed FROM orders GROUP BY ALL HAVING o_custkey % 40 > 0 AND count(*) <= CAST(0.35 AS DOUBLE) * (o_custkey % 40)")
def reusable_bases(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("commit"), F.col("o_orderpriority").alias("base")).agg(F.count("*").alias("n_changed"))
    return I.reusable(o.withColumn("n_indexed", F.col("commit") % 40))


@query("SELECT DISTINCT path FROM (SELECT CASE WHEN p_size % 4 = 0 THEN '/elsewhere/' || p_size ELSE '/checkout/m' || p_size END AS path FROM part UNION ALL SELECT '/checkout/src/main/kotlin' UNION ALL SELECT '/checkout/m1')")
def relocated_roots(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("/elsewhere/"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("/head/m"), F.col("p_size").cast("string")))
    usual = spark.createDataFrame([("/checkout/src/main/kotlin",), ("/checkout/m1",)], "path string")
    return I.relocated(V.table(spark, d, "part").select(path.alias("path")), F.lit("/head"), F.lit("/checkout"), usual)


_PATCH = """ch AS (SELECT DISTINCT file FROM sym WHERE file IN ('src0', 'src1')), gone AS (SELECT id FROM sym WHERE file IN (SELECT file FROM ch) AND pos % 50 = 0),
    extra AS (SELECT DISTINCT file FROM edg JOIN sym ON id = from_id WHERE to_id IN (SELECT id FROM gone) AND file NOT IN (SELECT file FROM ch)
      UNION SELECT DISTINCT file FROM err WHERE message IN ('unresolved call `t1`', 'unresolved call `t4`') AND file NOT IN (SELECT file FROM ch)),
    dirty AS (SELECT file FROM ch UNION SELECT file FROM extra)"""


def patched(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The index after src0 and src1 changed: every fiftieth declaration is gone, and two have new names."""
    s, e = V.graph(spark, d)
    base = {"symbols": s, "edges": e, "errors": V.err(spark, d).drop("seq"), "coverage": V.cov(spark, d)}

    def index(some: DataFrame) -> dict[str, DataFrame]:
        now = s.join(some.select("file"), "file", "left_semi").where("pos % 50 <> 0 or file not in ('src0', 'src1')")
        now = now.withColumn("name", F.when(F.col("pos") % 50 == 1, F.lit("t1")).when(F.col("pos") % 50 == 2, F.lit("t4")).otherwise(F.concat(F.lit("new_"), "name"))).select(s.columns)
        own = e.join(now.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi").select(e.columns)
        return {"symbols": now, "edges": own, "errors": spark.createDataFrame([], schema.ERRORS), "coverage": spark.createDataFrame([], schema.COVERAGE)}

    return I.patched(base, s.where(F.col("file").isin("src0", "src1")).select("file"), index)


@query(with_views(f"""WITH {_PATCH} SELECT id, file, CASE WHEN file NOT IN (SELECT file FROM dirty) THEN name WHEN pos % 50 = 1 THEN 't1' WHEN pos % 50 = 2 THEN 't4' ELSE 'new_' || name END AS name
    FROM sym WHERE file NOT IN (SELECT file FROM ch) OR pos % 50 <> 0""", "sym", "edg", "err"))
def index_patch(spark: SparkSession, d: str) -> DataFrame:
    return patched(spark, d)["symbols"].select("id", "file", "name")


@query(with_views(f"WITH {_PATCH} SELECT DISTINCT from_id, to_id, kind FROM edg WHERE from_id NOT IN (SELECT id FROM gone)", "sym", "edg", "err"))
def index_patch_edges(spark: SparkSession, d: str) -> DataFrame:
    return cut(patched(spark, d)["edges"])
