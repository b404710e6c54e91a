"""Queries of terms, BM25, channels and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import retrieval as R
from skein.operators.lineage import cut
from skein.plans import views as V
from skein.plans.registry import query
from skein.protocols import DenseSeeds
from skein.plans.views import terms_sql, with_views


@query(with_views("SELECT doc_id, array_to_string(terms, ' ') AS terms, CAST(len AS INT) AS n FROM docs", "docs"))
def terms_split(spark: SparkSession, d: str) -> DataFrame:
    return V.docs(spark, d).select("doc_id", F.array_join("terms", " ").alias("terms"), F.col("len").alias("n"))


@query(with_views("SELECT term, count(*) AS df FROM post GROUP BY term", "post"))
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return R.document_frequency(V.post(spark, d))


@query(with_views("SELECT doc_id, term, tf FROM post WHERE tf > 3", "post"))
def term_tf(spark: SparkSession, d: str) -> DataFrame:
    return V.post(spark, d).where("tf > 3")


@query(with_views("SELECT count(*) AS n_docs, round(coalesce(avg(len), 0), 6) AS avg_len FROM docs", "docs"))
def average_length(spark: SparkSession, d: str) -> DataFrame:
    return V.docs(spark, d).agg(F.count("*").alias("n_docs"), F.round(F.coalesce(F.avg("len"), F.lit(0.0)), 6).alias("avg_len"))


_TOP = "SELECT task_id, doc_id, score, rank FROM (SELECT task_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {0}) WHERE rank <= {1}"


@query(with_views(_TOP.format("bm", 20), "bm"))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(V.bm_best(spark, d, 20), 20).select("task_id", "doc_id", "score", "rank")


_TWICE = "SELECT task_id, unnest(list_concat(t, t[1:3])) AS term FROM (SELECT task_id, %s AS t FROM tsk)" % terms_sql("text")


@query(with_views("""WITH qq AS (%s), s AS (SELECT task_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al))) AS score
    FROM (SELECT task_id, term, count(*) AS times FROM qq GROUP BY ALL) JOIN post USING (term) JOIN (SELECT term, count(*) AS df FROM post GROUP BY term) USING (term)
    JOIN docs USING (doc_id), (SELECT count(*) AS n, avg(len) AS al FROM docs) GROUP BY task_id, doc_id) """ % _TWICE + _TOP.format("s", 10), "docs", "post", "tsk"))
def bm25_dup_terms(spark: SparkSession, d: str) -> DataFrame:
    """The first three terms of a task count once more: repeated terms are not made distinct."""
    t = T.terms(F.col("text"))
    q = V.tsk(spark, d).select("task_id", F.explode(F.concat(t, F.slice(t, 1, 3))).alias("term"))
    scores = R.bm25_best(V.index(spark, d), q, 10)
    return R.ranked(scores, 10).select("task_id", "doc_id", "score", "rank")


@query(with_views("SELECT item_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \\n\\t\\r]')) AS INT) AS tokens FROM benchmark"))
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "benchmark").select("item_id", T.token_count(F.col("text")).alias("tokens"))


@query(with_views(f"SELECT id, array_to_string(list_concat({terms_sql('name')}, {terms_sql('name')}, {terms_sql('fq_name')}, {terms_sql("coalesce(doc, '')")}), ' ') AS terms FROM sym", "sym"))
def document_terms(spark: SparkSession, d: str) -> DataFrame:
    s = V.sym(spark, d)
    return s.select("id", F.array_join(T.document_terms(F.col("name"), F.col("fq_name"), F.col("doc")), " ").alias("terms"))


@query(with_views("SELECT id, concat_ws(chr(10), signature, doc) AS dense FROM sym", "sym"))
def dense_documents(spark: SparkSession, d: str) -> DataFrame:
    return V.sym(spark, d).select("id", T.dense_document(F.col("signature"), F.col("doc")).alias("dense"))


@query("SELECT item_id, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), ' '), ' +', ' ', 'g') AS line FROM benchmark")
def one_line(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "benchmark").select("item_id", T.one_line(F.col("text")).alias("line"))


_NAMES = r"""(SELECT DISTINCT task_id, unnest(list_concat(flatten(list_transform(regexp_extract_all(text, '`([^`\n]+)`', 1), lambda x: regexp_extract_all(x, '[A-Za-z_][A-Za-z0-9_]*'))),
    regexp_extract_all(text, '\b([A-Za-z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*|_[A-Za-z0-9]+)+)\b', 1))) AS name FROM tsk)"""
_EXACT = f"exact AS (SELECT task_id, id, row_number() OVER (PARTITION BY task_id ORDER BY is_test, id) AS rank FROM (SELECT DISTINCT task_id, id, is_test FROM {_NAMES} JOIN sym USING (name)))"


@query(with_views(f"WITH {_EXACT} SELECT * FROM exact", "tsk", "sym"))
def exact_names(spark: SparkSession, d: str) -> DataFrame:
    return R.exact_names(V.tsk(spark, d), V.sym(spark, d))


def search_channel(spark: SparkSession, d: str, penalty: float, limit: int = R.CANDIDATES, symbols: DataFrame | None = None) -> DataFrame:
    """(task_id, id, rank) by BM25 over documents, test code at a penalty."""
    symbols = V.sym(spark, d) if symbols is None else symbols
    factors = None if penalty == 1 else symbols.where("is_test").select(F.col("pos").alias("doc_id"), F.lit(float(penalty)).alias("factor"))
    scores = V.bm_best(spark, d, limit, factors).select("task_id", V.doc_id(F.col("doc_id")).alias("id"), "score")
    return R.ranked(scores, limit, key="id")


def seeds(spark: SparkSession, d: str, penalty: float = R.TEST_PENALTY, limit: int = R.SEEDS, dense: bool | DenseSeeds = False, symbols: DataFrame | None = None) -> DataFrame:
    """(task_id, id, score, why, rank). dense: whether stored vectors are a channel too, or what scores in their place."""
    symbols = V.sym(spark, d) if symbols is None else symbols
    channels = R.exact_names(V.tsk(spark, d), symbols).withColumn("why", F.lit("seed:mentioned"))
    channels = channels.unionByName(search_channel(spark, d, penalty, symbols=symbols).select("task_id", "id", "rank").withColumn("why", F.lit("seed:search")))
    if dense:
        if dense is True:
            near = dense_channel(spark, d, R.CANDIDATES, penalty, symbols)
        else:
            near = R.ranked(R.penalised(dense.score(V.tsk(spark, d)), symbols.select("id", "is_test"), penalty, "id"), R.CANDIDATES, key="id")
        channels = channels.unionByName(near.select("task_id", "id", "rank").withColumn("why", F.lit("seed:embed")))
    return R.fuse(channels, limit)


def dense_channel(spark: SparkSession, d: str, limit: int | None, penalty: float = 1.0, symbols: DataFrame | None = None) -> DataFrame:
    e = V.table(spark, d, "embeddings")
    tasks = V.tsk(spark, d).select("task_id")
    q = tasks.join(e, F.col("task_id") == F.col("vec_id")).select("task_id", F.col("embedding").alias("q"))
    v = e.select(V.doc_id(F.col("vec_id")).alias("id"), F.col("embedding").alias("v"))
    return R.dense(q, v, limit, (V.sym(spark, d) if symbols is None else symbols).select("id", "is_test"), penalty)


def search_sql(penalty: float) -> str:
    return f"""search AS (SELECT * FROM (SELECT task_id, id, row_number() OVER (PARTITION BY task_id ORDER BY round(score * CASE WHEN is_test THEN {penalty} ELSE 1.0 END, 6) DESC, id) AS rank
        FROM (SELECT task_id, {V.id_sql('doc_id')} AS id, score FROM bm) JOIN sym USING (id)) WHERE rank <= 200)"""


def dense_sql(penalty: float, limit: int) -> str:
    unit = "list_transform(CAST({0} AS DOUBLE[]), lambda x: x / nullif(sqrt(list_sum(list_transform(CAST({0} AS DOUBLE[]), lambda y: y * y))), 0))"
    return f"""dense AS (SELECT * FROM (SELECT task_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 6) DESC, id) AS rank FROM
        (SELECT task_id, id, list_dot_product(q, v) * CASE WHEN is_test THEN {penalty} ELSE 1.0 END AS score
         FROM (SELECT item_id AS task_id, {unit.format('embedding')} AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
              (SELECT {V.id_sql('vec_id')} AS id, {unit.format('embedding')} AS v FROM embeddings) JOIN sym USING (id))) WHERE rank <= {limit})"""


def fuse_sql(channels: dict[str, str], limit: int) -> str:
    union = " UNION ALL ".join(f"SELECT task_id, id, rank, '{why}' AS why FROM {t}" for t, why in channels.items())
    return f"""seeds AS (SELECT * FROM (SELECT task_id, id, round(s, 9) AS score, why, row_number() OVER (PARTITION BY task_id ORDER BY round(s, 9) DESC, id) AS rank FROM
        (SELECT task_id, id, sum(1.0 / (60 + rank)) AS s, array_to_string(list_sort(list(DISTINCT why)), '+') AS why FROM ({union}) GROUP BY task_id, id)) WHERE rank <= {limit})"""


_CHANNELS = {"exact": "seed:mentioned", "search": "seed:search"}
SEED_VIEWS = ("tsk", "sym", "bm")


def seeds_sql(penalty: float = R.TEST_PENALTY, limit: int = R.SEEDS, dense: bool = False) -> str:
    parts = [_EXACT, search_sql(penalty)] + ([dense_sql(penalty, 200)] if dense else [])
    return ", ".join([*parts, fuse_sql(_CHANNELS | ({"dense": "seed:embed"} if dense else {}), limit)])


@query(with_views(f"WITH {seeds_sql()} SELECT * FROM seeds", *SEED_VIEWS))
def rrf_seeds(spark: SparkSession, d: str) -> DataFrame:
    return seeds(spark, d)


@query(with_views(f"WITH {seeds_sql(1.0)} SELECT * FROM seeds", *SEED_VIEWS))
def seed_tests(spark: SparkSession, d: str) -> DataFrame:
    """Test code at no penalty."""
    return seeds(spark, d, penalty=1.0)


@query(with_views(f"WITH {dense_sql(1.0, 10)} SELECT * FROM dense", "sym"))
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense_channel(spark, d, 10).select("task_id", "id", "score", "rank")


@query(with_views(f"WITH {seeds_sql(dense=True)} SELECT * FROM seeds", *SEED_VIEWS))
def embed_seeds(spark: SparkSession, d: str) -> DataFrame:
    return seeds(spark, d, dense=True)


@query(with_views("""WITH r AS (SELECT task_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm),
    l AS (SELECT task_id, list({'d': doc_id, 't': tokens} ORDER BY rank) AS items FROM r JOIN (SELECT pos AS doc_id, tokens FROM sym) USING (doc_id) WHERE rank <= 20 GROUP BY task_id),
    p AS (SELECT task_id, list_reduce(list_prepend({'spent': 0, 'took': CAST([] AS BIGINT[]), 'd': CAST(0 AS BIGINT), 't': 0}, list_transform(items, lambda x: {'spent': 0, 'took': CAST([] AS BIGINT[]), 'd': x.d, 't': x.t})),
      lambda a, x: CASE WHEN a.spent + x.t <= 2000 THEN {'spent': a.spent + x.t, 'took': list_append(a.took, x.d), 'd': x.d, 't': x.t} ELSE {'spent': a.spent, 'took': a.took, 'd': x.d, 't': x.t} END) AS f FROM l)
    SELECT task_id, doc_id, score, rank, tokens FROM (SELECT task_id, unnest(f.took) AS doc_id FROM p) JOIN r USING (task_id, doc_id) JOIN (SELECT pos AS doc_id, tokens FROM sym) USING (doc_id)""", "bm", "sym"))
def retrieve_and_pack(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: BM25 over documents for every task, the best 20, packed greedily into 2,000 tokens."""
    from skein.operators.packing import skip_greedy

    top = R.ranked(V.bm_best(spark, d, 20), 20).join(V.sym(spark, d).select(F.col("pos").alias("doc_id"), "tokens"), "doc_id")
    return skip_greedy(top, 2000, "task_id", [F.col("rank")], "tokens", ["doc_id", "score", "rank", "tokens"])
