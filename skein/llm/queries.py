"""The registered queries of this subpackage. Each derives its digest columns from its operator's result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import ann, exactdedup, fim, licence, mixing, ngramjoin, packing, quality, simhash, suffixdedup, toxicity, urlfilter, wand
from skein.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark, table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op6_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.scan(spark, table(spark, sf_dir, "documents"), every=True)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.copies(spark, table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"))
    first = F.try_element_at("positions", F.lit(1))["position"]
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.size("positions").cast("long").alias("draws"), F.round(first, 6).alias("first_position"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op11_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.rank(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(spark, table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ann": op4_ann,
    "op5_pack": op5_pack,
    "op6_licence": op6_licence,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mix": op8_mix,
    "op9_quality": op9_quality,
    "op10_ngram_join": op10_ngram_join,
    "op11_wand": op11_wand,
    "op12_fim": op12_fim,
    "op13_simhash": op13_simhash,
}
