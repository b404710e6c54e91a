"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, source mixing, best-fit packing.

Each stage works on all that the one before it kept, and what it decides takes effect:

* quality: documents that the classifier rejects go;
* exact_dedup: of equal texts one document stays;
* near_dedup: of each component of near-duplicate links the document of the smallest id stays;
* mix: documents stand as often as the curriculum draws them, in the order of their training positions;
* pack: the last, gives the pieces and their places in sequences.

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import exactdedup, mixing, ngramjoin, packing, quality
from skein.llm.common import Scratch, table

STAGES = [
    ("quality", quality.stage),
    ("exact_dedup", exactdedup.stage),
    ("near_dedup", ngramjoin.stage),
    ("mix", mixing.stage),
    ("pack", packing.stage),
]

#: The classifier's decisions are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
