"""Mixing sources to target weights by a time-varying curriculum.

A source's target is its integral of a weight schedule over the training run. The run takes BUDGET times all words;
shares follow the weights, no target passes CAP times its source's words, and what a capped source leaves over is shared
again by weight (water-filling: target = least of CAP * size and level * weight, at the level that spends the budget).

Over training time u in 0..1 a source is drawn at the density 1 + slope * (2u - 1): heavily weighted sources fade out,
lightly weighted ones fade in. Its cumulative demand, target * (u + slope * (u*u - u)), is inverted at the middle of each
document's run of words, which gives the document's training position; documents are range-sorted by position.

Within a source documents stand in an order drawn by a hash (MD5) of their ids. Whole passes over the source come first; the
pass that the target cuts short takes documents in that order, and the one at the cut gives only the words still owed.
Running sums go over (source, hash bucket), so a source that holds a third of all rows is summed by many tasks.

A null text has no words; null is a source of its own, the last; documents without words are taken 0 times and keep
position null. Rows that repeat an id are rows of their own. Rows with a null doc_id take no part.

As a stage of the pipeline the mix gives a document as often as it is drawn. A draw that the cut shortens holds the
document's first words, as many as are owed, so each source's words meet its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, CAP = 1.5, 2.0
#: How far the sources of each weight lean to the start (negative) or the end (positive) of the run.
SLOPES = (-0.5, 0.0, 0.5)
BUCKETS = 4096


def word_count(text: F.Column) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, slope, target). A row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (nth + 1).cast("int"))
    t = sizes.select("source", "source_size", pick(weights).alias("weight"), pick(SLOPES).alias("slope"))
    t = t.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("all", F.sum("source_size").over(everything) * F.lit(float(budget)))
    # The level if all sources from this one on stay below their caps; the first that does so sets it.
    t = t.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return t.select("source", "source_size", "weight", "slope", target.alias("target"))


def mix(spark: SparkSession, docs: DataFrame, buckets: int = BUCKETS, row: F.Column | None = None) -> DataFrame:
    """One row per document, range-sorted by first training position: doc_id, row, size, source_size, target, taken, positions.

    positions: (position, words) of each time the document is drawn. row: a hash that tells rows of one id apart.
    """
    scratch = common.Scratch(spark, "mixing")
    row = F.lit(0).cast("long") if row is None else row
    sized = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row.alias("row"))
    sized = sized.withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary")))
    sized = scratch.keep(sized.withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int") % buckets))
    cells = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    cells = cells.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
    cells = cells.withColumnsRenamed({"source": "s", "bucket": "b"})
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumnRenamed("source", "of")
    cells = cells.join(aims, F.col("s").eqNullSafe(F.col("of"))).drop("of")

    own = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    d = sized.withColumn("start", F.sum("size").over(own) - F.col("size"))
    d = d.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("start") + F.col("before"))

    owed = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(owed / F.col("source_size"))).otherwise(0).cast("long")
    d = d.withColumn("owed", owed).withColumn("passes", passes)
    last = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("owed") - F.col("passes") * F.col("source_size") - F.col("start")))
    d = d.withColumn("last", last).withColumn("taken", F.col("passes") * F.col("size") + F.col("last"))

    def drawn(nth, n_words):
        at = (nth * F.col("source_size") + F.col("start") + n_words / 2) / F.col("target")
        lean = F.col("slope")
        u = F.when(lean == 0, at).otherwise((lean - 1 + F.sqrt((1 - lean) * (1 - lean) + 4 * lean * at)) / (2 * lean))
        return F.struct(u.alias("position"), n_words.alias("words"))

    whole = F.when((F.col("passes") > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda i: drawn(i, F.col("size")))).otherwise(F.array().cast("array<struct<position:double,words:bigint>>"))
    part = F.when(F.col("last") > 0, F.array(drawn(F.col("passes"), F.col("last")))).otherwise(F.array().cast("array<struct<position:double,words:bigint>>"))
    d = d.withColumn("positions", F.concat(whole, part))
    first = F.try_element_at("positions", F.lit(1))["position"]
    d = d.select("doc_id", "row", "source", "size", "source_size", "target", "taken", "positions", first.alias("first"))
    return d.repartitionByRange(F.col("first").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first").asc_nulls_last(), "doc_id").drop("first")


WORD = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as they are drawn, in order of training position; of a cut one, the words still owed.

    Rows of one id that differ are drawn each by its own; rows that are equal in all columns share their draws.
    """
    mark, row = common.unused(docs, "_at"), F.xxhash64(*(F.col(c).cast("string") for c, kind in docs.dtypes if kind != "void"))
    keyed = docs.where(F.col("doc_id").isNotNull()).withColumn(mark, F.struct(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row")))
    drawn = common.Scratch(spark, "mixing").keep(mix(spark, docs, row=row))
    again = drawn.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").select(F.struct("doc_id", "row").alias(mark))
    once = common.sieve(keyed, again, mark).dropDuplicates([mark])
    keyed = common.sieve(keyed, again, mark, keep=False).unionByName(once)
    draws = drawn.select(F.struct("doc_id", "row").alias(mark), "size", F.explode("positions").alias("at")).select(mark, F.struct("size", "at").alias("draw"))
    place = common.unused(docs, "_draw")
    rows = keyed.join(draws.withColumnRenamed("draw", place), mark)
    words, size = F.col(place)["at"]["words"], F.col(place)["size"]
    owed = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(1)), F.lit(1), words.cast("int")), "")
    rows = rows.withColumn("text", F.when(words < size, owed).otherwise(F.col("text")))
    position = F.col(place)["at"]["position"]
    return rows.repartitionByRange(position, "doc_id").sortWithinPartitions(position, "doc_id").select(*docs.columns)
