"""Tables in the shared folder: lineage is cut there in loops, and rows are numbered by way of them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, one of our own, but on a local master alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Tables written by cut(), by the path's file system; removed when the process ends.
_written: list[tuple[SparkSession, str]] = []


def _remove() -> None:
    for spark, path in _written:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone: the folder's owner clears it then  # noqa: BLE001
            return
    _written.clear()


atexit.register(_remove)


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, while checkpoint() computes what isn't persisted twice."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of stored(), by session, name and what their inputs were like.
_stored: dict[tuple, tuple[DataFrame, ...]] = {}


def stamps(spark: SparkSession, *paths: str) -> tuple[tuple[str, int, int], ...]:
    """(path, length, time of last change) of every file at the paths."""
    out = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def stored(spark: SparkSession, name: str, paths: list[str], build: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """The tables of build(), written once for what lies at the paths: a file there that is another by its length or its time
    of last change has them made anew. They last as long as the process, like all of cut()'s."""
    key = (spark.sparkContext.applicationId, name, stamps(spark, *paths))
    if key not in _stored:
        _stored[key] = tuple(cut(df) for df in build())
    return _stored[key]


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df with its place, from 0, in the order of all rows: a range sort, and counts of the partitions before each one.

    No task gets more than its range; the counts, a row a partition, are what one task adds up.
    """
    part = F.spark_partition_id()
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", part).withColumn("_nth", F.monotonically_increasing_id()))
    cells = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_nth").alias("_least"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    cells = cells.select("_part", "_least", before.alias("_before"))
    return rows.join(F.broadcast(cells), "_part").withColumn(name, F.col("_nth") - F.col("_least") + F.col("_before")).drop("_part", "_nth", "_least", "_before")
