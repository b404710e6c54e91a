"""A live index: batches of changed files are patched into it as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from skein.operators.incremental import patched, stamps
from skein.operators.ledger import SILENCE, SILENT


def watch(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of rows that land in a folder as JSON lines."""
    return spark.readStream.schema(schema).json(path)


def keep_patched(changes: DataFrame, base: Callable[[], dict[str, DataFrame]], index: Callable[[DataFrame], dict[str, DataFrame]], save: Callable[[dict[str, DataFrame], int], None], checkpoint: str) -> StreamingQuery:
    """Patches base() by each batch of changed files (file) and hands the outcome to save with the batch's number.

    index: symbols, edges, errors and coverage of the files in a table (file). Unchanged files that refer to what is gone, or
    that called what is new, are indexed anew as well. A batch may come again after a failure: save must write by the
    batch's number, so that the second write replaces the first.
    """

    def each(batch: DataFrame, number: int) -> None:
        save(patched(base(), batch.select("file"), index), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def is_fresh(files: DataFrame, stored: DataFrame) -> bool:
    """Whether an index is still that of the files: their stamps (file, stamp) are the stored ones, no more and no fewer."""
    now = stamps(files)
    differ = now.join(stored, ["file", "stamp"], "left_anti").select("file").unionByName(stored.join(now, ["file", "stamp"], "left_anti").select("file"))
    return differ.isEmpty()


def until_silent(trials: DataFrame, limit: int = SILENT) -> DataFrame:
    """A stream of trials (run, seq, outcome) up to the limit-th silent answer in a row of their run; later ones are dropped.

    What is kept of a run is how many of its last answers were silent, and whether it has ended. Trials of a run come in order
    from batch to batch; within a batch they are put in order.
    """

    def go_on(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        silent, ended = state.get if state.exists else (0, False)
        for batch in [pd.concat(list(batches)).sort_values("seq", kind="stable")]:
            kept = 0
            for outcome in batch["outcome"]:
                if ended:
                    break
                kept += 1
                silent = silent + 1 if outcome == SILENCE else 0
                ended = silent >= limit
            state.update((silent, ended))
            yield batch.head(kept)[["run", "seq", "outcome"]]

    return trials.groupBy("run").applyInPandasWithState(go_on, "run string, seq long, outcome string", "silent int, ended boolean", "append", "NoTimeout")


def freshness(changes: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Changed files by window of event time (ts), late ones up to the delay."""
    return changes.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w")).agg(F.approx_count_distinct("file").alias("files"))
