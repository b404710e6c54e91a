"""What may be put in place of the package's own retrievers, dense seeds and indexers."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Retriever(Protocol):
    """Packs of a batch of tasks."""

    def pack(self, tasks: DataFrame, budget: int) -> DataFrame:
        """tasks (task_id, text) to the items of their packs, as operators.packing.pack() gives them."""
        ...


@runtime_checkable
class DenseSeeds(Protocol):
    """Scores of declarations by something other than their words."""

    def score(self, tasks: DataFrame) -> DataFrame:
        """tasks (task_id, text) to (task_id, id, score)."""
        ...


@runtime_checkable
class CodeIndexer(Protocol):
    """The index of files."""

    def index(self, files: DataFrame | None) -> dict[str, DataFrame]:
        """symbols, edges, errors and coverage of the files (file), or of all."""
        ...
