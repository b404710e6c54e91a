"""The store of commits: snapshots, deltas on them, and what a lost manifest hides."""

import pathlib
import shutil

import pytest
from pyspark.sql import functions as F

from skein import schema
from skein.sources import store


def index(spark, versions):
    """versions: {file: number}; each file has two symbols, an edge between them and an error, all of that version."""
    symbols = [(f"{f}.{k}", f, f"{f}{k}", "CLASS", f, 1, v, f"v{v}", None, v, False) for f, v in versions.items() for k in "ab"]
    return {
        "symbols": spark.createDataFrame(symbols, schema.SYMBOLS),
        "edges": spark.createDataFrame([(f"{f}.a", f"{f}.b", "CALLS") for f in versions] + [("nowhere", f"n{min(versions)}", "CALLS")], schema.EDGES),
        "errors": spark.createDataFrame([(f, v, "odd") for f, v in versions.items()], schema.ERRORS),
        "coverage": spark.createDataFrame([(f, v, 0, 0, 0) for f, v in versions.items()], schema.COVERAGE),
    }


def rows(tables):
    return {n: sorted(map(tuple, df.collect()), key=repr) for n, df in tables.items()}


def written(root, commit):
    return sum(p.stat().st_size for p in pathlib.Path(root).rglob(f"commit={commit}/*.parquet"))


def test_chain_of_deltas_gives_each_commit_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "DEPTH", 2)
    root, versions, history = str(tmp_path / "store"), {f"f{i:03d}": 0 for i in range(300)}, []
    for k in range(4):
        if k:
            versions = {f: k if f == "f007" else v for f, v in versions.items() if f != f"f{k:03d}"} | {f"new{k}": k}
            store.write_delta(index(spark, versions), root, f"c{k}", f"c{k - 1}")
        else:
            store.write_index(index(spark, versions), root, "c0")
        history.append(versions)
    depths = {r["commit"]: (r["base"], r["depth"]) for r in spark.read.schema(store.MANIFEST).parquet(f"{root}/v{store.VERSION}/commits").collect()}
    assert depths == {"c0": (None, 0), "c1": ("c0", 1), "c2": ("c1", 2), "c3": (None, 0)}  # compacted
    for k in (1, 2, 3):
        assert rows(store.read_index(spark, root, f"c{k}")) == rows(index(spark, history[k]))
    touched = spark.read.parquet(f"{root}/v{store.VERSION}/touched").where(F.col("commit") == "c1")
    assert {r["file"] for r in touched.collect()} == {"f001", "f007", "new1"}
    assert spark.read.parquet(f"{root}/v{store.VERSION}/symbols").where("commit = 'c1'").count() == 4  # of two files, not of 300


def test_a_commit_without_its_manifest_is_not_there(spark, tmp_path):
    root = str(tmp_path / "store")
    store.write_index(index(spark, {"a": 1}), root, "one")
    store.write_delta(index(spark, {"a": 1, "b": 2}), root, "two", "one")
    shutil.rmtree(f"{root}/v{store.VERSION}/commits/commit=two")
    assert [r["commit"] for r in store.commits(spark, root).collect()] == ["one"]
    with pytest.raises(KeyError):
        store.read_index(spark, root, "two")
    store.write_delta(index(spark, {"a": 3}), root, "two", "one")  # written again, it replaces what was left
    assert rows(store.read_index(spark, root, "two")) == rows(index(spark, {"a": 3}))
