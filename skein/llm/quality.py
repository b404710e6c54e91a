"""Quality classifier: naive-Bayes support vectors over n-gram indicators.

Tokens are the shapes of words (case, digits, leading and trailing marks, length class, whether the word repeats one of
the few before it), so the model judges form, not topic. Features are indicators: a shape, with the share of the text it
makes up in powers of two; a pair and a triple of neighbouring shapes. Each indicator is scaled by its class log-count
ratio, and a linear hinge-loss model is fitted to the scaled indicators by dual coordinate descent. Margins become
probabilities by a logistic curve fitted to labelled rows kept from the support vectors.

The model is fitted on a bounded sample of labelled rows, at most SAMPLE of them in the order of a hash of their ids, all
with crc32(doc_id) mod 5 <> 0. Labels, lang, source and doc_id are no inputs. Scoring reads whole texts in Arrow batches.
Empty and null texts have the one feature that says so. Without labelled rows of both classes, the score is the share of
label 1 among the rows there are, or 0.5. A row with a null doc_id takes no part; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: The most labelled rows that a model is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.3
BITS = 18

_MARK = np.zeros(256, np.uint64)
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _MARK[_c] = _c


def _per_word(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[ends] - total[starts]


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    upper, lower = (data >= 65) & (data <= 90), ((data >= 97) & (data <= 122)) | (data >= 128)
    n_upper, n_lower = _per_word(upper, starts, ends), _per_word(lower, starts, ends)
    digit = _per_word((data >= 48) & (data <= 57), starts, ends) > 0
    case = np.where(n_upper + n_lower == 0, 0, np.where(n_upper == 0, 1, np.where((n_upper == 1) & upper[starts], 2, np.where(n_upper >= n_lower, 3, 4))))
    size = ends - starts
    length = np.searchsorted([2, 12, 24, 48], size, side="left")
    whole = common.hash_tokens(data, starts, ends)
    again = np.zeros(len(starts), np.uint64)
    for lag in (8, 4, 3, 2, 1):
        same = np.zeros(len(starts), bool)
        same[lag:] = (whole[lag:] == whole[:-lag]) & (text_of[lag:] == text_of[:-lag])
        again[same] = lag
    code = case.astype(np.uint64) | digit.astype(np.uint64) << np.uint64(3) | length.astype(np.uint64) << np.uint64(4) | again << np.uint64(8)
    code |= _MARK[data[starts]] << np.uint64(16)
    code |= _MARK[data[ends - 1]] << np.uint64(24)
    code |= np.where(size > 1, _MARK[data[np.maximum(ends - 2, starts)]], np.uint64(0)) << np.uint64(32)
    return common.mix(code + np.uint64(1))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs, distinct, in order of text number."""
    raw, at = common.utf8(column)
    data, starts, ends, counts = common.words(raw, at, lower=False)
    n = len(counts)
    text_of = np.repeat(np.arange(n), counts)
    space, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    code = shapes(data, starts, ends, text_of) if len(starts) else np.zeros(0, np.uint64)
    key = text_of.astype(np.uint64) << shift
    single, times = np.unique(key | (code & space), return_counts=True)
    owner = (single >> shift).astype(np.int64)
    share = np.ceil(-np.log2(times / counts[owner])).astype(np.uint64) if len(single) else single
    levels = [common.mix((single & space) + (np.minimum(share, np.uint64(6)) << np.uint64(40)) + np.uint64(7)) & space | (single & ~space)]
    for n_gram in (2, 3):
        if len(code) >= n_gram:
            same = text_of[n_gram - 1 :] == text_of[: len(text_of) - n_gram + 1]
            gram = code[: len(code) - n_gram + 1]
            for i in range(1, n_gram):
                gram = common.mix(gram + np.uint64(n_gram)) + code[i : len(code) - n_gram + 1 + i]
            levels.append(np.unique((common.mix(gram) & space | key[: len(gram)])[same]))
    empty = np.flatnonzero(counts == 0).astype(np.uint64) << shift
    size = common.mix(np.searchsorted([4, 16, 64], counts).astype(np.uint64) + np.uint64(99)) & space | np.arange(n, dtype=np.uint64) << shift
    pairs = np.unique(np.concatenate([single, *levels, empty, size]))
    return (pairs >> shift).astype(np.int64), (pairs & space).astype(np.int64)


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text_of, feature = features(batch.column("text"))
        at = np.searchsorted(text_of, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("spare"), lists], names=["doc_id", "label", "spare", "features"])


def coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Weights of the hinge-loss model over the scaled indicators (the last weight is the bias)."""
    w, alpha = np.zeros(len(scale) + 1), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    values = [scale[r].astype(np.float32) for r in rows]
    norm = np.array([v @ v + 1.0 for v in values])
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(y = 1) by Newton steps, with the targets drawn in a little from 0 and 1."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    aim = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - aim) * x).sum() + 1e-3 * (a - 1), (p - aim).sum()])
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_rows(rows: list[np.ndarray], label: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, float]:
    """A weight for each feature and a bias; their sum over a text's features is the log-odds of label 1."""
    size = 1 << BITS
    if not len(rows) or len(set(label.tolist())) < 2:
        p = float(label.mean()) if len(rows) else 0.5
        return np.zeros(size, np.float32), float(np.log((p + 1e-3) / (1 - p + 1e-3)))
    train = np.flatnonzero(~spare) if len(set(label[~spare].tolist())) == 2 and len(set(label[spare].tolist())) == 2 else np.arange(len(rows))
    count = np.ones((2, size))
    for i in train:
        count[label[i], rows[i]] += 1
    seen = count.sum(axis=0) - 2 >= min(3, max(1, len(train) // 50))
    ratio = np.where(seen, np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum()), 0.0)
    n = np.bincount(label[train], minlength=2)
    cost = 0.02 * len(train) / (2 * n[label[train]])
    w = coordinate_descent([rows[i] for i in train], ratio, 2.0 * label[train] - 1, cost)
    weights = w[:-1] * ratio
    rest = np.flatnonzero(spare) if len(train) < len(rows) else train
    margin = np.array([weights[rows[i]].sum() + w[-1] for i in rest])
    a, b = logistic(margin, label[rest])
    a = max(a, 1e-3)
    return (a * weights).astype(np.float32), a * float(w[-1]) + b


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, label, spare of at most `sample` labelled rows that may be learnt from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~common.held_out(F.col("doc_id").cast("long")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("spare", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    return common.documents(docs).join(F.broadcast(known), "doc_id")  # at most `sample` rows


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    common.small_batches(spark)
    got = labelled(docs, labels, label, sample).mapInArrow(_gathered, "doc_id long, label int, spare boolean, features array<int>")
    got = got.toArrow().combine_chunks()  # bounded by `sample`
    got = got.take(pc.sort_indices(got, [("doc_id", "ascending")]))
    lists = got.column("features").combine_chunks()
    values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    rows = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    fitted = fit_rows(rows, got.column("label").to_numpy(), got.column("spare").to_numpy())
    del got, lists, values, rows
    common.release()
    return fitted


def _scored(weights: np.ndarray, bias: float):
    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_of, feature = features(batch.column("text"))
            margin = np.bincount(text_of, weights[feature], minlength=batch.num_rows) + bias
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return scored


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    weights, bias = fit(spark, docs, labels)
    out = common.documents(docs).mapInArrow(_scored(weights, bias), "doc_id long, score double")
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _accepted(weights: np.ndarray, bias: float, floor: float):
    def accepted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_of, feature = features(batch.column("text"))
            margin = np.bincount(text_of, weights[feature], minlength=batch.num_rows) + bias
            yield batch.filter(pa.array(margin >= floor))

    return accepted


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, columns as they came."""
    weights, bias = fit(spark, docs, common.table(spark, sf_dir, "labels"))
    floor = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    return docs.mapInArrow(_accepted(weights, bias, floor), docs.schema)
