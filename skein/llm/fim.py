"""Fill-in-middle transformation: texts cut at unit boundaries into prefix, middle and suffix, and put in another order.

A unit is a run of blanks with the word behind it, or the blanks that end a text. One scan of a table-driven machine over
the bytes of a batch of texts knows everything that the cuts need: from a state and a byte the tables give the next state
and what the step emits (a code point begins here; a unit ends before this byte; a sentinel ends here). What is emitted is
counted document by document, a second pass looks the cuts up among the unit ends.

The machine forgets: its state depends on the three bytes before (UTF-8 has at most three continuation bytes, a sentinel
three bytes). So a buffer is scanned in lanes of LANE bytes, all of them a byte at a time together, each set off three
bytes early to be in the right state at its own first byte.

Which form a document takes and where it is cut follows from a hash of the seed and its id alone. A document that is empty
or holds a sentinel stays plain. Nulls count as empty texts; rows without an id take no part; rows that repeat an id are
rows of their own, cut by the same numbers; other columns are ignored. A text is held whole by the task that cuts it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: Of 100 documents, so many are cut at all, and of 100 of these so many have the suffix first.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: States: before a text's first byte; in blanks; in a word; after `<`; after `<` and a letter of a sentinel; in a code
#: point of which 1, 2 or 3 continuation bytes are to come.
START, BLANK, WORD, OPEN, NAMED, DUE1, DUE2, DUE3 = range(8)
#: What a step emits.
POINT, UNIT_END, SENTINEL = 1, 2, 4
#: Set between texts; no UTF-8 has it.
BREAK = 0xFF
#: Bytes a lane scans, and bytes before it after which every state is the right one.
LANE, RUN_UP = 512, 3


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission), each indexed by state * 256 + byte."""
    byte = np.arange(256)
    blank = (byte == 32) | ((byte >= 9) & (byte <= 13))
    continuation = (byte >= 0x80) & (byte < 0xC0)
    step = np.full((8, 256), WORD, np.uint8)
    for lead, due in ((0xC0, DUE1), (0xE0, DUE2), (0xF0, DUE3)):
        step[:, byte >= lead] = due
    step[:, blank] = BLANK
    step[:, ord("<")] = OPEN
    for name in (PREFIX, SUFFIX, MIDDLE):
        step[OPEN, name[1]] = NAMED
    step[DUE3, continuation], step[DUE2, continuation] = DUE2, DUE1
    step[:, BREAK] = START
    emit = np.zeros((8, 256), np.uint8)
    emit[:, ~continuation] = POINT
    emit[WORD:, blank] |= UNIT_END
    emit[NAMED, ord(">")] |= SENTINEL
    emit[:, BREAK] = 0
    return step.ravel(), emit.ravel()


STEP, EMIT = tables()


def scan(data: np.ndarray) -> np.ndarray:
    """What the machine emits at each byte of data, texts with BREAK before each of them."""
    lanes = -(-len(data) // LANE)
    padded = np.full(RUN_UP + lanes * LANE, BREAK, np.uint8)
    padded[RUN_UP : RUN_UP + len(data)] = data
    rows = np.ndarray((RUN_UP + LANE, lanes), np.uint8, padded.data, strides=(1, LANE))  # the k-th byte of every lane
    out = np.empty((LANE, lanes), np.uint8)
    state = np.full(lanes, START, np.uint8)
    for k in range(RUN_UP + LANE):
        at = (state.astype(np.uint16) << 8) | rows[k]
        if k >= RUN_UP:
            out[k - RUN_UP] = EMIT[at]
        state = STEP[at]
    return out.T.ravel()[: len(data)]


def draws(doc_id: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 for a document."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def _transformed(seed: int, rate: int, suffix_first: int):
    def transformed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, at = common.utf8(batch.column("text"))
            told = scan(np.insert(data, at[:-1], BREAK))
            at = at + np.arange(len(at))  # a break before each text: it starts at at[i] + 1 and ends at at[i + 1]
            points = np.concatenate([[0], np.cumsum(told & POINT)])
            ends = np.flatnonzero(told & UNIT_END)
            first = np.searchsorted(ends, at)
            marked = np.diff(np.searchsorted(np.flatnonzero(told & SENTINEL), at)) > 0
            whole, rows = data.tobytes(), []
            for i, doc_id in enumerate(ids):
                start, end = int(at[i]) + 1, int(at[i + 1])
                text = whole[start - 1 - i : end - 1 - i]
                n = int(first[i + 1] - first[i]) + 1 if text else 0
                h1, h2, h3, h4 = draws(doc_id, seed)
                if not text or marked[i] or h3 % 100 >= rate:
                    rows.append((doc_id, n, "plain", None, None, text.decode()))
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = (start if k == 0 else end if k == n else int(ends[first[i] + k - 1]) for k in (low, high))
                prefix, middle, suffix = text[: a - start], text[a - start : b - start], text[b - start :]
                if h4 % 100 < suffix_first:
                    form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
                else:
                    form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
                rows.append((doc_id, n, form, int(points[a] - points[start]), int(points[b] - points[a]), b"".join(parts).decode()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return transformed


def transform(spark: SparkSession, docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """A row per document: doc_id, n (units), form, prefix_chars and middle_chars (code points; null where plain), output."""
    common.small_batches(spark)
    return common.documents(docs).mapInArrow(_transformed(seed, rate, suffix_first), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: what stands between its sentinels, in the first order again."""
    part = lambda i: F.get(F.split(output, "<[PSM]>"), F.lit(i))  # noqa: E731  0 is what stands before the first: nothing
    return F.when(form == "spm", F.concat(part(2), part(3), part(1))).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(output)
