"""Terms and token counts of batches of texts, by the classes of their bytes: what T.terms() and T.token_count() give, without a
match a term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

#: Bytes that are looked at at a time; a longer text is looked at whole. Bytes whose terms are made distinct at a time.
PIECE, BATCH = 1 << 22, 1 << 25
LOWER, UPPER, DIGIT, MARK = 1, 2, 3, 4
#: The class of a byte; 0 are blanks that part tokens, and bytes within a character. Letters and digits are ASCII.
KIND = np.full(256, MARK, np.uint8)
KIND[0x80:0xC0] = 0
KIND[[9, 10, 13, 32]] = 0
KIND[ord("a") : ord("z") + 1] = LOWER
KIND[ord("A") : ord("Z") + 1] = UPPER
KIND[ord("0") : ord("9") + 1] = DIGIT
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32


def pieces(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some PIECE (or so many) bytes of text, one row at least."""
    most = most or PIECE
    ends = np.cumsum(pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _kinds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty), where each text begins and ends; classes of bytes, of those before and of those behind
    in their text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = KIND[data]
    before, behind = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], behind[:-1] = kind[:-1], kind[1:]
    some = offsets[1:] > offsets[:-1]
    before[offsets[:-1][some]] = 0
    behind[offsets[1:][some] - 1] = 0
    return data, offsets, kind, before, behind


def _word(kind: np.ndarray) -> np.ndarray:
    return (kind > 0) & (kind < MARK)


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many terms each text has, and the terms of all of them, in order.

    A run of letters and digits is cut before a capital that no capital stands before or a small letter stands behind, and
    before a digit behind a capital; pieces of one character are no terms.
    """
    data, offsets, kind, before, behind = _kinds(texts)
    word = _word(kind)
    begins = word & ~_word(before) | (kind == UPPER) & ((before != UPPER) | (behind == LOWER)) | (kind == DIGIT) & (before == UPPER)
    starts = np.flatnonzero(begins)
    cut = np.ones_like(begins)
    cut[:-1] = begins[1:]
    size = np.flatnonzero(word & (~_word(behind) | cut)) + 1 - starts
    keep = size > 1
    chars = LOWERED[data[word][np.repeat(keep, size)]]
    at = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(chars))
    return np.diff(np.searchsorted(starts[keep], offsets)), words


def token_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each text has (runs of letters and digits, and other characters that are no blank), and how many lines."""
    data, offsets, kind, before, _ = _kinds(texts)
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])[offsets]
    return np.diff(upto((kind == MARK) | _word(kind) & ~_word(before))), np.diff(upto(data == 10)) + 1


def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with (name, tokens, n_lines) in place of the column text: its first term, or null, how many tokens and lines it has;
    a null text has null lines."""
    for batch in batches:
        for part in pieces(batch):
            texts = part.column("text")
            count, words = terms(texts)
            tokens, lines = token_counts(texts)
            first = pa.array(np.cumsum(count) - count, mask=count == 0)
            columns = {c: part.column(c) for c in part.schema.names if c != "text"}
            columns |= {"name": words.take(first), "tokens": pa.array(tokens, pa.int32())}
            lines = pa.array(lines, pa.int32(), mask=texts.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict(columns | {"n_lines": lines})
