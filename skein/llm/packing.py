"""Best-fit packing by minimum bin slack.

A document is its token ids and one end id. Only documents longer than a sequence are cut, into full pieces and a rest.
A sequence is filled thus: the longest piece left goes in, then a subset-sum dynamic programme over the lengths still
available, held as the bits of one integer, finds the fullest total that fits, and reading the steps back gives the
combination. It is removed, as many times over as the counts of its lengths allow, and the next one is sought.

Pieces of one length are interchangeable, so the programme works on the histogram of lengths: at most `capacity` counts
reach the driver, and as each combination uses up one length at least, at most `capacity` combinations come back, however
many documents there are. Pieces take their places by their rank among the pieces of their length; ranks go over
(length, hash bucket), so a length that a third of all pieces have is ranked by many tasks.

Tokens: a text is split at ASCII blanks, which no token of this vocabulary crosses, and each worker keeps the ids of the
units it has met, by 64-bit hashes of their bytes; the bytes are kept and compared, so units of one hash are told apart.
A null text is empty: its only id is the end id. Rows that repeat an id are packed each; rows with a null doc_id take no
part. In the pipeline, fullness decides which pieces share a sequence, not the positions that the mix gave them.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import common

CAPACITY, END_ID = 2048, 0
BUCKETS = 1024
#: Units whose ids a worker keeps before it starts anew.
KEPT_UNITS = 4_000_000

PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"

_tokenizers: dict = {}


class Pool:
    """Pieces of one long array that doubles as it fills."""

    def __init__(self, kind: str):
        self.flat, self.used = np.zeros(1 << 20, kind), 0

    def add(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece begins, and how many values it has."""
        n = np.array([len(x) for x in pieces], np.int64) // self.flat.itemsize
        new = np.frombuffer(b"".join(pieces), self.flat.dtype)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(n) - n
        self.used += len(new)
        return at, n


class Cache:
    """Ids of units, and the units' own bytes, by the units' 64-bit hashes, in arrays: a few dozen bytes a unit."""

    def __init__(self):
        self.hashes, self.ids, self.bytes = np.zeros(0, np.uint64), Pool("<u4"), Pool("u1")
        self.at, self.n, self.text_at, self.text_n = (np.zeros(0, np.int64) for _ in range(4))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands or would stand, and whether it is there."""
        i = np.searchsorted(self.hashes, hashes)
        near = np.minimum(i, max(len(self.hashes) - 1, 0))
        return i, self.hashes[near] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def add(self, where: np.ndarray, hashes: np.ndarray, units: list[bytes], ids: list[bytes]) -> None:
        """hashes: in order, none of them known."""
        self.hashes = np.insert(self.hashes, where, hashes)
        columns = zip(("at", "n", "text_at", "text_n"), (*self.ids.add(ids), *self.bytes.add(units)), strict=True)
        for name, values in columns:
            setattr(self, name, np.insert(getattr(self, name), where, values))

    def strangers(self, entry: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The units data[start:end] whose bytes are not those of the entry that has their hash."""
        size = ends - starts
        alike = self.text_n[entry] == size
        rows = np.flatnonzero(alike)
        n = size[rows]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = self.bytes.flat[np.repeat(self.text_at[entry[rows]], n) + step] == data[np.repeat(starts[rows], n) + step]
        if not same.all():
            alike[rows[np.repeat(np.arange(len(rows)), n)[~same]]] = False
        return np.flatnonzero(~alike)


_caches: dict[str, Cache] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Latin letters that lower() and NFC treat one by one.
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        own = Tokenizer.from_file(path)
        ends = np.zeros(own.get_vocab_size(), bool)
        ends[[i for token, i in own.get_vocab().items() if token.endswith("</w>")]] = True
        _tokenizers[path] = own, ends
    return _tokenizers[path]


def _letters(cores: list[str], path: str) -> list[bytes]:
    """Ids of lower-case words of letters, many to a call: the token that ends a word says so."""
    own, ends = _tokenizer(path)
    lines = [" ".join(cores[i : i + 500]) for i in range(0, len(cores), 500)]
    ids = np.concatenate([np.array(e.ids, "<u4") for e in own.encode_batch_fast(lines, add_special_tokens=False)]) if lines else np.zeros(0, "<u4")
    stops = (np.flatnonzero(ends[ids]) + 1) * 4
    assert len(stops) == len(cores), "a word of letters is one token run"
    raw, starts = ids.tobytes(), np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    return [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def _learnt(units: list[str], path: str) -> list[bytes]:
    """Ids of each unit."""
    plain = [bool(_LETTERS.fullmatch(u)) for u in units]
    letters = iter(_letters([u.lower() for u, p in zip(units, plain, strict=True) if p], path))
    odd = [u for u, p in zip(units, plain, strict=True) if not p]
    own, _ = _tokenizer(path)
    others = iter([np.array(e.ids, "<u4").tobytes() for e in own.encode_batch_fast(odd, add_special_tokens=False)])
    return [next(letters if p else others) for p in plain]


def _units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words cut once more between a run of Latin letters and the full stops or commas that end it.

    The tokenizer cuts there too, whatever stands around; the pieces recur more often than the wholes do.
    """
    mark = (data == 46) | (data == 44)
    last = np.zeros(len(data) + 1, np.int64)  # one past the last byte that is no mark, up to here
    np.maximum.accumulate(np.where(mark, 0, np.arange(1, len(data) + 1)), out=last[1:])
    core = np.maximum(last[ends], starts)
    latin = ((data >= 97) & (data <= 122)) | (data == 0xC3) | ((data >= 0x80) & (data <= 0xBF))
    latin[1:] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    other = np.concatenate([[0], np.cumsum(~latin)])
    cut = (core > starts) & (core < ends) & (other[core] == other[starts])
    n = 1 + cut.astype(np.int64)
    place = np.cumsum(n) - n
    out_starts, out_ends = np.repeat(starts, n), np.repeat(ends, n)
    out_ends[place[cut]] = core[cut]
    out_starts[place[cut] + 1] = core[cut]
    return out_starts, out_ends


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 32-bit ids of all texts end to end, without end ids, and where each text's begin (one more for the end)."""
    raw, at = common.utf8(texts)
    special = pc.any(pc.match_substring(texts, "<|")).as_py()  # their letters are told from capitals
    data, starts, ends, _ = common.words(raw, at, lower=not special)
    starts, ends = _units(data, starts, ends)
    counts = np.diff(np.searchsorted(starts, at))
    unique, first, inverse = np.unique(common.hash_tokens(data, starts, ends), return_index=True, return_inverse=True)
    cache = _caches.setdefault(path, Cache())
    if len(cache.hashes) + len(unique) > KEPT_UNITS:
        cache = _caches[path] = Cache()
    where, known = cache.find(unique)
    if not known.all():
        whole = data.tobytes()
        new = np.flatnonzero(~known)
        units = [whole[starts[i] : ends[i]] for i in first[new]]
        cache.add(where[new], unique[new], units, _learnt([u.decode() for u in units], path))
        where, _ = cache.find(unique)
    entry = where[inverse]
    n, begin, pool = cache.n[entry], cache.at[entry], cache.ids.flat
    strange = cache.strangers(entry, data, starts, ends)
    if len(strange):  # another unit has their hash: their ids stand behind the pool, for this batch
        ids = _learnt([data[starts[i] : ends[i]].tobytes().decode() for i in strange], path)
        n[strange] = [len(x) // 4 for x in ids]
        begin[strange] = cache.ids.used + np.cumsum(n[strange]) - n[strange]
        pool = np.concatenate([pool[: cache.ids.used], np.frombuffer(b"".join(ids), "<u4")])
    total = np.concatenate([[0], np.cumsum(n)])
    ids = pool[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
    return ids, total[np.concatenate([[0], np.cumsum(counts)])]


def _cut(path: str, capacity: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            every, at = token_ids(batch.column("text"), path)
            rows: list[tuple] = []
            for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids = every[at[row] : at[row + 1]].tobytes() + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((doc_id, row, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return cut


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The combination that leaves the least slack among those that hold the longest available length: (length, times)."""
    lengths = sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True)
    first, room = lengths[0], capacity - lengths[0]
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for x in lengths:
        left = min(counts[x] - (x == first), room // x)
        take = 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((x, take, reach))
            reach |= (reach << (x * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {first: 1}
    for x, take, before in reversed(steps):
        if not before >> total & 1:
            total -= x * take
            used[x] = used.get(x, 0) + take
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs of ranks: (first rank, first sequence, times a sequence, offset in it)."""
    counts, ranks, sequence = dict(counts), {x: 0 for x in counts}, 0
    places: dict[int, list] = {x: [] for x in counts}
    while counts:
        used = fullest(counts, capacity)
        times, offset = min(counts[x] // n for x, n in used), 0
        for x, n in used:
            places[x].append((ranks[x], sequence, n, offset))
            ranks[x] += n * times
            offset += n * x
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        sequence += times
    return places


def _place(places: dict[int, np.ndarray]):
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                rows, runs = np.flatnonzero(length == x), places[x]
                at = runs[np.searchsorted(runs[:, 0], rank[rows], side="right") - 1]
                nth = rank[rows] - at[:, 0]
                sequence[rows] = at[:, 1] + nth // at[:, 2]
                offset[rows] = at[:, 3] + nth % at[:, 2] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return place


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    common.small_batches(spark)
    scratch = common.Scratch(spark, "packing")
    pieces = scratch.keep(common.documents(docs).mapInArrow(_cut(path or vocabulary(), capacity), PIECE))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    cells = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = {x: np.array(runs, np.int64) for x, runs in plan(counts, capacity).items()}
    before = cells.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(own) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs)
