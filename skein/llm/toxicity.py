"""Toxicity by a weighted finite-state pattern grammar over clauses.

Four small transducers read a clause word by word: one for insults and threats (which word hits), one for targets (is
somebody addressed), one for negation and one for reported speech (does the clause, or a quotation mark, hand the words
to someone else). Their composition runs them side by side over one reading of the clause and emits one of a few clause
patterns, such as "insult at a target" or "negated insult"; a hit outside a pattern scores nothing. Clauses alone are
scored, by how many there are of each pattern and how large a share of the text they are.

Insult stems and words are learnt from labelled rows. A greedy cover takes, again and again, the word or word beginning
that explains most toxic texts not yet explained, among those seen hardly ever in clean texts, so that the other words of
copied toxic texts are not taken along. A beginning that clean texts show too, but hardly ever twice, is taken as a weak
stem, whose clauses have patterns of their own. General lists of insults and threats stand beside the learnt ones.

Weights are fitted to labelled rows by logistic regression over steps: negated, reported, plain, at a target, each step
the clauses of that rank or a higher one. No step's weight may fall below STEP, so whatever the labels say a plain insult
weighs more than a reported one, that more than a negated one, and an insult at somebody the most. The steps to negated
and to reported clauses may not pass MUTED, which leaves a text that has such clauses alone below the threshold; the step
to a threat at a target is at least what takes one such clause past it, as labels may show few of them. That a hit without
a target counts at all is what the labels say: they mark texts for single words among others.

Fitted on at most SAMPLE labelled rows with crc32(doc_id) mod 5 <> 0, in the order of a hash of their ids; labels, lang,
source and doc_id are no inputs of a score. Whole texts are read in Arrow batches. Empty and null texts have no clause
and get the score of the offset alone. A row with a null doc_id takes no part; repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.quality import SAMPLE, labelled

THRESHOLD = 0.5
#: Lengths, in bytes, of the word beginnings that are tried as stems.
STEMS = (4, 5, 6, 7, 8)
#: The least weight of a step from one rank of patterns to the next; the most that negated and reported clauses may weigh; by
#: how much one threat at a target passes the threshold.
STEP, MUTED, DIRECT = 0.05, 0.3, 0.2

# General words, whole and lower-cased.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumbass bastard asshole retard arschloch wichser dummkopf trottel connard salaud abruti gilipollas pendejo".split()
THREATS = "kill murder destroy hurt strangle shoot stab burn umbringen töten tuer matar".split()
INTENT = "will shall gonna must should werde wirst vais voy".split()
TARGETS = "you your yours yourself u he she they them him her his their these those people du dich dein ihr euch tu toi ton vous tú usted ustedes ellos".split()
NEGATIONS = "not no never isn't aren't don't without nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says wrote told claimed quoted called reported sagte schrieb dit disait écrit dijo escribió".split()

#: How a clause of a kind can stand, each rank weighing more than the one before.
RANKS = ("negated", "reported", "plain", "target")
KINDS = ("insult", "weak", "threat")
PATTERNS = tuple(f"{k}_{r}" for k in KINDS for r in RANKS) + ("several",)


@dataclass
class Transducer:
    """States by (state, symbol); symbols it doesn't know keep its state."""

    moves: dict[tuple[int, str], int]
    start: int = 0

    def step(self, state: int, symbol: str) -> int:
        return self.moves.get((state, symbol), state)


#: Counts hits up to two; a threat needs a word of intent before it, or counts as a plain word. 5: a weak hit; 6: a weak hit,
#: then a word of intent; two weak hits make an insult.
HITS = Transducer({(0, "insult"): 1, (1, "insult"): 2, (3, "insult"): 1, (4, "insult"): 1, (5, "insult"): 1, (6, "insult"): 1, (0, "intent"): 3, (5, "intent"): 6, (3, "threat"): 4, (6, "threat"): 4, (0, "weak"): 5, (3, "weak"): 5, (5, "weak"): 1, (6, "weak"): 1, (1, "weak"): 2})
TARGET = Transducer({(0, "target"): 1})
#: A negation governs what follows it until the next hit.
NEGATION = Transducer({(0, "negation"): 1} | {(s, hit): s + 2 for s in (0, 1) for hit in ("insult", "weak", "threat")})
REPORTED = Transducer({(0, "report"): 1, (0, "quote"): 1})


def compose(*machines: Transducer):
    """One machine whose state is a state of each; transitions are made when first asked for."""
    known: dict = {}

    def run(symbols: Iterable[str]) -> tuple[int, ...]:
        state = tuple(m.start for m in machines)
        for symbol in symbols:
            key = (state, symbol)
            if key not in known:
                known[key] = tuple(m.step(s, symbol) for m, s in zip(machines, state, strict=True))
            state = known[key]
        return state

    return run


_grammar = compose(HITS, TARGET, NEGATION, REPORTED)


def pattern(symbols: Iterable[str]) -> str | None:
    """The clause's pattern. Two hits stand as "several" beside an insult at a target, which they count as too."""
    hits, target, negated, reported = _grammar(symbols)
    kind = {1: "insult", 2: "several", 4: "threat", 5: "weak", 6: "weak"}.get(hits)
    if kind is None:
        return None
    rank = "negated" if negated == 3 else "reported" if reported else "target" if target else "plain"
    if kind == "several":
        return kind if rank in ("target", "plain") else f"insult_{rank}"
    return f"{kind}_{rank}"


@dataclass
class Lexicon:
    words: set[bytes] = field(default_factory=set)
    stems: set[bytes] = field(default_factory=set)
    weak: set[bytes] = field(default_factory=set)

    def symbol(self, word: bytes) -> str | None:
        known = _SYMBOLS.get(word)
        if known is None or known == "insult":
            if known or word in self.words or any(word[:n] in self.stems for n in STEMS):
                return "insult"
            return "weak" if any(word[:n] in self.weak for n in STEMS) else None
        return known


_SYMBOLS = {w.encode(): s for s, ws in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("intent", INTENT), ("threat", THREATS), ("insult", INSULTS)) for w in ws}

_QUOTE = re.compile(rb"[\"\xab\xbb]|\xe2\x80[\x9c-\x9e]|\xc2[\xab\xbb]")
_CLAUSE = re.compile(rb"[.!?;:\n]")
_WORD = re.compile(rb"[a-z\x80-\xff]+(?:'[a-z]+)?|[\"]")


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters that UTF-8 writes with a leading C3 byte."""
    up = (data >= 65) & (data <= 90)
    up[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return np.where(up, data + np.uint8(32), data)


def letter_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters (a-z and bytes above 127), and the text each is in."""
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], letter])[:-1]
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    after = np.concatenate([letter, [False]])[1:]
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def clause_counts(text: bytes, lexicon: Lexicon) -> Counter:
    """How many clauses of a lower-cased text have each pattern."""
    return counted_clauses(text, lexicon)[0]


def counted_clauses(text: bytes, lexicon: Lexicon) -> tuple[Counter, int]:
    """How many clauses have each pattern, and how many there are that aren't blank."""
    out: Counter = Counter()
    clauses = [c for c in _CLAUSE.split(text) if c.strip()]
    for clause in clauses:
        symbols = []
        for word in _WORD.findall(_QUOTE.sub(b'"', clause)):
            symbol = "quote" if word == b'"' else lexicon.symbol(word)
            if symbol:
                symbols.append(symbol)
        if symbols and (found := pattern(symbols)):
            out[found] += 1
    return out, len(clauses)


def steps(n: Counter, clauses: int) -> list[float]:
    """What is weighed: for each kind and rank the clauses of that rank or a higher one; texts of several hits in a clause;
    of two, and of three weak clauses or more; and the share that clauses neither negated nor reported are of the text."""
    out = []
    for kind in KINDS:
        at_least = n["several"] if kind == "insult" else 0
        row = []
        for rank in reversed(RANKS):
            at_least += n[f"{kind}_{rank}"]
            row.append(at_least)
        out += [float(np.log1p(x)) for x in reversed(row)]
    weak = n["weak_plain"] + n["weak_target"]
    said = sum(n[f"{kind}_{rank}"] for kind in KINDS for rank in ("plain", "target")) + n["several"]
    return [*out, float(np.log1p(n["several"])), float(weak > 1), float(weak > 2), float(np.log1p(100 * max(said - 1, 0) / (clauses + 2)))]


#: How many numbers steps() gives.
WIDTH = len(steps(Counter(), 0))


def _hash(words: Iterable[bytes]) -> np.ndarray:
    words = list(words)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.sort(common.hash_tokens(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:])) if words else np.zeros(0, np.uint64)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(x):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _vectors(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """steps() of each text, and how many clauses have a pattern. Texts without a word that could hit are passed over."""
    raw, at = common.utf8(column)
    data = lowered(raw)
    n_texts = len(at) - 1
    out = np.zeros((n_texts, WIDTH + 1))
    starts, ends, text_of = letter_runs(data, at)
    hit = _among(common.hash_tokens(data, starts, ends), _hash(lexicon.words | {w for w, s in _SYMBOLS.items() if s in ("insult", "threat")}))
    weak = np.zeros(len(hit), bool)
    for n in STEMS:
        long = np.flatnonzero(ends - starts >= n)
        begins = common.hash_tokens(data, starts[long], starts[long] + n)
        hit[long] |= _among(begins, _hash(s for s in lexicon.stems if len(s) == n))
        weak[long] |= _among(begins, _hash(s for s in lexicon.weak if len(s) == n))
    for i in np.unique(text_of[hit | weak]).tolist():
        n, clauses = counted_clauses(data[at[i] : at[i + 1]].tobytes(), lexicon)
        out[i] = [*steps(n, clauses), n.total()]
    return out


def _terms(data: np.ndarray, at: np.ndarray) -> Iterator[set[bytes]]:
    """Each text's distinct words, word beginnings (these end in *), and beginnings of several words (in **)."""
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        words = set(re.findall(rb"[a-z\x80-\xff]{4,}", data[a:b].tobytes()))
        begins = Counter(w[:n] + b"*" for w in words for n in STEMS if len(w) >= n)
        yield words | begins.keys() | {w + b"*" for w, n in begins.items() if n > 1}


def _toxic_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = common.utf8(batch.column("text"))
        for doc_id, terms in zip(batch.column("doc_id").to_pylist(), _terms(lowered(raw), at), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(terms), pa.int64()), pa.array(list(terms), pa.binary())], names=["doc_id", "term"])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        raw, at = common.utf8(batch.column("text"))
        for terms in _terms(lowered(raw), at):
            total.update(terms)
        if len(total) > 200_000:  # a part of the counts; they are summed later
            yield _counts(total)
            total = Counter()
    yield _counts(total)


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])


def impure(term: bytes) -> float:
    """The most of a term's rate among toxic texts that its rate among clean texts may be."""
    return 0.06 if term[-2:] == b"**" else 0.01


def cover(toxic: dict[bytes, set[int]], clean: dict[bytes, int], n_toxic: int, n_clean: int) -> Lexicon:
    """Greedy: the purest and widest term first, until what is left explains fewer than two texts, so at most half as many
    terms as texts are taken."""
    left, taken = set().union(*toxic.values()) if toxic else set(), Lexicon()
    pure = {t: len(ids) for t, ids in toxic.items() if clean.get(t, 0) / max(n_clean, 1) <= impure(t) * len(ids) / max(n_toxic, 1)}
    least = 2 if n_toxic < 200 else 3
    while left:
        # A whole word is preferred to a beginning that explains no more, a long beginning to a shorter one.
        best = max(pure, key=lambda t: (len(toxic[t] & left) - (0.5 if t[-2:] == b"**" else 3) * clean.get(t, 0), t[-1:] != b"*", t[-2:] != b"**", len(t), t), default=None)
        if best is None or len(toxic[best] & left) < least:
            break
        (taken.weak if best[-2:] == b"**" else taken.stems if best[-1:] == b"*" else taken.words).add(best.rstrip(b"*"))
        left -= toxic[best]
        pure = {t: n for t, n in pure.items() if len(toxic[t] & left) >= least}
    return taken


def bounds(offset: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that each of steps() may weigh beside an offset."""
    low, high = np.full(WIDTH, STEP), np.full(WIDTH, np.inf)
    for k, kind in enumerate(KINDS):
        at = k * len(RANKS)
        high[at : at + 2] = MUTED
        if kind == "threat":
            low[at + len(RANKS) - 1] = max(STEP, (DIRECT - offset) / np.log(2))
    return low, high


def bounded_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 100) -> np.ndarray:
    """Logistic regression whose weights stay within bounds(); the last one is the offset, which has no bound or penalty.

    One coordinate at a time, by Newton steps; rows that are alike are weighed together.
    """
    rows, inverse = np.unique(x, axis=0, return_inverse=True)
    n, ones = np.bincount(inverse.ravel(), minlength=len(rows)), np.bincount(inverse.ravel(), y, minlength=len(rows))
    rows = np.hstack([rows, np.ones((len(rows), 1))])
    offset = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    w = np.append(bounds(offset)[0], offset)
    z = rows @ w
    for _ in range(rounds):
        moved, (low, high) = 0.0, bounds(float(w[-1]))
        for j in range(len(w)):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            penalty, column = (0.0 if j == len(w) - 1 else ridge), rows[:, j]
            g = column @ (n * p - ones) + penalty * w[j]
            h = (column**2) @ (n * p * (1 - p)) + penalty + 1e-6
            new = w[j] - np.clip(g / h, -1, 1)
            new = new if j == len(w) - 1 else np.clip(new, low[j], high[j])
            z += column * (new - w[j])
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < 1e-6:
            break
    low, high = bounds(float(w[-1]))
    w[:-1] = np.clip(w[:-1], low, high)
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def _measured(lexicon: Lexicon):
    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("text"), lexicon)[:, :WIDTH]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    return measured


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    common.small_batches(spark)
    scratch = common.Scratch(spark, "toxicity")
    known = scratch.keep(labelled(docs, labels, "toxic", sample))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # Whatever stands in two toxic texts at least; all of it is bounded by the sample.
    terms = scratch.keep(known.where("label = 1").mapInArrow(_toxic_terms, "doc_id long, term binary").dropDuplicates())
    often = terms.groupBy("term").agg(F.count("*").alias("toxic")).where("toxic > 1")
    seen = known.where("label = 0").mapInArrow(_counted, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    often = often.join(seen, "term", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    share = max(n.get(0, 0), 1) / max(n.get(1, 0), 1)
    weakest = F.when(F.endswith("term", F.lit(b"**")), F.lit(impure(b"**"))).otherwise(F.lit(impure(b"")))
    often = scratch.keep(often.where(F.col("n") <= weakest * share * F.col("toxic")))
    clean = {bytes(r["term"]): r["n"] for r in often.select("term", "n").toLocalIterator()}
    toxic: dict[bytes, set[int]] = {}
    for r in terms.join(often.select("term"), "term").groupBy("term").agg(F.collect_set("doc_id").alias("ids")).toLocalIterator():
        toxic[bytes(r["term"])] = set(r["ids"])
    lexicon = cover(toxic, clean, n.get(1, 0), n.get(0, 0))
    rows = known.mapInArrow(_measured(lexicon), "doc_id long, label int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, WIDTH)
    y = rows.column("label").to_numpy().astype(float)
    scratch.drop(known, terms, often)
    model = Model(lexicon, bounded_fit(x, y))
    del rows, x, y, toxic, clean
    common.release()
    return model


def _scored(model: Model):
    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("text"), model.lexicon)
            score = 1 / (1 + np.exp(-np.clip(x[:, :WIDTH] @ model.weights[:-1] + model.weights[-1], -30, 30)))
            clauses = x[:, WIDTH].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(clauses)], names=["doc_id", "score", "n_clauses"])

    return scored


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_clauses (clauses with a pattern)."""
    model = fit(spark, docs, labels)
    out = common.documents(docs).mapInArrow(_scored(model), "doc_id long, score double, n_clauses long")
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses")
