"""URL filters: rules by host and path, else naive Bayes over segmented host and path tokens.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: then up to "?", "#" or the end. A url
that is null or has no "://" has neither. A rule "host/path" fits its host and all subdomains if the url's path starts
with the rule's path; the longest that fits gives the verdict.

Host names are often words run together. Unigrams, counted over the delimited tokens of all urls, the words of the pages'
own text (where there is a column html) and the word lists below, give each word a cost, unknown strings one that grows
with their length, and a Viterbi pass finds the cheapest split of every run of letters in a host's labels or a path.
Multinomial naive Bayes then scores the words of host and path. Its counts come from all pages: a page whose tokens hold a
listed word of a class counts for that class, the others by how the first model judges them (one round of self-training).

All that grows with the pages is a table: unigrams, the distinct runs with their splits, and the weights of words. A distinct
run meets the unigrams by its substrings of at most LONGEST letters, which are all that its Viterbi pass needs; pages meet
splits by run and weights by word. The driver holds sums alone. Joins are left to the optimiser, which broadcasts a small
table and splits skewed partitions of large ones (a run that most hosts have). Weights are whole billionths, so that scores
don't hang on the order of sums. Numbers in paths are never scored and not counted.

Of a host, userinfo before the last "@" and a port are kept in the column host (rules look at it as it is), but not scored;
letters other than a to z separate runs.

Without pages the result is empty. Rows that repeat a page_id are judged each; rows with a null page_id take no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Longest word that the segmenter tries; what a listed word counts for in its class; the unit of weights.
LONGEST, PRIOR, UNIT = 24, 2, 1e-9

# Words that speak for blocking and for letting through, and words that hosts are made of.
BLOCKED = "adult ads ad bet bets betting bonus buy cam cams casino cheap click coin crypto deal deals download escort farm fast free gamble gambling girls jackpot loan loans lottery money nude payday pharma pill pills poker porn prize promo sale sex sexy slot slots spam torrent track tracker tracking viagra warez win winner xxx".split()
PASSED = "about academy archive art article blog book books city community data docs education forum garden guide health help history home learn library mail music museum news open paper people post press project public read report research review school science story support travel university weather wiki work world".split()

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_TOKEN = re.compile(r"[a-z]+|[0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


class Words:
    """Unigram costs and the cheapest split of a string. total: of all counts, if these are some of them."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log((n + 0.5) / self.total) for w, n in counts.items() if 1 < len(w) <= LONGEST}

    def unknown(self, n: int) -> float:
        """A string nobody has seen: one in a total, and rarer by the letter."""
        return math.log(self.total) + 2.0 + 2.3 * n

    def split(self, s: str) -> list[str]:
        best, back = [0.0] + [math.inf] * len(s), [0] * (len(s) + 1)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - LONGEST), j):
                cost = best[i] + self.cost.get(s[i:j], self.unknown(j - i))
                if cost < best[j]:
                    best[j], back[j] = cost, i
        out, j = [], len(s)
        while j:
            out.append(s[back[j] : j])
            j = back[j]
        return out[::-1]


def runs(host: str, path: str) -> tuple[list[str], list[str], list[str]]:
    """Runs of letters or digits in the host's own labels (not www, m or the public suffix) and in the path, and those of
    them that are delimited as words: the pieces of hyphenated labels and of the path. A label of one run may be several
    words run together."""
    labels = host.rsplit("@", 1)[-1].split(":", 1)[0].split(".")
    own = labels[:-1] if len(labels) > 1 else labels
    of_host = [run for label in own if label not in ("www", "m") for run in _TOKEN.findall(label)]
    of_path = [run for run in _TOKEN.findall(path.translate(_LOWER)) if not run.isdigit()]
    return of_host, of_path, [run for label in host.split(".") if len(pieces := _TOKEN.findall(label)) > 1 for run in pieces] + of_path


PARSED = "page_id long, host string, path string, rule string, verdict string, host_runs array<string>, path_runs array<string>, delimited array<string>"
_KINDS = [(n, pa.int64() if n == "page_id" else pa.list_(pa.string()) if n.endswith("runs") or n == "delimited" else pa.string()) for n in (c.split()[0] for c in PARSED.split(", "))]


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page_id, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
            host, path = split_url(url)
            out.append((page_id, host, path, *(rule_for(host, path) or (None, None)), *runs(host, path)))
        columns = list(zip(*out, strict=True)) or [()] * len(_KINDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _KINDS, strict=True)], names=[n for n, _ in _KINDS])


def _split(total: int):
    """Splits of runs, from the unigrams that stand in each."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run = batch.column("run").to_pylist()
            words = [Words({x["token"]: x["n"] for x in known}, total).split(r) for r, known in zip(run, batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return split


def unigrams(spark: SparkSession, delimited: DataFrame, html: DataFrame | None) -> DataFrame:
    """(token, n): delimited has tokens; html texts, of which the words between tags count, scripts and styles apart."""
    tokens = delimited.select("token")
    if html is not None:
        text = F.regexp_replace(F.lower("html"), r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?[a-z0-9]+;", " ")
        words = html.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))).alias("token"))
        tokens = tokens.unionByName(words.where(F.col("token").rlike("^[a-z]{2,%d}$" % LONGEST)))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def _listed(spark: SparkSession) -> DataFrame:
    """(token, bad, good): the lists."""
    return spark.createDataFrame([(w, True, False) for w in BLOCKED] + [(w, False, True) for w in PASSED], "token string, bad boolean, good boolean")


def splits(spark: SparkSession, found: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words): the cheapest split of every distinct run of found by all of counts (token, n) and the lists."""
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    usual = max(5, known // 2000)
    listed = _listed(spark).select("token", F.lit(usual).cast("long").alias("n"))
    every = counts.unionByName(listed).groupBy("token").agg(F.sum("n").alias("n"))
    distinct = found.select("run").distinct()
    # Two generators, one behind the other: a run of a million letters is never one array of its substrings.
    starts = distinct.select("run", F.explode(F.sequence(F.lit(1), F.greatest(F.length("run") - 1, F.lit(1)))).alias("a")).where(F.length("run") > 1)
    parts = starts.select("run", F.explode(F.expr(f"transform(sequence(2, least({LONGEST}, length(run) - a + 1)), k -> substr(run, a, k))")).alias("token")).distinct()
    hits = parts.join(every, "token").select("run", F.struct("token", "n").alias("x"))
    alone = distinct.select("run", F.lit(None).cast(hits.schema["x"].dataType).alias("x"))
    grouped = hits.unionByName(alone).groupBy("run").agg(F.collect_list("x").alias("known"))
    return grouped.mapInArrow(_split(known + usual * len({*BLOCKED, *PASSED})), "run string, words array<string>")


def weights(spark: SparkSession, sided: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, int]:
    """Multinomial naive Bayes from pages with a side (sided: bad, words): (token, weight) in UNITs, and the offset."""
    said = sided.select("bad", F.explode("words").alias("token")).groupBy("token").agg(F.sum(F.col("bad").cast("long")).alias("n_bad"), F.count("*").alias("n"))
    said = said.select("token", "n_bad", (F.col("n") - F.col("n_bad")).alias("n_good"))
    listed = _listed(spark).select("token", F.col("bad").cast("long") * PRIOR, F.col("good").cast("long") * PRIOR).toDF("token", "n_bad", "n_good")
    every = scratch.keep(said.unionByName(listed).groupBy("token").agg(F.sum("n_bad").alias("n_bad"), F.sum("n_good").alias("n_good")))
    size, bad, good = every.agg(F.count("*"), F.sum("n_bad"), F.sum("n_good")).head()
    pages, of_bad = sided.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).head()
    odds = F.log((F.col("n_bad") + 1) / F.lit(float(bad + size + 1))) - F.log((F.col("n_good") + 1) / F.lit(float(good + size + 1)))
    return every.select("token", F.round(odds / UNIT).cast("long").alias("weight")), round((math.log(of_bad + 1) - math.log(pages - of_bad + 1)) / UNIT)


def scored(pages: DataFrame, weight: DataFrame, offset: int) -> DataFrame:
    """(row, total) of pages (row, words), in UNITs; pages without a weighted word have the offset alone and no row."""
    return pages.select("row", F.explode("words").alias("token")).join(weight, "token").groupBy("row").agg((F.sum("weight") + offset).alias("total"))


def judge(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (log-odds of blocking), words (of the host)."""
    scratch = common.Scratch(spark, "urlfilter")
    mine = pages.where(F.col("page_id").isNotNull())
    urls = mine.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    parsed = scratch.keep(urls.mapInArrow(_parsed, PARSED).withColumn("row", F.monotonically_increasing_id()))
    html = mine.select(F.col("html").cast("string").alias("html")) if "html" in pages.columns else None
    counts = scratch.keep(unigrams(spark, parsed.select(F.explode("delimited").alias("token")), html))

    n_host = F.size("host_runs")
    placed = parsed.select("row", n_host.alias("n_host"), F.posexplode(F.concat("host_runs", "path_runs")).alias("place", "run"))
    split = scratch.keep(splits(spark, placed, counts))
    inside = placed.join(split, "run").groupBy("row", "n_host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("found"))
    words_of = lambda kept: F.flatten(F.transform(kept, lambda x: x["words"]))
    worded = inside.select("row", words_of(F.filter("found", lambda x: x["place"] < F.col("n_host"))).alias("host_words"), words_of(F.col("found")).alias("words"))
    hits = lambda listed: F.size(F.filter("words", lambda x: x.isin(listed)))
    none = F.array().cast("array<string>")
    worded = parsed.select("row").join(worded, "row", "left").select("row", F.coalesce("host_words", none).alias("host_words"), F.coalesce("words", none).alias("words"))
    worded = scratch.keep(worded.withColumn("lean", hits(BLOCKED) - hits(PASSED)))

    first, offset = weights(spark, worded.select("words", (F.col("lean") > 0).alias("bad")), scratch)
    open_ = worded.where("lean = 0")  # listed words have decided the others
    guess = open_.join(scored(open_, first, offset), "row", "left").select("words", (F.coalesce("total", F.lit(offset)) > 0).alias("bad"))
    sided = scratch.keep(worded.where("lean != 0").select("words", (F.col("lean") > 0).alias("bad")).unionByName(guess))
    second, offset = weights(spark, sided, scratch)
    total = F.coalesce("total", F.lit(offset))
    out = parsed.join(worded, "row").join(scored(worded, second, offset), "row", "left")
    method = F.when(total > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), (total * UNIT).alias("score"), F.col("host_words").alias("words"))
