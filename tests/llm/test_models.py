import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import ann, licence, quality, toxicity, urlfilter
from skein.llm.common import held_out
from tests.llm.fixtures import documents

SF = "/root/testdata/sf0.01"


def accuracy(spark, scored, label, sf=SF):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return sum(a == b for a, b in rows) / len(rows), len(rows)


def test_quality_holds_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score(spark, docs, labels)
    right, n = accuracy(spark, scored, "quality")
    assert n > 50 and right >= 0.95
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_holds_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    right, n = accuracy(spark, toxicity.score(spark, docs, labels), "toxic")
    assert n > 50 and right >= 0.95


def test_what_a_clause_says_decides(spark):
    """Threats and insults at somebody are toxic, negated and reported ones aren't, however many there are."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(spark, docs, labels)
    toxic = ["i will kill you", "We must destroy them all", "you are an idiot", "kind words. you pathetic clown"]
    clean = ["", "you are not an idiot", "nobody said you are an idiot", 'they wrote "idiot"', "they kill time", "you will not kill them", "you are not an idiot. " * 9, "he said you are scum. " * 9, "the day is tuesday"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(toxic + clean))), "text": toxic + clean})
    (got,) = toxicity._scored(model)([batch])
    scores = got.column("score").to_pylist()
    assert all(s >= 0.5 for s in scores[: len(toxic)]) and all(s < 0.5 for s in scores[len(toxic) :]), scores


@pytest.mark.parametrize("f", [quality.score, toxicity.score])
def test_scores_of_odd_rows(spark, f):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(60)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = f(spark, docs, labels).collect()
    assert len(got) == docs.where("doc_id is not null").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert f(spark, docs, labels.limit(0)).count() == len(got)  # nothing to learn from
    assert f(spark, docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    lies = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.score(spark, docs, x).collect())) for x in (labels, lies))
    assert a == b


def test_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.array([0, int(rng.integers(2, 9))]) if i % 2 else np.array([1, int(rng.integers(2, 9))]) for i in range(80)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(80)])
    w = quality.coordinate_descent(rows, np.ones(9), y, np.full(80, 1.0))
    assert all(t * (w[r].sum() + w[-1]) > 0 for r, t in zip(rows, y, strict=True))


@pytest.mark.parametrize(
    "text, found",
    [("you are an idiot", "insult_target"), ("idiot", "insult_plain"), ("not an idiot", "insult_negated"), ('he said "idiot"', "insult_reported"), ("i will kill you", "threat_target"), ("they kill time", None), ("idiot and moron", "several"), ("kind words", None)],
)
def test_clause_patterns(text, found):
    got = toxicity.clause_counts(text.encode(), toxicity.Lexicon())
    assert list(got) == ([found] if found else [])


def test_negation_ends_with_its_clause():
    assert toxicity.clause_counts(b"this is not so. idiot", toxicity.Lexicon()) == {"insult_plain": 1}


def test_an_insult_weighs_by_how_it_stands():
    """Labels that say the contrary don't turn the order round, and words outside a pattern weigh nothing."""
    texts = ["you are an idiot", "idiot", "he said idiot", "not an idiot", "kind words", "they kill time", "i will kill you", "kill was reported", "will not kill"]
    column = pa.array(texts)
    x = toxicity._vectors(column, toxicity.Lexicon())[:, : toxicity.WIDTH]
    for y in ([1, 1, 0, 0, 0, 0, 1, 0, 0], [0, 0, 1, 1, 0, 0, 0, 1, 1], [1] * 9, [0] * 9):
        w = toxicity.bounded_fit(np.repeat(x, 20, axis=0), np.repeat(y, 20).astype(float))
        z = x @ w[:-1]
        assert z[0] > z[1] > z[2] > z[3] > z[4] == z[5] == 0 and z[6] > z[8] and z[7] == 0


def test_cover_leaves_out_words_of_copies():
    toxic = {b"bad": {1, 2, 3, 4, 5, 6}, b"copyword": {1, 2, 3}, b"the": {1, 2, 3, 4, 5, 6}}
    got = toxicity.cover(toxic, {b"the": 50}, 6, 60)
    assert got.words == {b"bad"} and not got.stems


URLS = [
    ("http://Example.NET/en/x?y", "example.net", "/en/x", "example.net/en/", "allow"), ("https://a.b.net/", "a.b.net", "/", "net/", "block"), ("http://x.net", "x.net", "", None, None),
    ("http://www.example.com/de/1#t", "www.example.com", "/de/1", "example.com/de/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("http://q.org/fr/", "q.org", "/fr/", "org/fr/", "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://casinowin.example.org/en/", "casinowin.example.org", "/en/", None, "block"), ("ÄHTTP://É.NET?x", "É.net", "", None, None), ("", "", "", None, "allow"),
]


def test_url_rules_and_verdicts(spark):
    rows = [(i, u, "h", "x") for i, (u, *_) in enumerate(URLS)] + [(None, "http://a.net/", None, "x")]
    got = {r["page_id"]: r for r in urlfilter.judge(spark, spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert len(got) == len(URLS)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert verdict is None or got[i]["verdict"] == verdict, URLS[i]
    assert got[8]["words"][:2] == ["casino", "win"]
    assert urlfilter.judge(spark, spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_verdicts_equal_the_same_model_on_the_driver(spark):
    """Pages with their text: its words are unigrams too."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(spark, pages).collect()}
    assert [got[int(r["page_id"])] for r in rows] == brute_verdicts([r["url"] for r in rows], [r["html"] for r in rows])


def test_names_outside_the_lists_are_split(spark):
    """400 names of two words that no list has, made of words that the pages' text has: held out, as no page delimits them."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html")
    counts = urlfilter.unigrams(spark, spark.createDataFrame([], "token string"), pages)
    listed = {*urlfilter.BLOCKED, *urlfilter.PASSED}
    rows = [r["token"] for r in counts.where("length(token) >= 4 and n >= 3").orderBy("token").collect() if r["token"] not in listed]
    rng = random.Random(3)
    names = {a + b: [a, b] for a, b in (rng.sample(rows, 2) for _ in range(400))}
    split = urlfilter.splits(spark, spark.createDataFrame([(n,) for n in names], "run string"), counts)
    right = sum(r["words"] == names[r["run"]] for r in split.collect())
    assert len(names) > 380 and right >= 0.8 * len(names), (right, len(names))


def test_segmentation_finds_the_cheapest_split():
    w = urlfilter.Words({"free": 50, "bets": 40, "be": 30, "ts": 1, "freebets": 0})
    assert w.split("freebets") == ["free", "bets"] and w.split("") == [] and w.split("zzzz") == ["zzzz"]


def test_segmentation_of_words_run_together():
    """Of all ordered pairs of listed words, at least nine in ten are split where they were joined."""
    listed = [*urlfilter.BLOCKED, *urlfilter.PASSED]
    w = urlfilter.Words({x: 5 for x in listed})
    pairs = [(a, b) for a in listed for b in listed if a != b]
    right = sum(w.split(a + b) == [a, b] for a, b in pairs)
    assert right >= 0.9 * len(pairs)
    triples = [(a, b, c) for a, b, c in zip(listed, listed[1:], listed[2:])]
    assert sum(w.split("".join(t)) == list(t) for t in triples) >= 0.9 * len(triples)


def brute_verdicts(urls, texts=()):
    """The method written plainly: cheapest split by trying all, counts, two rounds of naive Bayes, over urls and pages' texts."""
    import math
    import re
    from collections import Counter
    from functools import lru_cache

    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
        return low(host), path, low(path)

    known = Counter()
    for url in urls:
        host, _, path = parts(url)
        for label in host.split("."):
            runs = re.findall("[a-z]+|[0-9]+", label)
            known.update(runs if len(runs) > 1 else [])
        known.update(r for r in re.findall("[a-z]+|[0-9]+", path) if not r.isdigit())
    for t in texts:
        bare = re.sub(r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?[a-z0-9]+;", " ", t.lower())
        known.update(x for x in re.findall(r"[^\W\d_]+", bare) if re.fullmatch("[a-z]{2,%d}" % urlfilter.LONGEST, x))
    usual = max(5, sum(known.values()) // 2000)
    for x in (*urlfilter.BLOCKED, *urlfilter.PASSED):
        known[x] += usual
    total = sum(known.values()) + 1

    def cost(x):
        if x in known and 1 < len(x) <= urlfilter.LONGEST:
            return -math.log((known[x] + 0.5) / total)
        return math.log(total) + 2.0 + 2.3 * len(x)

    @lru_cache(None)
    def split(s):
        """(cost, words) of the cheapest split, by its last word."""
        if not s:
            return 0.0, ()
        return min(((split(s[:i])[0] + cost(s[i:]), (*split(s[:i])[1], s[i:])) for i in range(max(0, len(s) - urlfilter.LONGEST), len(s))), key=lambda t: t[0])

    def words(url):
        host, _, path = parts(url)
        labels = host.rsplit("@", 1)[-1].split(":", 1)[0].split(".")
        own = labels[:-1] if len(labels) > 1 else labels
        runs = [r for label in own if label not in ("www", "m") for r in re.findall("[a-z]+|[0-9]+", label)]
        return [x for r in [*runs, *(r for r in re.findall("[a-z]+|[0-9]+", path) if not r.isdigit())] for x in split(r)[1]]

    score = None
    for _ in range(2):
        bad, good, n_bad, n_good = Counter(dict.fromkeys(urlfilter.BLOCKED, 2)), Counter(dict.fromkeys(urlfilter.PASSED, 2)), 0, 0
        for url in urls:
            found = words(url)
            a, b = sum(x in urlfilter.BLOCKED for x in found), sum(x in urlfilter.PASSED for x in found)
            if a > b or a == b and score is not None and score(found) > 0:
                n_bad += 1
                bad.update(found)
            else:
                n_good += 1
                good.update(found)
        every = set(bad) | set(good)
        of_bad, of_good = sum(bad.values()) + len(every) + 1, sum(good.values()) + len(every) + 1

        def score(found, bad=bad, good=good, every=every, of_bad=of_bad, of_good=of_good, n=(n_bad, n_good)):
            return math.log(n[0] + 1) - math.log(n[1] + 1) + sum(math.log((bad[x] + 1) / of_bad) - math.log((good[x] + 1) / of_good) for x in found if x in every)

    out = []
    for url in urls:
        host, path, _ = parts(url)
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((host, path, *(max(fits)[1:] if fits else (None, "block" if score(words(url)) > 0 else "allow"))))
    return out


def test_url_filter_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()
    rows += [(10**6 + i, f"http://{a}{b}.shop.com/{b}-{a}/x?{i}") for i, (a, b) in enumerate([("free", "casino"), ("history", "museum"), ("unseenword", "poker"), ("zzz", "qqq")])]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(spark, spark.createDataFrame([tuple(r) for r in rows], "page_id long, url string")).collect()}
    assert [got[r[0]] for r in rows] == brute_verdicts([r[1] for r in rows])


def brute_neighbours(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, x in ok:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q)[:k]
            out |= {(q, n + 1, i, round(s, 9)) for n, (s, i) in enumerate(near)}
    return out


def test_ann_on_a_small_table_is_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(301)]
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] + [1.0] * 7), (None, [1.0] * 8), (500, rows[0][1]), (501, rows[0][1]), (404, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    single = [(i, [None if x is None else float(np.float32(x)) for x in v] if v else None) for i, v in rows]
    got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(spark, df, F.col("vec_id") % 100 == 0).collect()}
    assert got == brute_neighbours(single)
    assert ann.search(spark, df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = ann.search(spark, df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_ann_gives_each_id_once(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    again = rows + [rows[0], rows[0], rows[7], (9, [9.0] * 4)]  # rows that repeat an id: the vector that comes first in order
    df = spark.createDataFrame(again, "vec_id long, embedding array<double>")
    least = {i: min(v for j, v in again if j == i) for i, _ in again}
    got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(spark, df, F.col("vec_id") % 100 == 0).collect()}
    assert got == brute_neighbours(list(least.items())) and len(got) == 10


def test_ann_probes_few_lists_where_clusters_are_tight():
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(50, 16)) * 10
    tight = np.repeat(spots, 40, axis=0) + rng.normal(size=(2000, 16)) * 0.1
    tight = tight[rng.permutation(2000)]
    even = rng.normal(size=(2000, 16))
    few, many = (ann.lists_needed(x, ann.kmeans(x, 45), 10) for x in (tight, even))
    assert few <= 10 < many


def test_ann_recall_over_lists(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    more = spark.createDataFrame([(i + 10_000 * k, [x + 0.01 * k for x in v]) for k in range(2) for i, v in rows], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(spark, more, F.col("vec_id") % 100 == 0).collect()}
    want = {(q, i) for q, _, i, _ in brute_neighbours([(r["vec_id"], r["embedding"]) for r in more.collect()])}
    assert len(got & want) / len(want) >= 0.9


def test_licence_scan_equals_the_driver_version(spark):
    lines = [t for ts in licence.TEMPLATES.values() for t in ts] + licence.OTHER + ["", "xx " * 50 + "Released under the MIT License."]
    docs = documents(spark, [(0, "\n".join(lines)), (1, None), (2, ""), (3, "Licensed under CC BY-NC 4.0.\n" * 3), (None, "MIT License")])
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licence.scan(spark, docs).collect()}
    for i, line in enumerate(lines):
        assert got.get((0, i), "unknown") == licence.classify(line)[0]
    assert [got.get((3, i)) for i in range(3)] == ["cc-by-nc"] * 3 and not any(k[0] in (1, 2) for k in got)
    assert licence.scan(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, family",
    [("GNU General Public License v2 only", "gpl-2.0"), ("Redistributions of source code must retain the above copyright notice", "bsd"), ("THE SOFTWARE IS PROVIDED AS IS", "mit"), ("ISC License", "isc"), ("Eclipse Public License 2.0", "epl-2.0"), ("distributed under the terms of the MIT license, see below", "mit"), ("the law on public works of art", "unknown")],
)
def test_notices_in_other_words(spark, text, family):
    assert licence.classify(text)[0] == family
    got = [r["family"] for r in licence.scan(spark, documents(spark, [(1, text)])).collect()]
    assert got == ([family] if family != "unknown" else [])


def test_calibration_texts_are_told_from_one_another():
    right = [licence.classify(t)[0] == f for f, ts in licence.VARIANTS.items() for t in ts]
    assert sum(right) >= 0.9 * len(right) and not any(licence.classify(t)[0] != "unknown" for t in licence.UNSEEN)


@pytest.mark.parametrize("family", list(licence.TEMPLATES))
def test_templates_are_recognised(family):
    assert all(licence.classify(t)[0] == family for t in licence.TEMPLATES[family])
    assert all(licence.classify(t)[0] == "unknown" for t in licence.OTHER)
