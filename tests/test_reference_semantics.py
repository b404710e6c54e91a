"""Small hand-built inputs for behaviour that is easy to get wrong."""

import json

import pytest
from pyspark.sql import functions as F

from skein import schema
from skein.functions import text as T
from skein.operators import gold as Gd
from skein.operators import graph as G
from skein.operators import incremental as I
from skein.operators import ledger as L
from skein.operators import names as N
from skein.operators import packing as P
from skein.operators import rendering as Re
from skein.operators import retrieval as R
from skein.sources import diffs, store
from skein.streaming import live


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def symbols(spark, rows):
    """(id, name, file, start, end[, tokens, is_test, signature])"""
    full = [(i, i, n, "FUNCTION", f, s, e, (more[2] if len(more) > 2 else f"fun {n}()"), None, (more[0] if more else 10), (more[1] if len(more) > 1 else False)) for i, n, f, s, e, *more in rows]
    return spark.createDataFrame(full, schema.SYMBOLS)


@pytest.mark.parametrize("text, terms", [("parseKtFile", ["parse", "kt", "file"]), ("HTTPServer", ["http", "server"]), ("X1", []), ("URL2", ["url"]), ("Schöpfö", ["sch", "pf"]), ("K", []), ("a1B2", ["a1"]), ("", [])])
def test_terms(spark, text, terms):
    assert one(spark, T.terms(F.col("t")), t=text) == terms


def test_identifiers_in_text(spark):
    text = "see `Foo.bar(x)` and snake_case, parseKtFile but not run or Word"
    assert sorted(one(spark, T.mentioned(F.col("t")), t=text)) == ["Foo", "bar", "parseKtFile", "snake_case", "x"]
    assert one(spark, T.called(F.col("t")), t="a(b (c) d") == ["a", "b"]
    assert one(spark, T.unresolved_callee(F.col("t")), t="unresolved call `visit`") == "visit"
    assert one(spark, T.one_line(F.col("t")), t="a(\n  b,\n  c)") == "a( b, c)"
    assert one(spark, T.basename(F.col("t")), t="a/b/C.kt") == "C.kt"


def test_lines_drop_a_final_break(spark):
    assert one(spark, T.lines(F.col("t")), t="a\nb\n") == ["a", "b"]
    assert one(spark, T.lines(F.col("t")), t="a\n\n") == ["a", ""]


def test_diff_in_reply(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n"
    for reply, want in ((diff, diff), (f"```diff\n{diff}\n```", diff), (f"Sure:\n{diff}", diff), ("no idea", ""), ("--- a/x", "")):
        assert one(spark, T.diff_in(F.col("t")), t=reply) == want


def test_signature_doc_and_ids(spark):
    assert one(spark, T.signature(F.col("t")), t="/** Doc. */\nfun a(b: Int): Int = b") == "fun a(b: Int): Int"
    assert one(spark, T.signature(F.col("t")), t="class A {\n}") == "class A"
    assert one(spark, T.doc_line(F.col("t")), t="\n  \n First. \nSecond.") == "First."
    f = lambda kind, receiver, ps: one(spark, T.symbol_id(F.lit(kind), F.lit("p.f"), F.lit(receiver).cast("string"), F.array(*(F.lit(p).cast("string") for p in ps))))
    assert f("FUNCTION", None, ["kotlin.Int", None]) == "p.f(kotlin.Int,?)"
    assert f("FUNCTION", "kotlin.String", []) == "p.f(this:kotlin.String)"
    assert f("CONSTRUCTOR", None, ["A"]) == "p.f.<init>(A)" and f("CLASS", None, []) == "p.f"
    assert one(spark, T.relative_path(F.lit("/r/a/B.kt"), F.lit("/r"))) == "a/B.kt"
    assert one(spark, T.relative_path(F.lit("/other/B.kt"), F.lit("/r"))) == "/other/B.kt"


def test_bm25_counts_a_repeated_query_term_twice(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, [])], "doc_id long, terms array<string>")
    postings, lens = R.bag(docs, "doc_id", F.col("terms")), R.lengths(docs, "doc_id", F.col("terms"))
    ask = lambda terms: {r["doc_id"]: r["score"] for r in R.bm25(postings, lens, spark.createDataFrame([(0, t) for t in terms], "task_id long, term string")).collect()}
    once, twice = ask(["a"]), ask(["a", "a"])
    assert twice[1] == pytest.approx(2 * once[1]) and set(once) == {1}


def test_seeds_fuse_channels(spark):
    rows = [(0, "b", "seed:search", 1), (0, "a", "seed:search", 2), (0, "a", "seed:mentioned", 1), (0, "c", "seed:embed", 1)]
    got = R.fuse(spark.createDataFrame(rows, "task_id long, id string, why string, rank long")).orderBy("rank").collect()
    assert [(r["id"], r["why"]) for r in got] == [("a", "seed:mentioned+seed:search"), ("b", "seed:search"), ("c", "seed:embed")]


def test_exact_names_put_tests_last_and_are_case_sensitive(spark):
    s = symbols(spark, [("z", "GreetingService", "f", 1, 2, 5, True), ("y", "GreetingService", "f", 3, 4), ("x", "run", "f", 5, 6)])
    t = spark.createDataFrame([(0, "`GreetingService` should run", None, None)], "task_id long, text string, base_commit string, x string")
    assert [(r["id"], r["rank"]) for r in R.exact_names(t, s).orderBy("rank").collect()] == [("y", 1), ("z", 2)]


def test_penalty_of_tests_in_the_dense_channel(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "task_id long, q array<double>")
    v = spark.createDataFrame([("t", [1.0, 0.0]), ("c", [0.9, 0.1])], "id string, v array<double>")
    tests = spark.createDataFrame([("t", True), ("c", False)], "id string, is_test boolean")
    assert [r["id"] for r in R.dense(q, v, 5, tests, 0.3).orderBy("rank").collect()] == ["c", "t"]


EDGES = [("Checkout", "Gateway", "CALLS"), ("Stripe", "Gateway", "EXTENDS"), ("Checkout", "ext", "CALLS")]


def graph(spark, **weights):
    s = symbols(spark, [("Checkout", "Checkout", "a/A.kt", 1, 5), ("Gateway", "Gateway", "a/B.kt", 1, 5), ("Stripe", "Stripe", "a/C.kt", 1, 5)])
    return s, G.links(s, spark.createDataFrame(EDGES, schema.EDGES), G.weight_table(spark, **weights))


def test_provenance_names_the_implementation(spark):
    _, links = graph(spark)
    seeds = spark.createDataFrame([(0, "Gateway", 1)], "task_id long, id string, rank long")
    why = {r["node"]: r["why"] for r in G.provenance(seeds, links).collect()}
    assert why["Stripe"] == "impl-of:Gateway" and why["Checkout"] == "caller-of:Gateway" and why["Gateway"] == "seed"
    assert why["file:a/B.kt"] == "in:B.kt" and "ext" not in why


def test_without_weights_ranks_are_the_restart_vector(spark):
    s, links = graph(spark, **{k: 0.0 for k in schema.WEIGHTS})
    start = G.restart(spark.createDataFrame([(0, "Gateway", 3.0), (0, "Stripe", 1.0), (0, "gone", 9.0)], "task_id long, id string, score double"), s)
    got = {r["node"]: r["score"] for r in G.pagerank(start, links).collect()}
    assert got == pytest.approx({"Gateway": 0.75, "Stripe": 0.25})


def test_pagerank_keeps_mass_with_dangling_nodes(spark):
    start = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5)], "task_id long, node string, mass double")
    moves = spark.createDataFrame([("a", "c", 1.0), ("a", "b", 3.0)], "src string, dst string, w double")
    got = {r["node"]: r["score"] for r in G.pagerank(start, moves, iterations=6).collect()}
    rank = {"a": 0.5, "b": 0.5, "c": 0.0}
    for _ in range(6):
        lost = rank["b"] + rank["c"]
        rank = {"a": 0.075 + 0.425 * lost, "b": 0.075 + 0.425 * lost + 0.85 * rank["a"] * 0.75, "c": 0.85 * rank["a"] * 0.25}
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(1)


def test_a_walk_takes_the_earlier_frontier_node_first(spark):
    links = spark.createDataFrame([("s2", "x", 1.0, "late", "0"), ("s1", "x", 1.0, "early", "9"), ("s1", "y", 0.0, "none", "0")], "src string, dst string, w double, reason string, ord string")
    seeds = spark.createDataFrame([(0, "s1", 1), (0, "s2", 2)], "task_id long, id string, rank long")
    assert {r["node"]: r["why"] for r in G.provenance(seeds, links).collect()} == {"s1": "seed", "s2": "seed", "x": "early"}


def test_last_of_repeated_ids_answers(spark):
    s = symbols(spark, [("a", "one", "f1", 1, 2), ("a", "two", "f2", 1, 2)])
    assert [(r["id"], r["name"]) for r in G.last_by_id(s).collect()] == [("a", "two")]


def test_closures(spark):
    c = spark.createDataFrame([("a", "b", "CONTAINS"), ("b", "c", "CONTAINS"), ("a", "d", "CONTAINS")], schema.EDGES)
    assert {tuple(r) for r in G.descendants(c).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")}
    assert {r["id"]: r["ancestors"] for r in G.ancestors(c).collect()} == {"b": ["a"], "c": ["a", "b"], "d": ["a"]}


def test_greedy_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([(0, i, c) for i, c in enumerate([5, 9, 3, 4])], "task_id long, at int, cost int")
    assert sorted(r["cost"] for r in P.skip_greedy(items, 10, "task_id", [F.col("at")], "cost", ["cost"]).collect()) == [3, 5]


def candidates(spark, rows):
    """(rank, id, file, tokens, is_test, score, body, ancestors, descendants)"""
    full = [("t", r, i, i, i, f, 1, f"fun {i}()", body, tokens, test, score, "seed", up, down) for r, i, f, tokens, test, score, body, up, down in rows]
    return spark.createDataFrame(full, "task_id string, rank long, id string, fq_name string, name string, file string, start_line int, signature string, body string, tokens int, is_test boolean, score double, why string, ancestors array<string>, descendants array<string>")


def count(text: str) -> int:
    return len(text.split())


@pytest.mark.parametrize("budget", [60, 120, 400, 4000])
def test_pack_stays_in_budget(spark, budget):
    rows = [(k + 1, f"s{k}", f"f{k % 4}", 8, k % 5 == 0, 1.0 / (k + 1), f"body of {k}", None, None) for k in range(30)]
    got = P.pack(candidates(spark, rows), budget, count=count).collect()
    assert got and got[0]["spent"] + got[0]["overhead"] <= budget
    assert sum(r["tokens"] for r in got) <= got[0]["spent"]
    assert [r["fidelity"] for r in got] == sorted((r["fidelity"] for r in got))


def test_a_budget_below_the_overhead_is_reported_all_the_same(spark):
    rows = [(1, "a", "f", 5, False, 1.0, "b", None, None)]
    assert P.pack(candidates(spark, rows), 10, count=count).count() == 0
    pack = P.two_pass(10, count=count)
    assert pack(candidates(spark, rows).toPandas()).empty


def test_a_rejected_test_uses_up_the_test_budget():
    import pandas as pd

    columns = "task_id rank id fq_name name file start_line signature body tokens is_test score why ancestors descendants".split()
    row = lambda r, i, sig, test, score: ("t", r, i, i, i, "f", 1, sig, None, 5, test, score, "w", None, None)
    cost = lambda text: 1000 if "big" in text else 1 if text.startswith(("- ", "\n`")) else 0
    df = pd.DataFrame([row(1, "a", "big", True, 9.0), row(2, "b", "small", True, 1.0), row(3, "c", "small", False, 1.0)], columns=columns)
    # The test of 1,001 tokens is within the test limit of 1,001 but not the budget that is left: it stays charged.
    got = P.two_pass(1012, full_share=0.0, test_share=0.99, count=cost)(df)
    assert set(got["id"]) == {"c"}


def test_a_body_takes_the_place_of_its_members_and_leaves_under_it_are_left_out():
    import pandas as pd

    columns = "task_id rank id fq_name name file start_line signature body tokens is_test score why ancestors descendants".split()
    rows = [
        ("t", 1, "C.m", "C.m", "m", "f", 2, "fun m()", "m body", 1, False, 9.0, "w", ["C"], None),
        ("t", 2, "C", "C", "C", "f", 1, "class C", "c body", 5, False, 8.0, "w", None, ["C.m", "C.n"]),
        ("t", 3, "C.n", "C.n", "n", "f", 4, "fun n()", "n body", 9, False, 1.0, "w", ["C"], None),
    ]
    got = P.two_pass(1000, full_share=1.0, count=count)(pd.DataFrame(rows, columns=columns))
    assert got[["id", "fidelity"]].values.tolist() == [["C", "FULL"]]


def test_heading_is_paid_once_a_file(spark):
    rows = [(k + 1, f"s{k}", "same", 8, False, 1.0, None, None, None) for k in range(3)]
    got = P.pack(candidates(spark, rows), 400, count=count).collect()
    stubs = sum(r["tokens"] for r in got)
    assert got[0]["spent"] == stubs + count(Re.heading_text("same"))


def test_markdown_and_explanation(spark):
    items = spark.createDataFrame([("t", 0, "p.A", "a.kt", 3, "FULL", "seed", "class A {\n}", False, "A", 9), ("t", 1, "p.b", "b.kt", 7, "STUB", "caller-of:A", "fun b(\n  x)", False, "b", 4), ("t", 2, "p.t", "t.kt", 1, "STUB", "test-of:A", "fun t()", True, "T", 4)], "task_id string, at long, fq_name string, file string, start_line int, fidelity string, why string, text string, is_test boolean, id string, tokens int")
    totals = spark.createDataFrame([("t", 50, 400)], "task_id string, tokens int, budget int")
    errors = spark.createDataFrame([("t", "a.kt", 4, "oops")], "task_id string, file string, line int, message string")
    text = Re.markdown(items, totals, errors).first()["markdown"]
    assert text == ("# Context pack\n\n50 / 400 tokens, 3 declarations.\n\n## Definitions\n\n### p.A\n`a.kt:3` — seed\n\n```kotlin\nclass A {\n}\n```\n"
                    "\n## Related signatures\n\n`b.kt`\n- 7: fun b( x) — caller-of:A\n\n## Tests likely affected\n\n`t.kt`\n- 1: fun t() — test-of:A\n\n## Diagnostics\n- `a.kt:4`: oops\n")  # fmt: skip
    told = json.loads(Re.explain(items.withColumn("name", F.lower("id")), totals, errors).first()["json"])
    assert told["tokens"] == 50 and told["budget"] == 400 and told["errors"] == [{"file": "a.kt", "line": 4, "message": "oops"}]
    assert [i["id"] for i in told["items"]] == ["A", "b", "T"]
    assert told["items"][0] == {"id": "A", "name": "a", "file": "a.kt", "line": 3, "why": "seed", "fidelity": "full", "tokens": 9}


def test_errors_fit_from_the_head(spark):
    items = spark.createDataFrame([("t", "a", 90)], "task_id string, file string, used int")
    errors = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("b", 1, "other"), ("a", 3, "x " * 200)], schema.ERRORS)
    assert [r["line"] for r in P.fit_errors(items, errors, 130).orderBy("line").collect()] == [1, 2]
    assert P.fit_errors(items, errors, 90).count() == 0


PRINTER = [("Printer.format", "format", "P.kt", 2, 4), ("Report.format", "format", "R.kt", 2, 4), ("Caller", "Caller", "C.kt", 1, 9), ("Caller.run", "run", "C.kt", 3, 6)]


def test_calls_matched_by_name(spark):
    s = symbols(spark, PRINTER)
    calls = spark.createDataFrame([("C.kt", 4, "format"), ("C.kt", 4, "println")], "file string, line int, name string")
    assert {(r["from_id"], r["to_id"]) for r in N.name_calls(calls, s).collect()} == {("Caller.run", "Printer.format"), ("Caller.run", "Report.format")}
    assert N.name_calls(calls, s, 1).count() == 0


def test_windows_and_what_they_hold(spark):
    files = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(1, 21)) + "\n")], "file string, text string")
    s = symbols(spark, [("alpha", "alpha", "f", 1, 4), ("straddler", "straddler", "f", 8, 12), ("beta", "beta", "f", 16, 18)])
    w = N.windows(files, 10)
    assert [(r["start_line"], r["end_line"]) for r in w.orderBy("chunk").collect()] == [(1, 10), (11, 20)]
    assert {r["id"] for r in N.contained(w, s).collect()} == {"alpha", "beta"}
    assert {r["id"] for r in N.contained(N.windows(files, 5), s).collect()} == {"alpha", "beta"}
    assert {r["id"]: r["body"] for r in N.bodies(s, files).collect()}["alpha"] == "l1\nl2\nl3\nl4"
    assert N.bodies(symbols(spark, [("x", "x", "f", 19, 21), ("y", "y", "gone", 1, 1)]), files).where("body is null").count() == 2


def test_reference_map_prefers_what_is_used(spark):
    s = symbols(spark, [("Gadget", "Gadget", "g", 1, 2), ("Hermit", "Hermit", "h", 1, 2)] + [(f"U{i}", f"User{i}", f"u{i}", 1, 2) for i in range(3)])
    files = spark.createDataFrame([("g", "class Gadget"), ("h", "class Hermit")] + [(f"u{i}", f"class User{i} Gadget Gadget" + " Hermit" * (i == 0)) for i in range(3)], "file string, text string")
    refs = N.reference_counts(files, s)
    assert {(r["file"], r["ident"]): r["count"] for r in refs.collect()}[("u1", "Gadget")] == 2
    asked = spark.createDataFrame([(0, None), (1, None), (1, "Hermit")], "task_id long, ident string")
    edges, start = N.map_edges(refs, s, asked), N.map_restart(s, asked)
    assert edges.where("task_id = 1 and ident = 'Hermit'").first()["w"] == pytest.approx(10.0)
    assert edges.where("task_id = 0 and ident = 'User1'").first()["w"] == pytest.approx(0.1)
    rank = G.pagerank(start.where("task_id = 0").select("task_id", "node", "mass"), edges.where("task_id = 0").select(F.col("from_file").alias("src"), F.col("to_file").alias("dst"), "w"), iterations=30, tolerance=None)
    score = {r["ident"]: r["score"] for r in N.map_definitions(edges.where("task_id = 0"), rank).collect()}
    assert score["Gadget"] > score["Hermit"]


DIFFS = {
    "two": ("--- a/src/Rule.kt\n+++ b/src/Rule.kt\n@@ -12,3 +12,4 @@ x\n@@ -40 +41 @@", {("src/Rule.kt", n) for n in (12, 13, 14, 40)}),
    "insertion": ("--- a/A.kt\n@@ -12,0 +13,2 @@", {("A.kt", 12), ("A.kt", 13)}),
    "new": ("--- a/A.kt\n@@ -1 +1 @@\n--- /dev/null\n+++ b/N.kt\n@@ -0,0 +1,3 @@", {("A.kt", 1)}),
}


@pytest.mark.parametrize("case", list(DIFFS))
def test_changed_lines(spark, case):
    diff, want = DIFFS[case]
    got = diffs.changed_lines(spark.createDataFrame([("k", diff)], "key string, diff string"), "key").collect()
    assert {(r["file"], r["line"]) for r in got} == want


def test_tasks_of_commits_and_suites(spark):
    long = "fix the rule that reports too much"
    commits = spark.createDataFrame([("a" * 40, 1, long, DIFFS["two"][0]), ("b" * 40, 2, "short", DIFFS["two"][0]), ("c" * 40, 3, long, "--- a/src/test/T.kt\n@@ -1 +1 @@")], "sha string, seq long, message string, diff string")
    (t,) = diffs.mined_tasks(commits).collect()
    assert t["task_id"] == "a" * 10 and t["changed_lines"] == {"src/Rule.kt": [12, 13, 14, 40]} and t["base_commit"].endswith("^")
    parts = {"task.toml": 'repository_name = "x/y"', "instruction.md": "Issue", "environment/prepare.sh": "git checkout abcdef1234", "solution/fix.patch": "--- a/A.kt\n@@ -12,2 +12,2 @@"}
    rows = [(f"t1/{k}", v) for k, v in parts.items()] + [(f"t2/{k}", v.replace("x/y", "z")) for k, v in parts.items()] + [(f"t3/{k}", v.replace("a/A.kt", "a/src/test/A.kt")) for k, v in parts.items()]
    (t,) = diffs.suite_tasks(spark.createDataFrame(rows, "path string, text string"), "x/y").collect()
    assert (t["task_id"], t["base_commit"], t["changed_lines"]) == ("t1", "abcdef1234", {"A.kt": [12, 13]})


def gold_of(spark, lines, rows):
    changed = spark.createDataFrame([("t", "R.kt", n) for n in lines], "task_id string, file string, line int")
    s = G.positions(symbols(spark, rows))
    return {r["id"] for r in Gd.innermost_gold(Gd.touched(changed, s)).collect()}


def test_gold_is_innermost(spark):
    rows = [("Rule", "Rule", "R.kt", 1, 20), ("visit", "visit", "R.kt", 5, 10), ("report", "report", "R.kt", 12, 18)]
    assert gold_of(spark, [7], rows) == {"visit"}
    assert gold_of(spark, [7, 15], rows) == {"visit", "report"}
    assert gold_of(spark, [2], [("a", "a", "R.kt", 1, 3), ("b", "b", "R.kt", 1, 3)]) == set()


def test_scores(spark):
    s = symbols(spark, [("visit", "visit", "R.kt", 1, 2), ("report", "report", "R.kt", 3, 4), ("run", "run", "C.kt", 1, 2)])
    gold = spark.createDataFrame([("t", "visit"), ("t", "report")], "task_id string, id string")
    items = spark.createDataFrame([("t", "visit", "R.kt", 0)], "task_id string, id string, file string, at long")
    callers = Gd.callers(gold, spark.createDataFrame([("run", "visit", "CALLS"), ("visit", "report", "CALLS")], schema.EDGES))
    assert [tuple(r) for r in callers.collect()] == [("t", "run")]
    r = Gd.scores(items, gold, s, callers).first()
    assert (r["recall"], r["precision"], r["file_recall"], r["ndcg"]) == (0.5, 1.0, 1.0, 1.0)
    assert r["caller_recall"] == pytest.approx(1 / 2.5)
    empty = Gd.scores(items.limit(0), gold, s, callers).first()
    assert (empty["recall"], empty["precision"], empty["ndcg"]) == (0.0, 0.0, 0.0)


def test_diagnosis_takes_the_upper_median(spark):
    best = spark.createDataFrame([("a", 3), ("b", 50), ("c", 51), ("d", 99), ("e", None)], "task_id string, best_rank long")
    packed = spark.createDataFrame([("a", True)], "task_id string, packed boolean")
    share = spark.createDataFrame([("a", 0.5)], "task_id string, test_share double")
    r = Gd.diagnosis(best, packed, share).first()
    assert (r["tasks"], r["reachable"], r["packed"], r["median_rank"], r["near"], r["test_share"]) == (5, 4, 1, 51, 2, 0.1)


def test_index_upkeep(spark):
    s = symbols(spark, [("Rule.visit", "visit", "Rule.kt", 1, 2), ("Caller.run", "run", "Caller.kt", 1, 2)])
    e = spark.createDataFrame([("Caller.run", "Rule.visit", "CALLS"), ("ghost", "Rule.visit", "CALLS")], schema.EDGES)
    changed = spark.createDataFrame([("Rule.kt",)], "file string")
    assert [r["file"] for r in I.referrers_to_removed(s, e, changed, s.limit(0)).collect()] == ["Caller.kt"]
    assert I.referrers_to_removed(s, e, changed, s).count() == 0
    errors = spark.createDataFrame([("Caller.kt", 1, "unresolved call `visit`"), ("X.kt", 1, "unresolved call `other`")], schema.ERRORS)
    assert [r["file"] for r in I.referrers_to_added(errors, changed, s).collect()] == ["Caller.kt"]
    coverage = spark.createDataFrame([("Rule.kt", 10, 8, 8, 0), ("Caller.kt", 4, 4, 4, 0)], schema.COVERAGE)
    base = {"symbols": s, "edges": e, "errors": errors, "coverage": coverage}
    fresh = {"symbols": symbols(spark, [("Rule.check", "check", "Rule.kt", 1, 2)]), "edges": e.limit(0), "errors": errors.limit(0), "coverage": spark.createDataFrame([("Rule.kt", 5, 5, 5, 0)], schema.COVERAGE)}
    out = I.merge(base, changed, fresh)
    assert {r["id"] for r in out["symbols"].collect()} == {"Rule.check", "Caller.run"}
    assert out["edges"].count() == 2  # both come from elsewhere, one from a file nobody knows
    assert tuple(I.coverage_fold(out["coverage"]).first()) == (9, 9, 9, 0)
    assert I.worth_reusing(35, 100) and not I.worth_reusing(36, 100) and not I.worth_reusing(0, 0)


def test_excluded_roots_go_by_path_segment(spark):
    roots = spark.createDataFrame([("/a/b",), ("/a/b/c",), ("/a/bc",)], "path string")
    assert [r["path"] for r in I.without_excluded(roots, spark.createDataFrame([("/a/b",)], "path string")).collect()] == ["/a/bc"]


def test_index_files_and_ledgers(spark, tmp_path):
    doc = {"stamps": {"a.kt": "1"}, "classpath": [], "index": {"symbols": [{"id": "a", "fqName": "a", "name": "a", "kind": "CLASS", "file": "a.kt", "startLine": 1, "endLine": 2, "signature": "class a", "tokens": 3, "isTest": False, "extra": 1}], "edges": [{"from": "a", "to": "b", "kind": "CALLS"}], "errors": [], "fileCoverage": {"a.kt": {"callSites": 1, "resolvedCallees": 1, "attributedToCaller": 0, "failedFiles": 0}}}}
    (tmp_path / "i.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "bad.json").write_text("{nonsense")
    index = store.read_index_json(spark, str(tmp_path / "i.json"))
    assert index["symbols"].first()["doc"] is None and index["edges"].first()["to_id"] == "b"
    assert store.read_index_json(spark, str(tmp_path / "bad.json")) is None and store.read_index_json(spark, str(tmp_path / "none.json")) is None
    store.write_index({k: index[k] for k in ("symbols", "edges", "errors", "coverage")}, str(tmp_path / "store"), "abc")
    back = store.read_index(spark, str(tmp_path / "store"), "abc")
    assert back["symbols"].columns == index["symbols"].columns and back["coverage"].count() == 1
    led = spark.createDataFrame([("t1", "jp", "RESOLVED", 5), ("t1", "none", "UNRESOLVED", 0)], store.LEDGER)
    store.append_ledger(led, str(tmp_path / "led"))
    (tmp_path / "led" / "part-x.csv").write_text("lonely\n")
    kept = store.read_ledger(spark, str(tmp_path / "led"))
    assert kept.count() == 2 and L.certified(kept, "jp", "none").count() == 1
    assert L.pending(led.select("task", "arm").union(spark.createDataFrame([("t2", "jp")], "task string, arm string")), kept).count() == 1


def test_stream_patches_batches_and_repairs_referrers(spark, tmp_path):
    base = {
        "symbols": symbols(spark, [("old", "old", "a.kt", 1, 2), ("stay", "stay", "a.kt", 3, 4), ("keep", "keep", "b.kt", 1, 2), ("far", "far", "c.kt", 1, 2), ("ask", "ask", "d.kt", 1, 2)]),
        "edges": spark.createDataFrame([("old", "keep", "CALLS"), ("keep", "old", "CALLS"), ("stay", "far", "CALLS"), ("far", "stay", "CALLS")], schema.EDGES),
        "errors": spark.createDataFrame([("d.kt", 1, "unresolved call `x.new(1)`"), ("a.kt", 1, "gone soon")], schema.ERRORS),
        "coverage": spark.createDataFrame([("a.kt", 5, 1, 1, 0), ("c.kt", 2, 2, 2, 0)], schema.COVERAGE),
    }
    asked = []

    def index(some):
        """Anew: a.kt has stay and new, new calling far; b.kt calls stay; d.kt calls new."""
        names = {r["file"] for r in some.collect()}
        asked.append(names)
        every = {"a.kt": ([("stay", "stay", "a.kt", 1, 2), ("new", "new", "a.kt", 3, 3)], [("new", "far", "CALLS"), ("stay", "far", "CALLS")]), "b.kt": ([("keep", "keep", "b.kt", 1, 2)], [("keep", "stay", "CALLS")]), "d.kt": ([("ask", "ask", "d.kt", 1, 2)], [("ask", "new", "CALLS")])}
        rows, edges = [x for n in names for x in every[n][0]], [x for n in names for x in every[n][1]]
        none = symbols(spark, [("x", "x", "x", 1, 1)]).limit(0)
        return {"symbols": symbols(spark, rows) if rows else none, "edges": spark.createDataFrame(edges, schema.EDGES), "errors": spark.createDataFrame([], schema.ERRORS), "coverage": spark.createDataFrame([(n, 1, 1, 1, 0) for n in names], schema.COVERAGE)}

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"file": "a.kt"}\n{"file": "a.kt"}\n')
    saved = {}
    keep = lambda out, n: saved.update({n: {k: sorted(map(tuple, out[k].select(c).collect())) for k, c in (("symbols", ["id"]), ("edges", ["from_id", "to_id"]), ("errors", ["file"]), ("coverage", ["file"]))}})
    live.keep_patched(live.watch(spark, str(tmp_path / "in"), "file string"), lambda: base, index, keep, str(tmp_path / "cp")).awaitTermination(120)
    assert asked == [{"a.kt"}, {"b.kt", "d.kt"}]
    assert saved[0]["symbols"] == [("ask",), ("far",), ("keep",), ("new",), ("stay",)]
    assert saved[0]["edges"] == sorted([("new", "far"), ("stay", "far"), ("far", "stay"), ("keep", "stay"), ("ask", "new")])
    assert saved[0]["errors"] == [] and saved[0]["coverage"] == [("a.kt",), ("b.kt",), ("c.kt",), ("d.kt",)]


def test_index_is_fresh_while_stamps_are_alike(spark):
    files = spark.createDataFrame([("a.kt", "x"), ("b.kt", "y")], "file string, text string")
    stored = I.stamps(files)
    assert live.is_fresh(files, stored)
    assert not live.is_fresh(files.where("file = 'a.kt'"), stored) and not live.is_fresh(files.withColumn("text", F.lit("z")), stored)


def test_index_of_a_commit_is_read_patched_or_built(spark, tmp_path):
    root, asked = str(tmp_path / "store"), []

    def index(some):
        names = None if some is None else {r["file"] for r in some.collect()}
        asked.append(names)
        rows = [(f"s{i}", f"s{i}", f"f{i}.kt", 1, 2) for i in range(9) if names is None or f"f{i}.kt" in names]
        none = symbols(spark, [("x", "x", "x", 1, 1)]).limit(0)
        return {"symbols": symbols(spark, rows) if rows else none, "edges": spark.createDataFrame([], schema.EDGES), "errors": spark.createDataFrame([], schema.ERRORS), "coverage": spark.createDataFrame([], schema.COVERAGE)}

    def changes(few):
        def of(stored):
            pairs = stored.select(F.lit("now").alias("commit"), F.col("commit").alias("base"))
            return pairs.crossJoin(spark.createDataFrame([(f"f{i}.kt",) for i in range(few)], "file string"))

        return of

    assert store.index_at(spark, root, "one", changes(0), index)["symbols"].count() == 9 and asked == [None]
    assert store.index_at(spark, root, "one", changes(0), index)["symbols"].count() == 9 and asked == [None]
    assert store.index_at(spark, root, "two", changes(2), index)["symbols"].count() == 9 and asked[1:] == [{"f0.kt", "f1.kt"}, set()]
    assert store.index_at(spark, root, "three", changes(8), index)["symbols"].count() == 9 and asked[-1] is None
    store.write_index(index(None), root, "two")
    assert store.read_index(spark, root, "two")["symbols"].count() == 9


@pytest.mark.parametrize(
    "text, head",
    [
        ("fun f(a: Int = 3): String = a.x", "fun f(a: Int = 3): String"),
        ("/** Doc = {x} */\nfun f(b: () -> Unit = { g() }) { h() }", "fun f(b: () -> Unit = { g() })"),
        ('class A(val s: String = "{=") : B(1 == 2) { }', 'class A(val s: String = "{=") : B(1 == 2)'),
        ("val x = 1", "val x"),
        ("interface I", "interface I"),
    ],
)
def test_signature_ends_where_the_body_begins(spark, text, head):
    assert one(spark, T.signature(F.col("t")), t=text) == head


def test_signature_by_the_parser_s_offset(spark):
    assert one(spark, T.signature(F.col("t"), F.lit(24)), t="/** d */ val x: Int  =   3") == "val x: Int"


def test_protocols_are_met_by_shape():
    from skein import protocols

    class Own:
        def pack(self, tasks, budget): ...

    assert isinstance(Own(), protocols.Retriever) and not isinstance(Own(), protocols.DenseSeeds)
