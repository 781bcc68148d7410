import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import casegen as cg
from siftline.operators import catalog as ct
from siftline.operators import rerank as rr

CATALOG = "name string, description string, augmented_description string"
CASES = "query_id bigint, query string, expected array<string>, also_accept array<string>, kind string, server string, status string"


def test_stratified_sizes_and_repeatability(spark):
    rows = spark.createDataFrame([("w", f"w{i}") for i in range(3)] + [("m", f"m{i}") for i in range(2)] + [("z", f"z{i}") for i in range(40)] + [("one", "x")], "grp string, name string")
    a = cg.stratified_sample(rows, "grp", "name", 10).collect()
    b = cg.stratified_sample(rows.orderBy(F.desc("name")), "grp", "name", 10).collect()
    assert sorted(a) == sorted(b)
    sizes = {g: sum(r.grp == g for r in a) for g in ("w", "m", "z", "one")}
    assert sizes == {"w": 2, "m": 2, "z": round(10 * 40 / 46), "one": 1}
    assert sorted(a) != sorted(cg.stratified_sample(rows, "grp", "name", 10, seed=8).collect())


def test_draft_rows(spark):
    good = json.dumps({"direct": ["q1", "q2"], "confusable": {"query": "q3", "confused_with": "sib"}, "multi": {"query": "q4", "also": "sib"}})
    invented = json.dumps({"direct": [], "confusable": {"query": "q5", "confused_with": "nobody"}, "multi": {"query": "q6", "also": "nobody"}})
    rows = [("t", f"```json\n{good}\n```", ["sib"]), ("u", invented, ["sib"]), ("v", "no json", []), ("w", None, []), ("x", '{"direct": ["q7"], "multi": null}', [])]
    got = {(r.name, r.query, tuple(r.expected), r.kind, r.confused_with) for r in cg.drafted_rows(spark.createDataFrame(rows, "name string, reply string, siblings array<string>")).collect()}
    assert got == {
        ("t", "q1", ("t",), "direct", None), ("t", "q2", ("t",), "direct", None), ("t", "q3", ("t",), "confusable", "sib"), ("t", "q4", ("t", "sib"), "multi", None),
        ("u", "q5", ("u",), "confusable", None), ("x", "q7", ("x",), "direct", None),
    }


def test_prompts(spark):
    shown = spark.createDataFrame([("a", "name: a"), ("b", "name: b {x}"), ("c", "name: c")], "name string, shown string")
    pairs = spark.createDataFrame([("a", "c", 2), ("a", "b", 1)], "query_id string, id string, rank int")
    got = {r.name: r.prompt for r in cg.prompts(shown, pairs).collect()}
    assert got["a"].endswith("TARGET:\nname: a\n\nSIBLINGS:\nname: b {x}\n\nname: c") and got["b"].endswith("SIBLINGS:\n(none)")
    assert '{"direct"' in got["a"]


def test_replies_are_cached_and_failures_are_not(spark):
    asked = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p3"), ("d", "p1")], "name string, prompt string")

    def answer(p):
        if p == "p3":
            raise OSError("down")
        return p.upper()

    none = spark.createDataFrame([], "k string, v string")
    got, fresh = cg.replies(asked, none, answer, "m")
    assert {r.name: r.reply for r in got.collect()} == {"a": "P1", "b": "P2", "c": None, "d": "P1"}
    assert sorted(r.v for r in fresh.collect()) == ["P1", "P2"]
    again, more = cg.replies(asked.where("name <> 'c'"), fresh.persist(), lambda p: 1 / 0, "m")
    assert {r.reply for r in again.collect()} == {"P1", "P2"} and more.count() == 0


def lint_cases(spark):
    rows = [
        (1, "weather forecast city tomorrow", ["get_weather"], None, "direct", "weather", "ok"),
        (2, " Weather Forecast City tomorrow ", ["get_weather"], None, "direct", "weather", "ok"),
        (3, "something else", ["nothing"], ["nobody"], "direct", "weather", None),
        (4, "please go there", ["send_mail"], None, None, None, "draft"),
        (5, "umbrella today needed", ["get_weather"], None, "direct", "weather", "OK"),
        (6, "x", ["nothing"], None, "direct", "mail", "dropped"),
        (7, None, None, None, "direct", "weather", "ok"),
    ]
    catalog = [("get_weather", "Weather forecast for a city", "bring an umbrella today"), ("send_mail", None, None)]
    return spark.createDataFrame(rows, CASES), spark.createDataFrame(catalog, CATALOG)


def test_lint(spark):
    cases, catalog = lint_cases(spark)
    got = {(r.severity, r.rule, r.line, r.detail) for r in cg.lint(cases, catalog, "query_id").collect()}
    assert {x for x in got if x[1] in ("unknown_tool", "duplicate", "status", "thin_group")} == {
        ("error", "unknown_tool", 3, "nothing"), ("error", "unknown_tool", 3, "nobody"), ("error", "duplicate", 2, "1"), ("error", "status", 4, "draft"), ("warning", "thin_group", None, "?"),
    }
    assert {(r, line) for _, r, line, _ in got if r.startswith("leak")} == {("leak_text", 1), ("leak_text", 2), ("leak_augmented", 5)}
    assert not any(r.rule == "status" for r in cg.lint(cases, catalog, "query_id", allow_draft=True).collect())
    t = {(r.what, r.value): r.n for r in cg.totals(cases, catalog).collect()}
    assert t[("kept", "")] == 6 and t[("dropped", "")] == 1 and t[("catalog", "")] == 2 and t[("kind", "direct")] == 6 and t[("group", "?")] == 1
    assert cg.lint(cases.limit(0), catalog, "query_id").count() == 0


def test_random_subset(spark):
    catalog = spark.createDataFrame([(f"t{i}",) for i in range(30)], "name string")
    cases = spark.createDataFrame([(0, ["t3", "t4", "gone"]), (1, []), (2, ["t5"])], "query_id bigint, expected array<string>")
    got = cg.random_subset(cases, catalog, 6).collect()
    by = {q: {r.name: r.pos for r in got if r.query_id == q} for q in (0, 1, 2)}
    assert all(len(v) == 6 and sorted(v.values()) == [1, 2, 3, 4, 5, 6] for v in by.values())
    assert {"t3", "t4"} <= set(by[0]) and "t5" in by[2] and by[0] != by[1]
    assert sorted(got) == sorted(cg.random_subset(cases, catalog.orderBy(F.desc("name")), 6).collect())
    assert cg.random_subset(cases, catalog, 30).count() == 90
    # exactly n for every case and size, also where the catalog is hardly larger; expected rows beyond n are kept
    for size in (1, 5, 6, 7, 8, 24, 25, 29):
        for n in (1, 4, 6):
            some = spark.createDataFrame([(q, [f"t{(q + k) % 30}" for k in range(q % 4)] + [None] * (q % 2)) for q in range(40)] + [(40, None)], "query_id bigint, expected array<string>")
            got = [(r.query_id, r.name) for r in cg.random_subset(some, catalog.where(F.substring("name", 2, 9).cast("int") < size), n).collect()]
            assert len(set(got)) == len(got)
            known = {q: {x for k in range(q % 4) if int((x := f"t{(q + k) % 30}")[1:]) < size} for q in range(40)} | {40: set()}
            for q in range(41):
                names = {name for p, name in got if p == q}
                assert known[q] <= names and len(names) == max(min(n, size), len(known[q]))
    assert cg.random_subset(cases, catalog.limit(0), 5).count() == 0


def test_random_subset_shows_all_names_alike(spark):
    catalog = spark.createDataFrame([(f"t{i:02}",) for i in range(30)], "name string")
    cases = spark.range(3000).selectExpr("id as query_id", "cast(array() as array<string>) as expected")
    times = [r["count"] for r in cg.random_subset(cases, catalog, 6).groupBy("name").count().collect()]
    assert len(times) == 30 and min(times) > 480 and max(times) < 720  # 600 on average

def test_conditions_and_costs(spark):
    assert cg.parse_condition("all@10") == ("all", "10")
    for bad in ("all", "none@3", "all@"):
        with pytest.raises(ValueError):
            cg.parse_condition(bad)
    df = spark.createDataFrame([("all",), ("all-5",), ("all-500",), ("top-5",)], "c string")
    assert [r.n for r in df.select(cg.catalog_size(F.col("c"), F.lit(90).cast("bigint")).alias("n")).collect()] == [90, 5, 90, None]
    jobs = spark.createDataFrame([("a", "x" * 40), ("b", "y" * 40), ("a", "x" * 40)], "k string, prompt string")
    cache = spark.createDataFrame([("b",)], "k string")
    r = cg.projected_cost(jobs, cache, 1.0, 2.0, 100).first()
    assert (r.n_jobs, r.n_cached, r.input_tokens) == (2, 1, 10) and r.usd == pytest.approx((10 + 200) / 1e6)
    assert cg.require_paid(jobs, cache, True) == 1
    with pytest.raises(SystemExit) as stop:
        cg.require_paid(jobs, cache, False)
    assert stop.value.code == 2


def shortlist(spark, n=2):
    return spark.createDataFrame([(0, 'say "hi"', f"t{i}", f"option {i}", n - i) for i in range(n)], "query_id bigint, query string, id string, option string, rank int")


def test_requests(spark):
    body = json.loads(rr.requests(shortlist(spark), "m", True).first().body)
    assert body["state"] == 'say "hi"' and list(body["questions"]["tool"]["criteria"]) == ["t1", "t0", "none"]
    assert body["questions"]["needs_tool"]["type"] == "noul"
    assert rr.requests(shortlist(spark, 254), "m").count() == 1
    with pytest.raises(Exception, match="too many options"):
        rr.requests(shortlist(spark, 255), "m").collect()


def test_responses(spark):
    answer = {"answers": {"tool": {"choice": "b", "confidence": 0.4, "probabilities": {"a": 0.2, "b": 0.7, "none": 0.1}}, "needs_tool": {"noul": 0.9}}}
    none = {"answers": {"tool": {"choice": "none", "confidence": 0.4, "probabilities": {}}}}
    rows = [(0, json.dumps(answer)), (1, json.dumps({"result": answer})), (2, json.dumps(none)), (3, "{"), (4, None), (5, json.dumps(answer))]
    names = spark.createDataFrame([(i, n) for i in range(5) for n in "ab"], "query_id bigint, id string")
    got = {r.query_id: r for r in rr.parse_response(spark.createDataFrame(rows, "query_id bigint, body string"), names).collect()}
    assert (got[0].pick, got[0].confidence, got[0].needs_tool) == ("b", 0.7, 0.9) and got[1][1:] == got[0][1:]
    assert [x.name for x in got[0].ranked] == ["b", "a", "none"]
    assert (got[2].pick, got[2].confidence) == (None, 0.4) and got[3].pick is None and got[4].ranked == [] and got[5].pick is None
    top = rr.parse_response(spark.createDataFrame(rows[:1], "query_id bigint, body string")).select(rr.top_names("ranked", 2).alias("t")).first().t
    assert top == ["b", "a"]


def test_cascade_ignores_failures_it_does_not_need(spark):
    first = spark.createDataFrame([(0, "a", 0.95), (1, "a", 0.5), (2, None, 0.99), (3, "a", 0.1)], "query_id bigint, pick string, confidence double")
    second = spark.createDataFrame([(0, None, "timeout"), (1, "b", ""), (2, "b", None), (3, None, "timeout")], "query_id bigint, pick string, error string")
    got = {r.query_id: (r.pick, r.used, r.error) for r in rr.cascade(first, second).collect()}
    assert got == {0: ("a", "first", None), 1: ("b", "second", None), 2: ("b", "second", None), 3: (None, "second", "timeout")}


def test_rerank_calls_the_function_per_query(spark):
    got = rr.rerank(shortlist(spark), lambda q, c: {"pick": c[0]["name"], "confidence": 0.5, "ranked": [(x["name"], 0.5) for x in c]}).first()
    assert (got.pick, got.confidence, [x.name for x in got.ranked], got.needs_tool) == ("t1", 0.5, ["t1", "t0"], None)


def test_last_wins_and_merges(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), (None, 1)], "name string, v int")
    b = spark.createDataFrame([("y", 2), ("z", 2)], "name string, v int")
    assert {tuple(r) for r in ct.last_wins([a, b]).collect()} == {("x", 1), ("y", 2), ("z", 2)}
    old = spark.createDataFrame([("c1", 1), ("c2", 1), (None, 1)], "condition string, v int")
    new = spark.createDataFrame([("c2", 2), (None, 2)], "condition string, v int")
    assert sorted(ct.merge_runs(old, new).collect(), key=str) == sorted([("c1", 1), ("c2", 2), (None, 2)], key=str)
    groups = spark.createDataFrame([("y",)], "grp string")
    assert {tuple(r) for r in ct.refresh_subset(a, b.where("name = 'y'"), F.col("name"), groups).collect()} >= {("x", 1), ("y", 2)}
