import math
import zlib
from collections import Counter

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import index as ix
from siftline.operators import retrieve as rt
from siftline.operators.catalog import Catalog

DOCS = [
    ("a_mail", "send a mail to someone, mail attachments", ["mail"]),
    ("b_rates", "currency exchange rates of the day", ["finance"]),
    ("c_weather", "weather forecast for a city", ["weather"]),
    ("d_mail2", "read mail from the inbox of the day", ["mail"]),
    ("e_empty", None, None),
    ("f_stop", "the of and", []),
]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "name string, text string, tags array<string>")


def tables(spark, rows=DOCS):
    d = docs(spark, rows)
    tok = ix.tokens(d, "name", "text")
    post = ix.postings(tok)
    return {"postings": post, "df": ix.document_frequency(post), "stats": ix.statistics(ix.lengths(tok)), "vectors": ix.hash_vectors(d, "name", "text"), "docs": d.select(F.col("name").alias("id"), "tags")}


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def embed(q):
    return ix.hash_vectors(q, "query_id", "text").withColumnRenamed("id", "query_id")


def tokens(t):
    import re

    return [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in tx.STOP_WORDS]


def brute_bm25(query, rows=DOCS):
    toks = {n: tokens(t) for n, t, _ in rows}
    n, avg = len(rows), sum(map(len, toks.values())) / len(rows) or 1.0
    df = Counter(w for t in toks.values() for w in set(t))
    out = []
    for name, t in toks.items():
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in set(tokens(query)) if w in t)
        if round(s, 6) > 0:
            out.append((-round(s, 6), name))
    return [(name, -s) for s, name in sorted(out)]


def test_bm25_is_the_definition(spark):
    t = tables(spark)
    asked = ["mail of the day", "", "the", "unknown", "mail mail inbox"]
    got = rt.bm25_top(queries(spark, *asked), t["postings"], t["df"], t["stats"], 10).orderBy("query_id", "rank").collect()
    for i, q in enumerate(asked):
        assert [(r.id, r.score) for r in got if r.query_id == i] == [(n, pytest.approx(s)) for n, s in brute_bm25(q)]


def test_long_and_short_documents_count_alike(spark):
    text = " ".join(f"w{i % 90}" for i in range(700))
    d = spark.createDataFrame([("long", text), ("short", "w1 w1 w2")], "name string, text string")
    got = {(r.id, r.term): (r.tf, r.dl) for r in ix.postings(ix.tokens(d, "name", "text")).collect()}
    want = {("long", w): (n, 700) for w, n in Counter(text.split()).items()} | {("short", "w1"): (2, 3), ("short", "w2"): (1, 3)}
    assert got == want


def test_statistics_count_documents_without_tokens(spark):
    s = tables(spark)["stats"].first()
    assert s.n == 6 and s.avgdl == pytest.approx(sum(len(tokens(t)) for _, t, _ in DOCS) / 6)
    assert ix.statistics(ix.lengths(ix.tokens(docs(spark, [("x", "the", None)]), "name", "text"))).first().avgdl == 1.0


def test_hash_vectors_are_the_definition(spark):
    row = ix.hash_vectors(spark.createDataFrame([(1, "ab c ab"), (2, None), (3, "")], "id int, t string"), "id", "t").orderBy("id").collect()
    total = Counter()
    for f in ["w:ab", "w:c", "w:ab", "b:ab_c", "b:c_ab", "c:#ab", "c:ab#", "c:#c#", "c:#ab", "c:ab#"]:
        h = zlib.crc32(f.encode())
        total[h % 1024] += 1 if h >> 31 else -1
    norm = math.sqrt(sum(v * v for v in total.values()))
    assert dict(zip(row[0].buckets, row[0].weights)) == {b: pytest.approx(v / norm) for b, v in total.items() if v}
    assert row[1].buckets == [] and row[2].buckets == []


def test_vector_contract(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.5, 0.5, 0.0]), ("z", [0.0, 0.0, 0.0]), ("n", None), ("short", [1.0])], "id string, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id bigint, v array<double>")
    got = [(r.id, r.score) for r in rt.dense_top(q, v, 25).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("c", 0.707107), ("b", 0.0), ("z", 0.0)]
    assert [r.id for r in rt.dense_top(q, v, 2).orderBy("rank").collect()] == ["a", "c"]
    assert rt.dense_top(q.limit(0), v, 2).count() == 0 and rt.dense_top(q, v.limit(0), 2).count() == 0


def test_query_blocks_give_the_same(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id bigint, v array<double>")
    q = v.select(F.col("id").alias("query_id"), "v")
    want = rt.dense_top(q, v, 3, exclude_self=True).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(rt, "QUERY_BLOCK", 9)
    assert rt.dense_top(q, v, 3, exclude_self=True).orderBy("query_id", "rank").collect() == want
    assert all(r.query_id != r.id for r in want) and len(want) == 120


def test_hybrid_is_the_fusion_of_both_ranks(spark):
    t, q = tables(spark), queries(spark, "mail of the day", "the")
    got = rt.search(q, t, 5, embed=embed, dim=ix.DIM).collect()
    sem = {(r.query_id, r.id): r.rank for r in rt.dense_top(embed(q), t["vectors"], 25, dim=ix.DIM).collect()}
    kw = {(r.query_id, r.id): r.rank for r in rt.bm25_top(q, t["postings"], t["df"], t["stats"], 25).collect()}
    for r in got:
        key = (r.query_id, r.id)
        assert (r.semantic_rank, r.keyword_rank) == (sem.get(key), kw.get(key))
        assert r.score == pytest.approx(0.6 / (60 + sem[key]) + (0.4 / (60 + kw[key]) if key in kw else 0), abs=1e-8)
    assert Counter(r.query_id for r in got) == {0: 5, 1: 5}  # dense search fills up with any row


def test_batch_is_the_union_of_single_queries_and_input_order_does_not_matter(spark):
    asked = ["mail", "day rates", "weather city"]
    t = tables(spark)
    batch = {(r.query_id, r.id, r.rank) for r in rt.search(queries(spark, *asked), t, 3, embed=embed, dim=ix.DIM).collect()}
    t2 = tables(spark, list(reversed(DOCS)))
    single = set()
    for i, q in enumerate(asked):
        single |= {(i, r.id, r.rank) for r in rt.search(queries(spark, q), t2, 3, embed=embed, dim=ix.DIM).collect()}
    assert batch == single


def test_tag_filter_ranks_after_filtering_with_statistics_of_all(spark):
    t, q = tables(spark), queries(spark, "mail of the day")
    got = rt.search(q, t, 3, tags=["finance", "weather"], embed=embed, dim=ix.DIM).orderBy("rank").collect()
    assert {r.id for r in got} == {"b_rates", "c_weather"}
    kw = [r for r in got if r.keyword_rank]
    assert [(r.id, r.keyword_rank) for r in kw] == [("b_rates", 1)]
    assert rt.search(q, t, 3, tags=["nothing"], embed=embed, dim=ix.DIM).count() == 0


def test_pool_depends_on_k():
    assert rt.pool_size(3) == 25 and rt.pool_size(10) == 50 and rt.pool_size(3, ["t"], 7) == 7


def test_incremental_index_equals_full_rebuild(spark):
    changed = [("a_mail", "a new text about rates", ["mail"]) if r[0] == "a_mail" else r for r in DOCS if r[0] != "c_weather"] + [("g_new", "fresh day", [])]
    post = ix.postings(ix.tokens(docs(spark), "name", "text"))
    ids = spark.createDataFrame([("a_mail",), ("g_new",), ("c_weather",)], "id string")
    fresh = ix.postings(ix.tokens(docs(spark, changed).where("name in ('a_mail', 'g_new')"), "name", "text"))
    assert sorted(ix.upsert(post, fresh, ids).collect()) == sorted(ix.postings(ix.tokens(docs(spark, changed), "name", "text")).collect())


def test_delta(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "id string, hash string")
    before = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "id string, hash string")
    assert {(r.id, r.change) for r in ix.delta(now, before).collect()} == {("b", "changed"), ("d", "new"), ("c", "removed")}


def test_siblings_use_the_statistics_of_the_group_without_the_target(spark):
    rows = [("a", "g", "send mail fast"), ("b", "g", "send mail slow mail"), ("c", "g", "read inbox"), ("x", "h", "send mail")]
    d = spark.createDataFrame(rows, "id string, grp string, text string").select("id", "grp", tx.tokenize("text").alias("tokens"))
    got = rt.siblings(d, spark.createDataFrame([("a",), ("x",)], "query_id string")).collect()
    want = brute_bm25("send mail fast", [(n, t, None) for n, g, t in rows if g == "g" and n != "a"])
    assert [(r.query_id, r.id, r.score) for r in got] == [("a", n, pytest.approx(s)) for n, s in want]


def test_subset_argmax_uses_the_statistics_of_the_subset(spark):
    shown = spark.createDataFrame([(0, "a_mail"), (0, "b_rates"), (1, "c_weather")], "query_id bigint, id string")
    got = rt.best_of_subset(queries(spark, "mail of the day", "mail"), shown, ix.tokens(docs(spark), "name", "text")).collect()
    want = brute_bm25("mail of the day", [r for r in DOCS if r[0] in ("a_mail", "b_rates")])[0]
    assert [(r.query_id, r.id, r.score) for r in got] == [(0, want[0], pytest.approx(want[1]))]


def test_select_without_reranker(spark):
    found = spark.createDataFrame([(0, "b", 2), (0, "a", 1)], "query_id bigint, id string, rank int")
    got = {r.query_id: r for r in rt.select_first(queries(spark, "x", "y"), found).collect()}
    assert got[0].pick == "a" and got[0].confidence is None and [x.name for x in got[0].ranked] == ["a", "b"]
    assert got[1].pick is None and got[1].ranked == []


def test_cached_values_compute_only_misses(spark):
    asked = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "k string, text string")
    values, fresh = ix.cached(asked, spark.createDataFrame([("a", "old")], "k string, v string"), lambda m: m.select("k", F.upper("text").alias("v")))
    assert sorted((r.k, r.v) for r in values.collect()) == [("a", "old"), ("b", "2"), ("b", "2")]
    assert [r.k for r in fresh.collect()] == ["b"]


class TestCatalog:
    def catalog(self, spark):
        c = Catalog(spark)

        @c.register(tags=["weather"])
        def get_weather(city: str, days: int = 1) -> str:
            """Weather forecast for a city.

            Args:
                city: Name of the city
            """
            return f"{city}:{days}"

        c.add({"name": "send_mail", "description": "Send an email message", "tags": ["mail"]})
        c.add({"name": "convert_currency", "description": "Convert money between currencies", "tags": ["finance"]})
        return c

    def test_lifecycle(self, spark, tmp_path):
        c = self.catalog(spark)
        for mode in ("hybrid", "semantic", "keyword"):
            assert c.search("what is the weather forecast", 1, mode)[0]["id"] == "get_weather"
        assert [r["id"] for r in c.search("email message", 3, tags=["finance"])] == ["convert_currency"]
        c.remove("send_mail")
        c.remove("send_mail")
        assert "send_mail" not in {r["id"] for r in c.search("email message", 3)} and len(c) == 2
        c.add({"name": "send_mail", "description": "Post an email message"})
        assert c.search("email message", 1)[0]["id"] == "send_mail"
        assert c.call("get_weather", '{"city": "Oslo"}') == "Oslo:1"
        with pytest.raises(RuntimeError):
            c.call("send_mail", {})
        with pytest.raises(KeyError):
            c.get("nothing")
        tool = c.tools_for("weather forecast", 1)[0]
        assert tool["function"]["name"] == "get_weather" and tool["function"]["parameters"]["required"] == ["city"]
        assert c.answer_search('{"query": "weather forecast", "k": 1}', "mcp")[0]["name"] == "get_weather"
        assert c.best("weather forecast")["pick"] == "get_weather"
        path = str(tmp_path / "c.json")
        c.save(path)
        d = Catalog(spark)
        d.load(path)
        assert [r["name"] for r in d] == [r["name"] for r in c] and d.search("weather forecast", 1)[0]["id"] == "get_weather"

    def test_augmented_text_only_affects_retrieval(self, spark):
        c = Catalog(spark, augment=lambda n: "umbrella rain" if n == "x" else None)
        c.add({"name": "x", "description": "sky"})
        c.add({"name": "y", "description": "ground"})
        assert c.search("umbrella", 1, "keyword")[0]["id"] == "x"
        assert c.tools_for("umbrella", 1, "mcp")[0]["description"] == "sky"

    def test_empty(self, spark):
        assert Catalog(spark).search("x") == []


def test_no_document_beyond_the_depth_is_among_the_best():
    import random

    rng = random.Random(1)
    for k in (1, 3, 5, 10, 20, 31, 40):
        depth = rt.fusion_depth(k)
        assert (depth is None) == (k >= 32)
        n = (depth or 400) + 50
        for _ in range(20):
            keyword = rng.sample(range(1, n + 1), n)
            if rng.random() < 0.5:  # the worst case: first by keyword, late by meaning
                keyword[rng.randrange(n)] = 1
            score = lambda r, limit: round((0.6 / (60 + r) if limit is None or r <= limit else 0.0) + 0.4 / (60 + keyword[r - 1]), 8)
            top = lambda limit: sorted(range(1, n + 1), key=lambda r: (-score(r, limit), r))[:k]
            assert top(None) == top(depth)
    for k in range(1, 32):
        d = rt.fusion_depth(k)
        assert round(0.6 / (60 + d + 1) + 0.4 / 61, 8) < round(0.6 / (60 + k), 8)


def many(n_docs, n_queries, words=40):
    """Documents and queries that all share a word; equal texts and missing ones among them."""
    import random

    rnd = random.Random(3)
    text = lambda n: " ".join(["common", *(f"w{int(rnd.expovariate(0.1)) % words}" for _ in range(n))])
    rows = [(f"t{rnd.randrange(10**6):06d}_{i}", None if i % 97 == 0 else "common w1 w2" if i % 7 == 0 else text(9), [["mail"], ["other", "mail"], ["finance"], None, []][i % 5]) for i in range(n_docs)]
    return rows, [None, "", "common", "no such thing", *(text(3) for _ in range(n_queries - 4))]


def shuffled(spark, df):
    """Rows of the result and MB that were shuffled for it."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    rows = df().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return rows, (written() - before) / 1e6


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


def write_tables(spark, path, rows, texts):
    """The catalog and the drafted cases as the registered queries read them."""
    tags = {"mail": "mailkite", "finance": "ledgerly"}
    tools = [(i, n, t, None, None if g is None else [tags.get(x, x) for x in g], None, {"server": "s"}, None) for i, (n, t, g) in enumerate(rows)]
    spark.createDataFrame(tools, "tool_id bigint, name string, description string, parameters string, tags array<string>, augmented_description string, metadata map<string,string>, loaded_at timestamp").write.parquet(f"{path}/tool_catalog.parquet")
    cases = [(100 * i, t, [rows[i][0]], None, "s", "ok") for i, t in enumerate(texts)]
    spark.createDataFrame(cases, "query_id bigint, query string, expected array<string>, also_accept array<string>, server string, status string").write.parquet(f"{path}/queries_before_review.parquet")


@pytest.mark.parametrize("block", [16_384, 7])
def test_tagged_search_of_many_queries_is_the_search(spark, monkeypatch, block):
    monkeypatch.setattr(rt, "KEYWORD_BLOCK", block)
    rows, texts = many(900, 20)
    d, q = docs(spark, rows).repartition(3), queries(spark, *texts)
    named = d.select(F.col("name").alias("id"), "text", "tags")
    for tags, k in ((["mail"], 10), (["mail", "finance"], 3), (["unknown"], 10)):
        want = rt.search(q, tables(spark, rows), k, tags=tags, embed=embed, dim=ix.DIM).collect()
        got = rt.search_tagged(q, named, tags, k)
        assert got.columns == ["query_id", "id", "rank", "score", "semantic_rank", "keyword_rank"]
        assert plain(got.collect()) == plain(want) and (len(want) == 20 * k or tags == ["unknown"])
    if block > 20:
        # more than fusion_depth knows a limit for: all documents are candidates
        assert plain(rt.search_tagged(q, named, ["mail"], 40).collect()) == plain(rt.search(q, tables(spark, rows), 40, tags=["mail"], embed=embed, dim=ix.DIM).collect())


def test_tagged_search_shuffles_no_table_of_queries_times_documents(spark, tmp_path):
    rows, texts = many(4_000, 200)
    write_tables(spark, tmp_path, rows, texts)
    found, mb = shuffled(spark, lambda: entry.queries()["ret5_tag_filter"](spark, str(tmp_path)))
    assert len(found) == 200 * 10 and mb < 5


@pytest.mark.parametrize("block", [16_384, 7])
def test_keyword_search_of_many_queries_is_bm25_top(spark, monkeypatch, block):
    monkeypatch.setattr(rt, "KEYWORD_BLOCK", block)
    rows, texts = many(900, 20)
    t, q = tables(spark, rows), queries(spark, *texts)
    for some, k in ((rows, 10), (rows, 1), (rows, 1000), ([], 10)):
        t = tables(spark, some)
        got = rt.keyword_top(q, ix.tokens(docs(spark, some).repartition(3), "name", "text"), k)
        want = rt.bm25_top(q, t["postings"], t["df"], t["stats"], k)
        assert got.dtypes == want.dtypes and plain(got.collect()) == plain(want.collect())


def test_comparison_shuffles_no_table_of_queries_times_documents(spark, tmp_path):
    rows, texts = many(4_000, 200)
    write_tables(spark, tmp_path, rows, texts)
    found, mb = shuffled(spark, lambda: entry.queries()["eva5_compare"](spark, str(tmp_path)))
    assert len(found) == 4 and mb < 3
