import json
import os
import sys
import textwrap
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Literal, Optional

import pytest
from pyspark.sql import functions as F

from siftline import adapters, factories, reports
from siftline.operators import casegen as cg
from siftline.operators import index as ix
from siftline.operators import nested
from siftline.operators import rerank as rr
from siftline.operators.catalog import Catalog
from siftline.serve import Proxy, start_upstreams
from siftline.session import clean, materialise, numbered, shared_dir
from siftline.sources import files, formats, functions, servers, stores
from siftline.streaming.delta import IndexStore, apply_changes, follow

SERVER = textwrap.dedent(
    """
    import json, sys
    TOOLS = [{"name": "echo.it", "description": " Echo text back ", "inputSchema": {"type": "object", "properties": {"t": {"type": "string"}}}},
             {"name": "fail", "description": "Always fails", "inputSchema": None}, {"name": "add", "inputSchema": {"type": "string"}}]
    for line in sys.stdin:
        m = json.loads(line)
        if "id" not in m:
            continue
        p = m.get("params") or {}
        if m["method"] == "initialize":
            r = {}
        elif m["method"] == "tools/list":
            at = int(p.get("cursor") or 0)
            r = {"tools": TOOLS[at:at + 2], **({"nextCursor": str(at + 2)} if at + 2 < len(TOOLS) else {})}
        elif p["name"] == "fail":
            r = {"isError": True, "content": [{"type": "text", "text": "broken"}]}
        elif p["name"] == "add":
            r = {"structuredContent": {"sum": 3}, "content": []}
        else:
            r = {"content": [{"type": "text", "text": p["arguments"]["t"]}]}
        print(json.dumps({"jsonrpc": "2.0", "id": m["id"], "result": r}), flush=True)
    """
)


@pytest.fixture
def configs(tmp_path):
    path = tmp_path / "server.py"
    path.write_text(SERVER)
    return [{"name": "s", "command": sys.executable, "args": [str(path)], "env": {}, "prefix": True, "package": "pkg"}, {"name": "bad", "command": "/no/such/program", "args": [], "env": {}, "prefix": True, "package": None}]


def test_functions_become_rows():
    def f(self, a: int, b: Optional[list[str]] = None, c: Literal["x", "y"] = "x", *rest, d: dict = {}, **more):
        """Does it.

        In two lines.

        Args:
            a (int): first
              and more
            b: second
        Returns:
            c: nothing
        """

    row = functions.from_function(f, tags=["t"])
    assert row["description"] == "Does it.\n\nIn two lines." and row["tags"] == ["t"]
    assert json.loads(row["parameters"]) == {
        "type": "object",
        "properties": {"a": {"type": "integer", "description": "first and more"}, "b": {"type": "array", "items": {"type": "string"}, "default": None, "description": "second"}, "c": {"enum": ["x", "y"], "default": "x"}, "d": {"type": "object"}},
        "required": ["a"],
    }


def test_formats_invert_each_other(spark):
    schema = '{"z": 1,  "a": {"type":"object"}}'
    df = spark.createDataFrame([("n", 'say "x"\n', schema), ("m", None, None)], "name string, description string, parameters string")
    for fmt in formats.FORMATS:
        out = df.select(formats.export(fmt).alias("j"))
        assert schema in out.first().j and json.loads(out.first().j)
        n, about, p = formats.imported("j", fmt)
        got = out.select(n.alias("n"), about.alias("d"), p.alias("p")).collect()
        assert (got[0].n, got[0].d, json.loads(got[0].p)) == ("n", 'say "x"\n', json.loads(schema)) and got[1].d == ""
    with pytest.raises(ValueError):
        formats.export("other")


def test_case_files(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"query":"a","expected":"x","status":"ok"}\n\n{"query":"b","expected":["y","z"],"status":"draft","extra":1}\n  \n{"query":"c","expected":["z"]}\n{"query":"d","status":"dropped"}\n')
    got = [(r.uid, r.query, r.expected) for r in files.read_cases(spark, str(path)).orderBy("uid").collect()]
    assert got == [(0, "a", ["x"]), (2, "c", ["z"])]
    assert [r.uid for r in files.read_cases(spark, str(path), True).orderBy("uid").collect()] == [0, 1, 2]


def test_run_files(spark, tmp_path):
    path = tmp_path / "runs"
    path.mkdir()
    (path / "runs.a.jsonl").write_text('{"condition":"c","i":0,"correct":0}\n{"condition":"c","i":0,"correct":1}\n{"condition":"c","i":1,"correct":0}\n')
    got = {(r.condition, r.i): r.correct for r in files.read_runs(spark, str(path)).collect()}
    assert got == {("c", 0): 1, ("c", 1): 0}
    out = str(tmp_path / "out")
    files.write_runs(spark.createDataFrame([("a", 1), ("b", 1)], "condition string, v int"), out)
    files.write_runs(spark.createDataFrame([("b", 2)], "condition string, v int"), out)
    assert {(r.condition, r.v) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 2)}
    files.write_scores(spark.createDataFrame([("hit", 0.5)], "metric string, value double"), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == [{"metric": "hit", "value": 0.5}]


def test_partial_runs_do_not_relabel_a_summary():
    old = {"m": {"n": 97, "conditions": {"a": 1}}}
    assert files.merge_summary(old, {"m": {"n": 3, "conditions": {"b": 2}}}, 3) == {"m": {"n": 97, "conditions": {"a": 1, "b": 2}}}
    assert files.merge_summary(old, {"m": {"n": 99, "conditions": {"b": 2}}}, None)["m"]["n"] == 99


def test_configurations(tmp_path):
    data = {"mcpServers": {"a": {"command": "x", "args": ["1"]}, "b": {"url": "http://x"}}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(data))
    assert [c["name"] for c in servers.configurations(str(path))] == ["a"]
    assert [c["name"] for c in servers.configurations(data["mcpServers"])] == ["a"]
    assert servers.configurations([{"name": "z", "command": "y", "prefix": False}])[0]["prefix"] is False


def test_listing_isolates_failures(spark, configs):
    raw = servers.list_servers(spark, configs, 20).persist()
    assert sorted(r.name for r in raw.where("error is null").collect()) == ["add", "echo.it", "fail"]
    assert [r.server for r in raw.where("error is not null").collect()] == ["bad"]
    rows = {r.name: r for r in servers.catalog_rows(raw.where("error is null"), spark.createDataFrame(configs, servers.SERVER), F.lit("2026-01-02")).collect()}
    assert set(rows) == {"s__echo_it", "s__fail", "s__add"}
    assert rows["s__echo_it"].description == "Echo text back" and rows["s__echo_it"].metadata == {"server": "s", "package": "pkg", "original_name": "echo.it", "collected_at": "2026-01-02"}
    assert json.loads(rows["s__add"].parameters) == {"type": "object", "properties": {}}


def test_proxy(spark, configs):
    catalog, warned = Catalog(spark), []
    owners = start_upstreams(configs, catalog, warned.append, 20)
    try:
        assert set(owners) == {"s__echo_it", "s__fail", "s__add"} and len(warned) == 1
        proxy = Proxy(catalog, owners)
        ask = lambda p, m, **params: p.handle({"jsonrpc": "2.0", "id": 1, "method": m, "params": params})
        assert [t["name"] for t in ask(proxy, "tools/list")[0]["result"]["tools"]] == ["search_tools", "call_tool"]
        found = json.loads(ask(proxy, "tools/call", name="search_tools", arguments={"query": "echo text", "k": 1})[0]["result"]["content"][0]["text"])
        assert found[0]["name"] == "s__echo_it"
        call = lambda n, a: ask(proxy, "tools/call", name="call_tool", arguments={"name": n, "arguments": a})[0]["result"]
        assert call("s__echo_it", {"t": "hi"})["content"][0]["text"] == "hi" and json.loads(call("s__add", {})["content"][0]["text"]) == {"sum": 3}
        assert call("s__fail", {})["isError"] and call("nothing", {})["isError"]
        dynamic = Proxy(catalog, owners, "dynamic", ["s__add"])
        answers = ask(dynamic, "tools/call", name="search_tools", arguments={"query": "echo text", "k": 1})
        assert answers[1]["method"] == "notifications/tools/list_changed"
        assert [t["name"] for t in ask(dynamic, "tools/list")[0]["result"]["tools"]] == ["search_tools", "s__add", "s__echo_it"]
        assert ask(dynamic, "no/such")[0]["error"]["code"] == -32601 and proxy.handle({"method": "x"}) == []
    finally:
        for session, _ in owners.values():
            session.close()


def test_every_request_has_its_own_time(configs):
    with servers.Session(configs[0], 1.5) as session:
        for _ in range(3):
            time.sleep(0.8)
            assert session.call("echo.it", {"t": "hi"}) == "hi"


SLOW = "import time\nfor line in __import__('sys').stdin:\n    time.sleep(60)\n"


def test_a_silent_server_runs_out_of_time(tmp_path):
    (tmp_path / "slow.py").write_text(SLOW)
    with pytest.raises(TimeoutError):
        servers.Session({"name": "x", "command": sys.executable, "args": [str(tmp_path / "slow.py")]}, 0.5)


def test_a_draft_pays_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def complete(prompt):
        (calls / uuid.uuid4().hex).write_text(prompt)
        return None if "bad" in prompt else prompt.upper()

    asked = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "bad"), ("d", "two")], "name string, prompt string")
    cache = str(tmp_path / "cache")
    got, fresh = cg.replies(asked, files.read_cache(spark, cache), complete, "m")
    assert len(list(calls.iterdir())) == 3
    fresh.write.mode("append").parquet(cache)
    for _ in range(2):
        assert {r.name: r.reply for r in got.collect()} == {"a": "ONE", "b": "ONE", "c": None, "d": "TWO"}
    assert len(list(calls.iterdir())) == 3
    got, fresh = cg.replies(asked, files.read_cache(spark, cache), complete, "m")
    assert fresh.count() == 0 and {r.reply for r in got.collect()} == {"ONE", "TWO", None} and len(list(calls.iterdir())) == 4  # only what failed
    assert files.read_cache(spark, None).count() == 0


def test_requests_are_sent_and_errors_surface(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            if "slow" in body:
                time.sleep(2)
            self.send_response(503 if "bad" in body else 200)
            self.end_headers()
            self.wfile.write(b"overloaded" if "bad" in body else json.dumps({"got": body, "key": self.headers["Authorization"]}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        send = rr.http_sender(f"http://127.0.0.1:{server.server_port}/", "k", 0.7)
        bodies = spark.createDataFrame([(1, "{}"), (2, "bad"), (3, "slow"), (4, None)], "query_id bigint, body string")
        got = {r.query_id: (r.body, r.error) for r in rr.send_requests(bodies, send).collect()}
    finally:
        server.shutdown()
    assert json.loads(got[1][0]) == {"got": "{}", "key": "Bearer k"} and got[1][1] is None
    assert got[2] == (None, "HTTP 503: overloaded") and got[3][0] is None and "no answer" in got[3][1] and got[4] == (None, None)


def test_reports_and_scores_have_all_rows(spark, tmp_path):
    many = spark.range(0, 12_000, 1, 3).selectExpr("id as line", "'error' as severity", "'r' as rule", "'x' as detail")
    assert len(reports.collect(many, ("line",))) == 12_000
    text, errors = reports.lint_text(many)
    assert errors == 12_000 and len(text.splitlines()) == 12_002
    files.write_scores(many, str(tmp_path / "m.json"))
    assert len(json.loads((tmp_path / "m.json").read_text())) == 12_000
    files.write_scores(many.limit(0), str(tmp_path / "n.json"))
    assert json.loads((tmp_path / "n.json").read_text()) == []


def test_rows_are_numbered_in_order(spark):
    df = spark.range(1000, 0, -1, 7).selectExpr("id", "id % 10 as k")
    got = numbered(df, "k", "id").collect()
    assert sorted((r.uid, r.k, r.id) for r in got) == [(i, k, x) for i, (k, x) in enumerate(sorted((x % 10, x) for x in range(1, 1001)))]
    assert numbered(df.limit(0), "id").count() == 0


def test_written_tables_are_deleted_when_asked(spark):
    t = materialise(spark.range(5).toDF("id"))
    assert t.count() == 5
    folder = shared_dir(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    clean(spark)
    assert not os.path.isdir(folder)
    assert materialise(spark.range(5).toDF("id")).count() == 5


def test_a_store_in_tables_keeps_the_contract(spark):
    store = stores.TableStore(spark)
    assert isinstance(store, stores.VectorStore) and store.count() == 0
    items = lambda *rows: spark.createDataFrame(list(rows), stores.ITEMS)
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 2.0])], "query_id bigint, v array<double>")
    assert store.search(queries, 3).count() == 0
    store.upsert(items(("a", [3.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", None), (None, [1.0, 0.0])))
    store.upsert(items(("b", [-1.0, 0.0]), ("e", [0.0, 0.0])))
    store.delete(ids("c", "gone"))
    assert store.count() == 3 and sorted(r.id for r in store.contained(ids("a", "a", "c", "e")).collect()) == ["a", "e"]
    got = {(r.query_id, r.rank): (r.id, r.score) for r in store.search(queries, 2).collect()}
    assert got[(1, 1)] == ("a", 0.995037) and [got[(2, r)][0] for r in (1, 2)] == ["a", "b"] and len(got) == 4


def test_items_are_sent_in_batches(spark, tmp_path):
    def connect():
        def write(names, vectors):
            assert len(names) <= stores.SEND_ROWS
            for n, v in zip(names, vectors):
                (tmp_path / n).write_text(json.dumps(v))

        return write

    items = spark.range(0, 1200, 1, 2).selectExpr("cast(id as string) as id", "array(cast(id as double), 1.0) as v")
    assert stores.send_items(items, connect) == 1200
    assert len(list(tmp_path.iterdir())) == 1200 and json.loads((tmp_path / "7").read_text()) == [7.0, 1.0]
    assert stores.send_items(items.limit(0), connect) == 0


def test_texts_are_embedded_in_batches_and_put_in_order(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            data = [{"index": i, "embedding": [float(len(t)), float(len(texts) <= 128)]} for i, t in enumerate(texts)]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": data[::-1]}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = spark.range(0, 300, 1, 2).selectExpr("id", "if(id = 5, null, repeat('x', cast(id as int))) as text")
        got = {r.id: r.v for r in factories.embedded(rows, "id", "text", factories.http_embedder(f"http://127.0.0.1:{server.server_port}/", "m")).collect()}
    finally:
        server.shutdown()
    assert len(got) == 300 and got[5] == [0.0, 1.0]
    assert all(abs(got[i][0] - i / (i * i + 1) ** 0.5) < 1e-12 for i in range(300) if i != 5)
    zero = factories.embedded(rows.where("id < 3"), "id", "text", lambda texts: [[0.0, 0.0]] * len(texts)).collect()
    assert all(r.v == [0.0, 0.0] for r in zero)


def test_adapters(spark):
    c = Catalog(spark)

    @c.register
    def pair(a: int, b: int) -> list:
        """Adds a pair."""
        return [a, b]

    assert [r["name"] for r in adapters.by_names(c, ["pair", "gone", "pair"])] == ["pair"]
    assert adapters.runner(c, "pair")(a=1, b=2) == "[1, 2]"
    assert json.loads(adapters.search_results(c, "add pair", 1))[0]["name"] == "pair"
    with pytest.raises(ImportError, match="langchain"):
        adapters.langchain_tools(c, ["pair"])
    assert adapters.merge_tools([], []) == []


def test_factories(spark):
    q = spark.createDataFrame([(1, "a b")], "query_id bigint, text string")
    assert max(factories.embedder("hashing:64")(q).first().buckets) < 64
    with pytest.raises(ValueError):
        factories.embedder("remote:x")
    assert factories.picker("first")("q", [{"name": "n"}])["pick"] == "n"
    assert factories.picker("mine:3", {"mine": lambda a: a}) == "3"


def test_reports(spark):
    assert reports.text_table([{"a": 1, "b": 0.5}, {"a": None, "b": 2.0}]) == "a  b\n1  0.5000\n   2.0000"
    assert reports.markdown([{"a": 1}]) == "| a |\n|---|\n| 1 |" and reports.text_table([]) == ""
    text, errors = reports.lint_text(spark.createDataFrame([("error", "status", 3, "draft"), ("warning", "thin_group", None, "g")], "severity string, rule string, line bigint, detail string"))
    assert errors == 1 and text.endswith("1 errors, 1 warnings")


CHANGES = "name string, text string, hash string, removed boolean, seq bigint"


def test_stream_of_changes_equals_rebuild(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "index")
    batches = [
        [("a", "send mail", "1", False, 1), ("b", "read inbox", "2", False, 2), ("c", "weather", "3", False, 3)],
        [("a", "send mail", "1", False, 4), ("b", "new words", "5", False, 5), ("c", None, None, True, 6), ("d", "old", "7", False, 7), ("d", "day rates", "8", False, 8)],
    ]
    store = IndexStore(spark, path)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(str(source / f"b{n}"))
        stream = spark.readStream.schema(CHANGES).parquet(str(source / "*"))
        follow(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    final = spark.createDataFrame([("a", "send mail"), ("b", "new words"), ("d", "day rates")], "id string, text string")
    want = ix.postings(ix.tokens(final, "id", "text"))
    now = store.read()
    assert sorted(now["postings"].collect()) == sorted(want.collect())
    assert sorted(now["vectors"].collect()) == sorted(ix.hash_vectors(final, "id", "text").collect())
    assert sorted(r.id for r in now["lengths"].collect()) == ["a", "b", "d"]
    apply_changes(store, spark.createDataFrame([("z", "x", "9", False, 9)], CHANGES), 1)  # a batch that runs again
    assert store.read()["rows"].count() == 3
    # a version without its marker is not there: a job that failed before the end
    (tmp_path / "index" / "batch-7").mkdir()
    assert store.read()["rows"].count() == 3 and store.batches() == [0, 1]
    for n in (2, 3):
        apply_changes(store, spark.createDataFrame([(f"z{n}", "x", "9", False, 9)], CHANGES), n)
    assert store.batches() == [2, 3] and store.read()["rows"].count() == 5 and not (tmp_path / "index" / "batch-0").exists()


SCHEMAS = [
    (1, '{"type":"object","properties":{"a":{"type":"array","items":{"properties":{"b":{"anyOf":[{"type":"null"},{"properties":{"c":5}}]}}}},"x/y":{}}}'),
    (2, json.dumps('{"properties":{"d":{"oneOf":[{"properties":{"e":true}}]}}}')), (3, '{"type":"string","properties":{"f":{}}}'), (4, "[1]"), (5, '{"a":'), (6, None), (7, ""), (8, '{"properties":[1],"allOf":[{"properties":{"g":{}}},7]}'),
    (9, '{"patternProperties":{"h":{"properties":{"i":{}}}}}'),
]


def test_schema_parameters(spark):
    df = spark.createDataFrame([(*r, "clash") for r in SCHEMAS], "tool_id bigint, parameters string, dewey string")
    got = {(r.tool_id, r.node_path, r.parent_path) for r in nested.schema_parameters(df, "tool_id", "parameters").collect()}
    assert got == {(1, "/a", ""), (1, "/a[]/b", "/a"), (1, "/a[]/b|1/c", "/a[]/b"), (1, "/x/y", ""), (2, "/d", ""), (2, "/d|0/e", "/d"), (8, "|0/g", "")}
    assert nested.schema_parameters(df.limit(0), "tool_id", "parameters").count() == 0
    twice = spark.createDataFrame([(1, '{"anyOf":[{"properties":{"a":{}}}],"oneOf":[{"properties":{"a":{}}}]}')], "tool_id bigint, parameters string")
    assert nested.schema_parameters(twice, "tool_id", "parameters").count() == 2 and nested.schema_parameters(twice, "tool_id", "parameters", True).count() == 1


def test_nodes_rebuild_the_document(spark, tmp_path):
    doc = {"a": [1, {"b": None, "c": [True, "x"]}, []], "d/e": {}, "f": 1.5, "g": "é"}
    rows = nested.nodes(spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, '"x"')], "id bigint, j string"), "id", "j").collect()
    assert {r.id for r in rows} == {1}  # a string that holds no JSON is damaged
    by = {r.dewey: r for r in rows}
    assert all(r.parent_dewey == (r.dewey.rpartition(".")[0] or None) and (r.parent_dewey in by or r.dewey == "1") for r in rows)

    def build(dewey):
        r = by[dewey]
        children = sorted((x for x in rows if x.parent_dewey == dewey), key=lambda x: int(x.dewey.rpartition(".")[2]))
        if r.kind == "object":
            return {x.name: build(x.dewey) for x in children}
        if r.kind == "array":
            return [build(x.dewey) for x in children]
        return None if r.kind == "null" else r.value if r.kind == "string" else json.loads(r.value)

    assert build("1") == doc
    labelled = nested.nodes(spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(doc))], "id bigint, j string"), "id", "j")
    paths = {r.schema_path: (r.n_rows, r.n_documents) for r in nested.tables(labelled, "id").collect()}
    assert paths["$/a[]"] == (6, 2) and paths["$/a[]/c[]"] == (4, 2) and paths["$/d~1e"] == (2, 2)
    rows = nested.records(spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(doc))], "id bigint, j string"), "id", "j")
    got = sorted((r.schema_path, r.dewey, r.parent_dewey, r.position, tuple(sorted((k, v) for k, v in r.fields.items()))) for r in rows.where("id = 1").collect())
    assert got == [("$", "1", None, None, (("f", "1.5"), ("g", "é"))), ("$/a[]", "1.1.1", "1", 0, (("", "1"),)), ("$/a[]", "1.1.2", "1", 1, (("b", None),)), ("$/a[]/c[]", "1.1.2.2.1", "1.1.2", 0, (("", "true"),)), ("$/a[]/c[]", "1.1.2.2.2", "1.1.2", 1, (("", "x"),)), ("$/d~1e", "1.2", "1", None, ())]
    flat = nested.table_of(rows, "id", "$", {"f": "double", "g": "string", "gone": "int"}).where("id = 2").first()
    assert (flat.f, flat.g, flat.gone, flat.dewey) == (1.5, "é", None, "1")
    out = str(tmp_path / "tables")
    nested.write_tables(rows, out)
    assert spark.read.parquet(out).where("schema_path = '$/a[]/c[]'").count() == 4


def test_parameters_have_typed_columns(spark):
    doc = '{"required":["a",5],"properties":{"a":{"type":["string","null"],"description":"x","enum":["p",1,null],"default":{"k":[]}},"b":true,"c":{"type":7,"description":[]}}}'
    got = {r.name: r for r in nested.schema_parameters(spark.createDataFrame([(1, doc)], "id bigint, j string"), "id", "j").collect()}
    assert (got["a"].type, got["a"].description, got["a"].required, got["a"].default_json, got["a"].enum) == ("string|null", "x", True, '{"k":[]}', ["p", "1", "null"])
    assert all((got[n].type, got[n].description, got[n].required, got[n].default_json, got[n].enum) == (None, None, False, None, None) for n in "bc")


def test_documents_of_any_depth(spark):
    """100,000 arrays in one another: nodes down to the depth of the longest label, with the rest as text."""
    deep = "[" * 100_000 + "]" * 100_000
    assert nested.dumps(nested.loads(deep)) == deep
    rows = nested.nodes(spark.createDataFrame([(1, deep), (2, "[[1]]"), (3, deep[:-1]), (4, deep + "]")], "id bigint, j string"), "id", "j")
    got = {r.id: (r.n, r.deepest) for r in rows.groupBy("id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).collect()}
    assert got == {1: (nested.MAX_DEPTH, nested.MAX_DEPTH), 2: (3, 3)}
    last = rows.where(f"id = 1 and depth = {nested.MAX_DEPTH}").first()
    assert last.value == "[" * (100_001 - nested.MAX_DEPTH) + "]" * (100_001 - nested.MAX_DEPTH) and last.kind == "array"
    # every parameter, at any depth
    n = 3_000
    schema = '{"properties":{"p":' * n + "{}" + "}}" * n
    found = nested.schema_parameters(spark.createDataFrame([(1, schema)], "id bigint, j string"), "id", "j")
    assert found.count() == n and found.agg(F.max(F.length("node_path"))).first()[0] == 2 * n
    assert nested.records(spark.createDataFrame([(1, schema), (2, None), (3, "")], "id bigint, j string"), "id", "j").where("id > 1").count() == 0


def test_the_explicit_parser_reads_what_the_usual_one_reads():
    for text in ('{"a": [1, -2.5e3, true, false, null, "\\u00e9\\n", {}, [ ]], "b" : {"c":{"d":[[]]}}, "a": 2}', " 7 ", '"x"', "[]", "{}", "NaN", "[-Infinity]"):
        assert repr(nested._loads_deep(text)) == repr(json.loads(text))
    for text in ("", "{", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "[1}", "01", "tru", '{a:1}', '["x]', "[]]"):
        with pytest.raises(ValueError):
            nested._loads_deep(text)
    odd = {"k": ["é", 1.5, {"x": []}, None, True], "": {}}
    assert json.loads(nested.dumps(odd)) == odd
