"""Tool servers: configurations, their listing as a data source, and raw rows to catalog rows."""

from __future__ import annotations

import json
import os
import select
import subprocess
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftline.functions import text as tx
from siftline.operators import nested

SERVER = "name string, command string, args array<string>, env map<string,string>, prefix boolean, package string"
RAW = "server string, name string, description string, schema string, error string"


def configurations(data: str | dict | list) -> list[dict]:
    """Configurations from a path or parsed data: a map under ``mcpServers``, a bare map, or a list; url-only ones are skipped."""
    if isinstance(data, str):
        with open(data, encoding="utf-8") as f:
            data = json.load(f)
    if isinstance(data, dict):
        named = data.get("mcpServers", data)
        data = [{"name": n, **c} for n, c in named.items() if isinstance(c, dict)]
    out = []
    for c in data:
        if c.get("command"):
            out.append({"name": c["name"], "command": c["command"], "args": list(c.get("args") or []), "env": dict(c.get("env") or {}), "prefix": c.get("prefix", True), "package": c.get("package")})
    return out


def usable(servers: DataFrame) -> DataFrame:
    """Configurations that can be started: with a name and a command."""
    return servers.where("name is not null and coalesce(command, '') <> ''")


@F.pandas_udf(T.StringType())
def clean_schema(schemas: pd.Series) -> pd.Series:
    """A schema every provider takes: an object at the root, ``properties`` present, no ``$schema``; else the empty one."""

    def one(text):
        try:
            schema = nested.loads(text) if text else {}
        except ValueError:
            schema = {}
        if not isinstance(schema, dict) or schema.get("type", "object") != "object":
            schema = {}
        schema = {"type": "object", **{k: v for k, v in schema.items() if k != "$schema"}}
        schema.setdefault("properties", {})
        try:
            return json.dumps(schema, ensure_ascii=False)
        except RecursionError:
            return nested.dumps(schema)

    return schemas.map(one).astype(object)


def catalog_rows(raw: DataFrame, servers: DataFrame, collected_at: Column | None = None) -> DataFrame:
    """Catalog rows of ``raw(server, name, description, schema)``; ``servers`` has each name once."""
    day = F.coalesce(collected_at if collected_at is not None else F.lit(None), F.date_format(F.current_date(), "yyyy-MM-dd"))
    joined = raw.join(servers.select(F.col("name").alias("server"), "prefix", "package"), "server")
    meta = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("server", F.col("server")), ("package", F.col("package")), ("original_name", F.col("name")), ("collected_at", day))]), lambda e: e["value"].isNotNull()))
    return joined.select(
        tx.clean_name("server", "name", F.col("prefix")).alias("name"), F.regexp_replace(F.coalesce("description", F.lit("")), r"^\s+|\s+$", "").alias("description"), clean_schema("schema").alias("parameters"),
        F.array("server").alias("tags"), F.lit(None).cast("string").alias("augmented_description"), meta.alias("metadata"),
    )


class Session:
    """A server process spoken to in JSON-RPC over its standard streams; every request has ``timeout`` seconds of its own."""

    def __init__(self, server: dict, timeout: float = 120.0):
        self.timeout = timeout
        env = {**os.environ, **(server.get("env") or {})}
        self.process = subprocess.Popen([server["command"], *server.get("args", [])], env=env, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        self.buffer, self.n = b"", 0
        try:
            self.request("initialize", {"protocolVersion": "2024-11-05", "capabilities": {}, "clientInfo": {"name": "siftline", "version": "1"}})
            self.send({"jsonrpc": "2.0", "method": "notifications/initialized"})
        except BaseException:
            self.close()
            raise

    def send(self, message: dict) -> None:
        self.process.stdin.write(json.dumps(message).encode() + b"\n")
        self.process.stdin.flush()

    def line(self, deadline: float) -> bytes:
        while b"\n" not in self.buffer:
            left = deadline - time.monotonic()
            if left <= 0 or not select.select([self.process.stdout], [], [], left)[0]:
                raise TimeoutError("the server did not answer in time")
            more = os.read(self.process.stdout.fileno(), 1 << 16)
            if not more:
                raise ConnectionError("the server ended")
            self.buffer += more
        line, self.buffer = self.buffer.split(b"\n", 1)
        return line

    def request(self, method: str, params: dict) -> dict:
        self.n += 1
        deadline = time.monotonic() + self.timeout
        self.send({"jsonrpc": "2.0", "id": self.n, "method": method, "params": params})
        while True:
            line = self.line(deadline)
            if not line.strip():
                continue
            answer = json.loads(line)
            if answer.get("id") == self.n:
                if "error" in answer:
                    raise RuntimeError(answer["error"].get("message", "error"))
                return answer.get("result", {})

    def tools(self) -> Iterator[dict]:
        """All tools, page by page."""
        cursor = None
        while True:
            page = self.request("tools/list", {"cursor": cursor} if cursor else {})
            yield from page.get("tools", [])
            cursor = page.get("nextCursor")
            if not cursor:
                return

    def call(self, name: str, arguments: dict):
        """A call's structured result, else its text; a tool's own error is raised."""
        result = self.request("tools/call", {"name": name, "arguments": arguments})
        texts = [c.get("text", "") for c in result.get("content", []) if c.get("type") == "text"]
        if result.get("isError"):
            raise RuntimeError("\n".join(texts) or "the tool failed")
        return result["structuredContent"] if result.get("structuredContent") is not None else "\n".join(texts)

    def close(self) -> None:
        self.process.kill()
        self.process.wait()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class _Part(InputPartition):
    def __init__(self, server: dict):
        self.server = server


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.servers = configurations(json.loads(options["servers"]))
        self.timeout = float(options.get("timeout", 120))

    def partitions(self):
        return [_Part(s) for s in self.servers] or [_Part({})]

    def read(self, partition: _Part):
        """A server that fails gives one row with its error and does not end the job."""
        server = partition.server
        if not server:
            return
        try:
            with Session(server, self.timeout) as s:
                for t in s.tools():
                    yield server["name"], t["name"], t.get("description"), json.dumps(t.get("inputSchema") or t.get("input_schema") or {}), None
        except Exception as e:  # noqa: BLE001
            yield server["name"], None, None, None, f"{type(e).__name__}: {e}"[:300]


class ToolServers(DataSource):
    """``spark.read.format("tool_servers").option("servers", json).load()``: one partition per server."""

    @classmethod
    def name(cls) -> str:
        return "tool_servers"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def list_servers(spark: SparkSession, servers: list[dict], timeout: float = 120.0) -> DataFrame:
    spark.dataSource.register(ToolServers)
    return spark.read.format("tool_servers").option("servers", json.dumps(servers)).option("timeout", str(timeout)).load()
