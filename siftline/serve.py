"""A tool server in front of many: search over all their tools, calls forwarded to the owner. JSON-RPC on standard streams.

In mode ``search`` two tools are listed, one that searches and one that calls. In mode ``dynamic`` the listed tools are the
search tool, the pinned ones and those the last search found; a change of the list is announced.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Sequence
from typing import IO

from siftline.operators.catalog import SEARCH_TOOL, Catalog
from siftline.sources.servers import Session

SEARCH, CALL = "search_tools", "call_tool"
CALL_TOOL = {
    "name": CALL,
    "description": "Calls a tool that a search has found.",
    "inputSchema": {"type": "object", "properties": {"name": {"type": "string"}, "arguments": {"type": "object"}}, "required": ["name"]},
}


class Proxy:
    def __init__(self, catalog: Catalog, owners: dict[str, tuple[Session, str]], mode: str = "search", pinned: Sequence[str] = (), k: int = 5):
        """``owners`` gives for each catalog name the session that owns it and its name there."""
        if mode not in ("search", "dynamic"):
            raise ValueError(f"unknown mode {mode!r}")
        self.catalog, self.owners, self.mode, self.k = catalog, owners, mode, k
        self.pinned, self.found = [n for n in pinned if n in owners], []

    def definitions(self, names: Sequence[str]) -> list[dict]:
        """The listed form of rows; one read for all of them."""
        return [{"name": n, "description": r["description"], "inputSchema": json.loads(r["parameters"])} for n, r in self.catalog.lookup(names).items()]

    def listed(self) -> list[dict]:
        search = SEARCH_TOOL
        first = {"name": SEARCH, "description": search["description"], "inputSchema": search["parameters"]}
        if self.mode == "search":
            return [first, CALL_TOOL]
        # reserved names shadow tools of the same name
        return [first, *self.definitions([n for n in [*self.pinned, *self.found] if n != SEARCH])]

    def call(self, name: str, arguments: dict) -> tuple[object, bool]:
        """The result, and whether the list of tools has changed."""
        if name == SEARCH:
            names = [r["id"] for r in self.catalog.search(arguments["query"], int(arguments.get("k", self.k)))]
            changed = self.mode == "dynamic" and names != self.found
            self.found = names
            return self.definitions(names), changed
        if name == CALL and self.mode == "search":
            name, arguments = arguments["name"], arguments.get("arguments") or {}
        if name not in self.owners:
            raise KeyError(f"unknown tool {name!r}")
        session, original = self.owners[name]
        return session.call(original, arguments), False

    def handle(self, message: dict) -> list[dict]:
        """Answers to one message: at most a response and a notification."""
        method, params, key = message.get("method"), message.get("params") or {}, message.get("id")
        if key is None:
            return []
        try:
            if method == "initialize":
                result, extra = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {"listChanged": self.mode == "dynamic"}}, "serverInfo": {"name": "siftline", "version": "1"}}, []
            elif method == "tools/list":
                result, extra = {"tools": self.listed()}, []
            elif method == "tools/call":
                try:
                    value, changed = self.call(params["name"], params.get("arguments") or {})
                    result = {"content": [{"type": "text", "text": value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)}]}
                    extra = [{"jsonrpc": "2.0", "method": "notifications/tools/list_changed"}] * changed
                except Exception as e:  # noqa: BLE001 - a tool's failure is its result
                    result, extra = {"content": [{"type": "text", "text": str(e)}], "isError": True}, []
            elif method == "ping":
                result, extra = {}, []
            else:
                return [{"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"unknown method {method}"}}]
        except Exception as e:  # noqa: BLE001
            return [{"jsonrpc": "2.0", "id": key, "error": {"code": -32603, "message": str(e)}}]
        return [{"jsonrpc": "2.0", "id": key, "result": result}, *extra]

    def run(self, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
        for line in source:
            if line.strip():
                for answer in self.handle(json.loads(line)):
                    sink.write(json.dumps(answer) + "\n")
                    sink.flush()


def start_upstreams(servers: list[dict], catalog: Catalog, warn: Callable[[str], None] = lambda m: print(m, file=sys.stderr), timeout: float = 120.0) -> dict[str, tuple[Session, str]]:
    """Starts the servers and adds their tools to the catalog; one that fails is reported and left out."""
    import re

    owners: dict[str, tuple[Session, str]] = {}
    for server in servers:
        try:
            session = Session(server, timeout)
            for t in session.tools():
                full = f"{server['name']}__{t['name']}" if server.get("prefix", True) else t["name"]
                name = re.sub(r"[^a-zA-Z0-9_-]", "_", full)[:64]
                if name in (SEARCH, CALL):
                    continue
                schema = t.get("inputSchema") or {"type": "object", "properties": {}}
                catalog.add({"name": name, "description": (t.get("description") or "").strip(), "parameters": schema, "tags": [server["name"]], "metadata": {"server": server["name"], "original_name": t["name"]}})
                owners[name] = (session, t["name"])
        except Exception as e:  # noqa: BLE001
            warn(f"{server.get('name')}: {type(e).__name__}: {e}")
    return owners
