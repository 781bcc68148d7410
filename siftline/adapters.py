"""Found rows as objects of agent frameworks. The frameworks are optional and imported when asked for."""

from __future__ import annotations

import asyncio
import json
from collections.abc import Callable, Sequence

from siftline.functions.text import result_text
from siftline.operators.catalog import Catalog


def by_names(catalog: Catalog, names: Sequence[str]) -> list[dict]:
    """The named rows, each once, in order; unknown names are skipped."""
    return list(catalog.lookup(names).values())


def runner(catalog: Catalog, name: str) -> Callable[..., str]:
    return lambda **arguments: result_text(catalog.call(name, arguments))


async def run_async(catalog: Catalog, name: str, arguments: dict) -> str:
    """A blocking call moved to a thread."""
    return await asyncio.to_thread(lambda: result_text(catalog.call(name, arguments)))


def search_results(catalog: Catalog, query: str, k: int = 5) -> str:
    rows = by_names(catalog, [r["id"] for r in catalog.search(query, k)])
    return json.dumps([{"name": r["name"], "description": r["description"], "parameters": json.loads(r["parameters"])} for r in rows], ensure_ascii=False)


def _framework(module: str, package: str):
    try:
        return __import__(module, fromlist=["_"])
    except ImportError as e:
        raise ImportError(f"this adapter needs the package {package}") from e


def langchain_tools(catalog: Catalog, names: Sequence[str]) -> list:
    tools = _framework("langchain_core.tools", "langchain-core")
    return [tools.StructuredTool.from_function(func=runner(catalog, r["name"]), name=r["name"], description=r["description"], args_schema=json.loads(r["parameters"])) for r in by_names(catalog, names)]


def llamaindex_tools(catalog: Catalog, names: Sequence[str]) -> list:
    tools = _framework("llama_index.core.tools", "llama-index-core")
    return [tools.FunctionTool.from_defaults(fn=runner(catalog, r["name"]), name=r["name"], description=r["description"]) for r in by_names(catalog, names)]


def agents_tools(catalog: Catalog, names: Sequence[str]) -> list:
    agents = _framework("agents", "openai-agents")

    def one(row: dict):
        async def invoke(_context, arguments: str) -> str:
            return await run_async(catalog, row["name"], json.loads(arguments or "{}"))

        return agents.FunctionTool(name=row["name"], description=row["description"], params_json_schema=json.loads(row["parameters"]), on_invoke_tool=invoke, strict_json_schema=False)

    return [one(r) for r in by_names(catalog, names)]


def merge_tools(present: Sequence, more: Sequence) -> list:
    """Both lists without a second object of the same name."""
    names = {getattr(t, "name", None) for t in present}
    return [*present, *(t for t in more if getattr(t, "name", None) not in names)]
