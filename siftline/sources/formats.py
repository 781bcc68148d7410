"""Schema formats of tool-calling interfaces: export and import as column expressions. Parameters stay verbatim JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_SCHEMA = '{"type":"object","properties":{}}'
FORMATS = ("openai", "anthropic", "mcp")
_PARAMETERS = {"openai": "parameters", "anthropic": "input_schema", "mcp": "inputSchema"}


def quote(c: Column) -> Column:
    """A string as JSON."""
    return F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def export(fmt: str) -> Column:
    """The definition of a row with ``name, description, parameters`` in one of ``FORMATS``; no parameters give an empty schema."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    body = F.concat(
        F.lit('{"name":'), quote(F.col("name")), F.lit(',"description":'), quote(F.coalesce("description", F.lit(""))),
        F.lit(f',"{_PARAMETERS[fmt]}":'), F.coalesce(F.nullif(F.col("parameters"), F.lit("")), F.lit(EMPTY_SCHEMA)), F.lit("}"),
    )
    return F.concat(F.lit('{"type":"function","function":'), body, F.lit("}")) if fmt == "openai" else body


def result() -> Column:
    """A row as an agent reads it in a search result."""
    return F.concat(F.lit('{"name":'), quote(F.col("name")), F.lit(',"description":'), quote(F.coalesce("description", F.lit(""))), F.lit(',"parameters":'), F.coalesce(F.nullif(F.col("parameters"), F.lit("")), F.lit(EMPTY_SCHEMA)), F.lit("}"))


def imported(c: Column | str, fmt: str) -> tuple[Column, Column, Column]:
    """Name, description and parameters of a definition in one of ``FORMATS`` (for openai with or without its wrapper)."""
    j = F.col(c) if isinstance(c, str) else c
    if fmt == "openai":
        j = F.coalesce(F.get_json_object(j, "$.function"), j)
    description = F.coalesce(F.get_json_object(j, "$.description"), F.lit(""))
    return F.get_json_object(j, "$.name"), description, F.coalesce(F.get_json_object(j, f"$.{_PARAMETERS[fmt]}"), F.lit(EMPTY_SCHEMA))
