"""Nested JSON documents as related flat tables.

Every node of a document gets a Dewey label, the path of its ordinals from the root ("1.3.2"); cutting the last ordinal
gives its parent. Nodes of one schema path (the path without array positions) form one table.

Documents may be nested to any depth: what is too deep for the usual parser is read with an explicit stack. A label is as long
as its node is deep, so ``nodes`` goes down ``MAX_DEPTH`` levels, and a node there holds what lies under it as JSON text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}
MAX_DEPTH = 1_000
FLUSH_ROWS = 20_000
FLUSH_CHARS = 8 << 20
_SPACE = re.compile(r"[ \t\n\r]*").match
_SCALAR = re.compile(r"true|false|null|NaN|-?Infinity|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?").match
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
# Schema keywords that lead from one schema to others.
_LISTS = ("anyOf", "oneOf", "allOf")


def loads(text: str):
    """``json.loads`` for any depth."""
    try:
        return json.loads(text)
    except RecursionError:
        return _loads_deep(text)


def _loads_deep(text: str):
    """Reads JSON with a stack of open objects and arrays; a ValueError if it is damaged."""
    def skip(at: int) -> int:
        return _SPACE(text, at).end()

    def fail(at: int):
        raise ValueError(f"damaged JSON at {at}")

    root: list = []
    stack: list = [root]
    keys: list = [None]
    at, want = skip(0), "value"
    while True:
        c = text[at : at + 1]
        if want == "value":
            if c == '"':
                value, at = scanstring(text, at + 1)
            elif c in ("{", "["):
                value, at = ({} if c == "{" else []), at + 1
            elif m := _SCALAR(text, at):
                value, at = json.loads(m.group()), m.end()
            else:
                fail(at)
            top = stack[-1]
            if isinstance(top, list):
                top.append(value)
            else:
                top[keys[-1]] = value
            at, want = skip(at), "next"
            if c in ("{", "["):
                stack.append(value)
                keys.append(None)
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    stack.pop()
                    keys.pop()
                    at = skip(at + 1)
                else:
                    want = "key" if c == "{" else "value"
        elif want == "key":
            if c != '"':
                fail(at)
            keys[-1], at = scanstring(text, at + 1)
            at = skip(at)
            if text[at : at + 1] != ":":
                fail(at)
            at, want = skip(at + 1), "value"
        elif len(stack) == 1:
            return root[0] if at == len(text) else fail(at)
        elif c == ",":
            at, want = skip(at + 1), "key" if isinstance(stack[-1], dict) else "value"
        elif c == ("}" if isinstance(stack[-1], dict) else "]"):
            stack.pop()
            keys.pop()
            at = skip(at + 1)
        else:
            fail(at)


def dumps(value) -> str:
    """``json.dumps`` for any depth, without spaces."""
    out, todo = [], [(False, value)]
    while todo:
        written, v = todo.pop()
        if written:
            out.append(v)
        elif isinstance(v, dict) and v:
            parts = [x for i, (k, y) in enumerate(v.items()) for x in ((True, ("," if i else "{") + json.dumps(k, ensure_ascii=False) + ":"), (False, y))]
            todo += reversed([*parts, (True, "}")])
        elif isinstance(v, list) and v:
            parts = [x for i, y in enumerate(v) for x in ((True, "," if i else "["), (False, y))]
            todo += reversed([*parts, (True, "]")])
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def parse_json(text: str | None, twice: bool = True):
    """Whether the text parses, and its value, which is parsed again if it is a string."""
    if text is None:
        return False, None
    try:
        value = loads(text)
        if twice and isinstance(value, str):
            value = loads(value)
    except ValueError:
        return False, None
    return True, value


def walk(value, most: int | None = None, texts: bool = True) -> Iterator[tuple]:
    """Nodes in document order: Dewey label, depth, key or None, array position or None, schema path, kind, text, the node itself.

    The text is a scalar's value, or the JSON of an object or array at depth ``most``, below which there are no nodes; null
    without ``texts``.
    """
    stack = [("1", 1, None, None, "$", value)]
    while stack:
        dewey, depth, name, position, path, v = stack.pop()
        kind = _KINDS[type(v)]
        inner = v if kind in ("object", "array") and depth != most else ()
        if not texts or kind == "null":
            text = None
        elif kind in ("object", "array"):
            text = dumps(v) if depth == most else None
        else:
            text = v if kind == "string" else json.dumps(v)
        yield dewey, depth, name, position, path, kind, text, v
        if not inner:
            continue
        if kind == "object":
            children = [(f"{dewey}.{i}", depth + 1, k, None, f"{path}/{_escape(k)}", x) for i, (k, x) in enumerate(v.items(), 1)]
        else:
            children = [(f"{dewey}.{i}", depth + 1, None, i - 1, f"{path}[]", x) for i, x in enumerate(v, 1)]
        stack.extend(reversed(children))


def _escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1").replace("[", "~2")


def _flat(source: DataFrame, schema: str, rows_of) -> DataFrame:
    """The rows ``rows_of(text)`` gives for each ``(id, text)``, in batches of bounded size, with the id before them."""
    kind = source.schema["id"].dataType.simpleString()
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    names = [n for n, _ in fields]
    types = [_ARROW[t] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            owner: list[int] = []
            rows: list[tuple] = []

            def batch(whole=whole) -> pa.RecordBatch:
                columns = list(zip(*rows)) or [()] * len(names)
                ids = whole.column(0).take(pa.array(owner, pa.int32()))
                arrays = [pa.array([_clean(x) for x in c] if pa.types.is_string(t) else c, t) for c, t in zip(columns, types)]
                owner.clear()
                rows.clear()
                return pa.RecordBatch.from_arrays([ids, *arrays], ["id", *names])

            chars = 0
            for i, text in enumerate(whole.column(1).to_pylist()):
                for row in rows_of(text):
                    owner.append(i)
                    rows.append(row)
                    chars += sum(len(x) for x in row if isinstance(x, str))
                    if len(rows) >= FLUSH_ROWS or chars > FLUSH_CHARS:
                        yield batch()
                        chars = 0
            yield batch()

    return source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in fields))


def nodes(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """One row per node: ``(id_col, dewey, parent_dewey, depth, name, position, schema_path, kind, value)``.

    Text that is null, empty or damaged has no rows. Of equal keys in one object the last counts. A text that holds a
    JSON string is read once more. A node at depth ``MAX_DEPTH`` has its subtree as JSON in ``value``. There is no shuffle;
    other columns are not read.
    """

    def rows_of(text: str | None) -> Iterator[tuple]:
        ok, value = parse_json(text)
        return (row[:7] for row in walk(value, MAX_DEPTH)) if ok else iter(())

    out = _flat(df.select(df[id_col].alias("id"), df[json_col].alias("text")), "dewey string, depth int, name string, position int, schema_path string, kind string, value string", rows_of)
    parent = F.when(F.instr("dewey", ".") > 0, F.regexp_replace("dewey", r"\.[0-9]+$", ""))
    return out.select(F.col("id").alias(id_col), "dewey", parent.alias("parent_dewey"), "depth", "name", "position", "schema_path", "kind", "value")


def _clean(s):
    return s.encode("utf-8", "replace").decode("utf-8") if isinstance(s, str) and not s.isascii() else s


def tables(labelled: DataFrame, id_col: str) -> DataFrame:
    """The schema paths of all documents with their row counts: the list of the flat tables that the nodes form."""
    return labelled.groupBy("schema_path").agg(
        F.count("*").alias("n_rows"), F.count_distinct(id_col).alias("n_documents"), F.max("depth").alias("depth"), F.array_sort(F.collect_set("kind")).alias("kinds")
    )


def records(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """The rows of all flat tables: ``(id_col, schema_path, dewey, parent_dewey, position, fields map<string,string>)``.

    A row is an object, or an element of an array that is none. ``fields`` holds an object's scalars by key, a null one too,
    or an element's value under an empty key; objects and arrays in it are rows of other tables, linked by the label of
    the nearest row around them, found by cutting labels. ``records`` has no shuffle.
    """

    def rows_of(text: str | None) -> Iterator[tuple]:
        ok, value = parse_json(text)
        open_rows: list[str] = []
        for dewey, _, _, position, path, kind, text_of, v in walk(value, MAX_DEPTH) if ok else ():
            while open_rows and not dewey.startswith(open_rows[-1] + "."):
                open_rows.pop()
            parent = open_rows[-1] if open_rows else None
            if kind == "object" and text_of is None:
                inner = [(k, None if x is None else x if isinstance(x, str) else json.dumps(x)) for k, x in v.items() if not isinstance(x, (dict, list))]
                yield path, dewey, parent, position, [(_clean(k), _clean(x)) for k, x in inner]
                open_rows.append(dewey)
            elif position is not None and kind != "array" or text_of is not None and kind in ("object", "array"):
                yield path, dewey, parent, position, [("", _clean(text_of))]

    out = _flat(df.select(df[id_col].alias("id"), df[json_col].alias("text")), "schema_path string, dewey string, parent_dewey string, position int, fields map<string,string>", rows_of)
    return out.withColumnRenamed("id", id_col)


def table_of(rows: DataFrame, id_col: str, schema_path: str, columns: dict[str, str]) -> DataFrame:
    """The flat table of one schema path: keys to its row and to the row around it, and a typed column for each field named.

    A field that a row lacks, or whose text is not of the type, is null.
    """
    typed = [F.expr(f"try_cast(fields['{k}'] as {t})").alias(k or "value") for k, t in columns.items()]
    return rows.where(F.col("schema_path") == schema_path).select(id_col, "dewey", "parent_dewey", "position", *typed)


def write_tables(rows: DataFrame, path: str) -> None:
    """All flat tables in one pass over ``records``: a folder for each schema path, so that a table is read alone."""
    rows.write.mode("overwrite").partitionBy("schema_path").parquet(path)


_LINKS = "node_path string, parent_path string, dewey string, parent_dewey string, kind string"
_PARAMETER = _LINKS + ", name string, type string, description string, required boolean, default_json string, enum array<string>"


def schema_parameters(df: DataFrame, id_col: str, json_col: str, first_only: bool = False, details: bool = True) -> DataFrame:
    """The parameters of JSON Schemas at any depth, as one flat table: ``(id_col, node_path, parent_path, dewey, parent_dewey,
    kind, name, type, description, required, default_json, enum)``.

    A parameter is an entry of a ``properties`` object reached from the root through ``properties``, ``items``, ``anyOf``,
    ``oneOf`` and ``allOf``. ``node_path`` adds ``/`` and the name for an entry, ``[]`` for ``items`` and ``|i`` for an
    alternative. The labels are those of the document's nodes; ``parent_dewey`` is that of the enclosing parameter, found
    by cutting the label. Texts that do not parse, whose root is no object, or whose root has another ``type`` than
    ``object`` have no rows. Two entries of one path (in two lists of alternatives) are one row each, or one row with
    ``first_only``. Several types are joined by ``|``; ``required`` says whether the schema around it lists it; optional
    fields that are missing or of another kind than JSON Schema has them are null. Without ``details`` the columns end with
    ``kind``.
    """

    def rows_of(text: str | None) -> Iterator[tuple]:
        ok, root = parse_json(text)
        if not ok or not isinstance(root, dict) or root.get("type", "object") != "object":
            return iter(())
        found = _parameters(root, details)
        return iter({x[:2]: x for x in reversed(list(found))}.values()) if first_only else found

    return _flat(df.select(df[id_col].alias("id"), df[json_col].alias("text")), _PARAMETER if details else _LINKS, rows_of).withColumnRenamed("id", id_col)


def _details(name: str, value, around: dict) -> tuple:
    """Name, type, description, required, default and enum of a parameter."""
    schema = value if isinstance(value, dict) else {}
    kinds, about, needed, choices = schema.get("type"), schema.get("description"), around.get("required"), schema.get("enum")
    types = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
    return (
        name, "|".join(types) or None, about if isinstance(about, str) else None, isinstance(needed, list) and name in needed,
        dumps(schema["default"]) if "default" in schema else None, [_clean(x if isinstance(x, str) else dumps(x)) for x in choices] if isinstance(choices, list) else None,
    )


def _parameters(root: dict, details: bool) -> Iterator[tuple]:
    """Walks the labelled nodes once; a node's role follows from its parent's role and its key."""
    schema: dict[str, tuple[str, dict]] = {"1": ("", root)}
    properties: dict[str, tuple[str, dict]] = {}
    alternatives: dict[str, str] = {}
    entry: dict[str, str] = {}
    for dewey, _, name, position, _, kind, _, v in walk(root, texts=False):
        if dewey == "1":
            continue
        parent = dewey[: dewey.rindex(".")]
        if parent in properties:
            base, around = properties[parent]
            path = f"{base}/{name}"
            over = parent
            while "." in over and over not in entry:
                over = over[: over.rindex(".")]
            entry[dewey] = path
            yield path, entry.get(over, ""), dewey, over if over in entry else None, kind, *(_details(name, v, around) if details else ())
            if kind == "object":
                schema[dewey] = path, v
        elif parent in alternatives:
            if kind == "object":
                schema[dewey] = f"{alternatives[parent]}|{position}", v
        elif parent in schema:
            base, around = schema[parent]
            if name == "properties" and kind == "object":
                properties[dewey] = base, around
            elif name == "items" and kind == "object":
                schema[dewey] = base + "[]", v
            elif name in _LISTS and kind == "array":
                alternatives[dewey] = base
