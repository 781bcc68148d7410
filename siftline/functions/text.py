"""Column functions on catalog text. All but ``parameter_list`` and ``content_hash`` stay in the JVM."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.nested import loads

# Words that keyword search leaves out.
STOP_WORDS = (
    "a an the of to for in on and or is are be with by from at as it this that what how do does can i me my you your please"
).split()
# types, not a type string: workers import this module too, and have no session to parse one
PARAMETERS = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("pname", "kind", "description")]))
CACHE_SEPARATOR = 31
# White space of any script, as one set for all engines.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, also cut where a capital follows; without stop words. Null gives none."""
    spaced = F.lower(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"))
    return F.filter(F.regexp_extract_all(spaced, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def split_words(c: Column | str) -> Column:
    """As ``tokenize``, but a digit before a capital does not cut, and stop words stay."""
    spaced = F.lower(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "([a-z])([A-Z])", "$1 $2"))
    return F.regexp_extract_all(spaced, F.lit("[a-z0-9]+"), F.lit(0))


def hash_features(words: Column) -> Column:
    """Words, pairs of neighbouring words, and the 3-grams of ``#word#``, marked by kind."""
    n = F.size(words)
    singles = F.transform(words, lambda w: F.concat(F.lit("w:"), w))
    pairs = F.when(
        n > 1,
        F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b)),
    ).otherwise(F.array().cast("array<string>"))
    grams = F.flatten(
        F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.lit("c:"), F.substring(F.concat(F.lit("#"), w, F.lit("#")), i, F.lit(3)))))
    )
    return F.concat(singles, pairs, grams)


def humanise(name: Column | str) -> Column:
    spaced = F.regexp_replace(_c(name), "([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(spaced, r"[_\-.]+", " ")))


@F.pandas_udf(PARAMETERS)
def parameter_list(parameters: pd.Series) -> pd.Series:
    """Top-level properties of a JSON Schema in document order; none if the text does not parse (a string is read again)."""

    def one(text):
        try:
            schema = loads(text) if text else None
            if isinstance(schema, str):
                schema = loads(schema)
        except ValueError:
            return []
        properties = schema.get("properties") if isinstance(schema, dict) else None
        if not isinstance(properties, dict):
            return []
        out = []
        for name, p in properties.items():
            p = p if isinstance(p, dict) else {}
            kind, about = p.get("type"), p.get("description")
            out.append({"pname": name, "kind": kind if isinstance(kind, str) else None, "description": about if isinstance(about, str) else None})
        return out

    return parameters.map(one)


def base_text(name: Column | str, description: Column | str, params: Column | str, tags: Column | str) -> Column:
    """The text a catalog row is found by: name, description, parameters and tags, one line each; absent ones leave no line."""
    lines = F.transform(_c(params), lambda p: F.regexp_replace(F.concat(F.lit("- "), p["pname"], F.lit(": "), F.coalesce(p["description"], F.lit(""))), "[: ]+$", ""))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Tool: "), _c(name), F.lit(" ("), humanise(name), F.lit(")")),
        F.nullif(_c(description), F.lit("")),
        F.when(F.size(lines) > 0, F.array_join(lines, "\n")),
        F.when(F.size(_c(tags)) > 0, F.concat(F.lit("Tags: "), F.array_join(_c(tags), ", "))),
    )


def embedding_text(base: Column | str, augmented: Column | str) -> Column:
    return F.concat_ws("\n", _c(base), F.nullif(_c(augmented), F.lit("")))


def clean_name(server: Column | str, name: Column | str, prefix: Column | None = None) -> Column:
    full = F.concat(_c(server), F.lit("__"), _c(name))
    joined = full if prefix is None else F.when(F.coalesce(prefix, F.lit(True)), full).otherwise(_c(name))
    return F.substring(F.regexp_replace(joined, "[^a-zA-Z0-9_-]", "_"), 1, 64)


def option_text(description: Column | str, params: Column | str, max_chars: int = 400) -> Column:
    """One line, cut at the last space before ``max_chars`` with an ellipsis, followed by the argument names."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(_c(description), F.lit("")), r"^\s+|\s+$", ""), "\n", " ")
    cut = F.when(F.length(flat) > max_chars, F.concat(F.regexp_replace(F.substring(flat, 1, max_chars), " [^ ]*$", ""), F.lit("..."))).otherwise(flat)
    names = F.array_join(F.transform(_c(params), lambda p: p["pname"]), ", ")
    return F.when(F.size(_c(params)) > 0, F.concat(cut, F.lit(" (arguments: "), names, F.lit(")"))).otherwise(cut)


def describe(name: Column | str, description: Column | str, params: Column | str) -> Column:
    """A row as a drafting prompt shows it: 600 characters of description, eight parameters of 80 characters each."""
    shown = F.transform(
        F.slice(_c(params), 1, 8),
        lambda p: F.concat(p["pname"], F.lit(": "), F.substring(F.coalesce(F.nullif(p["description"], F.lit("")), p["kind"], F.lit("")), 1, 80)),
    )
    return F.concat(
        F.lit("name: "), _c(name), F.lit("\ndescription: "), F.substring(F.coalesce(_c(description), F.lit("")), 1, 600),
        F.lit("\nparameters: "), F.coalesce(F.nullif(F.array_join(shown, ", "), F.lit("")), F.lit("(none)")),
    )


def strip_fences(c: Column | str) -> Column:
    """Without white space around it, and then without a code fence around it and the white space inside that."""
    trimmed = F.regexp_replace(_c(c), rf"\A{SPACE}+|{SPACE}+\z", "")
    return F.regexp_replace(F.regexp_replace(trimmed, rf"\A```(?:json)?{SPACE}*", ""), rf"{SPACE}*```\z", "")


def model_family(model: Column | str) -> Column:
    """``vendor/model-4.1-mini`` gives ``model``; the ``llm:...:hash`` form of augmenter names is unwrapped first."""
    m = _c(model)
    bare = F.when(m.startswith("llm:"), F.regexp_replace(F.substring(m, 5, 1 << 20), ":[^:]*$", "")).otherwise(m)
    letters = F.regexp_extract(F.lower(F.regexp_extract(bare, "([^/]*)$", 1)), "^[a-z]+", 0)
    return F.coalesce(F.nullif(letters, F.lit("")), F.lower(bare))


def token_estimate(*texts: Column | str) -> Column:
    total = sum((F.length(F.coalesce(_c(t), F.lit(""))) for t in texts), F.lit(0))
    return F.floor(total / 4)


def cache_key(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(chr(CACHE_SEPARATOR), *[_c(p) for p in parts]), 256)


@F.pandas_udf(T.StringType())
def content_hash(name: pd.Series, description: pd.Series, parameters: pd.Series, tags: pd.Series) -> pd.Series:
    """16 hex digits of SHA-256 over the row as JSON with sorted keys; text that is no JSON counts as a string."""

    def one(n, d, p, t):
        try:
            schema = json.loads(p) if p is not None else None
        except (ValueError, RecursionError):
            schema = p
        payload = json.dumps([n, d, schema, [] if t is None else list(t)], sort_keys=True)
        return hashlib.sha256(payload.encode()).hexdigest()[:16]

    return pd.Series([one(*x) for x in zip(name, description, parameters, tags)], dtype=object)


def row_hash(*columns: Column | str) -> Column:
    """A hash of a row's content that stays in the JVM; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), _c(c).cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.sha2(F.concat_ws(chr(CACHE_SEPARATOR), *parts), 256), 1, 16)


def group_key(metadata: Column | str, tags: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(metadata)["server"], F.lit("")), F.get(_c(tags), F.lit(0)), F.lit(""))


def result_text(value) -> str:
    """A call's result as text: a string as it is, else JSON, else its ``str``."""
    if isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except (TypeError, ValueError):
        return str(value)
