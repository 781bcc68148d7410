"""Records that differ only in formatting: Merkle digests of nested records, grouped and confirmed.

A record is a tree of structs, maps, arrays and leaves. From the bottom up, leaves are normalised (letters and digits, lower
case) and hashed; a node that has no order (a struct, a map, an array unless it is named as ordered) hashes its children's
digests sorted, an array's without repeats; an ordered array hashes them in their order. The root digest names the class of
equal records. Members are compared with their class's keeper in full, so that a digest collision cannot merge records.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators import nested
from siftline.session import materialise

HOT_CLASSES = 4_096
LEAST_HOT = 16_384


def leaf(c: Column) -> Column:
    """Letters and digits of a string, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def merkle(c: Column, kind: T.DataType, ordered: Collection[str] = (), path: str = "") -> tuple[Column, Column]:
    """A node's normalised form and its digest, built from those of its children.

    ``ordered`` names the paths of arrays whose order counts (``field.inner``, with ``[]`` for an array's elements). Null
    elements of an array are dropped, a null array or map is an empty one, a null leaf or struct is different from all others.
    The normalised form has struct fields in the order of names, a map as its entries in order, an unordered array sorted and
    without repeats.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [(f.name, *merkle(c[f.name], f.dataType, ordered, f"{path}.{f.name}".lstrip("."))) for f in fields]
        form = F.struct(*[n.alias(name) for name, n, _ in parts])
        children = F.array(*[F.concat(digest(F.lit(name)), d) for name, _, d in parts])
        node = digest(F.concat(F.lit("{"), F.array_join(F.array_sort(children), ",")))
        return F.when(c.isNotNull(), form), F.when(c.isNull(), digest(F.lit("~"))).otherwise(node)
    if isinstance(kind, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return merkle(F.map_entries(c), entries, ordered, path)
    if isinstance(kind, T.ArrayType):
        some = F.filter(c, lambda x: x.isNotNull())
        node = lambda x: merkle(x, kind.elementType, ordered, path + "[]")
        inside = [F.transform(some, lambda x: node(x)[0]), F.transform(some, lambda x: node(x)[1])]
        if path not in ordered:
            inside = [F.array_sort(F.array_distinct(x)) for x in inside]
        form, digests = inside
        return F.coalesce(form, F.array()), digest(F.concat(F.lit("["), F.coalesce(F.array_join(digests, ","), F.lit(""))))
    text = leaf(c.cast("string"))
    return text, digest(F.coalesce(F.concat(F.lit("="), text), F.lit("~")))


def with_digests(df: DataFrame, fields: dict[str, Column], ordered: Collection[str] = (), named: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds ``canonical`` (the normalised record of ``fields``) and ``root`` (its digest).

    Rows for whose ``canonical`` the condition ``named`` does not hold are left out.
    """
    record = df.withColumn("_record", F.struct(*[c.alias(name) for name, c in fields.items()]))
    form, root = merkle(F.col("_record"), record.schema["_record"].dataType, ordered)
    out = record.withColumn("canonical", form).withColumn("root", root).drop("_record")
    return out if named is None else out.where(named(F.col("canonical")))


def has_query(canonical: Column) -> Column:
    """A case counts if its query has a letter or digit."""
    return F.length(canonical["query"]) > 0


def groups(df: DataFrame, scope: list[str], id_col: str) -> DataFrame:
    """``(scope..., keep_id, n_copies)``: one row per class of same records, ``n_copies`` counting all of its members.

    Members are pre-aggregated before the shuffle, so a class that holds a third of all rows is no hot task.
    """
    return df.groupBy(*scope, "root", "canonical").agg(F.min(id_col).alias("keep_id"), F.count("*").alias("n_copies"))


def copies(df: DataFrame, scope: list[str], id_col: str) -> DataFrame:
    """``(scope..., keep_id, copy_id)``: every record other than its class's smallest id.

    The keepers of classes with more than one member meet the members by digest, and the full comparison confirms each pair.
    A class that holds more than its share of all members (one in ``HOT_CLASSES``, and ``LEAST_HOT``) is cut into parts by
    id, its keeper going to each of them. There can be no more than ``HOT_CLASSES`` such classes, so they are broadcast.
    """
    classes = materialise(groups(df, scope, id_col).where("n_copies > 1"), "classes")
    total = classes.agg(F.coalesce(F.sum("n_copies"), F.lit(0))).first()[0]
    share = max(LEAST_HOT, total // HOT_CLASSES)
    parts = F.ceil(F.col("n_copies") / share)
    hot = F.broadcast(classes.where(F.col("n_copies") > share).select(*scope, "root", F.col("canonical").alias("kept"), parts.alias("parts")))
    keepers = classes.select(*scope, "root", F.col("canonical").alias("kept"), "keep_id", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    members = df.select(*scope, "root", "canonical", F.col(id_col).alias("copy_id"))
    same = [members[c].eqNullSafe(hot[c]) for c in scope] + [members["root"] == hot["root"], members["canonical"] == hot["kept"]]
    cut = members.join(hot, same, "left").select(*[members[c] for c in scope], members["root"], "canonical", "copy_id", F.pmod(F.xxhash64("copy_id"), F.coalesce("parts", F.lit(1))).alias("part"))
    paired = cut.join(keepers, [*scope, "root", "part"]).where((F.col("canonical") == F.col("kept")) & (F.col("copy_id") != F.col("keep_id")))
    return paired.select(*scope, "keep_id", "copy_id")


def parse_cases(lines: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """``(id_col, query, expected)`` of JSON lines; lines that do not parse, or hold no object, are left out.

    A bare string is a list of one; a query that is no string is null; list elements that are no strings are dropped.
    """
    source = lines.select(lines[id_col].alias("id"), lines[line_col].alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, query, expected = [], [], []
            for i, line in enumerate(batch.column(1).to_pylist()):
                try:
                    case = nested.loads(line) if line else None
                except ValueError:
                    continue
                if not isinstance(case, dict):
                    continue
                q, e = case.get("query"), case.get("expected")
                keep.append(i)
                query.append(_text(q))
                expected.append([_text(e)] if isinstance(e, str) else [_text(x) for x in e if isinstance(x, str)] if isinstance(e, list) else [])
            ids = batch.column(0).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(query, pa.string()), pa.array(expected, pa.list_(pa.string()))], ["id", "query", "expected"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, query string, expected array<string>").withColumnRenamed("id", id_col)


def _text(x) -> str | None:
    return x.encode("utf-8", "replace").decode("utf-8") if isinstance(x, str) else None


def case_records(drafts: DataFrame, lines: DataFrame) -> DataFrame:
    """``(tab, id, canonical, root)`` of the drafted cases and of the received lines."""
    case = {"query": F.col("query"), "expected": F.col("expected")}
    a = with_digests(drafts.select(F.lit("queries_before_review").alias("tab"), F.col("query_id").alias("id"), "query", "expected"), case, named=has_query)
    parsed = parse_cases(lines, "line_id", "line")
    b = with_digests(parsed.select(F.lit("case_lines").alias("tab"), F.col("line_id").alias("id"), "query", "expected"), case, named=has_query)
    return a.select("tab", "id", "canonical", "root").unionByName(b.select("tab", "id", "canonical", "root"))
