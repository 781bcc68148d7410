"""Tables of the domain as the queries use them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.session import table

STOP_LIST = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def latest_tools(spark: SparkSession, d: str) -> DataFrame:
    """The catalog: of each name the row loaded last."""
    w = Window.partitionBy("name").orderBy(F.desc_nulls_last("loaded_at"), F.desc("tool_id"))
    return table(spark, d, "tool_catalog").where("name is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return latest_tools(spark, d).withColumn("params", tx.parameter_list("parameters"))


def texts(spark: SparkSession, d: str, augmented: bool = True) -> DataFrame:
    """``(name, text, tags, grp)`` of the catalog."""
    c = catalog(spark, d)
    base = tx.base_text("name", "description", "params", "tags")
    return c.select("name", (tx.embedding_text(base, "augmented_description") if augmented else base).alias("text"), "tags", tx.group_key("metadata", "tags").alias("grp"))


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """The query set of a search: every drafted case whose id is divisible by 100."""
    return table(spark, d, "queries_before_review").where("query_id % 100 = 0").select("query_id", F.col("query").alias("text"))


CATALOG = """
latest AS (
  SELECT * EXCLUDE rn FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY loaded_at DESC NULLS LAST, tool_id DESC) AS rn
    FROM tool_catalog WHERE name IS NOT NULL) WHERE rn = 1),
schema0 AS (SELECT name, CASE WHEN parameters <> '' AND json_valid(parameters) THEN parameters::JSON END AS j FROM latest),
schema1 AS (
  SELECT name, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM schema0),
property AS (
  SELECT s.name, e.key AS pname, e.rowid AS pos,
         CASE WHEN json_type(e.value, '$.description') = 'VARCHAR' THEN e.value->>'$.description' END AS about,
         CASE WHEN json_type(e.value, '$.type') = 'VARCHAR' THEN e.value->>'$.type' END AS kind
  FROM (SELECT name, j FROM schema1 WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.properties') = 'OBJECT') s, json_each(s.j, '$.properties') e),
params AS (
  SELECT name, list({'pname': pname, 'kind': kind, 'description': about} ORDER BY pos) AS params FROM property GROUP BY name)
"""
HUMAN = r"lower(trim(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-.]+', ' ', 'g')))"
TEXTS = (
    CATALOG
    + r""",
based AS (
  SELECT l.name, l.tags, l.metadata, l.description, l.augmented_description, coalesce(p.params, []) AS params,
    concat_ws(chr(10), 'Tool: ' || l.name || ' (' || """
    + HUMAN.format("l.name")
    + r""" || ')', nullif(l.description, ''),
      CASE WHEN len(p.params) > 0 THEN array_to_string(list_transform(p.params, lambda x: regexp_replace('- ' || x.pname || ': ' || coalesce(x.description, ''), '[: ]+$', '')), chr(10)) END,
      CASE WHEN len(l.tags) > 0 THEN 'Tags: ' || array_to_string(l.tags, ', ') END) AS base
  FROM latest l LEFT JOIN params p ON l.name = p.name),
texts AS (
  SELECT name, tags, concat_ws(chr(10), base, nullif(augmented_description, '')) AS text, base,
    coalesce(nullif(metadata['server'], ''), tags[1], '') AS grp FROM based)
"""
)


def tokens_sql(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+'), lambda t: t NOT IN ({STOP_LIST}))"


def words_sql(c: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace(coalesce({c}, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')"
