"""Queries on files, configurations and what calls need: written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import casegen as cg
from siftline.plans import common as c
from siftline.plans.registry import Registry
from siftline.session import shared_dir, table
from siftline.sources import files, formats, servers

R = Registry()


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@R.add("src1_catalog_file", f"WITH {c.CATALOG} SELECT name, description, parameters, array_to_string(tags, '|') AS tags, augmented_description, metadata['server'] AS server FROM latest")
def src1(spark, d):
    """The catalog written as JSON and read again: parameters stay the text they are."""
    path = folder(spark, "catalog")
    files.write_json(c.latest_tools(spark, d).select("name", "description", "parameters", "tags", "augmented_description", "metadata"), path)
    return files.read_catalog(spark, path, lines=True).select("name", "description", "parameters", F.array_join("tags", "|").alias("tags"), "augmented_description", F.col("metadata")["server"].alias("server"))


@R.add(
    "src3_case_file",
    """SELECT query, array_to_string(expected, '|') AS expected, kind, server, confused_with, count(*) AS n FROM queries_before_review WHERE lower(coalesce(status, 'ok')) <> 'dropped' GROUP BY ALL""",
)
def src3(spark, d):
    """Drafted cases written as JSON lines and read again, all but dropped ones."""
    path = folder(spark, "cases")
    rows = table(spark, d, "queries_before_review").select("query", "expected", "kind", "server", "status", "target_original_name", "confused_with", "also_accept", "review_note", "original_query")
    files.write_json(rows, path)
    got = files.read_cases(spark, path, allow_draft=True)
    return got.groupBy("query", F.array_join("expected", "|").alias("expected"), "kind", "server", "confused_with").agg(F.count("*").alias("n"))


@R.add(
    "snk3_run_folders",
    """WITH m AS (SELECT * FROM run_records WHERE condition IS NULL OR condition NOT LIKE 'top%' UNION ALL SELECT * FROM run_records WHERE condition LIKE 'top%' AND i % 2 = 0)
    SELECT condition, count(*) AS n, sum(rec_id)::BIGINT AS ids FROM m GROUP BY condition""",
)
def snk3(spark, d):
    """Run records in a folder for each condition; a second run replaces the folders of its own conditions only."""
    path = folder(spark, "runs")
    rows = table(spark, d, "run_records").select("condition", "rec_id", "i")
    files.write_runs(rows, path)
    files.write_runs(rows.where("condition like 'top%' and i % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("condition").agg(F.count("*").alias("n"), F.sum("rec_id").alias("ids"))


@R.add("src8_usable_configs", "SELECT server_id, name FROM mcp_server_config WHERE name IS NOT NULL AND coalesce(command, '') <> ''")
def src8(spark, d):
    return servers.usable(table(spark, d, "mcp_server_config")).select("server_id", "name")


@R.add("ret14_search_result", """SELECT tool_id, md5('{"name":' || to_json(name) || ',"description":' || to_json(coalesce(description, '')) || ',"parameters":' || coalesce(nullif(parameters, ''), '{"type":"object","properties":{}}') || '}') AS result FROM tool_catalog""")
def ret14(spark, d):
    return table(spark, d, "tool_catalog").select("tool_id", F.md5(formats.result()).alias("result"))


@R.add("gen15_missing_calls", "SELECT count(DISTINCT query) AS n FROM queries_before_review WHERE query NOT IN (SELECT query FROM queries_before_review WHERE query_id % 3 = 0 AND query IS NOT NULL)")
def gen15(spark, d):
    """How many paid calls are to be made when every third case's reply is cached."""
    rows = table(spark, d, "queries_before_review").where("query is not null").select("query_id", tx.cache_key("query").alias("k"))
    return spark.createDataFrame([(cg.require_paid(rows, rows.where("query_id % 3 = 0"), True),)], "n bigint")
