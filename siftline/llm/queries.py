"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import budget, duplicates, neighbours, packing, pii, spans
from siftline.llm.encode import encode
from siftline.session import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(table(spark, d, "embedding_cache"), "vec_id", "model", "v")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.mutual_pairs(p1_neighbours(spark, d))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    tools = table(spark, d, "tool_catalog")
    parts = [tools.select(F.lit("tool_catalog").alias("tab"), F.col("tool_id").alias("rec_id"), F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("description", "augmented_description")]
    drafts = table(spark, d, "queries_before_review")
    parts.append(drafts.select(F.lit("queries_before_review").alias("tab"), F.col("query_id").alias("rec_id"), F.lit("query").alias("field_name"), F.col("query").alias("text")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_stretches(_fields(spark, d))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """For each field with shared stretches, how many of its characters are shared."""
    return p2_found(spark, d).groupBy("tab", "rec_id", "field_name").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("n_shared"), F.count("*").alias("n_stretches"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    records = duplicates.case_records(table(spark, d, "queries_before_review"), table(spark, d, "case_lines"))
    return duplicates.copies(records, ["tab"], "id")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each case once, with the number of its copies."""
    records = duplicates.case_records(table(spark, d, "queries_before_review"), table(spark, d, "case_lines"))
    return duplicates.groups(records, ["tab"], "id").select("tab", "keep_id", "n_copies")


def p4_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return budget.catalog_budget(table(spark, d, "tool_catalog"), table(spark, d, "mcp_server_config"))


def p4_tool_tokens(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens each text of each tool has."""
    return budget.text_tokens(table(spark, d, "tool_catalog"), "tool_id", ["description", "parameters"])


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", packing.read_specs(table(spark, d, "pack_specs")))


def _pii_parts(spark: SparkSession, d: str) -> tuple[set[str], set[str]]:
    given, surnames = pii.known_parts(table(spark, d, "name_parts"))
    return pii.learn_parts(table(spark, d, "documents"), "doc_id", "text", given, surnames)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    spans = pii.find(table(spark, d, "documents"), "doc_id", "text", *_pii_parts(spark, d))
    # distinct within a document, so without a shuffle
    return spans.select("doc_id", F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(s.kind, s.mention)))).alias("s")).select(
        "doc_id", F.col("s.kind").alias("pii_type"), F.col("s.mention").alias("mention")
    )


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    out = pii.find(table(spark, d, "documents"), "doc_id", "text", *_pii_parts(spark, d), with_text=True)
    return out.select("doc_id", F.col("redacted").alias("text"), F.size("spans").alias("n_mentions"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p2_found": p2_found, "p2_shares": p2_shares, "p3_found": p3_found, "p3_groups": p3_groups, "p4_token_budget": p4_token_budget, "p4_tool_tokens": p4_tool_tokens, "p7_containers": p7_containers, "p6_ids": p6_ids, "p8_found": p8_found, "p8_redacted": p8_redacted}


NORMAL = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
CASES_SQL = f"""l AS (SELECT line_id, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM case_lines),
    r AS (SELECT 'queries_before_review' AS tab, query_id AS id, query AS q, coalesce(expected, []) AS e FROM queries_before_review
      UNION ALL SELECT 'case_lines', line_id, CASE WHEN json_type(j, '$.query') = 'VARCHAR' THEN j->>'$.query' END,
        CASE WHEN json_type(j, '$.expected') = 'VARCHAR' THEN [j->>'$.expected'] WHEN json_type(j, '$.expected') = 'ARRAY' THEN list_transform(list_filter((j->'$.expected')::JSON[], lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') ELSE [] END FROM l WHERE json_type(j) = 'OBJECT'),
    k AS (SELECT tab, id, {NORMAL.format('q')} AS q, list_sort(list_distinct(list_transform(list_filter(e, lambda x: x IS NOT NULL), lambda x: {NORMAL.format('x')}))) AS e FROM r),
    g AS (SELECT tab, q, e, min(id) AS keep_id, count(*) AS n_copies FROM k WHERE q <> '' GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {CASES_SQL} SELECT tab, keep_id, id AS copy_id FROM k JOIN g USING (tab, q, e) WHERE id <> keep_id",
        "p3_groups": f"WITH {CASES_SQL} SELECT tab, keep_id, n_copies FROM g",
    }
