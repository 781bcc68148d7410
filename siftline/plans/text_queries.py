"""Queries on text functions (scalar projections)."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.plans import common as c
from siftline.plans.registry import Registry
from siftline.session import table

R = Registry()


@R.add("txt1_tokenize", f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {c.tokens_sql('text')} AS t FROM documents)")
def txt1(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@R.add("txt2_split_words", f"SELECT doc_id, len(t)::BIGINT AS n_words, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {c.words_sql('text')} AS t FROM documents)")
def txt2(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.split_words("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_words"), F.md5(F.array_join("t", " ")).alias("digest"))


FEATURES_SQL = """list_transform(w, lambda x: 'w:' || x) ||
  CASE WHEN len(w) > 1 THEN list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda z: 'b:' || z[1] || '_' || z[2]) ELSE [] END ||
  flatten(list_transform(w, lambda x: list_transform(range(1, len(x) + 1), lambda i: 'c:' || substr('#' || x || '#', i, 3))))"""


@R.add("txt3_hash_features", f"SELECT doc_id, len(f)::BIGINT AS n_features, md5(array_to_string(f, ' ')) AS digest FROM (SELECT doc_id, {FEATURES_SQL} AS f FROM (SELECT doc_id, {c.words_sql('text')} AS w FROM documents))")
def txt3(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.split_words("text").alias("w")).select("doc_id", tx.hash_features(F.col("w")).alias("f"))
    return t.select("doc_id", F.size("f").cast("bigint").alias("n_features"), F.md5(F.array_join("f", " ")).alias("digest"))


@R.add("txt4_humanise", f"SELECT tool_id, {c.HUMAN.format('name')} AS human FROM tool_catalog")
def txt4(spark, d):
    return table(spark, d, "tool_catalog").select("tool_id", tx.humanise("name").alias("human"))


@R.add("txt5_base_text", f"WITH {c.TEXTS} SELECT name, md5(base) AS base, md5(text) AS embedded, length(text)::BIGINT AS n_chars FROM texts")
def txt5(spark, d):
    rows = c.catalog(spark, d).withColumn("base", tx.base_text("name", "description", "params", "tags"))
    text = tx.embedding_text("base", "augmented_description")
    return rows.select("name", F.md5("base").alias("base"), F.md5(text).alias("embedded"), F.length(text).cast("bigint").alias("n_chars"))


@R.add(
    "txt6_clean_name",
    """SELECT tool_id, left(regexp_replace(coalesce(metadata['server'], 'none') || '__' || name, '[^a-zA-Z0-9_-]', '_', 'g'), 64) AS with_server,
    left(regexp_replace(name, '[^a-zA-Z0-9_-]', '_', 'g'), 64) AS bare FROM tool_catalog""",
)
def txt6(spark, d):
    server = F.coalesce(F.col("metadata")["server"], F.lit("none"))
    return table(spark, d, "tool_catalog").select("tool_id", tx.clean_name(server, "name").alias("with_server"), tx.clean_name(server, "name", F.lit(False)).alias("bare"))


@R.add(
    "txt8_option_text",
    f"""WITH {c.TEXTS}, flat AS (SELECT name, params, replace(regexp_replace(coalesce(description, ''), '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM based),
    cut AS (SELECT name, params, CASE WHEN length(t) > 120 THEN regexp_replace(left(t, 120), ' [^ ]*$', '') || '...' ELSE t END AS t FROM flat)
    SELECT name, CASE WHEN len(params) > 0 THEN t || ' (arguments: ' || array_to_string(list_transform(params, lambda p: p.pname), ', ') || ')' ELSE t END AS option FROM cut""",
)
def txt8(spark, d):
    return c.catalog(spark, d).select("name", tx.option_text("description", "params", 120).alias("option"))


DESCRIBE_SQL = """'name: ' || name || chr(10) || 'description: ' || left(coalesce(description, ''), 600) || chr(10) || 'parameters: ' ||
  coalesce(nullif(array_to_string(list_transform(params[1:8], lambda p: p.pname || ': ' || left(coalesce(nullif(p.description, ''), p.kind, ''), 80)), ', '), ''), '(none)')"""


@R.add("txt9_describe", f"WITH {c.TEXTS} SELECT name, {DESCRIBE_SQL} AS shown FROM based")
def txt9(spark, d):
    return c.catalog(spark, d).select("name", tx.describe("name", "description", "params").alias("shown"))


@R.add(
    "txt11_strip_fences",
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(s, '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g'), '^```(?:json)?{tx.SPACE}*', ''), '{tx.SPACE}*```$', '')) AS body
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(10) || '```json' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10) ELSE ' ' || coalesce(text, '') || ' ' END AS s FROM documents)""",
)
def txt11(spark, d):
    """Whole texts, half of them fenced, the others as they are, with the fences that some of them have."""
    text = F.coalesce("text", F.lit(""))
    s = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n```json\n"), text, F.lit("\n```\n"))).otherwise(F.concat(F.lit(" "), text, F.lit(" ")))
    return table(spark, d, "documents").select("doc_id", F.md5(tx.strip_fences(s)).alias("body"))


@R.add(
    "txt12_model_family",
    """SELECT spelled, coalesce(nullif(regexp_extract(lower(regexp_extract(bare, '([^/]*)$', 1)), '^[a-z]+'), ''), lower(bare)) AS family, n FROM (
      SELECT spelled, CASE WHEN starts_with(spelled, 'llm:') THEN regexp_replace(substr(spelled, 5), ':[^:]*$', '') ELSE spelled END AS bare, n FROM (
        SELECT CASE vec_id % 3 WHEN 0 THEN 'vendor/' || model || '-v2' WHEN 1 THEN 'llm:vendor/' || model || ':ab12cd34' ELSE upper(model) END AS spelled, count(*) AS n
        FROM embedding_cache GROUP BY 1))""",
)
def txt12(spark, d):
    k, m = F.col("vec_id") % 3, F.col("model")
    spelled = F.when(k == 0, F.concat(F.lit("vendor/"), m, F.lit("-v2"))).when(k == 1, F.concat(F.lit("llm:vendor/"), m, F.lit(":ab12cd34"))).otherwise(F.upper(m))
    counted = table(spark, d, "embedding_cache").groupBy(spelled.alias("spelled")).agg(F.count("*").alias("n"))
    return counted.select("spelled", tx.model_family("spelled").alias("family"), "n")


@R.add("txt13_token_estimate", "SELECT doc_id, floor(length(coalesce(text, '')) / 4)::BIGINT AS tokens FROM documents")
def txt13(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_estimate("text").alias("tokens"))


@R.add(
    "txt14_cache_key",
    """SELECT tool_id, sha256(concat_ws(chr(31), 'augment', name, description)) AS key,
    left(sha256(concat_ws(chr(31), coalesce('=' || name, '-'), coalesce('=' || description, '-'), coalesce('=' || parameters, '-'), coalesce('=' || array_to_string(tags, ','), '-'))), 16) AS row_hash FROM tool_catalog""",
)
def txt14(spark, d):
    return table(spark, d, "tool_catalog").select(
        "tool_id", tx.cache_key(F.lit("augment"), "name", "description").alias("key"), tx.row_hash("name", "description", "parameters", F.array_join("tags", ",")).alias("row_hash")
    )


@R.add("txt14_content_hash")
def txt14_compatible(spark, d):
    return table(spark, d, "tool_catalog").select("tool_id", tx.content_hash("name", "description", "parameters", "tags").alias("content_hash"))


@R.add(
    "txt16_list_hash",
    """WITH h AS (SELECT tool_id, coalesce(metadata['server'], '') AS server, left(sha256(concat_ws(chr(31), coalesce('=' || name, '-'), coalesce('=' || description, '-'))), 16) AS h FROM tool_catalog)
    SELECT server, left(sha256(string_agg(h, '|' ORDER BY tool_id)), 16) AS list_hash, count(*) AS n FROM h GROUP BY server""",
)
def txt16(spark, d):
    """Order-sensitive hash of a list of rows. The list is one condition's tools: as long as a request can be."""
    rows = table(spark, d, "tool_catalog").select("tool_id", F.coalesce(F.col("metadata")["server"], F.lit("")).alias("server"), tx.row_hash("name", "description").alias("h"))
    held = rows.groupBy("server").agg(F.array_sort(F.collect_list(F.struct("tool_id", "h"))).alias("hs"), F.count("*").alias("n"))
    return held.select("server", F.substring(F.sha2(F.array_join(F.transform("hs", lambda x: x["h"]), "|"), 256), 1, 16).alias("list_hash"), "n")


@R.add("txt17_group_key", "SELECT tool_id, coalesce(nullif(metadata['server'], ''), tags[1], '') AS grp FROM tool_catalog")
def txt17(spark, d):
    return table(spark, d, "tool_catalog").select("tool_id", tx.group_key("metadata", "tags").alias("grp"))
