"""Queries on data-set jobs, linting, sources, sinks, reranking and catalog access."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import text as tx
from siftline.operators import casegen as cg
from siftline.operators import catalog as ct
from siftline.operators import index as ix
from siftline.operators import rerank as rr
from siftline.operators import retrieve as rt
from siftline.plans import common as c
from siftline.plans.registry import Registry
from siftline.plans.retrieval_queries import TOOL_DOCS, bm25_sql, index
from siftline.plans.text_queries import DESCRIBE_SQL
from siftline.session import materialise, numbered, table
from siftline.sources import files, formats, servers

R = Registry()


@R.add(
    "gen1_stratified_sample",
    f"""WITH {c.TEXTS}, g AS (SELECT grp, count(*) AS size FROM texts GROUP BY grp), t AS (SELECT sum(size) AS total FROM g),
    s AS (SELECT grp, size, least(size, greatest(least(2, size), round_even(100.0::DOUBLE * size / total, 0)::BIGINT)) AS k FROM g, t),
    r AS (SELECT name, grp, row_number() OVER (PARTITION BY grp ORDER BY md5('7:' || name), name) AS rn FROM texts)
    SELECT r.grp, r.name FROM r JOIN s USING (grp) WHERE rn <= k""",
)
def gen1(spark, d):
    return cg.stratified_sample(c.texts(spark, d).select("grp", "name"), "grp", "name", 100).select("grp", "name")


def drafts(spark, d):
    """Replies as a drafter would give them, built from the drafted cases: some fenced, some broken, some with invented siblings."""
    rows = table(spark, d, "queries_before_review").where("query is not null and size(expected) > 0")
    known = F.array_distinct(F.concat(F.filter(F.array("confused_with"), lambda x: x.isNotNull()), F.coalesce("also_accept", F.array().cast("array<string>"))))
    body = F.to_json(
        F.struct(
            F.array("query", F.upper("query")).alias("direct"),
            F.struct(F.lower("query").alias("query"), F.when(F.col("query_id") % 3 == 0, F.lit("invented")).otherwise(F.col("confused_with")).alias("confused_with")).alias("confusable"),
            F.struct(F.col("query").alias("query"), F.get("also_accept", F.lit(0)).alias("also")).alias("multi"),
        )
    )
    k = F.col("query_id") % 5
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("no "), body)).otherwise(body)
    return rows.select("query_id", F.get("expected", F.lit(0)).alias("name"), reply.alias("reply"), known.alias("siblings"))


@R.add(
    "gen2_draft_rows",
    """WITH dr AS (SELECT query_id, query, expected[1] AS name, list_distinct(list_filter([confused_with], lambda x: x IS NOT NULL) || coalesce(also_accept, [])) AS siblings,
      CASE WHEN query_id % 3 = 0 THEN 'invented' ELSE confused_with END AS cw, also_accept[1] AS also FROM queries_before_review WHERE query IS NOT NULL AND len(expected) > 0 AND query_id % 5 <> 1)
    SELECT name, query, [name] AS expected, 'direct' AS kind, NULL::VARCHAR AS confused_with FROM dr UNION ALL SELECT name, upper(query), [name], 'direct', NULL FROM dr
    UNION ALL SELECT name, lower(query), [name], 'confusable', CASE WHEN list_contains(siblings, cw) THEN cw END FROM dr WHERE query <> ''
    UNION ALL SELECT name, query, [name, also], 'multi', NULL FROM dr WHERE query <> '' AND list_contains(siblings, also)""",
)
def gen2(spark, d):
    return cg.drafted_rows(drafts(spark, d).select("name", "reply", "siblings"))


@R.add(
    "gen3_generation_prompts",
    f"""WITH {c.TEXTS}, {bm25_sql("SELECT name AS id, base AS text FROM texts")}, shown AS (SELECT name, {DESCRIBE_SQL} AS shown FROM based),
    sib AS (SELECT q.query_id, string_agg(shown, chr(10) || chr(10) ORDER BY rank) AS s FROM (SELECT query_id FROM queries_before_review WHERE query_id % 100 = 0) q LEFT JOIN kw USING (query_id) LEFT JOIN shown ON shown.name = kw.id WHERE kw.rank <= 3 GROUP BY q.query_id)
    SELECT query_id, md5(s) AS siblings, length(s)::BIGINT AS n_chars FROM sib""",
)
def gen3(spark, d):
    """What a drafting prompt shows as siblings, here the three best rows for a query."""
    docs = materialise(c.texts(spark, d, augmented=False), "texts")
    tok = ix.tokens(docs, "name", "text")
    post = ix.postings(tok)
    found = rt.bm25_top(c.search_queries(spark, d), post, ix.document_frequency(post), ix.statistics(ix.lengths(tok)), 3)
    shown = c.catalog(spark, d).select(F.col("name").alias("id"), tx.describe("name", "description", "params").alias("shown"))
    held = found.join(shown, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "shown"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["shown"]), "\n\n")
    return held.select("query_id", F.md5(text).alias("siblings"), F.length(text).cast("bigint").alias("n_chars"))


@R.add(
    "gen3_cached_replies",
    """WITH r AS (SELECT query_id, query FROM queries_before_review WHERE query IS NOT NULL), c AS (SELECT DISTINCT query FROM r WHERE query_id % 2 = 0)
    SELECT query_id::VARCHAR AS name, CASE WHEN c.query IS NOT NULL THEN 'cached ' || r.query WHEN contains(r.query, '?') THEN NULL ELSE 'fresh ' || r.query END AS reply FROM r LEFT JOIN c ON c.query = r.query""",
)
def gen3_replies(spark, d):
    """Replies for all prompts: cached ones are reused, each missing one is asked for once, failures give null."""
    rows = table(spark, d, "queries_before_review").where("query is not null").select(F.col("query_id").cast("string").alias("name"), F.col("query").alias("prompt"))
    cache = rows.where("cast(name as bigint) % 2 = 0").select(tx.cache_key(F.lit("draft"), F.lit("echo"), F.sha2("prompt", 256)).alias("k"), F.concat(F.lit("cached "), "prompt").alias("v")).dropDuplicates(["k"])
    out, _ = cg.replies(rows, cache, lambda p: None if "?" in p else f"fresh {p}", "echo")
    return out


LINES = "lines AS (SELECT query_id AS line, * FROM queries_before_review WHERE lower(coalesce(status, 'ok')) <> 'dropped')"


def lines(spark, d):
    return table(spark, d, "queries_before_review")


def one_rule(spark, d, f):
    rows = lines(spark, d).where(F.lower(F.coalesce("status", F.lit("ok"))) != "dropped").withColumn("line", F.col("query_id"))
    return f(rows)


@R.add("gen4_lint_unknown", f"WITH {LINES} SELECT line, name FROM (SELECT line, unnest(coalesce(expected, []) || coalesce(also_accept, [])) AS name FROM lines) x ANTI JOIN tool_catalog t ON t.name = x.name")
def gen4(spark, d):
    return one_rule(spark, d, lambda r: cg.unknown_tools(r, c.latest_tools(spark, d)).select("line", "name"))


@R.add("gen5_lint_duplicates", f"WITH {LINES} SELECT line, first_line FROM (SELECT line, min(line) OVER (PARTITION BY lower(trim(query))) AS first_line FROM lines WHERE query IS NOT NULL) WHERE line > first_line")
def gen5(spark, d):
    return one_rule(spark, d, cg.duplicates)


@R.add("gen6_lint_status", f"WITH {LINES} SELECT line, status FROM lines WHERE lower(coalesce(status, 'ok')) <> 'ok'")
def gen6(spark, d):
    return one_rule(spark, d, cg.not_reviewed)


@R.add(
    "gen7_lint_leakage",
    f"""WITH {c.CATALOG}, {LINES}, q AS (SELECT line, expected[1] AS name, list_filter({c.tokens_sql('query')}, lambda t: length(t) > 2) AS w FROM lines WHERE query IS NOT NULL),
    k AS (SELECT name, {c.tokens_sql("concat_ws(' ', name, description)")} AS own, CASE WHEN augmented_description <> '' THEN {c.tokens_sql('augmented_description')} END AS aug FROM latest),
    s AS (SELECT line, 'text' AS source, len(list_filter(w, lambda t: list_contains(own, t))) / len(w) AS share FROM q JOIN k USING (name) WHERE len(w) > 0
      UNION ALL SELECT line, 'augmented', len(list_filter(w, lambda t: list_contains(aug, t))) / len(w) FROM q JOIN k USING (name) WHERE len(w) > 0 AND aug IS NOT NULL)
    SELECT line, source, round(share, 6) AS share FROM s WHERE share >= 0.3""",
)
def gen7(spark, d):
    return one_rule(spark, d, lambda r: cg.leakage(r, c.latest_tools(spark, d), 0.3).withColumn("share", F.round("share", 6)))


@R.add("gen8_lint_thin_groups", f"WITH {LINES} SELECT coalesce(server, '?') AS grp, count(*) AS n FROM lines GROUP BY 1 HAVING count(*) < 12")
def gen8(spark, d):
    return one_rule(spark, d, lambda r: cg.thin_groups(r, 12))


@R.add(
    "gen9_same_family",
    "SELECT a.model AS generator, b.model AS augmenter, regexp_extract(lower(a.model), '^[a-z]+') = regexp_extract(lower(b.model), '^[a-z]+') AS same FROM (SELECT DISTINCT model FROM embedding_cache) a, (SELECT DISTINCT model FROM embedding_cache) b",
)
def gen9(spark, d):
    m = table(spark, d, "embedding_cache").select("model").distinct()
    a, b = m.select(F.col("model").alias("generator"), F.lit(1).alias("one")), m.select(F.col("model").alias("augmenter"), F.lit(1).alias("one"))
    return a.join(b, "one").select("generator", "augmenter", cg.same_family(F.col("generator"), F.col("augmenter")).alias("same"))


@R.add(
    "gen10_lint_totals",
    """WITH k AS (SELECT * FROM queries_before_review WHERE lower(coalesce(status, 'ok')) <> 'dropped')
    SELECT 'kept' AS what, '' AS value, count(*) AS n FROM k UNION ALL SELECT 'dropped', '', count(*) FROM queries_before_review WHERE lower(coalesce(status, 'ok')) = 'dropped'
    UNION ALL SELECT 'catalog', '', count(DISTINCT name) FROM tool_catalog UNION ALL SELECT 'kind', coalesce(kind, 'direct'), count(*) FROM k GROUP BY 2 UNION ALL SELECT 'group', coalesce(server, '?'), count(*) FROM k GROUP BY 2""",
)
def gen10(spark, d):
    return cg.totals(lines(spark, d), c.latest_tools(spark, d))


@R.add(
    "gen11_random_subset",
    f"""WITH {c.CATALOG}, nm AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS place FROM latest WHERE name IS NOT NULL), t AS (SELECT count(*) AS total FROM nm),
    p AS (SELECT total, (SELECT min(x) FROM range(total, total + 500) r(x) WHERE NOT EXISTS (SELECT 1 FROM range(2, 10000) q(y) WHERE y * y <= x AND x % y = 0)) AS prime FROM t),
    cs AS (SELECT query_id, list_distinct(coalesce(expected, [])) AS expected, ('0x' || md5('start:7:' || query_id || ':10')[:8])::BIGINT AS a, ('0x' || md5('step:7:' || query_id || ':10')[:8])::BIGINT AS b FROM queries_before_review),
    e AS (SELECT query_id, name FROM (SELECT query_id, unnest(expected) AS name FROM cs) SEMI JOIN nm USING (name)),
    w AS (SELECT query_id, expected, total, j, (a % prime + j * (b % (prime - 1) + 1)) % prime AS place FROM (SELECT *, unnest(range(0, 10 + prime - total + len(expected))) AS j FROM cs, p)),
    o AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY j) AS rn FROM w JOIN nm USING (place) WHERE NOT list_contains(expected, name)),
    b AS (SELECT query_id, name FROM e UNION ALL SELECT o.query_id, o.name FROM o LEFT JOIN (SELECT query_id, count(*) AS have FROM e GROUP BY query_id) h USING (query_id) WHERE rn <= 10 - coalesce(have, 0))
    SELECT query_id, name, (row_number() OVER (PARTITION BY query_id ORDER BY md5('order:7:' || query_id || ':' || name), name))::INT AS pos FROM b""",
)
def gen11(spark, d):
    return cg.random_subset(table(spark, d, "queries_before_review").select("query_id", "expected"), c.latest_tools(spark, d), 10)


@R.add("gen12_shuffled_shortlist", f"WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS, '20')} SELECT query_id, id, rank::INT AS rank, (row_number() OVER (PARTITION BY query_id ORDER BY md5('7:' || query_id || ':shuffle:' || id), id))::INT AS pos FROM kw")
def gen12(spark, d):
    i = index(spark, d)
    return cg.shuffled(rt.bm25_top(c.search_queries(spark, d), i["postings"], i["df"], i["stats"], 20)).select("query_id", "id", "rank", "pos")


@R.add(
    "gen14_projected_cost",
    """WITH j AS (SELECT DISTINCT sha256(concat_ws(chr(31), 'draft', query)) AS k, query AS prompt FROM queries_before_review WHERE query IS NOT NULL), h AS (SELECT DISTINCT sha256(concat_ws(chr(31), 'draft', query)) AS k FROM run_records WHERE query IS NOT NULL)
    SELECT count(*) AS n_jobs, count(h.k) AS n_cached, floor(sum(CASE WHEN h.k IS NULL THEN length(prompt) ELSE 0 END) / 4)::BIGINT AS input_tokens,
    round((sum(CASE WHEN h.k IS NULL THEN length(prompt) ELSE 0 END) / 4 * 0.25 + sum((h.k IS NULL)::INT) * 250 * 2.0) / 1e6, 6) AS usd FROM j LEFT JOIN h ON h.k = j.k""",
)
def gen14(spark, d):
    key = tx.cache_key(F.lit("draft"), "query").alias("k")
    jobs = table(spark, d, "queries_before_review").where("query is not null").select(key, F.col("query").alias("prompt"))
    out = cg.projected_cost(jobs, table(spark, d, "run_records").where("query is not null").select(key), 0.25, 2.0)
    return out.withColumn("usd", F.round("usd", 6))


@R.add("gen16_expected_known", "SELECT DISTINCT name FROM (SELECT unnest(expected) AS name FROM queries_before_review) x ANTI JOIN tool_catalog t ON t.name = x.name WHERE name IS NOT NULL")
def gen16(spark, d):
    named = table(spark, d, "queries_before_review").select(F.explode("expected").alias("name")).where("name is not null").distinct()
    return named.join(table(spark, d, "tool_catalog").select("name"), "name", "left_anti")


@R.add(
    "gen17_catalog_size",
    """SELECT condition, CASE WHEN condition = 'all' THEN t.n WHEN regexp_extract(condition, '^all-(\\d+)$', 1) <> '' THEN least(regexp_extract(condition, '^all-(\\d+)$', 1)::BIGINT, t.n) END AS n
    FROM (SELECT DISTINCT condition FROM run_records UNION SELECT unnest(['all', 'all-10', 'all-100000'])), (SELECT count(DISTINCT name) AS n FROM tool_catalog) t""",
)
def gen17(spark, d):
    more = spark.createDataFrame([("all",), ("all-10",), ("all-100000",)], "condition string")
    total = table(spark, d, "tool_catalog").agg(F.count_distinct("name").alias("total"))
    conditions = table(spark, d, "run_records").select("condition").unionByName(more).distinct()
    return conditions.join(F.broadcast(total)).select("condition", cg.catalog_size(F.col("condition"), F.col("total")).alias("n"))


@R.add(
    "gen18_response_reuse",
    """WITH r AS (SELECT rec_id, sha256(concat_ws(chr(31), condition, query, n_tools::VARCHAR)) AS k FROM run_records), f AS (SELECT k, min(rec_id) AS first_rec FROM r GROUP BY k) SELECT rec_id, first_rec, rec_id <> first_rec AS reused FROM r JOIN f USING (k)""",
)
def gen18(spark, d):
    """Which requests a response cache would answer: those whose key an earlier record has."""
    rows = table(spark, d, "run_records").select("rec_id", tx.cache_key("condition", "query", F.col("n_tools").cast("string")).alias("k"))
    first = rows.groupBy("k").agg(F.min("rec_id").alias("first_rec"))
    return rows.join(first, "k").select("rec_id", "first_rec", (F.col("rec_id") != F.col("first_rec")).alias("reused"))


@R.add(
    "src2_union_last_wins",
    """WITH j AS (SELECT name, max_by(struct_pack(tool_id := tool_id, description := description), tool_id) AS x, 0 AS part FROM tool_catalog WHERE name IS NOT NULL AND tool_id % 2 = 0 GROUP BY name),
    s AS (SELECT name, max_by(struct_pack(tool_id := tool_id, description := description), tool_id) AS x, 1 AS part FROM tool_catalog WHERE name IS NOT NULL AND tool_id % 2 = 1 GROUP BY name)
    SELECT name, max_by(x, part).tool_id AS tool_id, max_by(x, part).description AS description FROM (SELECT * FROM j UNION ALL SELECT * FROM s) GROUP BY name""",
)
def src2(spark, d):
    def part(k):
        rows = table(spark, d, "tool_catalog").where(f"name is not null and tool_id % 2 = {k}")
        return rows.groupBy("name").agg(F.max_by(F.struct("tool_id", "description"), "tool_id").alias("x")).select("name", "x.*")

    return ct.last_wins([part(0), part(1)]).select("name", "tool_id", "description")


@R.add("src4_status_filter", "SELECT uid, query_id FROM (SELECT query_id, status, (row_number() OVER (ORDER BY query_id) - 1)::BIGINT AS uid FROM queries_before_review WHERE trim(coalesce(query, '')) <> '') WHERE lower(coalesce(status, 'ok')) = 'ok'")
def src4(spark, d):
    """Cases of status ok with their place among all non-blank ones, which is given before the others are left out."""
    rows = table(spark, d, "queries_before_review").where("trim(coalesce(query, '')) <> ''")
    return files.filter_status(numbered(rows.select("query_id", "status"), "query_id")).select("uid", "query_id")


@R.add(
    "src5_scorable",
    "SELECT query_id, expected || coalesce(also_accept, []) AS accept FROM queries_before_review WHERE lower(coalesce(status, 'ok')) = 'ok' AND query IS NOT NULL AND trim(query) <> '' AND len(expected) > 0",
)
def src5(spark, d):
    from siftline.operators import evals as ev

    return ev.scorable(table(spark, d, "queries_before_review")).select("query_id", "accept")


SERVERS_SQL = "srv AS (SELECT name, any_value(prefix ORDER BY server_id) AS prefix, arg_min(package, CASE WHEN package IS NOT NULL THEN server_id END) AS package FROM mcp_server_config WHERE name IS NOT NULL AND coalesce(command, '') <> '' GROUP BY name)"


@R.add(
    "src7_server_rows",
    f"""WITH {SERVERS_SQL.replace('any_value(prefix ORDER BY server_id)', 'arg_min(prefix, server_id)')}, raw AS (SELECT tool_id, metadata['server'] AS server, metadata['original_name'] AS name, description FROM tool_catalog WHERE metadata['original_name'] IS NOT NULL)
    SELECT left(regexp_replace(CASE WHEN coalesce(prefix, true) THEN raw.server || '__' || raw.name ELSE raw.name END, '[^a-zA-Z0-9_-]', '_', 'g'), 64) AS name, regexp_replace(coalesce(description, ''), '^\\s+|\\s+$', '', 'g') AS description,
      [raw.server] AS tags, raw.name AS original_name, package FROM raw JOIN srv ON srv.name = raw.server""",
)
def src7(spark, d):
    conf = servers.usable(table(spark, d, "mcp_server_config")).groupBy("name").agg(F.min_by("prefix", "server_id").alias("prefix"), F.min_by("package", F.when(F.col("package").isNotNull(), F.col("server_id"))).alias("package"))
    m = F.col("metadata")
    raw = table(spark, d, "tool_catalog").select(m["server"].alias("server"), m["original_name"].alias("name"), "description", F.col("parameters").alias("schema")).where("name is not null")
    rows = servers.catalog_rows(raw, conf, F.lit("2026-01-01"))
    return rows.select("name", "description", "tags", F.col("metadata")["original_name"].alias("original_name"), F.try_element_at("metadata", F.lit("package")).alias("package"))


@R.add(
    "src9_subset_refresh",
    """WITH k AS (SELECT tool_id, name, coalesce(metadata['server'], '') AS server, description FROM tool_catalog)
    SELECT tool_id, server, description FROM k WHERE server NOT IN ('gridmoor', 'mailkite') UNION ALL SELECT tool_id, server, 'fresh: ' || description FROM k WHERE server IN ('gridmoor', 'mailkite')""",
)
def src9(spark, d):
    rows = table(spark, d, "tool_catalog").select("tool_id", F.coalesce(F.col("metadata")["server"], F.lit("")).alias("server"), "description")
    groups = spark.createDataFrame([("gridmoor",), ("mailkite",)], "grp string")
    fresh = rows.join(groups.withColumnRenamed("grp", "server"), "server", "left_semi").select("tool_id", "server", F.concat(F.lit("fresh: "), "description").alias("description"))
    return ct.refresh_subset(rows, fresh, F.col("server"), groups)


WRAPPED = """'{"type":"function","function":{"name":' || to_json(name) || ',"description":' || to_json(coalesce(description, '')) || ',"parameters":' || coalesce(nullif(parameters, ''), '{"type":"object","properties":{}}') || '}}'"""


@R.add("src11_import_formats", "SELECT tool_id, 'openai' AS format, name, coalesce(description, '') AS description FROM tool_catalog WHERE name IS NOT NULL UNION ALL SELECT tool_id, 'mcp', name, coalesce(description, '') FROM tool_catalog WHERE name IS NOT NULL UNION ALL SELECT tool_id, 'anthropic', name, coalesce(description, '') FROM tool_catalog WHERE name IS NOT NULL")
def src11(spark, d):
    """Definitions exported in each format and read back; parameters that are no JSON are replaced by the empty schema."""
    rows = table(spark, d, "tool_catalog").where("name is not null").withColumn("parameters", servers.clean_schema("parameters"))
    parts = []
    for fmt in formats.FORMATS:
        n, about, _ = formats.imported("j", fmt)
        parts.append(rows.select("tool_id", formats.export(fmt).alias("j")).select("tool_id", F.lit(fmt).alias("format"), n.alias("name"), about.alias("description")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add("src12_last_run", "SELECT condition, i, rec_id, correct FROM (SELECT *, row_number() OVER (PARTITION BY condition, i ORDER BY rec_id DESC) AS rn FROM run_records) WHERE rn = 1")
def src12(spark, d):
    from siftline.operators import stats as st

    return st.last_per_query(table(spark, d, "run_records").select("condition", "i", "rec_id", "correct"))


@R.add("snk2_export", f"SELECT tool_id, md5({WRAPPED}) AS openai, md5('{{\"name\":' || to_json(name) || ',\"description\":' || to_json(coalesce(description, '')) || ',\"input_schema\":' || coalesce(nullif(parameters, ''), '{{\"type\":\"object\",\"properties\":{{}}}}') || '}}') AS anthropic FROM tool_catalog")
def snk2(spark, d):
    return table(spark, d, "tool_catalog").select("tool_id", F.md5(formats.export("openai")).alias("openai"), F.md5(formats.export("anthropic")).alias("anthropic"))


@R.add(
    "snk5_merge_runs",
    """WITH new AS (SELECT * FROM run_records WHERE condition IN (SELECT DISTINCT condition FROM run_records WHERE condition LIKE 'top%') AND i % 2 = 0),
    m AS (SELECT * FROM run_records WHERE condition IS NULL OR condition NOT IN (SELECT condition FROM new) UNION ALL SELECT * FROM new) SELECT condition, count(*) AS n, sum(rec_id)::BIGINT AS ids FROM m GROUP BY condition""",
)
def snk5(spark, d):
    rows = table(spark, d, "run_records")
    return ct.merge_runs(rows, rows.where("condition like 'top%' and i % 2 = 0")).groupBy("condition").agg(F.count("*").alias("n"), F.sum("rec_id").alias("ids"))


@R.add("cat1_access", "SELECT q.query_id, q.name, t.name IS NOT NULL AS known FROM (SELECT query_id, unnest(expected) AS name FROM queries_before_review) q LEFT JOIN (SELECT DISTINCT name FROM tool_catalog) t ON t.name = q.name")
def cat1(spark, d):
    names = table(spark, d, "queries_before_review").select("query_id", F.explode("expected").alias("name"))
    return names.join(table(spark, d, "tool_catalog").select("name").distinct().withColumn("k", F.lit(True)), "name", "left").select("query_id", "name", F.col("k").isNotNull().alias("known"))


@R.add("cat2_remove", f"WITH {c.TEXTS}, tok AS (SELECT name AS id, unnest({c.tokens_sql('text')}) AS term FROM texts WHERE grp NOT IN ('gridmoor', 'dbwren')) SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY term")
def cat2(spark, d):
    """Document frequencies after rows are removed from the index."""
    docs = c.texts(spark, d)
    post = ix.postings(ix.tokens(docs, "name", "text"))
    gone = docs.where("grp in ('gridmoor', 'dbwren')").select(F.col("name").alias("id"))
    return ix.document_frequency(ix.delete(post, gone))


OPTION_SQL = """opt AS (SELECT name, CASE WHEN len(params) > 0 THEN t || ' (arguments: ' || array_to_string(list_transform(params, lambda p: p.pname), ', ') || ')' ELSE t END AS option FROM (
  SELECT name, params, CASE WHEN length(t) > 400 THEN regexp_replace(left(t, 400), ' [^ ]*$', '') || '...' ELSE t END AS t FROM (SELECT name, params, replace(regexp_replace(coalesce(description, ''), '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM based)))"""


@R.add(
    "rrk1_callable",
    f"""WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS)}, {OPTION_SQL}, x AS (SELECT query_id, id, rank, length(option) AS n FROM kw JOIN opt ON opt.name = kw.id)
    SELECT query_id, arg_max(id, struct_pack(n := n, id := id)) AS pick, round(max(n) / sum(n), 6) AS confidence, string_agg(id, ',' ORDER BY rank) AS ranked FROM x GROUP BY query_id""",
)
def rrk1(spark, d):
    """A user's reranker on every shortlist: here the candidate whose option text is longest, sure in proportion."""

    def longest(query, candidates):
        best = max(candidates, key=lambda x: (len(x["option"]), x["name"]))
        total = sum(len(x["option"]) for x in candidates) or 1
        return {"pick": best["name"], "confidence": len(best["option"]) / total, "ranked": [(x["name"], len(x["option"]) / total) for x in candidates]}

    got = rr.rerank(shortlists(spark, d), longest)
    return got.select("query_id", "pick", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("ranked", lambda x: x["name"]), ",").alias("ranked"))


def shortlists(spark, d, k=10):
    i, q = index(spark, d), c.search_queries(spark, d)
    options = c.catalog(spark, d).select(F.col("name").alias("id"), tx.option_text("description", "params").alias("option"))
    return rt.bm25_top(q, i["postings"], i["df"], i["stats"], k).join(options, "id").join(q.select("query_id", F.col("text").alias("query")), "query_id")


@R.add(
    "rrk2_requests",
    f"""WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS)}, {OPTION_SQL}
    SELECT q.query_id, md5('{{"model":"chooser","state":' || to_json(q.query) || ',"questions":{{"tool":{{"type":"choice","instructions":' || to_json($a${rr.INSTRUCTIONS}$a$) || ',"criteria":{{' || o.o || ',"none":' || to_json($a${rr.NONE_TEXT}$a$) || '}}}}' || '}}}}') AS body, o.n
    FROM (SELECT query_id, string_agg(to_json(id) || ':' || to_json(option), ',' ORDER BY rank) AS o, count(*) AS n FROM kw JOIN opt ON opt.name = kw.id GROUP BY query_id) o JOIN queries_before_review q USING (query_id)""",
)
def rrk2(spark, d):
    held = shortlists(spark, d)
    return rr.requests(held, "chooser").select("query_id", F.md5("body").alias("body")).join(held.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")


RESPONSE_SQL = """CASE WHEN query_id % 4 = 0 THEN '{"result":' || b || '}' WHEN query_id % 4 = 1 THEN b ELSE substr(b, 1, CASE WHEN query_id % 4 = 2 THEN length(b) ELSE 20 END) END"""


def responses(spark, d):
    rows = table(spark, d, "queries_before_review").where("size(expected) > 0")
    first = formats.quote(F.get("expected", F.lit(0)))
    chosen = F.when(F.col("query_id") % 7 == 0, F.lit('"none"')).otherwise(first)
    b = F.concat(F.lit('{"answers":{"tool":{"choice":'), chosen, F.lit(',"confidence":0.5,"probabilities":{'), first, F.lit(':0.'), (F.col("query_id") % 9 + 1).cast("string"), F.lit(',"none":0.05}},"needs_tool":{"noul":0.75}}}'))
    k = F.col("query_id") % 4
    body = F.when(k == 0, F.concat(F.lit('{"result":'), b, F.lit("}"))).when(k == 3, F.substring(b, 1, 20)).otherwise(b)
    return rows.select("query_id", body.alias("body"))


@R.add(
    "rrk3_parse",
    """SELECT query_id, CASE WHEN query_id % 4 <> 3 AND query_id % 7 <> 0 THEN expected[1] END AS pick, CASE WHEN query_id % 4 = 3 THEN NULL WHEN query_id % 7 = 0 THEN 0.05 ELSE (query_id % 9 + 1) / 10.0 END AS confidence,
    CASE WHEN query_id % 4 = 3 THEN '' ELSE expected[1] || ',none' END AS ranked, CASE WHEN query_id % 4 <> 3 THEN 0.75::DOUBLE END AS needs_tool FROM queries_before_review WHERE len(expected) > 0""",
)
def rrk3(spark, d):
    p = rr.parse_response(responses(spark, d))
    return p.select("query_id", "pick", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("ranked", lambda x: x["name"]), ",").alias("ranked"), "needs_tool")


@R.add("rrk8_top_names", "SELECT query_id, CASE WHEN query_id % 4 = 3 THEN []::VARCHAR[] ELSE [expected[1]] END AS top FROM queries_before_review WHERE len(expected) > 0")
def rrk8(spark, d):
    return rr.parse_response(responses(spark, d)).select("query_id", rr.top_names("ranked", 3).alias("top"))


@R.add(
    "rrk5_route",
    f"""WITH {c.TEXTS}, names AS (SELECT grp, name, sum(length(name) + 2) OVER (PARTITION BY grp ORDER BY name) AS chars FROM texts),
    gdoc AS (SELECT grp AS id, grp || ' tools: ' || string_agg(name, ', ' ORDER BY name) AS text FROM names WHERE chars <= 3000 GROUP BY grp), {bm25_sql('SELECT id, text FROM gdoc', '1')},
    shown AS (SELECT kw.query_id, kw.id AS grp, t.name AS id, {c.tokens_sql('t.base')} AS t FROM kw JOIN texts t ON t.grp = kw.id),
    st2 AS (SELECT query_id, count(*) AS n, coalesce(nullif(avg(len(t)), 0), 1) AS avgdl FROM shown GROUP BY query_id), post2 AS (SELECT query_id, id, dl, term, count(*) AS tf FROM (SELECT query_id, id, len(t) AS dl, unnest(t) AS term FROM shown) GROUP BY ALL),
    df2 AS (SELECT query_id, term, count(*) AS df FROM post2 GROUP BY ALL),
    s2 AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN post2 USING (query_id, term) JOIN df2 USING (query_id, term) JOIN st2 USING (query_id) GROUP BY ALL HAVING score > 0),
    pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s2) WHERE rn = 1)
    SELECT a.query_id, kw.id AS grp, pick.id, pick.score FROM (SELECT query_id FROM queries_before_review WHERE query_id % 100 = 0) a LEFT JOIN kw USING (query_id) LEFT JOIN pick USING (query_id)""",
)
def rrk5(spark, d):
    """Two stages with keyword search as the picker: the best group by its members' names, then the best row in it."""
    docs = materialise(c.texts(spark, d, augmented=False), "texts")
    groups = rr.group_documents(docs.select("name", "grp"))
    tok = ix.tokens(groups, "id", "text")
    post, q = ix.postings(tok), c.search_queries(spark, d)
    first = rt.bm25_top(q, post, ix.document_frequency(post), ix.statistics(ix.lengths(tok)), 1).select("query_id", F.col("id").alias("grp"))
    return rr.route(q, first, lambda qs, shown: rt.best_of_subset(qs, shown, ix.tokens(docs, "name", "text")), docs)


@R.add(
    "rrk6_cascade",
    """WITH f AS (SELECT query_id, CASE WHEN query_id % 4 <> 3 AND query_id % 7 <> 0 THEN expected[1] END AS p1, CASE WHEN query_id % 4 = 3 THEN NULL WHEN query_id % 7 = 0 THEN 0.05 ELSE (query_id % 9 + 1) / 10.0 END AS c1,
      expected[-1] AS p2, CASE WHEN query_id % 10 = 0 THEN 'timeout' ELSE '' END AS e2 FROM queries_before_review WHERE len(expected) > 0), u AS (SELECT *, coalesce(c1, 0) < 0.6 OR p1 IS NULL AS use FROM f)
    SELECT query_id, CASE WHEN use THEN CASE WHEN e2 = '' THEN p2 END ELSE p1 END AS pick, CASE WHEN use THEN 'second' ELSE 'first' END AS used, CASE WHEN use AND e2 <> '' THEN e2 END AS error FROM u""",
)
def rrk6(spark, d):
    second = table(spark, d, "queries_before_review").where("size(expected) > 0").select("query_id", F.element_at("expected", -1).alias("pick"), F.when(F.col("query_id") % 10 == 0, "timeout").otherwise("").alias("error"))
    return rr.cascade(rr.parse_response(responses(spark, d)), second, 0.6)


@R.add(
    "idx8_callable_embedder",
    f"""WITH {c.TEXTS}, x AS (SELECT name, length(text)::DOUBLE AS a, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS b FROM texts)
    SELECT name, [round(a / sqrt(a * a + b * b + 1), 9), round(b / sqrt(a * a + b * b + 1), 9), round(1 / sqrt(a * a + b * b + 1), 9)] AS v FROM x""",
)
def idx8(spark, d):
    """A user's embedding function on batches of texts; vectors are normalised."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def lengths(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda x: [float(len(x)), float(x.count(" ")), 1.0])

    return c.texts(spark, d).select("name", lengths("text").alias("v")).select("name", F.transform(ix.normalise(F.col("v")), lambda x: F.round(x, 9)).alias("v"))


@R.add(
    "idx10_augment",
    f"""WITH {c.CATALOG}, cache AS (SELECT description AS d, parameters AS p, min(augmented_description) AS v FROM latest WHERE augmented_description <> '' GROUP BY ALL)
    SELECT name, coalesce(v, 'Use it when: ' || nullif(trim(description), '')) AS augmented_description FROM latest LEFT JOIN cache ON description IS NOT DISTINCT FROM d AND parameters IS NOT DISTINCT FROM p WHERE coalesce(augmented_description, '') = ''""",
)
def idx10(spark, d):
    """Augmented text for the rows that lack it: cached by content, computed once for each missing content; empty is null."""
    rows = c.latest_tools(spark, d).withColumn("k", tx.cache_key(F.lit("augment"), tx.row_hash("name", "description", "parameters")))
    todo = rows.where("coalesce(augmented_description, '') = ''").select("name", "k", F.col("description").alias("text"))
    cache = rows.where("augmented_description <> ''").select("k", F.col("augmented_description").alias("v")).groupBy("k").agg(F.min("v").alias("v"))
    values, _ = ix.cached(todo, cache, lambda m: m.select("k", F.concat(F.lit("Use it when: "), F.nullif(F.trim("text"), F.lit(""))).alias("v")).where("v is not null"))
    return values.select("name", F.col("v").alias("augmented_description"))
