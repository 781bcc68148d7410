"""Queries on retrieval: the drafted cases whose id is divisible by 100 search the whole catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import index as ix
from siftline.operators import retrieve as rt
from siftline.plans import common as c
from siftline.plans.index_queries import HASHED
from siftline.plans.registry import Registry
from siftline.session import materialise, table

R = Registry()
DIM = ix.DIM


def index(spark, d) -> dict:
    """The index of the catalog; texts and postings are used on both sides of a search, so they are written once."""
    docs = materialise(c.texts(spark, d), "texts")
    tok = ix.tokens(docs, "name", "text")
    post = materialise(ix.postings(tok), "postings")
    return {
        "postings": post,
        "df": ix.document_frequency(post),
        "stats": ix.statistics(ix.lengths(tok)),
        "vectors": ix.hash_vectors(docs, "name", "text"),
        "docs": docs.select(F.col("name").alias("id"), "tags"),
    }


def embed(queries):
    return ix.hash_vectors(queries, "query_id", "text").withColumnRenamed("id", "query_id")


def bm25_sql(docs: str, pool: str = "10", tag_filter: str = "") -> str:
    return f"""
tok AS (SELECT id, {c.tokens_sql('text')} AS t FROM ({docs})),
lens AS (SELECT id, len(t) AS dl FROM tok), st AS (SELECT count(*) AS n, coalesce(nullif(avg(dl), 0), 1) AS avgdl FROM lens),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT DISTINCT query_id, unnest({c.tokens_sql('query')}) AS term FROM queries_before_review WHERE query_id % 100 = 0),
kscore AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN post USING (term) JOIN df USING (term) JOIN lens USING (id), st {tag_filter} GROUP BY query_id, id HAVING score > 0),
kw AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kscore) WHERE rank <= {pool})"""


TOOL_DOCS = "SELECT name AS id, text FROM texts"


def sparse_sql(pool: str, tag_filter: str = "") -> str:
    return f"""
{HASHED.replace("FROM texts)", "FROM (SELECT 'd:' || name AS name, text FROM texts UNION ALL SELECT 'q:' || query_id, query FROM queries_before_review WHERE query_id % 100 = 0 AND query IS NOT NULL UNION ALL SELECT 'q:' || query_id, '' FROM queries_before_review WHERE query_id % 100 = 0 AND query IS NULL))")},
norms AS (SELECT id, sqrt(sum(x * x)) AS n FROM bucket GROUP BY id),
dots AS (SELECT substr(a.id, 3)::BIGINT AS query_id, substr(b.id, 3) AS id, sum(a.x * b.x) / (any_value(na.n) * any_value(nb.n)) AS s
  FROM bucket a JOIN bucket b ON a.bucket = b.bucket AND a.id LIKE 'q:%' AND b.id LIKE 'd:%' JOIN norms na ON na.id = a.id JOIN norms nb ON nb.id = b.id GROUP BY ALL),
sscore AS (SELECT q.query_id, t.name AS id, round(coalesce(s, 0), 6) + 0 AS score FROM (SELECT query_id FROM queries_before_review WHERE query_id % 100 = 0) q CROSS JOIN (SELECT name FROM texts {tag_filter}) t LEFT JOIN dots ON dots.query_id = q.query_id AND dots.id = t.name),
sem AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sscore) WHERE rank <= {pool})"""


FUSED = """
fused AS (SELECT query_id, id, s.rank AS semantic_rank, k.rank AS keyword_rank, round(coalesce(0.6 / (60 + s.rank), 0) + coalesce(0.4 / (60 + k.rank), 0), 8) AS score
  FROM sem s FULL JOIN kw k USING (query_id, id)),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10)"""


@R.add("ret1_bm25", f"WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS)} SELECT query_id, id, score, rank::INT AS rank FROM kw")
def ret1(spark, d):
    i = index(spark, d)
    return rt.bm25_top(c.search_queries(spark, d), i["postings"], i["df"], i["stats"], 10)


@R.add(
    "ret2_dense",
    """WITH v AS (SELECT vec_id, model, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embedding_cache
      WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: isnan(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / ((CASE WHEN q.n = 0 THEN 1 ELSE q.n END) * (CASE WHEN d.n = 0 THEN 1 ELSE d.n END)), 6) + 0 AS score
      FROM v q JOIN v d ON len(q.v) = len(d.v) AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
)
def ret2(spark, d):
    rows = table(spark, d, "embedding_cache").where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: F.isnan(x)))
    return rt.dense_top(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v"), rows.select(F.col("vec_id").alias("id"), "v"), 10, exclude_self=True)


@R.add("ret3_sparse_cosine", f"WITH {c.TEXTS}, {sparse_sql('10')} SELECT query_id, id, score, rank::INT AS rank FROM sem")
def ret3(spark, d):
    return rt.dense_top(embed(c.search_queries(spark, d)), ix.hash_vectors(c.texts(spark, d), "name", "text"), 10, dim=DIM)


@R.add("ret_hybrid_rrf", f"WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS, '50')}, {sparse_sql('50')}, {FUSED} SELECT query_id, id, rank::INT AS rank, score, semantic_rank::INT AS semantic_rank, keyword_rank::INT AS keyword_rank FROM hybrid")
def ret_hybrid(spark, d):
    """Hybrid search: the pool is a function of k (here 50 for 10), both ranks are fused by reciprocal rank."""
    return rt.search(c.search_queries(spark, d), index(spark, d), 10, embed=embed, dim=DIM)


TAGS = ("gridmoor", "mailkite", "ledgerly")
TAG_SQL = "WHERE list_has_any(tags, ['gridmoor', 'mailkite', 'ledgerly'])"


@R.add(
    "ret5_tag_filter",
    f"WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS, '1000000000', 'WHERE id IN (SELECT name FROM texts ' + TAG_SQL + ')')}, {sparse_sql('1000000000', TAG_SQL)}, {FUSED} SELECT query_id, id, rank::INT AS rank, score, semantic_rank::INT AS semantic_rank, keyword_rank::INT AS keyword_rank FROM hybrid",
)
def ret5(spark, d):
    """Ranks among the rows with one of the tags; the statistics stay those of the whole catalog."""
    docs = c.texts(spark, d).select(F.col("name").alias("id"), "text", "tags")
    return rt.search_tagged(c.search_queries(spark, d), docs, TAGS, 10)


@R.add(
    "ret6_modes",
    f"""WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS, '5')}, {sparse_sql('5')} SELECT 'keyword' AS mode, query_id, id, rank::INT AS rank, score FROM kw UNION ALL SELECT 'semantic', query_id, id, rank::INT, score FROM sem""",
)
def ret6(spark, d):
    i, q = index(spark, d), c.search_queries(spark, d)
    both = [rt.search(q, i, 5, mode, embed=embed, dim=DIM).select(F.lit(mode).alias("mode"), "query_id", "id", "rank", "score") for mode in ("keyword", "semantic")]
    return both[0].unionByName(both[1])


@R.add(
    "ret9_export",
    f"""WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS, '5')}
    SELECT query_id, rank::INT AS rank, '{{"name":' || to_json(l.name) || ',"description":' || to_json(coalesce(l.description, '')) || ',"inputSchema":' || coalesce(nullif(l.parameters, ''), '{{"type":"object","properties":{{}}}}') || '}}' AS tool
    FROM kw JOIN latest l ON l.name = kw.id""",
)
def ret9(spark, d):
    """Search, then the found rows' definitions in the form a tool-calling interface takes; parameters stay verbatim."""
    from siftline.sources.formats import export

    i = index(spark, d)
    found = rt.bm25_top(c.search_queries(spark, d), i["postings"], i["df"], i["stats"], 5)
    tools = c.latest_tools(spark, d).select(F.col("name").alias("id"), export("mcp").alias("tool"))
    return found.join(tools, "id").select("query_id", "rank", "tool")


@R.add(
    "ret10_select_fallback",
    f"""WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS, '40')}, x AS (SELECT query_id, list(id ORDER BY rank) AS names FROM kw GROUP BY query_id)
    SELECT q.query_id, x.names[1] AS pick, NULL::DOUBLE AS confidence, coalesce(len(x.names), 0)::BIGINT AS n, md5(coalesce(array_to_string(x.names, ','), '')) AS ranked
    FROM (SELECT query_id FROM queries_before_review WHERE query_id % 100 = 0) q LEFT JOIN x USING (query_id)""",
)
def ret10(spark, d):
    i, q = index(spark, d), c.search_queries(spark, d)
    picked = rt.select_first(q, rt.bm25_top(q, i["postings"], i["df"], i["stats"], 40))
    names = F.array_join(F.transform("ranked", lambda r: r["name"]), ",")
    return picked.select("query_id", "pick", "confidence", F.size("ranked").cast("bigint").alias("n"), F.md5(names).alias("ranked"))


@R.add(
    "ret11_siblings",
    f"""WITH {c.TEXTS}, tok AS (SELECT name AS id, grp, {c.tokens_sql('base')} AS t FROM texts), lens AS (SELECT id, grp, len(t) AS dl FROM tok),
    post AS (SELECT id, grp, term, count(*) AS tf FROM (SELECT id, grp, unnest(t) AS term FROM tok) GROUP BY ALL),
    target AS (SELECT id, grp, dl FROM lens WHERE id IN (SELECT name FROM latest WHERE tool_id % 100 = 0)),
    st AS (SELECT t.id AS query_id, t.grp, count(*) AS n, coalesce(nullif(avg(l.dl), 0), 1) AS avgdl FROM target t JOIN lens l ON l.grp = t.grp AND l.id <> t.id GROUP BY ALL),
    df AS (SELECT t.id AS query_id, p.term, count(*) AS df FROM target t JOIN post p ON p.grp = t.grp AND p.id <> t.id GROUP BY ALL),
    s AS (SELECT t.id AS query_id, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / avgdl))), 6) AS score
      FROM target t JOIN post q ON q.id = t.id JOIN post p ON p.grp = t.grp AND p.term = q.term AND p.id <> t.id JOIN df ON df.query_id = t.id AND df.term = p.term JOIN st ON st.query_id = t.id JOIN lens l ON l.id = p.id GROUP BY ALL HAVING score > 0)
    SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 8""",
)
def ret11(spark, d):
    docs = c.texts(spark, d, augmented=False)
    tok = docs.select(F.col("name").alias("id"), "grp", tx.tokenize("text").alias("tokens"))
    return rt.siblings(tok, c.latest_tools(spark, d).where("tool_id % 100 = 0").select(F.col("name").alias("query_id")))


@R.add(
    "ret12_subset_argmax",
    f"""WITH {c.TEXTS}, shown AS (SELECT DISTINCT query_id, t.name AS id FROM queries_before_review q JOIN texts t ON t.grp = q.server WHERE q.query_id % 100 = 0),
    tok AS (SELECT query_id, id, {c.tokens_sql('base')} AS t FROM shown JOIN texts ON texts.name = shown.id),
    st AS (SELECT query_id, count(*) AS n, coalesce(nullif(avg(len(t)), 0), 1) AS avgdl FROM tok GROUP BY query_id),
    q AS (SELECT DISTINCT query_id, unnest({c.tokens_sql('query')}) AS term FROM queries_before_review WHERE query_id % 100 = 0),
    post AS (SELECT query_id, id, dl, term, count(*) AS tf FROM (SELECT query_id, id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
    df AS (SELECT query_id, term, count(*) AS df FROM post GROUP BY ALL),
    s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN post USING (query_id, term) JOIN df USING (query_id, term) JOIN st USING (query_id) GROUP BY ALL HAVING score > 0)
    SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s) WHERE rn = 1""",
)
def ret12(spark, d):
    """The best row among those a case shows (here: its server's tools), with statistics of those rows alone."""
    docs = materialise(c.texts(spark, d, augmented=False), "texts")
    q = table(spark, d, "queries_before_review").where("query_id % 100 = 0").select("query_id", F.col("query").alias("text"), "server")
    shown = q.join(docs, q.server == docs.grp).select("query_id", F.col("name").alias("id")).distinct()
    return rt.best_of_subset(q.select("query_id", "text"), shown, ix.tokens(docs, "name", "text"))


@R.add(
    "ret15_by_names",
    """SELECT query_id, e.name, e.pos::INT AS pos FROM (SELECT query_id, name, min(pos) AS pos FROM (SELECT query_id, unnest(expected) AS name, unnest(range(len(expected))) AS pos FROM queries_before_review) GROUP BY ALL) e
    SEMI JOIN tool_catalog t ON t.name = e.name""",
)
def ret15(spark, d):
    """The named rows of each case, each once at its first place in the list; unknown names are skipped."""
    names = table(spark, d, "queries_before_review").select("query_id", F.posexplode("expected").alias("pos", "name")).groupBy("query_id", "name").agg(F.min("pos").alias("pos"))
    return names.join(table(spark, d, "tool_catalog").select("name"), "name", "left_semi").select("query_id", "name", "pos")
