"""Queries on index build and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import index as ix
from siftline.plans import common as c
from siftline.plans.registry import Registry
from siftline.session import table

R = Registry()

DOC_TOKENS = f"tok AS (SELECT doc_id AS id, {c.tokens_sql('text')} AS t FROM documents), lens AS (SELECT id, len(t)::BIGINT AS dl FROM tok), post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY id, term)"


@R.add("idx1_postings", f"WITH {DOC_TOKENS} SELECT id, term, tf FROM post")
def idx1(spark, d):
    return ix.postings(ix.tokens(table(spark, d, "documents"), "doc_id", "text")).select("id", "term", F.col("tf").cast("bigint").alias("tf"))


@R.add("idx3_doc_freq", f"WITH {DOC_TOKENS} SELECT term, count(*) AS df FROM post GROUP BY term")
def idx3(spark, d):
    return ix.document_frequency(ix.postings(ix.tokens(table(spark, d, "documents"), "doc_id", "text")))


@R.add("idx3_corpus_stats", f"WITH {DOC_TOKENS} SELECT count(*) AS n, round(coalesce(nullif(avg(dl), 0), 1), 6) AS avgdl FROM lens")
def idx3_stats(spark, d):
    s = ix.statistics(ix.lengths(ix.tokens(table(spark, d, "documents"), "doc_id", "text")))
    return s.select("n", F.round("avgdl", 6).alias("avgdl"))


@R.add(
    "idx2_delete_upsert",
    f"""WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'revised ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0),
    post AS (SELECT doc_id AS id, unnest({c.tokens_sql('text')}) AS term FROM docs)
    SELECT term, count(DISTINCT id) AS df, count(*) AS n FROM post GROUP BY term""",
)
def idx2(spark, d):
    """A tenth of the documents is deleted and another tenth comes again with a changed text, as a change set would."""
    docs = table(spark, d, "documents")
    post = ix.postings(ix.tokens(docs, "doc_id", "text"))
    post = ix.delete(post, docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("id")))
    changed = docs.where("doc_id % 10 = 1").withColumn("text", F.concat(F.lit("revised "), F.coalesce("text", F.lit(""))))
    post = ix.upsert(post, ix.postings(ix.tokens(changed, "doc_id", "text")), changed.select(F.col("doc_id").alias("id")))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@R.add(
    "idx4_delta",
    """WITH h AS (SELECT *, left(sha256(concat_ws(chr(31), coalesce('=' || description, '-'), coalesce('=' || parameters, '-'))), 16) AS hash,
      row_number() OVER (PARTITION BY name ORDER BY loaded_at DESC NULLS LAST, tool_id DESC) AS last,
      row_number() OVER (PARTITION BY name ORDER BY loaded_at NULLS FIRST, tool_id) AS first FROM tool_catalog WHERE name IS NOT NULL),
    now AS (SELECT name AS id, hash FROM h WHERE last = 1 AND tool_id % 13 <> 0), before AS (SELECT name AS id, hash FROM h WHERE first = 1 AND tool_id % 11 <> 0)
    SELECT id, CASE WHEN b.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM now n FULL JOIN before b USING (id) WHERE n.hash IS DISTINCT FROM b.hash""",
)
def idx4(spark, d):
    """What an incremental run must process: the catalog as last loaded against the catalog as first loaded."""
    from pyspark.sql import Window

    rows = table(spark, d, "tool_catalog").where("name is not null").withColumn("hash", tx.row_hash("description", "parameters"))
    last = Window.partitionBy("name").orderBy(F.desc_nulls_last("loaded_at"), F.desc("tool_id"))
    first = Window.partitionBy("name").orderBy(F.asc_nulls_first("loaded_at"), "tool_id")
    now = rows.withColumn("rn", F.row_number().over(last)).where("rn = 1 and tool_id % 13 <> 0").select(F.col("name").alias("id"), "hash")
    before = rows.withColumn("rn", F.row_number().over(first)).where("rn = 1 and tool_id % 11 <> 0").select(F.col("name").alias("id"), "hash")
    return ix.delta(now, before)


@R.add(
    "idx5_vector_upsert",
    """WITH ranked AS (SELECT k, model, vec_id, len(v)::BIGINT AS dim, row_number() OVER (PARTITION BY k, model ORDER BY cached_at DESC, vec_id DESC) AS rn FROM embedding_cache WHERE v IS NOT NULL)
    SELECT k, model, vec_id, dim FROM ranked WHERE rn = 1""",
)
def idx5(spark, d):
    """The vector store after all upserts in the order of their time: the last vector of each key."""
    rows = table(spark, d, "embedding_cache").where("v is not null")
    last = rows.groupBy("k", "model").agg(F.max_by(F.struct("vec_id", F.size("v").cast("bigint").alias("dim")), F.struct("cached_at", "vec_id")).alias("x"))
    return last.select("k", "model", "x.vec_id", "x.dim")


CRC_SQL = """list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen(f) + 1), lambda i: ord(substr(f, i, 1))::BIGINT),
   lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)))"""
HASHED = f"""
words AS (SELECT name AS id, {c.words_sql('text')} AS w FROM texts),
features AS (SELECT id, unnest(list_transform(w, lambda x: 'w:' || x) ||
  CASE WHEN len(w) > 1 THEN list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda z: 'b:' || z[1] || '_' || z[2]) ELSE [] END ||
  flatten(list_transform(w, lambda x: list_transform(range(1, len(x) + 1), lambda i: 'c:' || substr('#' || x || '#', i, 3))))) AS f FROM words),
crc AS (SELECT f, xor({CRC_SQL}, 4294967295) AS h FROM (SELECT DISTINCT f FROM features)),
bucket AS (SELECT id, h % 1024 AS bucket, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::BIGINT AS x FROM features JOIN crc USING (f) GROUP BY ALL HAVING x <> 0)
"""


@R.add(
    "idx6_hash_vectors",
    f"WITH {c.TEXTS}, {HASHED} SELECT b.id, b.bucket::INT AS bucket, round(b.x / sqrt(n.s), 6) AS weight FROM bucket b JOIN (SELECT id, sum(x * x) AS s FROM bucket GROUP BY id) n ON n.id = b.id",
)
def idx6(spark, d):
    v = ix.hash_vectors(c.texts(spark, d), "name", "text")
    return v.select("id", F.explode(F.arrays_zip("buckets", "weights")).alias("x")).select("id", F.col("x.buckets").alias("bucket"), F.round("x.weights", 6).alias("weight"))


UNIT_SQL = "list_transform(v, lambda x: x::DOUBLE / CASE WHEN n = 0 THEN 1 ELSE n END)"


@R.add(
    "idx11_normalise",
    f"""WITH f AS (SELECT vec_id, v, sqrt(coalesce(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)), 0)) AS n FROM embedding_cache WHERE v IS NOT NULL AND len(list_filter(v, lambda x: isnan(x))) = 0)
    SELECT vec_id, len(v)::BIGINT AS dim, round(coalesce(list_sum(list_transform({UNIT_SQL}, lambda x: x * x)), 0), 6) AS norm, round(coalesce(({UNIT_SQL})[1], 0), 6) AS first FROM f""",
)
def idx11(spark, d):
    rows = table(spark, d, "embedding_cache").where(F.col("v").isNotNull() & ~F.exists("v", lambda x: F.isnan(x)))
    u = rows.select("vec_id", ix.normalise(F.col("v")).alias("u"))
    norm = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return u.select("vec_id", F.size("u").cast("bigint").alias("dim"), F.round(norm, 6).alias("norm"), F.round(F.coalesce(F.get("u", F.lit(0)), F.lit(0.0)), 6).alias("first"))


@R.add(
    "idx9_cached_embedding",
    """WITH cache AS (SELECT k, max_by(vec_id, struct_pack(a := cached_at, b := vec_id)) AS v FROM embedding_cache WHERE v IS NOT NULL AND owner_kind = 'tool' GROUP BY k),
    asked AS (SELECT vec_id, k FROM embedding_cache)
    SELECT a.vec_id, a.k, coalesce(c.v, -length(a.k)) AS v, c.v IS NOT NULL AS hit FROM asked a LEFT JOIN cache c USING (k)""",
)
def idx9(spark, d):
    """Cached values for all requested keys; those the cache lacks are computed once each (here: the key's length, negated)."""
    rows = table(spark, d, "embedding_cache")
    cache = rows.where("v is not null and owner_kind = 'tool'").groupBy("k").agg(F.max_by("vec_id", F.struct("cached_at", "vec_id")).alias("v"))
    values, fresh = ix.cached(rows.select("vec_id", "k", F.col("k").alias("text")), cache, lambda m: m.select("k", (-F.length("text")).cast("bigint").alias("v")))
    return values.select("vec_id", "k", "v", (F.col("v") >= 0).alias("hit"))


@R.add(
    "snk7_cache_merge",
    """SELECT k, arg_max(model, struct_pack(a := cached_at, b := side)) AS model, max(cached_at) AS cached_at FROM (
      SELECT k, model, cached_at, 0 AS side FROM (SELECT k, min(model) AS model, min(cached_at) AS cached_at FROM embedding_cache WHERE owner_kind = 'tool' GROUP BY k)
      UNION ALL SELECT k, min(model), max(cached_at), 1 FROM embedding_cache WHERE owner_kind = 'query' GROUP BY k) GROUP BY k""",
)
def snk7(spark, d):
    rows = table(spark, d, "embedding_cache")
    old = rows.where("owner_kind = 'tool'").groupBy("k").agg(F.min("model").alias("model"), F.min("cached_at").alias("cached_at"))
    new = rows.where("owner_kind = 'query'").groupBy("k").agg(F.min("model").alias("model"), F.max("cached_at").alias("cached_at"))
    return ix.merge_cache(old, new, "cached_at")


@R.add(
    "idx12_augmentation_guard",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY loaded_at DESC NULLS LAST, tool_id DESC) AS rn FROM tool_catalog WHERE name IS NOT NULL)
    SELECT count(*) AS n, round(avg(CASE WHEN augmented_description <> '' THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN augmented_description <> '' THEN 1.0 ELSE 0.0 END) >= 0.95 AS enough FROM l WHERE rn = 1""",
)
def idx12(spark, d):
    has = F.when(F.col("augmented_description") != "", 1.0).otherwise(0.0)
    return c.latest_tools(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(has), 6).alias("share"), (F.avg(has) >= 0.95).alias("enough"))
