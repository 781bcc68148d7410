"""Queries on evaluation aggregates and paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import evals as ev
from siftline.operators import index as ix
from siftline.operators import retrieve as rt
from siftline.operators import stats as st
from siftline.plans import common as c
from siftline.plans.registry import Registry
from siftline.plans.retrieval_queries import TOOL_DOCS, bm25_sql
from siftline.session import materialise, table

R = Registry()

SCORABLE = """cases AS (SELECT query_id, expected, expected || coalesce(also_accept, []) AS accept, server FROM queries_before_review
  WHERE lower(coalesce(status, 'ok')) <> 'dropped' AND query IS NOT NULL AND trim(query) <> '' AND len(expected) > 0 AND query_id % 100 = 0)"""
HITS = f"""{SCORABLE}, hit AS (SELECT cs.query_id, list_distinct(cs.accept) AS accept, coalesce(list(kw.rank ORDER BY kw.rank) FILTER (WHERE kw.rank IS NOT NULL), []) AS ranks
  FROM cases cs LEFT JOIN kw ON kw.query_id = cs.query_id AND list_contains(cs.accept, kw.id) GROUP BY cs.query_id, cs.accept)"""


def found(spark, d, k=10):
    tokens = materialise(ix.tokens(c.texts(spark, d), "name", "text"), "tokens")
    return rt.keyword_top(c.search_queries(spark, d), tokens, k)


def cases(spark, d):
    rows = ev.scorable(table(spark, d, "queries_before_review").where("query_id % 100 = 0"), allow_draft=True)
    return rows.select("query_id", F.col("accept").alias("expected"), "server")


@R.add(
    "eva1_hit_recall_mrr",
    f"""WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS)}, {HITS}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k)
    SELECT 'hit' AS metric, k::INT AS k, round(avg(CASE WHEN len(list_filter(ranks, lambda r: r <= k)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS value FROM hit, ks GROUP BY k
    UNION ALL SELECT 'recall', k::INT, round(avg(len(list_filter(ranks, lambda r: r <= k)) / len(accept)), 6) FROM hit, ks GROUP BY k
    UNION ALL SELECT 'mrr', 10::INT, round(avg(CASE WHEN len(ranks) > 0 THEN 1.0 / ranks[1] ELSE 0.0 END), 6) FROM hit""",
)
def eva1(spark, d):
    m = ev.retrieval_metrics(ev.check_cases(cases(spark, d)), found(spark, d))
    return m.select("metric", "k", F.round("value", 6).alias("value"))


@R.add(
    "eva4_failures",
    f"""WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS)}, {HITS}
    SELECT h.query_id, h.ranks[1]::INT AS rank, coalesce(array_to_string(list(kw.id ORDER BY kw.rank) FILTER (WHERE kw.rank <= 5), ','), '') AS found FROM hit h LEFT JOIN kw USING (query_id) WHERE len(h.ranks) = 0 OR h.ranks[1] <> 1 GROUP BY h.query_id, h.ranks""",
)
def eva4(spark, d):
    f = ev.failures(cases(spark, d), found(spark, d))
    return f.select("query_id", "rank", F.array_join("found", ",").alias("found"))


@R.add(
    "eva5_compare",
    f"""WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS)}, {HITS}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
    v AS (SELECT h.query_id, k, CASE WHEN len(list_filter(ranks, lambda r: r <= k)) > 0 THEN 1.0 ELSE 0.0 END AS hit FROM hit h, ks)
    SELECT 'hit' AS metric, k::INT AS k, round(avg(hit), 4) AS all_cases, round(avg(hit) FILTER (WHERE v.query_id % 200 = 0), 4) AS even_cases FROM v GROUP BY k""",
)
def eva5(spark, d):
    cs, res = cases(spark, d), materialise(found(spark, d), "found")
    both = [ev.retrieval_metrics(part, res).where("metric = 'hit'").withColumn("label", F.lit(label)) for label, part in (("all_cases", cs), ("even_cases", cs.where("query_id % 200 = 0")))]
    return ev.compare(both[0].unionByName(both[1])).select("metric", "k", "all_cases", "even_cases")


CONF = "try_cast(json_extract_string(CASE WHEN json_valid(text) THEN text END, '$.confidence') AS DOUBLE)"


def picks(spark, d):
    confidence = F.expr("try_cast(get_json_object(text, '$.confidence') as double)")
    return table(spark, d, "run_records").where(~ev.failed()).select("condition", confidence.alias("confidence"), F.col("correct"))


@R.add(
    "eva6_calibration",
    f"""WITH p AS (SELECT condition, {CONF} AS confidence, correct FROM run_records WHERE coalesce(error, '') = ''), k AS (SELECT * FROM p WHERE confidence IS NOT NULL),
    b AS (SELECT *, CASE WHEN confidence >= 0 AND confidence <= 1 THEN least(len(list_filter([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: e <= confidence)), 10) - 1 END AS bin FROM k),
    t AS (SELECT condition, count(*) AS total FROM k GROUP BY condition),
    g AS (SELECT condition, bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM b WHERE bin IS NOT NULL GROUP BY ALL)
    SELECT condition, bin::INT AS bin, n, round(c, 6) AS confidence, round(a, 6) AS accuracy, round(sum(abs(c - a) * n / total) OVER (PARTITION BY condition), 6) AS ece FROM g JOIN t USING (condition)""",
)
def eva6(spark, d):
    out = ev.calibration(picks(spark, d), ["condition"])
    return out.select("condition", "bin", "n", *[F.round(x, 6).alias(x) for x in ("confidence", "accuracy", "ece")])


@R.add(
    "eva7_gating",
    f"""WITH p AS (SELECT condition, CASE WHEN {CONF} IS NULL AND rec_id % 2 = 0 THEN NULL ELSE coalesce({CONF}, 0.25) END AS confidence, correct FROM run_records WHERE coalesce(error, '') = '' AND text <> ''),
    t AS (SELECT unnest([0.5, 0.7, 0.9]::DOUBLE[]) AS threshold), ok AS (SELECT condition FROM p GROUP BY condition HAVING count(*) = count(confidence))
    SELECT condition, threshold, round(avg(CASE WHEN confidence >= threshold THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN confidence >= threshold THEN correct END), 6) AS accuracy
    FROM p JOIN ok USING (condition), t GROUP BY condition, threshold""",
)
def eva7(spark, d):
    confidence = F.expr("try_cast(get_json_object(text, '$.confidence') as double)")
    rows = table(spark, d, "run_records").where(~ev.failed() & (F.col("text") != ""))
    known = F.when(confidence.isNull() & (F.col("rec_id") % 2 == 0), F.lit(None)).otherwise(F.coalesce(confidence, F.lit(0.25)))
    out = ev.gating(rows.select("condition", known.alias("confidence"), "correct"), by=["condition"])
    return out.select("condition", "threshold", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


@R.add(
    "eva8_selection",
    f"""WITH {c.TEXTS}, {bm25_sql(TOOL_DOCS, '40')}, {SCORABLE},
    p AS (SELECT cs.query_id, cs.server, any_value(kw.id) FILTER (WHERE kw.rank = 1) AS pick, cs.accept FROM cases cs LEFT JOIN kw USING (query_id) GROUP BY ALL)
    SELECT server, count(*) AS n, round(avg(CASE WHEN list_contains(accept, pick) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY server""",
)
def eva8(spark, d):
    cs = cases(spark, d)
    picked = rt.select_first(cs, found(spark, d, 40)).join(cs, "query_id")
    right = F.coalesce(F.array_contains("expected", F.col("pick")), F.lit(False)).cast("double")
    return picked.groupBy("server").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


TARGET = "CASE WHEN len(expected) > 0 THEN coalesce(list_contains(expected[1:1] || coalesce(also_accept, []), tool), false)::BIGINT ELSE correct END"
PCT = "(SELECT condition, max(x) FILTER (WHERE k = round_even(0.5 * (n - 1), 0)) AS p50, max(x) FILTER (WHERE k = round_even(0.95 * (n - 1), 0)) AS p95 FROM (SELECT condition, latency_s AS x, row_number() OVER (PARTITION BY condition ORDER BY latency_s) - 1 AS k, count(*) OVER (PARTITION BY condition) AS n FROM ok WHERE latency_s > 0) GROUP BY condition)"
OK = "ok AS (SELECT * FROM run_records WHERE coalesce(error, '') = '')"
_ROUNDED = ("accuracy", "target_accuracy", "no_tool_rate", "cut_off_rate", "retrieval_recall", "tools_per_request", "mean_input_tokens", "mean_output_tokens", "mean_cache_read_tokens", "cost_list", "cost_effective", "billed_cost", "reported_cost", "cost_per_1k", "billed_per_1k")


@R.add(
    "eva9_run_summary",
    f"""WITH {OK}, m AS (SELECT condition, avg(correct) AS accuracy, avg({TARGET}) AS target_accuracy, avg((tool IS NULL)::INT) AS no_tool_rate, avg((coalesce(stop_reason, '') = 'length')::INT) AS cut_off_rate,
      avg(retrieved) AS retrieval_recall, avg(n_tools) AS tools_per_request, avg(input_tokens + cache_read + cache_write) AS mean_input_tokens, avg(output_tokens) AS mean_output_tokens, avg(cache_read) AS mean_cache_read_tokens,
      sum(input_tokens + cache_read + cache_write)::BIGINT AS total_input_tokens, sum(cost_list) AS cost_list, sum(cost_effective) AS cost_effective, sum(coalesce(reported_cost, cost_effective)) AS billed_cost, sum(reported_cost) AS reported_cost,
      avg(cost_list) * 1000 AS cost_per_1k, avg(coalesce(reported_cost, cost_effective)) * 1000 AS billed_per_1k FROM ok GROUP BY condition),
    a AS (SELECT condition, count(*) AS n, sum((coalesce(error, '') <> '')::INT)::BIGINT AS errors FROM run_records GROUP BY condition)
    SELECT a.condition, a.n, a.errors, {', '.join(f'round(m.{x}, 6) AS {x}' for x in _ROUNDED)}, coalesce(m.total_input_tokens, 0) AS total_input_tokens, coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95
    FROM a LEFT JOIN m ON a.condition IS NOT DISTINCT FROM m.condition LEFT JOIN {PCT} p ON p.condition = a.condition""",
)
def eva9(spark, d):
    s = ev.run_summary(table(spark, d, "run_records"))
    return s.select("condition", "n", "errors", *[F.round(x, 6).alias(x) for x in _ROUNDED], "total_input_tokens", "p50", "p95")


@R.add("eva9_by_kind", f"WITH {OK} SELECT condition, kind, count(*) AS n, sum(correct)::BIGINT AS correct, round(avg(correct), 6) AS accuracy FROM ok GROUP BY ALL")
def eva9_kind(spark, d):
    return ev.by_kind(table(spark, d, "run_records")).withColumn("accuracy", F.round("accuracy", 6))


@R.add(
    "eva10_percentiles",
    """SELECT server, max(x) FILTER (WHERE k = round_even(0.5 * (n - 1), 0)) AS p50, max(x) FILTER (WHERE k = round_even(0.95 * (n - 1), 0)) AS p95, max(x) FILTER (WHERE k = round_even(0.99 * (n - 1), 0)) AS p99
    FROM (SELECT coalesce(server, '?') AS server, latency_s AS x, row_number() OVER (PARTITION BY coalesce(server, '?') ORDER BY latency_s) - 1 AS k, count(*) OVER (PARTITION BY coalesce(server, '?')) AS n FROM run_records WHERE latency_s IS NOT NULL) GROUP BY server""",
)
def eva10(spark, d):
    return ev.percentile(table(spark, d, "run_records").withColumn("server", F.coalesce("server", F.lit("?"))), "latency_s", ["server"], (50, 95, 99))


@R.add("eva11_target_first", f"SELECT kind, sum({TARGET})::BIGINT AS target_correct, sum(correct)::BIGINT AS correct, count(*) AS n FROM run_records GROUP BY kind")
def eva11(spark, d):
    return table(spark, d, "run_records").groupBy("kind").agg(F.sum(ev.target_correct()).alias("target_correct"), F.sum("correct").alias("correct"), F.count("*").alias("n"))


@R.add("eva12_billed_cost", "SELECT coalesce(server, '?') AS server, round(sum(coalesce(reported_cost, cost_effective)), 6) AS billed, count(reported_cost) AS reported FROM run_records GROUP BY 1")
def eva12(spark, d):
    return table(spark, d, "run_records").groupBy(F.coalesce("server", F.lit("?")).alias("server")).agg(F.round(F.sum(ev.billed()), 6).alias("billed"), F.count("reported_cost").alias("reported"))


@R.add(
    "eva13_costs",
    """SELECT rec_id, round(((input_tokens + cache_read + cache_write) * 0.25 + output_tokens * 2.0) / 1e6, 12) AS list_cost,
    round((input_tokens * 0.25 + cache_read * 0.025 + cache_write * 0.3125 + output_tokens * 2.0) / 1e6, 12) AS effective_cost FROM run_records""",
)
def eva13(spark, d):
    a, b = ev.costs(F.lit(0.25), F.lit(2.0), F.lit(0.025), F.lit(0.3125))
    return table(spark, d, "run_records").select("rec_id", F.round(a, 12).alias("list_cost"), F.round(b, 12).alias("effective_cost"))


@R.add(
    "eva14_flags",
    """WITH a AS (SELECT rec_id, tool, retrieved, coalesce(expected, []) || coalesce(also_accept, []) AS accept FROM run_records)
    SELECT a.rec_id, coalesce(list_contains(a.accept, a.tool), false) AS correct, list_has_any(a.accept, list(DISTINCT t.name) FILTER (WHERE t.name IS NOT NULL)) IS TRUE AS in_catalog
    FROM a LEFT JOIN tool_catalog t ON list_contains(a.accept, t.name) GROUP BY a.rec_id, a.tool, a.accept""",
)
def eva14(spark, d):
    """Whether the pick is accepted, and whether any accepted name was there to be found (here: is in the catalog)."""
    none = F.array().cast("array<string>")
    rows = table(spark, d, "run_records").select("rec_id", "tool", F.concat(F.coalesce("expected", none), F.coalesce("also_accept", none)).alias("accept"))
    names = table(spark, d, "tool_catalog").select("name").distinct()
    there = rows.select("rec_id", F.explode("accept").alias("name")).join(names, "name", "left_semi").select("rec_id").distinct().withColumn("x", F.lit(True))
    return rows.join(there, "rec_id", "left").select("rec_id", F.coalesce(F.array_contains("accept", F.col("tool")), F.lit(False)).alias("correct"), F.coalesce("x", F.lit(False)).alias("in_catalog"))


LAST = "last AS (SELECT condition, i, correct FROM (SELECT *, row_number() OVER (PARTITION BY condition, i ORDER BY rec_id DESC) AS rn FROM run_records WHERE condition IS NOT NULL AND i IS NOT NULL) WHERE rn = 1)"


def last(spark, d):
    rows = table(spark, d, "run_records").where("condition is not null and i is not null")
    return st.last_per_query(rows.select("condition", "i", "correct", "rec_id"))


@R.add("eva16_refresh", f"WITH {LAST} SELECT condition, count(*) AS n, sum(correct)::BIGINT AS correct FROM last GROUP BY condition")
def eva16(spark, d):
    """Summaries recomputed from the records, of which a later one of the same query replaces the earlier."""
    return last(spark, d).groupBy("condition").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))


PAIRS = f"{LAST}, pairs AS (SELECT x.condition AS a, y.condition AS b, x.correct AS ca, y.correct AS cb FROM last x JOIN last y ON x.i = y.i AND x.condition < y.condition)"
# the binomial tail in exact arithmetic of doubles by the same recurrence
TAIL = """CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda j: exp(lgamma(a_only + b_only + 1) - lgamma(j + 1) - lgamma(a_only + b_only - j + 1) - (a_only + b_only) * ln(2))))) END"""
COUNTS = "SELECT a, b, count(*) AS n, sum((ca > cb)::INT)::BIGINT AS a_only, sum((cb > ca)::INT)::BIGINT AS b_only, avg(ca - cb) AS diff FROM pairs GROUP BY ALL"


@R.add("sta1_mcnemar", f"WITH {PAIRS} SELECT a, b, n, a_only, b_only, round(diff, 6) AS diff, round({TAIL}, 6) AS p FROM ({COUNTS})")
def sta1(spark, d):
    rows = last(spark, d)
    tests = _all_pairs(rows)
    return st.comparison_matrix(rows, tests).select("a", "b", "n", "a_only", "b_only", F.round("diff", 6).alias("diff"), F.round("p", 6).alias("p"))


def _all_pairs(rows):
    names = rows.select("condition").distinct()
    both = names.select(F.col("condition").alias("a"), F.lit(1).alias("one")).join(names.select(F.col("condition").alias("b"), F.lit(1).alias("one")), "one")
    return both.where("a < b").select(F.lit("all").alias("question"), "a", "b")


@R.add("sta2_bootstrap")
def sta2(spark, d):
    """All pairs of conditions, 10,000 resamples each; multinomial draws have no SQL."""
    rows = last(spark, d)
    x, y = rows.select(F.col("condition").alias("ga"), "i", F.col("correct").alias("a")), rows.select(F.col("condition").alias("gb"), "i", F.col("correct").alias("b"))
    out = st.bootstrap(x.join(y, "i").where("ga < gb"), ["ga", "gb"], reps=10_000)
    return out.select(F.col("ga").alias("a"), F.col("gb").alias("b"), *[F.round(k, 6).alias(k) for k in ("diff", "lo", "hi")])


@R.add(
    "sta3_holm",
    f"""WITH {PAIRS}, t AS (SELECT a, b, round({TAIL}, 9) AS p FROM ({COUNTS})), r AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS rn, count(*) OVER () AS n FROM t)
    SELECT a, b, round(p, 6) AS p, round(max(least(1.0, (n - rn + 1) * p)) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING), 6) AS holm_p FROM r""",
)
def sta3(spark, d):
    rows = last(spark, d)
    tests = st.comparison_matrix(rows, _all_pairs(rows)).select("a", "b", F.round("p", 9).alias("p"))
    return st.holm(tests, "p", ("a", "b")).select("a", "b", F.round("p", 6).alias("p"), F.round("holm_p", 6).alias("holm_p"))


@R.add(
    "sta4_comparison_matrix",
    f"""WITH {PAIRS}, acc AS (SELECT condition, avg(correct) AS acc FROM last GROUP BY condition),
    cmp AS (SELECT * FROM (VALUES ('shortlist size', 'top-20', 'top-5'), ('augmented', 'top-20', 'top-20-augmented'), ('missing', 'no-such-run', 'top-5')) v(question, x, y)),
    k AS (SELECT question, x, y, ca, cb FROM cmp JOIN (SELECT a AS x, b AS y, ca, cb FROM pairs UNION ALL SELECT b, a, cb, ca FROM pairs) USING (x, y)),
    t AS (SELECT question, x, y, count(*) AS n, sum((ca > cb)::INT)::BIGINT AS a_only, sum((cb > ca)::INT)::BIGINT AS b_only, avg(ca - cb) AS diff FROM k GROUP BY ALL),
    p AS (SELECT *, {TAIL} AS p FROM t), r AS (SELECT *, row_number() OVER (ORDER BY p, question, x, y) AS rn, count(*) OVER () AS m FROM p)
    SELECT question, x AS a, y AS b, n, a_only, b_only, round(aa.acc, 6) AS acc_a, round(ab.acc, 6) AS acc_b, round(diff, 6) AS diff, round(p, 6) AS p, round(max(least(1.0, (m - rn + 1) * p)) OVER (ORDER BY p, question, x, y ROWS UNBOUNDED PRECEDING), 6) AS holm_p
    FROM r JOIN acc aa ON aa.condition = x JOIN acc ab ON ab.condition = y""",
)
def sta4(spark, d):
    cmp = spark.createDataFrame([("shortlist size", "top-20", "top-5"), ("augmented", "top-20", "top-20-augmented"), ("missing", "no-such-run", "top-5")], "question string, a string, b string")
    out = st.comparison_matrix(last(spark, d), cmp)
    return out.select("question", "a", "b", "n", "a_only", "b_only", *[F.round(x, 6).alias(x) for x in ("acc_a", "acc_b", "diff", "p", "holm_p")])


@R.add(
    "sta5_gating_json",
    f"""WITH p AS (SELECT condition, coalesce({CONF}, 0.0) AS confidence, correct FROM run_records), t AS (SELECT unnest([0.5, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold)
    SELECT condition, threshold, round(avg(CASE WHEN confidence >= threshold THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN confidence >= threshold THEN correct END), 6) AS accuracy FROM p, t GROUP BY ALL""",
)
def sta5(spark, d):
    """Gating from the recorded text; here a missing confidence counts as 0, and failed records count too."""
    confidence = F.coalesce(F.expr("try_cast(get_json_object(text, '$.confidence') as double)"), F.lit(0.0))
    rows = table(spark, d, "run_records").select("condition", confidence.alias("confidence"), "correct")
    return ev.gating(rows, (0.5, 0.7, 0.8, 0.9), ["condition"]).select("condition", "threshold", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))
