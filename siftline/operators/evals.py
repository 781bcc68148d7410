"""Evaluation aggregates over search results, decisions and run records.

Cases are ``(query_id, expected array<string>)`` with a non-empty ``expected``; results are ``(query_id, id, rank)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_cases(cases: DataFrame) -> DataFrame:
    """The cases, failing the job if one has no expected name: its recall would be undefined."""
    empty = F.coalesce(F.size("expected"), F.lit(0)) < 1
    return cases.withColumn("expected", F.when(empty, F.raise_error(F.concat(F.lit("empty expected in case "), F.col("query_id").cast("string"))).cast("array<string>")).otherwise(F.col("expected")))


def scorable(rows: DataFrame, allow_draft: bool = False) -> DataFrame:
    """Cases that count: status ok (or any but dropped with ``allow_draft``; null counts as ok), a query and an expected
    name. ``accept`` is expected and also_accept together, which both widens what counts as a hit and recall's divisor.
    """
    status = F.lower(F.coalesce(F.col("status"), F.lit("ok")))
    kept = rows.where(status != "dropped" if allow_draft else status == "ok").where("query is not null and trim(query) <> '' and size(expected) > 0")
    return kept.withColumn("accept", F.concat("expected", F.coalesce("also_accept", F.array().cast("array<string>"))))


def hits(cases: DataFrame, results: DataFrame) -> DataFrame:
    """``(query_id, expected, ranks)``: for every case the sorted ranks at which expected names were found, maybe none."""
    wanted = cases.select("query_id", F.explode(F.array_distinct("expected")).alias("id"))
    found = wanted.join(results.select("query_id", "id", "rank"), ["query_id", "id"]).groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    return cases.select("query_id", "expected").join(found, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))


def retrieval_metrics(cases: DataFrame, results: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """``(metric, k, value)``: hit@k, recall@k and MRR (within the largest k), means over all cases, unrounded."""
    h = hits(cases, results)
    wanted = F.size(F.array_distinct("expected"))
    columns = []
    for k in ks:
        inside = F.size(F.filter("ranks", lambda r: r <= k))
        columns += [F.avg((inside > 0).cast("double")).alias(f"hit_{k}"), F.avg(inside / wanted).alias(f"recall_{k}")]
    first = F.get("ranks", F.lit(0))
    columns.append(F.avg(F.when(first <= max(ks), 1 / first).otherwise(0.0)).alias(f"mrr_{max(ks)}"))
    wide = h.agg(*columns)
    names = [c for c in wide.columns]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n.split("_")[0]).alias("metric"), F.lit(int(n.split("_")[1])).alias("k"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")


def failures(cases: DataFrame, results: DataFrame, top: int = 5) -> DataFrame:
    """``(query_id, rank, found)``: cases whose first expected name is not at rank 1, with what was found instead."""
    shown = results.where(F.col("rank") <= top).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("found"))
    first = hits(cases, results).select("query_id", F.get("ranks", F.lit(0)).alias("rank")).where("rank is null or rank <> 1")
    return first.join(shown, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def calibration(picks: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """``(by..., bin, n, confidence, accuracy, ece)`` of ``picks(by..., confidence, correct)``.

    Bins are [b/bins, (b+1)/bins), the last one with its upper edge; confidences outside [0, 1] fall in no bin but count in
    n of the expected calibration error; empty bins have no row; null confidences are left out.
    """
    c = F.col("confidence")
    # compared with the edges: multiplying by the number of bins misplaces values just below an edge
    edges = F.array(*[F.lit(b / bins) for b in range(bins)])
    at = F.when((c >= 0) & (c <= 1), F.least(F.size(F.filter(edges, lambda e: e <= c)), F.lit(bins)) - 1)
    rows = picks.where(c.isNotNull() & ~F.isnan(c)).withColumn("bin", at)
    total = rows.groupBy(*by).agg(F.count("*").alias("total")) if by else rows.agg(F.count("*").alias("total"))
    per = rows.where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    joined = per.join(total, list(by)) if by else per.join(F.broadcast(total))
    gap = F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n") / F.col("total")
    return joined.withColumn("ece", F.sum(gap).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))).drop("total")


def gating(picks: DataFrame, thresholds: Sequence[float] = (0.5, 0.7, 0.9), by: Sequence[str] = ()) -> DataFrame:
    """``(by..., threshold, coverage, accuracy)``; accuracy is null where nothing is covered. A group that has a null
    confidence has no rows: gating needs them all."""
    columns = [F.count("*").alias("n"), F.count("confidence").alias("known")]
    for i, t in enumerate(thresholds):
        over = F.col("confidence") >= t
        columns += [F.sum(over.cast("bigint")).alias(f"c{i}"), F.avg(F.when(over, F.col("correct").cast("double"))).alias(f"a{i}")]
    wide = (picks.groupBy(*by) if by else picks.groupBy()).agg(*columns).where("n = known and n > 0")
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"c{i}") / F.col("n")).alias("coverage"), F.col(f"a{i}").alias("accuracy")) for i, t in enumerate(thresholds)])
    return wide.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")


def percentile(rows: DataFrame, value: str, by: Sequence[str], points: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """``(by..., p<point>...)``: the value at index round-half-even(point/100 * (n - 1)) in sorted order; nulls are left out.

    Exact, without sorting large groups: in a group of more than ten times ``accuracy`` values, an approximate percentile
    (whose rank is wrong by n / accuracy at most) bounds each point from both sides; what lies below is counted, and only
    the values between the bounds are sorted.
    """
    x = F.col(value)
    margin = 2.0 / accuracy
    fractions = [min(1.0, max(0.0, p / 100 + side)) for p in points for side in (-margin, margin)]
    known = rows.where(x.isNotNull()).select(*by, x)
    groups = known.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(value, fractions, accuracy).alias("q"))
    large = F.col("n") > 10 * accuracy
    ends = F.array(*[F.struct(F.lit(i).alias("point"), F.when(large, F.get("q", F.lit(2 * i))).alias("lo"), F.when(large, F.get("q", F.lit(2 * i + 1))).alias("hi")) for i in range(len(points))])
    at = F.element_at(F.array(*[F.lit(p / 100.0) for p in points]), F.col("e.point") + 1)
    groups = groups.select(*by, "n", F.explode(ends).alias("e")).select(*by, F.col("e.point").alias("point"), F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"), F.bround(at * (F.col("n") - 1), 0).alias("at"))
    same = known.alias("r").join(groups.alias("g"), [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]).select(*[F.col(f"g.{c}").alias(c) for c in by], "point", "lo", "hi", "at", F.col(f"r.{value}").alias(value))
    # what lies below the bounds becomes one row of each group in the map stage, what lies above is dropped
    inside = same.where(F.col("hi").isNull() | (x <= F.col("hi"))).withColumn("x", F.when(F.col("lo").isNull() | (x >= F.col("lo")), x))
    counted = inside.groupBy(*by, "point", "at", "x").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by, "point").orderBy(F.asc_nulls_first("x"))
    found = counted.withColumn("upto", F.sum("c").over(w)).where(F.col("x").isNotNull() & (F.col("upto") > F.col("at"))).groupBy(*by, "point").agg(F.min("x").alias("x"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("point") == i, F.col("x"))).alias(f"p{p:g}") for i, p in enumerate(points)])


def billed() -> Column:
    """What a request cost: the reported amount if there is one, else the cache-aware estimate."""
    return F.coalesce("reported_cost", "cost_effective")


def costs(input_price: Column, output_price: Column, read_price: Column, write_price: Column, extra: Column | None = None) -> tuple[Column, Column]:
    """List and effective cost in USD from prices per million tokens: at list price all input tokens cost the same."""
    i, o, r, w = (F.col(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_write"))
    more = extra if extra is not None else F.lit(0.0)
    return ((i + r + w) * input_price + o * output_price) / 1e6 + more, (i * input_price + r * read_price + w * write_price + o * output_price) / 1e6 + more


def target_correct() -> Column:
    """1 if the pick is the first expected name or also accepted; records without expected names keep their ``correct``."""
    expected = F.coalesce("expected", F.array().cast("array<string>"))
    accepted = F.concat(F.slice(expected, 1, 1), F.coalesce("also_accept", F.array().cast("array<string>")))
    return F.when(F.size(expected) > 0, F.coalesce(F.array_contains(accepted, F.col("tool")), F.lit(False)).cast("bigint")).otherwise(F.col("correct"))


def failed() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) != ""


def run_summary(records: DataFrame, by: Sequence[str] = ("condition",)) -> DataFrame:
    """One row per condition; rates and means leave failed records out of the divisor, ``n`` and ``errors`` count them."""
    ok = ~failed()
    mean = lambda c: F.avg(F.when(ok, c))
    total = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0))
    tokens_in = F.col("input_tokens") + F.col("cache_read") + F.col("cache_write")
    main = records.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(failed().cast("bigint")).alias("errors"),
        mean(F.col("correct")).alias("accuracy"),
        mean(target_correct()).alias("target_accuracy"),
        mean(F.col("tool").isNull().cast("double")).alias("no_tool_rate"),
        mean((F.coalesce("stop_reason", F.lit("")) == "length").cast("double")).alias("cut_off_rate"),
        mean(F.col("retrieved")).alias("retrieval_recall"),
        mean(F.col("n_tools")).alias("tools_per_request"),
        mean(tokens_in).alias("mean_input_tokens"),
        mean(F.col("output_tokens")).alias("mean_output_tokens"),
        mean(F.col("cache_read")).alias("mean_cache_read_tokens"),
        total(tokens_in).alias("total_input_tokens"),
        total(F.col("cost_list")).alias("cost_list"),
        total(F.col("cost_effective")).alias("cost_effective"),
        total(billed()).alias("billed_cost"),
        F.sum(F.when(ok, F.col("reported_cost"))).alias("reported_cost"),
        (mean(F.col("cost_list")) * 1000).alias("cost_per_1k"),
        (mean(billed()) * 1000).alias("billed_per_1k"),
    )
    latency = percentile(records.where(ok & (F.col("latency_s") > 0)), "latency_s", by, (50, 95))
    out = main.join(latency, list(by), "left")
    return out.withColumn("p50", F.coalesce("p50", F.lit(0.0))).withColumn("p95", F.coalesce("p95", F.lit(0.0)))


def by_kind(records: DataFrame, by: Sequence[str] = ("condition",)) -> DataFrame:
    ok = records.where(~failed())
    return ok.groupBy(*by, "kind").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"), F.avg("correct").alias("accuracy"))


def compare(reports: DataFrame) -> DataFrame:
    """Side by side: one row per metric and k, one column per label of ``reports(label, metric, k, value)``, 4 decimals."""
    return reports.groupBy("metric", "k").pivot("label").agg(F.round(F.first("value"), 4))
