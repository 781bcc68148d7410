import pytest
from pyspark.sql import functions as F

from siftline.operators import evals as ev
from siftline.operators import stats as st


def cases(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, expected array<string>")


def results(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, id string, rank int")


def test_metrics(spark):
    c = cases(spark, [(0, ["a"]), (1, ["b", "c", "c"]), (2, ["z"])])
    r = results(spark, [(0, "a", 1), (1, "x", 1), (1, "c", 2), (1, "b", 4)])
    m = {(x.metric, x.k): x.value for x in ev.retrieval_metrics(c, r, (1, 3)).collect()}
    assert m == {("hit", 1): pytest.approx(1 / 3), ("hit", 3): pytest.approx(2 / 3), ("recall", 1): pytest.approx(1 / 3), ("recall", 3): pytest.approx(0.5), ("mrr", 3): pytest.approx(0.5)}
    f = {x.query_id: (x.rank, x.found) for x in ev.failures(c, r).collect()}
    assert f == {1: (2, ["x", "c", "b"]), 2: (None, [])}


def test_empty_expected_is_an_error(spark):
    with pytest.raises(Exception, match="empty expected"):
        ev.check_cases(cases(spark, [(7, [])])).collect()


def picks(spark, rows):
    return spark.createDataFrame(rows, "confidence double, correct int")


def test_calibration(spark):
    good = ev.calibration(picks(spark, [(0.9, int(i < 9)) for i in range(10)])).collect()
    assert len(good) == 1 and good[0].ece == pytest.approx(0) and good[0].bin == 9
    assert ev.calibration(picks(spark, [(0.9, 0)] * 10)).first().ece == pytest.approx(0.9)
    edges = ev.calibration(picks(spark, [(1.0, 1), (0.0, 0), (0.8999999999999999, 1), (1.5, 1), (None, 1)])).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in edges] == [(0, 1), (8, 1), (9, 1)]
    assert edges[0].ece == pytest.approx((0 + 0.1 + 0) / 4)  # the value above 1 counts in n
    assert ev.calibration(picks(spark, [])).count() == 0


def test_gating(spark):
    g = {r.threshold: (r.coverage, r.accuracy) for r in ev.gating(picks(spark, [(0.95, 1), (0.55, 1), (0.4, 0)])).collect()}
    assert g[0.9] == (pytest.approx(1 / 3), 1.0) and g[0.5] == (pytest.approx(2 / 3), 1.0)
    assert ev.gating(picks(spark, [(0.95, 1), (None, 1)])).count() == 0
    assert ev.gating(picks(spark, [(0.1, 1)]), (0.5,)).first().accuracy is None


def test_percentile_rounds_half_to_even(spark):
    for n in (1, 2, 3, 4, 7, 11):
        df = spark.createDataFrame([("g", float(i)) for i in range(n)] + [("g", None)], "g string, x double")
        r = ev.percentile(df, "x", ["g"], (50, 95)).first()
        assert (r.p50, r.p95) == (float(round(0.5 * (n - 1))), float(round(0.95 * (n - 1))))


def test_percentile_of_large_groups_is_exact(spark):
    import random

    rng = random.Random(1)
    values = {"big": [rng.choice([rng.random(), 0.5, 3.0]) for _ in range(3000)], "small": [rng.random() for _ in range(90)], "one": [7.0] * 900, None: [1.0, 2.0]}
    df = spark.createDataFrame([(g, x) for g, v in values.items() for x in v], "g string, x double").repartition(5)
    for r in ev.percentile(df, "x", ["g"], (0, 50, 95, 100), accuracy=50).collect():
        v = sorted(values[r.g])
        assert (r.p0, r.p50, r.p95, r.p100) == tuple(v[round(p / 100 * (len(v) - 1))] for p in (0, 50, 95, 100))


RECORD = "condition string, i bigint, kind string, expected array<string>, also_accept array<string>, tool string, correct bigint, retrieved bigint, n_tools bigint, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_write bigint, latency_s double, cost_list double, cost_effective double, reported_cost double, stop_reason string, error string"


def test_run_summary(spark):
    rows = [
        ("c", 0, "direct", ["a", "b"], [], "b", 1, 1, 5, 10, 1, 2, 3, 1.0, 0.5, 0.4, None, "tool_use", ""),
        ("c", 1, "direct", ["a"], ["d"], "d", 1, 1, 5, 10, 1, 0, 0, 0.0, 0.5, 0.4, 0.1, "length", None),
        ("c", 2, "multi", ["a"], None, None, 0, 0, 5, 10, 1, 0, 0, 3.0, 0.5, 0.4, None, "end", ""),
        ("c", 3, "multi", ["a"], None, None, 0, 0, 99, 99, 9, 0, 0, 9.0, 9.0, 9.0, None, "", "timeout"),
    ]
    s = ev.run_summary(spark.createDataFrame(rows, RECORD)).first()
    assert (s.n, s.errors, s.total_input_tokens) == (4, 1, 35)
    assert s.accuracy == pytest.approx(2 / 3) and s.target_accuracy == pytest.approx(1 / 3)
    assert s.no_tool_rate == pytest.approx(1 / 3) and s.cut_off_rate == pytest.approx(1 / 3)
    assert s.billed_cost == pytest.approx(0.4 + 0.1 + 0.4) and s.reported_cost == pytest.approx(0.1)
    assert (s.p50, s.p95) == (1.0, 3.0)  # only latencies above 0
    assert ev.run_summary(spark.createDataFrame([], RECORD)).count() == 0


def test_mcnemar(spark):
    a = spark.createDataFrame([(i, 1) for i in range(10)] + [(99, 1)], "i bigint, correct bigint")
    b = spark.createDataFrame([(i, int(i < 2)) for i in range(10)], "i bigint, correct bigint")
    r = st.mcnemar(st.paired(a, b)).first()
    assert (r.n, r.a_only, r.b_only) == (10, 8, 0) and r.p == pytest.approx(2 / 2**8)


def test_mcnemar_p_small_and_large(spark):
    from math import comb

    for x, y in ((0, 0), (12, 1), (17, 2), (5, 5), (700, 800), (1500, 1400)):
        n = x + y
        want = min(1.0, float(2 * sum(comb(n, j) for j in range(min(x, y) + 1)) / 2**n)) if n else 1.0
        got = spark.range(1).select(st.mcnemar_p(F.lit(x).cast("bigint"), F.lit(y).cast("bigint")).alias("p")).first().p
        assert got == pytest.approx(want, rel=1e-9)


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "i int, p double")
    assert [r.holm_p for r in st.holm(df).orderBy("i").collect()] == pytest.approx([0.03, 0.06, 0.06])


def test_bootstrap_is_repeatable_and_covers_the_difference(spark):
    rows = [("g", int(i % 3 > 0), int(i % 5 > 1)) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, a int, b int")
    x, y = st.bootstrap(df, ["g"], 400).first(), st.bootstrap(df.orderBy(F.desc("a")), ["g"], 400).first()
    assert x == y and x.lo <= x.diff <= x.hi and x.diff == pytest.approx(sum(a - b for _, a, b in rows) / 90)


def test_bootstrap_reaches_every_pair_of_a_large_group(spark):
    import numpy as np

    n, pos, neg, reps = 60_000, 24_000, 6_000, 1_000
    df = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") < pos).cast("int").alias("a"), (F.col("id") >= n - neg).cast("int").alias("b"))
    got = st.bootstrap(df, ["g"], reps).first()
    d = np.repeat(np.array([1, 0, -1], np.int8), [pos, n - pos - neg, neg])
    rng = np.random.default_rng(1)
    means = np.sort([d[rng.integers(0, n, n)].mean() for _ in range(reps)])
    assert got.diff == pytest.approx(0.3) and got.lo < got.diff < got.hi
    assert (got.lo, got.hi) == pytest.approx((means[25], means[974]), abs=0.0015)


def test_registered_bootstrap_gives_every_pair_of_conditions(spark, tmp_path):
    import numpy as np

    from siftline.plans.eval_queries import sta2

    correct = {"all": lambda i: i % 2, "top-20": lambda i: int(i % 3 > 0), "top-5": lambda i: int(i % 5 > 0)}
    rows = [(10 * i + k, name, i, f(i)) for k, (name, f) in enumerate(correct.items()) for i in range(120)]
    spark.createDataFrame(rows, "rec_id bigint, condition string, i bigint, correct bigint").write.parquet(str(tmp_path / "run_records.parquet"))
    got = {(r.a, r.b): r for r in sta2(spark, str(tmp_path)).collect()}
    assert set(got) == {("all", "top-20"), ("all", "top-5"), ("top-20", "top-5")}
    rng = np.random.default_rng(1)
    for (a, b), r in got.items():
        d = np.array([correct[a](i) - correct[b](i) for i in range(120)])
        means = np.sort(d[rng.integers(0, 120, (10_000, 120))].mean(axis=1))
        assert r.diff == pytest.approx(d.mean(), abs=1e-6)
        assert (r.lo, r.hi) == pytest.approx((means[250], means[9749]), abs=0.01)


def test_comparison_matrix_skips_missing_runs(spark):
    r = spark.createDataFrame([("a", i, 1) for i in range(4)] + [("b", i, i % 2) for i in range(4)], "condition string, i bigint, correct bigint")
    c = spark.createDataFrame([("q", "a", "b"), ("q", "a", "none")], "question string, a string, b string")
    got = st.comparison_matrix(r, c).collect()
    assert len(got) == 1 and (got[0].n, got[0].a_only, got[0].b_only, got[0].diff) == (4, 2, 0, 0.5) and got[0].holm_p == pytest.approx(0.5)


def test_last_record_counts(spark):
    r = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 2)], "condition string, i bigint, correct bigint, rec_id bigint")
    assert st.last_per_query(r).first().correct == 1


def test_binomial_tail_of_large_counts():
    from math import erfc, sqrt

    from siftline.operators.stats import binomial_tail

    for n, m in ((2_000, 900), (10**6, 499_000), (10**10, 5 * 10**9 - 60_000), (10**9, 0)):
        z = (n / 2 - m - 0.5) / sqrt(n / 4)
        want = erfc(z / sqrt(2)) / 2
        assert abs(binomial_tail(n, m) - want) <= 0.03 * want + 1e-300
    exact = sum(__import__("math").comb(2_000, j) for j in range(901)) / 2**2000
    assert abs(binomial_tail(2_000, 900) - exact) < 1e-9 * exact
