import random

import pytest
from pyspark.sql import functions as F

from statera.operators import latency, ordered


def log(n, seed, hot=0.6):
    """(key, ts in seconds, id, value): one key holds most rows; some keys are null; times repeat."""
    rng = random.Random(seed)
    return [
        (None if rng.random() < 0.1 else ("hot" if rng.random() < hot else rng.choice("ab")), rng.randint(0, 400), i, rng.randint(0, 3))
        for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, s long, i long, v long").withColumn("ts", F.timestamp_seconds("s")).repartition(3)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running_sum_and_changes(spark, parts):
    rows = log(200, parts)
    df = frame(spark, rows)
    sums = {r["i"]: r["run"] for r in ordered.with_running_sum(df, ["k"], ["s", "i"], F.col("v"), "run", parts).collect()}
    changes = {
        r["i"]: (r["prev"], r["n"])
        for r in ordered.with_changes(df, ["k"], ["s", "i"], "v", lambda p, c: p != c, "prev", "n", parts).collect()
    }
    begun = {
        r["i"]: r["n"]
        for r in ordered.with_changes(df, ["k"], ["s", "i"], "v", lambda p, c: p.isNull() | (p < c), "prev", "n", parts).collect()
    }
    state, ups = {}, {}
    for k, s, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total, prev, n = state.get(k, (0, None, 0))
        total, n = total + v, n + (prev is not None and prev != v)
        assert sums[i] == total
        assert changes[i] == (prev, n)
        ups[k] = ups.get(k, 0) + (prev is None or prev < v)
        assert begun[i] == ups[k]
        state[k] = (total, v, n)
    assert len(sums) == len(changes) == len(rows)


def test_nulls_in_a_running_sum(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, 2, None, 3, None])], "k int, i int, v int")
    got = {r["i"]: r["run"] for r in ordered.with_running_sum(df, ["k"], ["i"], F.col("v"), "run", 6).collect()}
    assert got == {0: None, 1: None, 2: 2, 3: 2, 4: 5, 5: 5}


def test_a_hot_key_is_spread_over_all_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(3)).alias("k"), "id")
    sizes = [r["count"] for r in ordered.dealt(df, ["k"], ["id"], 16).filter("k = 3").groupBy(ordered.CELL).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 20_000 / 16 * 1.5
    wrong = ordered.with_running_sum(df, ["k"], ["id"], F.lit(1), "n", 16).filter("k = 3").agg(F.max("n"), F.count_distinct("n"), F.count("*")).first()
    assert wrong[0] == wrong[1] == wrong[2]


@pytest.mark.parametrize("seconds", [0, 30, 1000])
def test_count_in_last(spark, seconds):
    rows = log(150, 9)
    got = {r["i"]: r["n"] for r in ordered.count_in_last(frame(spark, rows), "k", "ts", seconds, "n", 9).collect()}
    for k, s, i, _ in rows:
        assert got[i] == sum(1 for k2, s2, _, _ in rows if k2 == k and s - seconds <= s2 <= s)


@pytest.mark.parametrize("seed", range(4))
def test_values_at_ranks(spark, seed):
    rng = random.Random(seed)
    draw = [lambda: rng.lognormvariate(0, 3), lambda: float(rng.randint(0, 5)), lambda: 7.5, lambda: rng.uniform(-1e9, 1e9)][seed]
    values = [draw() for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    ranks = [0, 1, 350, 664, 665, 699]
    assert ordered.values_at_ranks(df, "x", ranks, 5) == [sorted(values)[r] for r in ranks]


def test_values_at_ranks_with_odd_numbers(spark):
    inf, nan = float("inf"), float("nan")
    values = [inf, -inf, 3.0, nan, 1e308, -1e308, 5e-324, 0.0, inf, 2.0]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    got = ordered.values_at_ranks(df, "x", list(range(10)), 4)
    assert got[:9] == [-inf, -1e308, 0.0, 5e-324, 2.0, 3.0, 1e308, inf, inf] and got[9] != got[9]
    only = spark.createDataFrame([(nan,), (inf,)], "x double")
    assert ordered.values_at_ranks(only, "x", [0])[0] == inf


def test_histogram_quantile_rules(spark):
    bounds = (0.1, 0.5, 1.0)
    one = spark.createDataFrame([([2, 6, 10, 10],), ([0, 0, 0, 4],), ([0, 0, 0, 0],), ([4, 4, 4, 4],)], "c array<long>")
    got = [r[0] for r in one.select(latency.histogram_quantile(F.col("c"), bounds, 0.5)).collect()]
    # Inside the second bucket; beyond the last bound; nothing observed; inside the first bucket from zero.
    assert got[0] == pytest.approx(0.1 + 0.4 * (5 - 2) / 4) and got[1] == 1.0 and got[2] is None and got[3] == pytest.approx(0.05)


def test_alert_needs_an_unbroken_hold(spark):
    minutes = [(0, True), (1, True), (2, True), (3, False), (4, True), (5, True), (7, True), (8, True), (9, True)]
    rows = spark.createDataFrame([(60 * m, on) for m, on in minutes], "s long, on boolean").withColumn("window_start", F.timestamp_seconds("s"))
    out = latency.sustained_alert(rows.withColumn("k", F.lit(1)), ["k"], "on", 60, 120)
    assert [r["s"] // 60 for r in out.filter("firing").orderBy("s").collect()] == [2, 9]


def test_approximate_profile_is_within_its_error(spark):
    df = spark.range(0, 200_000, 1, 16).select(F.pow(F.rand(3), 4).alias("x"))
    r = latency.latency_profile_approx(df, "x").first()
    checks = latency.rank_checks(df, "x", dict(zip((0.5, 0.95, 0.99), r))).collect()
    assert [c["within"] for c in checks] == [True] * 3 and checks[0]["n"] == 200_000
    assert not latency.rank_checks(df, "x", {0.5: r[1]}).first()["within"]
    few = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "x double")
    assert tuple(latency.latency_profile_approx(few, "x").first()) == (50.0, 95.0, 99.0)
    assert tuple(latency.latency_profile_approx(few.limit(0), "x").first()) == (None, None, None)


def test_windows_are_made_of_panes(spark):
    """Events are not expanded into their windows, and an odd slide is refused."""
    e = spark.createDataFrame([(60 * i + 7, "a") for i in range(12)], "s long, t string").withColumn("ts", F.timestamp_seconds("s"))
    out = latency.request_rate(e, "t")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.index("Expand") < plan.rindex("Aggregate")
    assert out.count() == 16 and out.agg(F.max("requests"), F.sum("requests")).first()[:] == (5, 60)
    with pytest.raises(ValueError):
        latency.request_rate(e, "t", slide="2 minutes")


def test_empty_profile(spark):
    df = spark.createDataFrame([], "x double, ok boolean, ts timestamp")
    r = latency.latency_profile(df, "x", F.col("ok"), "ts").first()
    assert r["total_requests"] == 0 and r["latency_p95"] == 0.0


def test_window_quantiles_are_exact_beyond_the_entries_of_a_sketch(spark):
    rng = random.Random(5)
    rows = [(i % 540, None if i % 11 == 0 else float(rng.randint(0, 5000))) for i in range(9000)] + [(7200, None)]
    df = spark.createDataFrame(rows, "s long, v double").withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    got = {r["w"]: (r["measured"], r["p50"], r["p95"], r["p99"]) for r in latency.sketched_quantiles(df, "v").withColumn("w", F.unix_timestamp("window_start")).collect()}
    for start in range(-240, 541, 60):
        held = sorted(v for s, v in rows if start <= s < start + 300 and v is not None)
        at = [held[-(-len(held) * q // 100) - 1] for q in (50, 95, 99)] if held else [None] * 3
        if any(start <= s < start + 300 for s, _ in rows):
            assert got[start] == (len(held), *at)
    assert got[7200] == (0, None, None, None) and max(g[0] for g in got.values()) > 4000
    plain = latency.sketched_quantiles(df, "v", slide=None).collect()
    assert any(r["measured"] > 4000 for r in plain) and all((r["p50"] is None) == (r["measured"] == 0) for r in plain)
    rough = latency.sketched_quantiles(df, "v", k=latency.SKETCH_K).filter("measured > 4000").collect()
    assert rough and all(2300 < r["p50"] < 2700 for r in rough)
