"""Sequential folds and streaming runs."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from statera.sources import files
from statera.sources.store import upsert_points
from statera.streaming import folds, runs
from statera.streaming.folds import Admission, CachedHits

SEC = 1_000_000


def test_limit_refuses_the_sixth():
    a = Admission(5, 10)
    got = [a.step(i * 2 * SEC) for i in range(6)]
    assert [g[0] for g in got] == [True] * 5 + [False]
    assert [g[1] for g in got] == [4, 3, 2, 1, 0, 0]
    assert got[5][2] == 51  # the first request leaves the minute 50 s later, plus one
    assert a.step(61 * SEC)[0]


def test_burst_is_checked_first():
    a = Admission(60, 3)
    got = [a.step(100 * i) for i in range(4)]
    assert [g[0] for g in got] == [True, True, True, False] and got[3][2] == 1 and got[3][1] == 57
    assert a.step(2 * SEC)[0]


def test_refused_requests_do_not_count():
    a = Admission(1, None)
    assert a.step(0)[0]
    assert not any(a.step(i * SEC)[0] for i in range(1, 60))
    # An entry exactly one minute old still counts.
    assert not a.step(60 * SEC)[0] and a.step(60 * SEC + 1)[0]


def test_cache_keeps_the_time_of_the_miss():
    c = CachedHits(10)
    assert [c.step(t * SEC)[0] for t in (0, 9, 10, 19, 20)] == [False, True, False, True, False]
    e = CachedHits(10)
    assert [e.step(0, False)[0], e.step(1, True)[0], e.step(2, True)[0]] == [False, False, True]


def requests(n, seed):
    rng = random.Random(seed)
    t, rows = 0.0, []
    for i in range(n):
        t += rng.choice([0.01, 0.2, 1.5, 90.0]) * rng.random()
        rows.append((i, rng.choice(["hot", "hot", "hot", "b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), rng.choice([2, 4])))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    rows = requests(400, 3)
    return rows, spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp, cap int").repartition(4)


def test_batch_replay_with_hot_and_null_clients(log):
    rows, df = log
    state, want = {}, {}
    for i, k, t, _ in rows:
        us = int((t - dt.datetime(2024, 1, 1)).total_seconds() * SEC + 0.5)
        want[i] = state.setdefault(k, Admission(4, 2)).step(us)
    got = {r["event_id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in folds.admit(df, limit=4, burst=2).collect()}
    assert got == want and not all(w[0] for w in want.values())


def test_limit_per_request(log):
    rows, df = log
    state, want = {}, {}
    for i, k, t, cap in rows:
        us = int((t - dt.datetime(2024, 1, 1)).total_seconds() * SEC + 0.5)
        want[i] = state.setdefault(k, Admission(9, None)).step(us, cap)[0]
    got = {r["event_id"]: r["allowed"] for r in folds.admit(df, burst=None, limit_column="cap").collect()}
    assert got == want


def test_stream_equals_batch_over_several_triggers(spark, log):
    rows, df = log
    base = tempfile.mkdtemp(prefix="spark-")
    # Micro-batches must come in time order.
    for part in range(4):
        df.filter((F.col("event_id") >= part * 100) & (F.col("event_id") < part * 100 + 100) & F.col("user_id").isNotNull()).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    runs.run_available(folds.admit_stream(stream, limit=4, burst=2), f"{base}/out", f"{base}/check")
    got = {(r["event_id"], r["allowed"]) for r in spark.read.parquet(f"{base}/out").collect()}
    batch = folds.admit(df.filter("user_id is not null"), limit=4, burst=2)
    assert got == {(r["event_id"], r["allowed"]) for r in batch.collect()}
    runs.run_available(folds.cached_query_hits_stream(stream, ["user_id"], ttl=5), f"{base}/out2", f"{base}/check2")
    hits = {(r["event_id"], r["hit"]) for r in spark.read.parquet(f"{base}/out2").collect()}
    assert hits == {(r["event_id"], r["hit"]) for r in folds.cached_query_hits(df.filter("user_id is not null"), ["user_id"], ttl=5).collect()}


def test_incremental_update_resumes_and_replaces(spark):
    base = tempfile.mkdtemp(prefix="spark-")

    def land(rows):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def update():
        src = spark.readStream.schema("id long, text string").parquet(f"{base}/in")
        runs.incremental_update(src, lambda d: d.withColumnRenamed("id", "point_id"), f"{base}/store", f"{base}/check")
        return {r["point_id"]: r["text"] for r in runs.current_points(spark, f"{base}/store").collect()}

    land([(1, "a"), (2, "b")])
    assert update() == {1: "a", 2: "b"}
    assert update() == {1: "a", 2: "b"}  # nothing new
    land([(2, "B"), (3, "c")])
    assert update() == {1: "a", 2: "B", 3: "c"}


def test_two_sources_and_shrinking_documents(spark):
    base = tempfile.mkdtemp(prefix="spark-")

    def update(name, rows):
        spark.createDataFrame(rows, "doc long, point_id long, text string").coalesce(1).write.mode("append").parquet(f"{base}/{name}")
        src = spark.readStream.schema("doc long, point_id long, text string").parquet(f"{base}/{name}")
        runs.incremental_update(src, lambda d: d, f"{base}/store", f"{base}/check-{name}")

    def now(store="store"):
        return {r["point_id"]: r["text"] for r in runs.current_points(spark, f"{base}/{store}", document="doc").collect()}

    update("a", [(1, 10, "p"), (1, 11, "q"), (1, 12, "r")])
    update("b", [(2, 20, "s")])
    assert now() == {10: "p", 11: "q", 12: "r", 20: "s"}
    update("b", [(1, 10, "P")])  # the document has one chunk now
    assert now() == {10: "P", 20: "s"}
    runs.compact(spark, f"{base}/store", f"{base}/small", document="doc")
    assert now("small") == now()


def test_emptied_and_removed_documents_lose_their_chunks(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    schema = "doc long, point_id long, text string, gone boolean"

    def update(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
        src = spark.readStream.schema(schema).parquet(f"{base}/{name}")
        keep = lambda d: d.filter("text <> ''").select("doc", "point_id", "text")
        runs.incremental_update(src, keep, f"{base}/store", f"{base}/check-{name}", document="doc", removed=F.col("gone"))

    def now(store="store"):
        return {r["point_id"]: r["text"] for r in runs.current_points(spark, f"{base}/{store}", document="doc").collect()}

    update("a", [(1, 10, "p", None), (1, 11, "q", False), (2, 20, "r", False), (3, 30, "s", False), (4, 40, "t", False), (None, 50, "u", False)])
    assert now() == {10: "p", 11: "q", 20: "r", 30: "s", 40: "t", 50: "u"}
    update("b", [(1, 10, "", False), (2, 20, "r", True), (3, 30, "x", True), (3, 31, "y", False)])
    assert now() == {31: "y", 40: "t", 50: "u"}  # emptied, removed, and one that keeps a row
    ids = spark.createDataFrame([(4,), (4,)], "doc long")
    runs.remove_documents(ids, f"{base}/store", "doc", "manual")
    runs.remove_documents(ids, f"{base}/store", "doc", "manual")
    assert now() == {31: "y", 50: "u"}
    runs.compact(spark, f"{base}/store", f"{base}/small", document="doc")
    assert now("small") == now()
    update("a", [(4, 40, "back", False)])
    assert now() == {31: "y", 40: "back", 50: "u"}


def test_a_repeated_batch_stays_old(spark):
    """Numbers are given once: a batch that is written again after a later one does not become the newest."""
    base = tempfile.mkdtemp(prefix="spark-")
    write = lambda text, run: files.append_stage(
        spark.createDataFrame([(1, text)], "point_id long, text string").withColumn("commit", F.lit(runs.commit_number(spark, base, run, 0)).cast("long")), base, 0, run=run
    )
    write("old", "r1")
    write("new", "r2")
    write("old", "r1")
    assert [r["text"] for r in runs.current_points(spark, base).collect()] == ["new"]


def test_upserts_are_deterministic_and_can_remove(spark):
    store = spark.createDataFrame([(1, "a", False), (2, "b", False)], "point_id long, text string, gone boolean")
    new = spark.createDataFrame([(1, "x", False), (1, "y", False), (2, "z", True), (3, "n", False)], "point_id long, text string, gone boolean")
    got = {r["point_id"]: r["text"] for r in upsert_points(new.repartition(4), store, removed=F.col("gone")).collect()}
    assert got == {1: "y", 3: "n"}


def test_failed_batch_is_repeated_into_the_same_folder(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    spark.range(3).select(F.col("id").alias("point_id")).write.parquet(f"{base}/in")
    fail = {"on": True}

    def prepare(d):
        if fail["on"]:
            raise RuntimeError("lost")
        return d

    src = lambda: spark.readStream.schema("point_id long").parquet(f"{base}/in")
    with pytest.raises(Exception):
        runs.incremental_update(src(), prepare, f"{base}/store", f"{base}/check")
    fail["on"] = False
    runs.incremental_update(src(), prepare, f"{base}/store", f"{base}/check")
    assert runs.current_points(spark, f"{base}/store").count() == 3


def test_staged_run_resumes_at_the_failed_stage(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    ran, broken = [], {"on": True}

    def first(_):
        ran.append("first")
        return spark.range(5)

    def second(d):
        ran.append("second")
        if broken["on"]:
            raise ValueError("boom")
        return d.filter("id > 1")

    stages = [("first", first), ("second", second)]
    with pytest.raises(ValueError):
        runs.staged_run(spark, root, "r1", stages)
    states = spark.read.parquet(f"{root}/_runs")
    assert [r["run_id"] for r in runs.resumable_runs(states).collect()] == ["r1"]
    broken["on"] = False
    assert runs.staged_run(spark, root, "r1", stages).count() == 3
    assert ran == ["first", "second", "second"]
    done = runs.latest_run(spark.read.parquet(f"{root}/_runs")).first()
    assert (done["stage"], done["status"], done["rows"]) == ("second", "completed", 3)
    assert runs.resumable_runs(spark.read.parquet(f"{root}/_runs")).count() == 0


def test_bad_records_are_listed(spark):
    d = spark.createDataFrame([(1, "ok text"), (2, ""), (3, None)], "id int, text string")
    good, bad = runs.bad_record_report(d, {"no text": F.col("text").isNull(), "empty": F.length("text") == 0}, "id")
    assert [r["id"] for r in good.collect()] == [1]
    assert {(r["id"], r["reason"]) for r in bad.collect()} == {(2, "empty"), (3, "no text")}
    g = {r["id"]: r["error"] for r in runs.guarded_chunks(d).collect()}
    assert g[1] is None and g[2] == "empty text" and g[3]


def test_dedupe_within_the_watermark(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    rows = [(dt.datetime(2024, 1, 1, 0, m), h) for m, h in ((0, "x"), (1, "x"), (2, "y"))]
    spark.createDataFrame(rows, "ts timestamp, h string").coalesce(1).write.parquet(f"{base}/in")
    s = runs.event_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
    runs.run_available(runs.dedupe_stream(s, ["h"]), f"{base}/out", f"{base}/check")
    assert sorted(r["h"] for r in spark.read.parquet(f"{base}/out").collect()) == ["x", "y"]


@pytest.mark.parametrize("name", ["j9_incremental_update", "j9_two_sources", "j9_removed_documents", "j1_request_rate_stream"])
def test_streams_read_tables_that_are_folders(spark, sf, name):
    from statera.plans import load

    base = tempfile.mkdtemp(prefix="spark-")
    for t in ("documents", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(3).write.parquet(f"{base}/{t}.parquet")
    run = load()[name].run
    got, want = run(spark, base), run(spark, sf)
    assert want.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
