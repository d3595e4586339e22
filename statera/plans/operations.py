"""Usage, quotas, retention, latency, alerts; batch forms of the windowed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latency, ordered, tenancy, usage
from ..streaming import folds
from ..streaming.runs import latest_run, resumable_runs
from .catalog import query, table
from .segments import long

BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


def events(spark, sf):
    return table(spark, sf, "events")


def utc_events(spark, sf):
    """Instants instead of naive timestamps, as the streaming forms need them."""
    return events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "e22_latency_profile",
    """
    with s as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events)
    select (select count(*) from events) as total_requests, (select count(*) from events where event_type <> 'error') as successful_requests,
           (select count(*) from events where event_type = 'error') as failed_requests, min(value) as latency_min, max(value) as latency_max, round(avg(value), 6) as latency_avg,
           (select round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 6) from events) as requests_per_second,
           median(value) as latency_p50, max(value) filter (i = floor(n * 0.95)) as latency_p95, max(value) filter (i = floor(n * 0.99)) as latency_p99 from s
    """,
)
def latency_profile(spark, sf):
    out = latency.latency_profile(events(spark, sf), "value", F.col("event_type") != "error", "ts")
    return out.withColumns({"latency_avg": F.round("latency_avg", 6), "requests_per_second": F.round("requests_per_second", 6)})


@query(
    "e22_latency_profile_approx",
    "select quantile, n, true as within from (select count(value) as n from events), (values (0.5::double), (0.95::double), (0.99::double)) q(quantile)",
)
def latency_profile_approx(spark, sf):
    """Whether the sketch's quantiles have ranks within its stated error among all values."""
    e = events(spark, sf)
    p50, p95, p99 = latency.latency_profile_approx(e, "value").first()
    return latency.rank_checks(e, "value", {0.5: p50, 0.95: p95, 0.99: p99})


LE = ", ".join(f"({b}::double)" for b in BOUNDS)


@query(
    "e23_histogram",
    f"""select event_type, le, count(*) filter (value <= le) as cumulative, round(sum(value), 4) as sum, count(value) as count
        from events, (values {LE}, ('infinity'::double)) b(le) group by all""",
)
def histogram(spark, sf):
    return latency.histogram(events(spark, sf), "value", BOUNDS, ["event_type"]).withColumn("sum", F.round("sum", 4))


def sql_quantile(q: float, n: str = "n") -> str:
    """Interpolation over the array ``c`` of cumulative counts with total ``n``."""
    out = f"case when {n} = 0 then null"
    for i, hi in enumerate(BOUNDS):
        lo, before = (0.0, "0") if i == 0 else (BOUNDS[i - 1], f"c[{i}]")
        out += f" when c[{i + 1}] >= {q} * {n} then {lo} + ({hi} - {lo}) * ({q} * {n} - {before}) / (c[{i + 1}] - {before})"
    return out + f" else {BOUNDS[-1]} end"


COUNTS = "[" + ", ".join(f"count(*) filter (value <= {b})" for b in BOUNDS) + "]"


@query(
    "e24_histogram_quantile",
    f"""select event_type, user_id, round({sql_quantile(0.5)}, 6) as p50, round({sql_quantile(0.95)}, 6) as p95, round({sql_quantile(0.99)}, 6) as p99
        from (select event_type, user_id, {COUNTS} as c, count(value) as n from events group by all)""",
)
def histogram_quantile(spark, sf):
    g = events(spark, sf).groupBy("event_type", "user_id").agg(latency.bucket_counts("value", BOUNDS).alias("c"))
    q = lambda x: F.round(latency.histogram_quantile(F.col("c"), BOUNDS, x), 6)
    return g.select("event_type", "user_id", q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


# --- sliding windows ------------------------------------------------------------------------


def sql_windows(size: int, slide: int, columns: str) -> str:
    """Rows with every sliding window (minutes) that holds them."""
    n = size // slide
    return f"""(select {columns}, s as window_start, s + interval {size} minute as window_end from (
        select *, unnest(list_transform(range({n}), lambda k: time_bucket(interval {slide} minute, ts, timestamp '2024-01-01') - to_minutes(cast(k * {slide} as integer)))) as s from events)
        where ts < s + interval {size} minute)"""


W5 = sql_windows(5, 1, "event_id, ts, event_type, user_id, value")
W15 = sql_windows(15, 1, "event_id, ts, event_type, user_id, value")
RATE_SQL = f"select window_start, window_end, event_type, count(*) as requests, round(count(*) / 300.0, 6) as per_second from {W5} group by all"
ERROR_SQL = f"""select *, errors / requests > 0.05 as high, errors / requests > 0.25 as critical, round(errors / requests, 6) as error_rate from (
    select window_start, window_end, count(*) as requests, count(*) filter (event_type = 'error') as errors from {W5} group by all)"""
QUANTILE_SQL = f"""select window_start, window_end, round({sql_quantile(0.5)}, 6) as p50, round({sql_quantile(0.95)}, 6) as p95, round({sql_quantile(0.99)}, 6) as p99,
    {sql_quantile(0.95)} > 80.0 as p95_high, {sql_quantile(0.99)} > 200.0 as p99_high
    from (select window_start, window_end, {COUNTS} as c, count(value) as n from {W5} group by all)"""
LOW_SQL = f"""select window_start, window_end, scored, low, round(low / scored, 6) as low_share, low / scored > 0.30 as firing from (
    select window_start, window_end, count(value) as scored, count(*) filter (value <= 20) as low from {W15} group by all)"""
VERY_LOW_SQL = f"""select window_start, window_end, scored, low, round(low / scored, 6) as low_share, low / scored > 0.15 as firing from (
    select window_start, window_end, count(value) as scored, count(*) filter (value <= 5) as low from {W5} group by all)"""
# Exact order statistics, however many values a window holds.
SKETCH_SQL = f"""select window_start, window_end, count(value) as measured, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99
    from {W5} group by all"""
LABEL_SQL = "select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end, event_type, count(*) as n from events group by all"
SLA_SQL = f"""select window_start, window_end, round(e, 6) as error_rate, round({sql_quantile(0.95)}, 6) as p95, coalesce({sql_quantile(0.95)}, 0) > 80.0 or e > 0.05 as violated
    from (select window_start, window_end, {COUNTS} as c, count(value) as n, count(*) filter (event_type = 'error') / count(*) as e from {W5} group by all)"""


def failed():
    return F.col("event_type") == "error"


def naive(df):
    """Window bounds as naive timestamps, the type of the table."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end") if c in df.columns})


def rate(e):
    return naive(latency.request_rate(e, "event_type")).withColumn("per_second", F.round("per_second", 6))


def errors(e):
    return naive(latency.error_rate(e, failed())).withColumn("error_rate", F.round("error_rate", 6))


def quantiles(e):
    out = naive(latency.latency_quantiles(e, "value", BOUNDS, p95_limit=80.0, p99_limit=200.0))
    return out.withColumns({p: F.round(p, 6) for p in ("p50", "p95", "p99")})


def low(e):
    return naive(latency.low_confidence_rate(e, "value", at_most=20)).withColumn("low_share", F.round("low_share", 6))


def very_low(e):
    """The second rule: a smaller share of worse scores, over a shorter time."""
    return naive(latency.low_confidence_rate(e, "value", size="5 minutes", at_most=5, limit=0.15)).withColumn("low_share", F.round("low_share", 6))


def sketches(e):
    return naive(latency.sketched_quantiles(e, "value"))


def labels(e):
    return naive(latency.label_counts(e, "event_type"))


def sla(e):
    out = naive(latency.sla_violation(e, "value", BOUNDS, failed(), p95_limit=80.0))
    return out.withColumns({"p95": F.round("p95", 6), "error_rate": F.round("error_rate", 6)})


@query("j1_request_rate", RATE_SQL)
def request_rate(spark, sf):
    return rate(utc_events(spark, sf))


@query(
    "j1_rate_alerts",
    """
    with c as (select epoch_us(ts) // 300000000 * 300 as start, count(*) as requests from events where ts is not null group by 1),
    clock as (select unnest(range((select min(start) from c), (select max(start) + 1 from c), 300)) as start)
    select clock.start, coalesce(requests, 0)::bigint as requests, coalesce(requests, 0) / 300 as per_second,
           coalesce(requests, 0) / 300 > 0.01 as too_high, coalesce(requests, 0) / 300 < 0.001 as too_low
    from clock left join c on c.start = clock.start
    """,
)
def rate_alerts(spark, sf):
    return latency.rate_alerts(events(spark, sf), "ts", 300, high=0.01, low=0.001)


@query("j2_error_rate", ERROR_SQL)
def error_rate(spark, sf):
    return errors(utc_events(spark, sf))


@query("j3_latency_quantiles", QUANTILE_SQL)
def latency_quantiles(spark, sf):
    return quantiles(utc_events(spark, sf))


@query("j4_low_confidence_rate", LOW_SQL)
def low_confidence_rate(spark, sf):
    return low(utc_events(spark, sf))


@query("j4_very_low_confidence_rate", VERY_LOW_SQL)
def very_low_confidence_rate(spark, sf):
    return very_low(utc_events(spark, sf))


@query("j3_sketched_quantiles", SKETCH_SQL)
def sketched_quantiles(spark, sf):
    return sketches(utc_events(spark, sf))


@query("j7_label_counts", LABEL_SQL)
def label_counts(spark, sf):
    return labels(utc_events(spark, sf))


@query("j8_sla_violation", SLA_SQL)
def sla_violation(spark, sf):
    return sla(utc_events(spark, sf))


@query(
    "j6_sustained_alert",
    f"""
    with r as (select window_start, event_type, requests >= 1 as on_ from ({RATE_SQL}) ),
    p as (select *, on_ and (lag(window_start) over w is null or not lag(on_) over w or window_start - lag(window_start) over w > interval 1 minute) as begins
          from r window w as (partition by event_type order by window_start)),
    i as (select *, sum(begins::int) over (partition by event_type order by window_start) as island from p)
    select window_start, event_type, on_ and window_start - min(window_start) over (partition by event_type, island) >= interval 10 minute as firing from i
    """,
)
def sustained_alert(spark, sf):
    r = latency.request_rate(utc_events(spark, sf), "event_type").withColumn("busy", F.col("requests") >= 1)
    out = latency.sustained_alert(r, ["event_type"], "busy", 60, 600)
    return naive(out.select("window_start", "event_type", "firing"))


@query(
    "e28_cache_ratio",
    """select *, hits / (hits + misses) < 0.70 as low, round(hits / (hits + misses), 6) as hit_ratio from (
         select time_bucket(interval 1 day, ts, timestamp '2024-01-01') as window_start, time_bucket(interval 1 day, ts, timestamp '2024-01-01') + interval 1 day as window_end,
                count(*) filter (value < 50) as hits, count(*) filter (value >= 50) as misses from events group by all)""",
)
def cache_ratio(spark, sf):
    out = latency.cache_ratio(utc_events(spark, sf), F.col("value") < 50, size="1 day")
    return naive(out).withColumn("hit_ratio", F.round("hit_ratio", 6))


# --- usage ----------------------------------------------------------------------------------

USAGE_SQL = """
    (select u.user_id, m.month, coalesce(tokens_used, 0)::bigint as tokens_used, coalesce(queries_count, 0)::bigint as queries_count,
            coalesce(documents_indexed, 0)::bigint as documents_indexed, 100000::bigint as token_quota, 1000::bigint as query_quota, 100::bigint as document_quota
     from (select c_custkey as user_id from customer) u, (values ('2024-01'), ('2024-02')) m(month)
     left join (select user_id, strftime(ts, '%Y-%m') as month, sum(cast(props ->> '$.k' as bigint)) as tokens_used, count(*) filter (event_type = 'view') as queries_count,
                       count(*) filter (event_type = 'signup') as documents_indexed from events group by all) x on x.user_id = u.user_id and x.month = m.month)
"""


def usage_table(spark, sf):
    e = events(spark, sf).select(
        "user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        (F.col("event_type") == "view").cast("long").alias("queries"), (F.col("event_type") == "signup").cast("long").alias("documents"),
    )
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return usage.monthly_usage(e, users, ["2024-01", "2024-02"])


@query("e29_monthly_usage", f"select * from {USAGE_SQL}")
def monthly_usage(spark, sf):
    return usage_table(spark, sf)


@query(
    "e30_quota_check",
    f"""
    select e.event_id, coalesce(case q when 'tokens' then tokens_used + amount <= 100000 when 'queries' then queries_count + amount <= 1000 when 'documents' then documents_indexed + amount <= 100 else false end, false) as allowed
    from (select event_id, user_id, strftime(ts, '%Y-%m') as month, case event_type when 'view' then 'queries' when 'signup' then 'documents' when 'click' then 'tokens' else event_type end as q,
                 (value * 2)::bigint as amount from (select * replace (floor(value) as value) from events)) e
    left join {USAGE_SQL} u on u.user_id = e.user_id and u.month = e.month
    """,
)
def quota_check(spark, sf):
    kind = (
        F.when(F.col("event_type") == "view", "queries").when(F.col("event_type") == "signup", "documents")
        .when(F.col("event_type") == "click", "tokens").otherwise(F.col("event_type"))
    )
    requests = events(spark, sf).select(
        "event_id", "user_id", F.date_format("ts", "yyyy-MM").alias("month"), kind.alias("quota_type"),
        (F.floor("value") * 2).cast("long").alias("amount"),
    )
    known = usage_table(spark, sf)
    # A user without any row is refused nothing: defaults apply, the twin only knows listed users.
    return usage.quota_check(requests, known).select("event_id", "allowed")


@query("e31_storage_stats", "select user_id, count(*) as file_count, sum(value::bigint * 1000)::bigint as total_size_bytes, round(sum(value::bigint * 1000) / 1048576, 2) as total_size_mb from (select user_id, floor(value) as value from events) group by 1")
def storage_stats(spark, sf):
    files = events(spark, sf).select("user_id", (F.floor("value").cast("long") * 1000).alias("size"))
    return usage.storage_stats(files)


@query(
    "f6_running_quota",
    """select event_id, sum(cast(props ->> '$.k' as bigint)) over (partition by user_id, strftime(ts, '%Y-%m') order by ts, event_id rows unbounded preceding)::bigint as used,
              sum(cast(props ->> '$.k' as bigint)) over (partition by user_id, strftime(ts, '%Y-%m') order by ts, event_id rows unbounded preceding) <= 2000 as within_quota from events""",
)
def running_quota(spark, sf):
    tokens = F.get_json_object("props", "$.k").cast("long")
    return usage.running_quota(events(spark, sf), tokens, 2000).select("event_id", "used", "within_quota")


@query(
    "f7_requests_in_window",
    "select event_id, count(*) over (partition by user_id order by ts range between interval 6 hour preceding and current row) as requests from events",
)
def requests_in_window(spark, sf):
    return ordered.count_in_last(events(spark, sf).select("event_id", "user_id", "ts"), "user_id", "ts", 21600, "requests").select("event_id", "requests")


RUNS = """(select user_id as run_id, event_id, case event_type when 'error' then 'failed' when 'view' then 'running' else 'completed' end as status, ts as last_updated from events)"""


def runs(spark, sf):
    t = F.col("event_type")
    return events(spark, sf).select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("stage"),
        F.when(t == "error", "failed").when(t == "view", "running").otherwise("completed").alias("status"), F.col("ts").alias("last_updated"),
    )


LATEST = f"select run_id, event_id as stage, status, last_updated from {RUNS} qualify row_number() over (partition by run_id order by last_updated desc, event_id desc) = 1"


@query("f8_list_runs", LATEST)
def list_runs(spark, sf):
    return latest_run(runs(spark, sf))


@query("f8_latest_run", f"select run_id, stage, status from ({LATEST}) order by last_updated desc limit 1")
def newest_run(spark, sf):
    return latest_run(runs(spark, sf), []).select("run_id", "stage", "status")


@query("f8_resumable_runs", f"select run_id, stage, status from ({LATEST}) where status in ('running', 'failed')")
def resumable(spark, sf):
    return resumable_runs(runs(spark, sf)).select("run_id", "stage", "status")


def documents_of_orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("user_id"), F.lit("ready").alias("status")
    )


@query("f9_document_list", "select o_orderkey as document_id from orders where o_custkey = 77")
def document_list(spark, sf):
    return tenancy.document_list(documents_of_orders(spark, sf), 77).select("document_id")


@query("f9_document_by_id", "select o_orderkey as document_id, o_custkey as user_id from orders where o_orderkey = 42")
def document_by_id(spark, sf):
    return tenancy.document_by_id(documents_of_orders(spark, sf), 42).select("document_id", "user_id")


@query(
    "d11_tenant_scope",
    """select l_orderkey as document_id, l_linenumber::bigint as line, l_partkey as part from lineitem
       where l_orderkey in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING'))""",
)
def tenant_scope(spark, sf):
    users = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part")
    )
    return tenancy.tenant_scope(rows, documents_of_orders(spark, sf), users)


@query(
    "d11_log_scope",
    """select event_id, document_id from (select event_id, case when event_type <> 'view' then user_id end as document_id from events)
       where document_id is null or document_id in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING'))""",
)
def log_scope(spark, sf):
    users = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    log = events(spark, sf).select("event_id", F.when(F.col("event_type") != "view", F.col("user_id")).alias("document_id"))
    return tenancy.tenant_scope(log, documents_of_orders(spark, sf), users, null_passes=True)


@query("d17_cascade_delete", "select l_orderkey as document_id, l_linenumber::bigint as line, l_partkey as part from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("document_id"))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part")
    )
    return tenancy.cascade_delete(rows, gone)


@query("d17_soft_delete", "select o_orderkey as document_id, case when o_orderstatus = 'P' then 'deleted' else 'ready' end as status from orders")
def soft_delete(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("document_id"))
    return tenancy.soft_delete(documents_of_orders(spark, sf), gone).select("document_id", "status")


@query(
    "d17_clear_lost_parents",
    """with c as (select vec_id as chunk_id, vec_id - vec_id % 8 as parent_id from embeddings where label <> 3)
       select chunk_id, case when parent_id in (select chunk_id from c) then parent_id end as parent_id from c""",
)
def clear_lost_parents(spark, sf):
    c = table(spark, sf, "embeddings").filter("label <> 3").select(
        F.col("vec_id").alias("chunk_id"), (F.col("vec_id") - F.col("vec_id") % 8).alias("parent_id")
    )
    return tenancy.clear_lost_parents(c)


# --- retention ------------------------------------------------------------------------------

NOW = "timestamp '2001-06-01'"


def _now():
    return F.to_timestamp_ntz(F.lit("2001-06-01 00:00:00"))


@query(
    "j12_expire_by_ttl",
    f"""select 'chunks' as table_name, count(*) filter (l_shipdate + interval 730 day < {NOW}) as purged, count(*) filter (l_shipdate + interval 730 day >= {NOW}) as kept from lineitem
        union all select 'query_logs', count(*) filter (o_orderdate + interval 90 day < {NOW}), count(*) filter (o_orderdate + interval 90 day >= {NOW}) from orders
        union all select 'user_usage', count(*) filter (month < '2000-05'), count(*) filter (month >= '2000-05') from (select distinct o_custkey, strftime(o_orderdate, '%Y-%m') as month from orders)""",
)
def expire_by_ttl(spark, sf):
    orders = table(spark, sf, "orders")
    months = orders.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    return usage.purge_counts(
        {
            "chunks": usage.expire_by_ttl(table(spark, sf, "lineitem"), "l_shipdate", _now(), usage.CHUNK_DAYS),
            "query_logs": usage.expire_by_ttl(orders, "o_orderdate", _now(), usage.LOG_DAYS),
            "user_usage": usage.expire_usage(months, _now()),
        }
    )


@query("j12_kept_rows", f"select o_orderkey, o_orderdate + interval 90 day as expires_at from orders where o_orderdate + interval 90 day >= {NOW}")
def kept_rows(spark, sf):
    out = usage.expire_by_ttl(table(spark, sf, "orders"), "o_orderdate", _now(), usage.LOG_DAYS)
    return out.filter(~F.col("expired")).select("o_orderkey", "expires_at")


@query(
    "j14_mapping_ttl",
    """select event_id as request_id from events where ts + interval 300 second > (select max(ts) - interval 2 day from events)
         and event_id not in (select event_id from events where event_type = 'click')""",
)
def mapping_ttl(spark, sf):
    e = events(spark, sf)
    now = e.agg((F.max("ts") - F.expr("interval 2 days")).alias("n")).first()["n"]
    mappings = e.select(F.col("event_id").alias("request_id"), F.col("ts").alias("created_at"))
    used = e.filter("event_type = 'click'").select(F.col("event_id").alias("request_id"))
    return usage.live_mappings(mappings, used, F.lit(now).cast("timestamp_ntz")).select("request_id")


# --- sequential folds -----------------------------------------------------------------------
# A thousandfold clock makes the sparse test events busy enough to be refused.

FAST = "(select event_id, event_type, user_id, make_timestamp(epoch_us(ts) // 1000) as ts, epoch_us(ts) // 1000 as us from events)"


def fast_events(e):
    us = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return e.withColumn("ts", F.timestamp_micros(us.cast("long")))


@query(
    "j5_admit",
    f"""
    with recursive o as (select *, row_number() over (partition by event_type order by us, event_id) as i from {FAST}),
    f as (
      select event_type, event_id, i, us, [us] as adm, true as allowed, 29::bigint as remaining, null::bigint as retry_after from o where i = 1
      union all
      select event_type, event_id, i, us, case when b < 2 and u < 30 then list_append(adm, us) else adm end, b < 2 and u < 30,
             (case when b < 2 and u < 30 then 30 - u - 1 else greatest(0, 30 - u) end)::bigint,
             case when b >= 2 then 1 when u >= 30 then (adm[1] + 60000000 - us) // 1000000 + 1 end::bigint
      from (select o.event_type, o.event_id, o.i, o.us, list_filter(f.adm, lambda x: x >= o.us - 60000000) as adm, len(list_filter(f.adm, lambda x: x >= o.us - 60000000)) as u,
                   len(list_filter(f.adm, lambda x: x > o.us - 1000000)) as b from f join o on o.event_type = f.event_type and o.i = f.i + 1))
    select event_id, allowed, remaining, retry_after from f
    """,
)
def admit(spark, sf):
    e = fast_events(events(spark, sf)).select("event_id", "event_type", "ts")
    out = folds.admit(e, client="event_type", limit=30, burst=2)
    return long(out.select("event_id", "allowed", "remaining", "retry_after"), "remaining", "retry_after")


@query(
    "j13_cached_query_hits",
    f"""
    with recursive o as (select *, row_number() over (partition by user_id, event_type order by us, event_id) as i from {FAST}),
    f as (
      select user_id, event_type, event_id, i, us as stored, false as hit from o where i = 1
      union all
      select o.user_id, o.event_type, o.event_id, o.i, case when o.us < f.stored + 300000000 then f.stored else o.us end, o.us < f.stored + 300000000
      from f join o on o.user_id = f.user_id and o.event_type = f.event_type and o.i = f.i + 1)
    select event_id, hit from f
    """,
)
def cached_query_hits(spark, sf):
    e = fast_events(events(spark, sf)).select("event_id", "event_type", "user_id", "ts")
    return folds.cached_query_hits(e, ["user_id", "event_type"], ttl=300).select("event_id", "hit")
