"""Usage, quotas, retention and storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import union_rows
from .ordered import with_running_sum

# Default monthly quotas and retention.
QUOTAS = {"tokens": 100_000, "queries": 1_000, "documents": 100}
USED = {"tokens": "tokens_used", "queries": "queries_count", "documents": "documents_indexed"}
CHUNK_DAYS, LOG_DAYS, USAGE_MONTHS = 730, 90, 13


def month_key(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def monthly_usage(events: DataFrame, users: DataFrame, months: list[str] | None = None) -> DataFrame:
    """Counters per user and month; users without a row in the asked months get zeros and default quotas.

    ``events``: user_id, ts, tokens, queries, documents.
    """
    used = events.groupBy("user_id", month_key("ts").alias("month")).agg(
        F.sum("tokens").alias("tokens_used"),
        F.sum("queries").alias("queries_count"),
        F.sum("documents").alias("documents_indexed"),
    )
    if months is None:
        joined = users.select("user_id").distinct().join(used, "user_id", "left")
    else:
        # A handful of calendar months per user, not a product of two tables: the months are an array.
        wanted = F.array(*[F.lit(m) for m in months])
        joined = users.select("user_id").distinct().withColumn("month", F.explode(wanted)).join(
            used, ["user_id", "month"], "left"
        )
    for c in USED.values():
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    return joined.withColumns(
        {
            "token_quota": F.lit(QUOTAS["tokens"]).cast("long"),
            "query_quota": F.lit(QUOTAS["queries"]).cast("long"),
            "document_quota": F.lit(QUOTAS["documents"]).cast("long"),
        }
    )


def quota_check(requests: DataFrame, usage: DataFrame) -> DataFrame:
    """Is ``used + amount`` within the limit of the request's type and month? Unknown types are refused."""
    j = requests.join(usage, ["user_id", "month"], "left")
    kind = F.col("quota_type")
    used = (
        F.when(kind == "tokens", F.coalesce("tokens_used", F.lit(0)))
        .when(kind == "queries", F.coalesce("queries_count", F.lit(0)))
        .when(kind == "documents", F.coalesce("documents_indexed", F.lit(0)))
    )
    limit = (
        F.when(kind == "tokens", F.coalesce("token_quota", F.lit(QUOTAS["tokens"])))
        .when(kind == "queries", F.coalesce("query_quota", F.lit(QUOTAS["queries"])))
        .when(kind == "documents", F.coalesce("document_quota", F.lit(QUOTAS["documents"])))
    )
    return j.select(*requests.columns, F.coalesce(used + F.col("amount") <= limit, F.lit(False)).alias("allowed"))


def running_quota(events: DataFrame, amount: Column, limit: int, row_id: str = "event_id", ts: str = "ts") -> DataFrame:
    """Usage so far in the month at every event, and whether it is still within the quota.

    A hot user's month is spread over many tasks, whatever its times are.
    """
    keyed = events.withColumn("month", month_key(ts))
    out = with_running_sum(keyed, ["user_id", "month"], [ts, row_id], amount, "used")
    return out.withColumn("within_quota", F.col("used") <= limit)


def storage_stats(files: DataFrame, user: str = "user_id", size: str = "size") -> DataFrame:
    total = F.coalesce(F.sum(size), F.lit(0))
    return files.groupBy(user).agg(
        F.count(F.lit(1)).alias("file_count"),
        total.alias("total_size_bytes"),
        F.round(total / (1024 * 1024), 2).alias("total_size_mb"),
    )


def expire_by_ttl(df: DataFrame, ts: str, now: Column, days: int | Column) -> DataFrame:
    """Adds ``expires_at`` and ``expired``; rows without a retention never expire."""
    days = F.lit(days) if isinstance(days, int) else days
    expires = F.col(ts) + F.make_dt_interval(days=days)
    return df.withColumn("expires_at", expires).withColumn(
        "expired", F.coalesce(F.col("expires_at") < now, F.lit(False))
    )


def expire_usage(usage: DataFrame, now: Column, months: int = USAGE_MONTHS) -> DataFrame:
    cutoff = F.date_format(F.add_months(F.to_date(now), -months), "yyyy-MM")
    return usage.withColumn("expired", F.col("month") < cutoff)


def purge_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows kept and purged per table."""
    out = None
    for name, df in parts.items():
        row = df.agg(
            F.count_if("expired").alias("purged"), F.count_if(~F.col("expired")).alias("kept")
        ).withColumn("table_name", F.lit(name))
        out = row if out is None else union_rows(out, row)
    return out


def live_mappings(mappings: DataFrame, used: DataFrame, now: Column, ttl_seconds: int = 300) -> DataFrame:
    """PII mappings that are neither older than their time to live nor used already."""
    fresh = mappings.filter(F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now)
    return fresh.join(used.select("request_id").distinct(), "request_id", "left_anti")
