"""Point store and append-only logs as partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_hash, point_id
from ..functions.rows import union_rows
from ..functions.text import strip


def with_point_id(chunks: DataFrame, chunk_id: str = "chunk_id", given: str | None = None) -> DataFrame:
    made = point_id(F.col(chunk_id))
    return chunks.withColumn("point_id", F.coalesce(F.col(given).cast("decimal(20,0)"), made) if given else made)


def latest_per_id(new: DataFrame, row_id: str, order: list[str]) -> DataFrame:
    """Last writer per id within a batch, by one partial aggregation."""
    rest = [c for c in new.columns if c != row_id]
    return new.groupBy(row_id).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(row_id, "_r.*").select(*new.columns)


def upsert_points(new: DataFrame, store: DataFrame, row_id: str = "point_id", order: list[str] | None = None,
                  removed: Column | None = None) -> DataFrame:
    """Store after replacing by id. Idempotent: the same batch twice gives the same store.

    Of equal ids the last in ``order`` wins; without an order, or where it ties, the row with the greatest values, column by
    column (maps cannot be compared and do not count). An id whose winning row ``removed`` marks leaves the store.
    """
    rest = [f.name for f in new.schema.fields if f.name != row_id and "map<" not in f.dataType.simpleString()]
    fresh = latest_per_id(new, row_id, [*(order or []), *rest]) if rest else new.dropDuplicates([row_id])
    kept = store.join(fresh.select(row_id), row_id, "left_anti")
    if removed is not None:
        fresh = fresh.filter(~F.coalesce(removed, F.lit(False)))
    return union_rows(kept, fresh, fill=True)


def upsert_counts(new: DataFrame, before: DataFrame, after: DataFrame, row_id: str) -> DataFrame:
    """The store must grow by exactly the new ids it did not have."""
    ids = new.select(row_id).distinct()
    added = ids.join(before.select(row_id), row_id, "left_anti").agg(F.count(F.lit(1)).alias("added"))
    one = F.lit(1).alias("_one")
    a = before.agg(F.count(F.lit(1)).alias("before")).select("*", one)
    b = after.agg(F.count(F.lit(1)).alias("after")).select("*", one)
    return (
        a.join(b, "_one").join(added.select("*", one), "_one").drop("_one")
        .withColumn("matches", F.col("before") + F.col("added") == F.col("after"))
    )


def incremental_scan(src: DataFrame, ts: str, last_update: Column | None, force_full: bool = False) -> DataFrame:
    """Rows since the day of the last update, that day included (upserts make re-reads safe)."""
    if force_full or last_update is None:
        return src
    return src.filter(F.col(ts) >= F.to_date(last_update))


def dry_run(src: DataFrame) -> DataFrame:
    return src.agg(F.count(F.lit(1)).alias("would_process"))


def update_state(runs: DataFrame, ts: str = "finished_at", docs: str = "docs_count", ok: Column | None = None) -> DataFrame:
    """Last update, its document count, and the number of successful runs, from the run log."""
    done = runs.filter(ok) if ok is not None else runs
    return done.agg(
        F.max(ts).alias("last_update"),
        F.coalesce(F.max_by(docs, F.struct(ts, docs)), F.lit(0)).alias("last_update_docs_count"),
        F.count(F.lit(1)).alias("total_runs"),
    )


def scan_payload(store: DataFrame, vector: str = "vec") -> DataFrame:
    """Payload without vectors: the scan does not read the vector column."""
    return store.drop(vector)


def result_projection(hits: DataFrame, metadata: list[str]) -> DataFrame:
    """``source`` is the law, else the court; the rest of the payload is nested."""
    source = F.coalesce(F.when(F.col("law") != "", F.col("law")), F.col("court"))
    return hits.select(
        "query_id", "rank", "text", source.alias("source"), "score",
        F.struct(*metadata).alias("metadata"),
    )


def verification_rows(audits: DataFrame, ids: list[str], created_at: Column, text: str = "text", metadata: Column | None = None,
                      duration_ms: Column | None = None) -> DataFrame:
    """Whole log rows of audits: the answer's text and hash, its scores, what was said about the run, valid, not retried
    unless the audit says so. The sources an audit used are link rows, see ``verification_links``."""
    out = audits.select(
        F.concat_ws("-", *ids).alias("verification_id"),
        created_at.alias("created_at"),
        F.col(text).alias("answer_text"),
        "answer_hash",
        F.col("total_sentences").cast("long").alias("answer_sentences"),
        "has_citations", "citations",
        F.col("source_count").cast("long").alias("source_count"),
        F.col("verified_sentences").cast("long").alias("verified_sentences"),
        "verification_rate", "confidence_score", "trust_label",
        "semantic_similarity", "retrieval_quality", "citation_presence", "coverage",
        (F.col("retry_attempts") if "retry_attempts" in audits.columns else F.lit(0)).alias("retry_attempts"),
        F.lit(True).alias("is_valid"),
        F.lit(None).cast("timestamp").alias("invalidated_at"),
        "error",
        (F.lit(None) if metadata is None else metadata).cast("map<string,string>").alias("metadata"),
        (F.lit(None) if duration_ms is None else duration_ms).cast("long").alias("duration_ms"),
    )
    return out


def verification_links(audits: DataFrame, ids: list[str], fingerprints: DataFrame, key: str) -> DataFrame:
    """One row for every audit and source text it was judged by: verification_id, source_hash. ``fingerprints`` has the key
    that audits share with their sources; sources with equal texts are one link."""
    used = fingerprints.select(key, "source_hash").distinct()
    return audits.select(key, F.concat_ws("-", *ids).alias("verification_id")).join(used, key).select("verification_id", "source_hash")


def append_verifications(rows: DataFrame, path: str, links: DataFrame | None = None) -> None:
    """Append log rows, by the day they were made, and their links beside them, by the hash's first two digits: a change of
    a source reads one partition of the links."""
    base = path.rstrip("/")
    rows.withColumn("log_date", F.to_date("created_at")).write.mode("append").partitionBy("log_date").parquet(f"{base}/log")
    if links is not None:
        links.withColumn("part", F.substring("source_hash", 1, 2)).write.mode("append").partitionBy("part").parquet(f"{base}/links")


def read_verifications(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Log rows and link rows as appended."""
    base = path.rstrip("/")
    log = spark.read.parquet(f"{base}/log").drop("log_date")
    return log, spark.read.parquet(f"{base}/links").drop("part")


def query_log_rows(queries: DataFrame, ts: str, query: str, response: str, passthrough: list[str]) -> DataFrame:
    """Hashes instead of text; ``log_date`` is the partition."""
    return queries.select(
        *passthrough,
        F.col(ts).alias("created_at"),
        content_hash(strip(F.col(query))).alias("query_hash"),
        content_hash(F.col(response)).alias("response_hash"),
        F.to_date(ts).alias("log_date"),
    )


def append_query_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("log_date").parquet(path)


def export_fingerprints(fingerprints: DataFrame, path: str) -> None:
    fingerprints.write.mode("overwrite").json(path)


def export_verifications(log: DataFrame, path: str, include_invalid: bool = False) -> None:
    (log if include_invalid else log.filter("is_valid")).write.mode("overwrite").json(path)


