"""Source versions, fingerprints, invalidation and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_hash
from .ordered import with_changes


def source_versions(snapshots: DataFrame, source: str = "source_id", order: list[str] | None = None,
                    text_hash: str = "source_hash") -> DataFrame:
    """Version number, previous hash and changed flag; a snapshot is compared with the latest one before it."""
    order = order or ["ts"]
    out = with_changes(
        snapshots, [source], order, text_hash, lambda prev, cur: prev != cur, "previous_hash", "_n"
    )
    return (
        out.withColumn("changed", F.coalesce(F.col("previous_hash") != F.col(text_hash), F.lit(False)))
        .withColumn("version", F.col("_n") + 1)
        .drop("_n")
    )


def affected_verifications(versions: DataFrame, links: DataFrame) -> DataFrame:
    """Verifications that used the hash a change replaced. ``links``: verification_id, source_hash."""
    counts = links.groupBy("source_hash").agg(F.count_distinct("verification_id").alias("affected_verifications"))
    j = versions.join(counts.withColumnRenamed("source_hash", "previous_hash"), "previous_hash", "left")
    return j.withColumn(
        "affected_verifications", F.when(F.col("changed"), F.coalesce("affected_verifications", F.lit(0))).otherwise(0)
    )


def latest_fingerprint(fingerprints: DataFrame, source: str = "source_id", order: list[str] | None = None) -> DataFrame:
    """Newest row per source by one partial aggregation; no per-source sort."""
    order = order or ["ts"]
    rest = [c for c in fingerprints.columns if c != source]
    return fingerprints.groupBy(source).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")
    ).select(source, "_l.*")


def fingerprint_by_hash(fingerprints: DataFrame, hash_value: str) -> DataFrame:
    return fingerprints.filter(F.col("source_hash") == hash_value)


def explode_fingerprints(log: DataFrame) -> DataFrame:
    """Link rows from the array form of the log."""
    return log.select("verification_id", F.explode("source_fingerprints").alias("source_hash"))


def invalidate_by_source(log: DataFrame, links: DataFrame, changed: DataFrame, at: Column) -> DataFrame:
    """Verifications citing a changed hash become invalid; an earlier invalidation keeps its time."""
    hit = (
        links.join(changed.select("source_hash"), "source_hash", "left_semi")
        .select("verification_id").distinct().withColumn("_hit", F.lit(True))
    )
    j = log.join(hit, "verification_id", "left")
    fresh = F.coalesce("_hit", F.lit(False)) & F.col("is_valid")
    return j.withColumn("invalidated_at", F.when(fresh, at).otherwise(F.col("invalidated_at"))).withColumn(
        "is_valid", F.col("is_valid") & F.col("_hit").isNull()
    ).drop("_hit")


def audit_trail(fingerprints: DataFrame, links: DataFrame, log: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """All verifications that used any version of the sources (all of them when none are named)."""
    fp = fingerprints.select("source_id", "source_hash").distinct()
    if sources is not None:
        fp = fp.join(sources.select("source_id"), "source_id", "left_semi")
    used = fp.join(links, "source_hash").select("source_id", "verification_id").distinct()
    return used.join(log, "verification_id")


def verification_status(log: DataFrame, links: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = ids.select("verification_id").distinct()
    n = links.join(wanted, "verification_id", "left_semi").groupBy("verification_id").agg(
        F.count(F.lit(1)).alias("source_count")
    )
    return (
        log.join(wanted, "verification_id", "left_semi")
        .join(n, "verification_id", "left")
        .withColumn("source_count", F.coalesce("source_count", F.lit(0)))
    )


def filter_verifications(log: DataFrame, min_confidence: float | None = None, trust_label: str | None = None,
                         valid_only: bool = False) -> DataFrame:
    out = log
    if min_confidence is not None:
        out = out.filter(F.col("confidence_score") >= min_confidence)
    if trust_label:
        out = out.filter(F.col("trust_label") == trust_label)
    if valid_only:
        out = out.filter(F.col("is_valid"))
    return out


def newest_page(df: DataFrame, ts: str, row_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, paged; planned as a top-n, not a full sort."""
    return df.orderBy(F.desc(ts), F.asc(row_id)).offset(offset).limit(limit)


def page_after(df: DataFrame, ts: str, row_id: str, last: tuple | None, limit: int = 100) -> DataFrame:
    """The rows that follow ``last`` (its time and id) in the order of ``newest_page``; the first page without it. A
    deep page costs as much as the first."""
    if last is not None:
        at, id = F.lit(last[0]), F.lit(last[1])
        df = df.filter((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(row_id) > id)))
    return df.orderBy(F.desc(ts), F.asc(row_id)).limit(limit)


def log_statistics(log: DataFrame, verified: str, review: str, rejected: str) -> DataFrame:
    """Totals over all rows; the mean confidence over valid rows only."""
    label = F.col("trust_label")
    return log.agg(
        F.count(F.lit(1)).alias("total_verifications"),
        F.count_if("is_valid").alias("valid_verifications"),
        F.count_if(~F.col("is_valid")).alias("invalid_verifications"),
        F.count_if(label == verified).alias("verified"),
        F.count_if(label == review).alias("review"),
        F.count_if(label == rejected).alias("rejected"),
        F.coalesce(F.avg(F.when(F.col("is_valid"), F.col("confidence_score"))), F.lit(0.0)).alias("average_confidence"),
    )


def fingerprint_statistics(fingerprints: DataFrame, log: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    a = fingerprints.agg(
        distinct("source_hash").alias("total_fingerprints"), distinct("source_id").alias("unique_sources")
    )
    b = log.agg(
        F.count(F.lit(1)).alias("total_verifications"),
        F.count_if("is_valid").alias("valid_verifications"),
        F.count_if(~F.col("is_valid")).alias("invalid_verifications"),
    )
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(b.select("*", one), "_one").drop("_one")


def drop_known_documents(new: DataFrame, known: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Documents whose content is not indexed yet; of equal new ones the lowest id stays."""
    hashed = new.withColumn("_h", content_hash(F.col(text)))
    first = hashed.groupBy("_h").agg(F.min(row_id).alias(row_id))
    keep = first.join(known.select(content_hash(F.col(text)).alias("_h")).distinct(), "_h", "left_anti")
    # The winners are unique ids, so this join cannot meet a hot key.
    return new.join(keep.select(row_id), row_id, "left_semi")
