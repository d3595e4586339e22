"""Structured Streaming runs over the events and documents, each against the twin of its batch form.

Append mode gives a window once the watermark has passed it, so the twins keep closed windows only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ids import point_id
from ..functions.rows import computed, spread
from ..functions.text import normalize_text
from ..operators import chunking, latency
from ..session import shared_dir
from ..streaming import folds, runs
from . import operations as ops
from .catalog import CATALOG, query, sql_normalize, sql_strip, table
from .segments import long

DELAY = "10 minutes"
CLOSED = "window_end <= (select max(ts) - interval 10 minute from events)"


def _files(sf: str, name: str) -> str:
    """A table as the source of a stream, one file or a folder of them: a path with a wildcard may be either."""
    return f"{sf}/[{name[0]}]{name[1:]}.parquet"


def _stream(spark, sf, name: str = "events"):
    return runs.event_stream(spark, _files(sf, name), table(spark, sf, name).schema, delay=DELAY, pattern="*")


def _documents(spark, sf):
    return spark.readStream.schema(table(spark, sf, "documents").schema).parquet(_files(sf, "documents"))


def _land(spark, df):
    """Run to the end of the input and read back what was written."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    runs.run_available(df, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def _register(name: str, sql: str, shape) -> None:
    @query(f"{name}_stream", f"select * from ({sql}) where {CLOSED}")
    def run(spark, sf):
        return _land(spark, shape(_stream(spark, sf)))


for _name, _sql, _shape in (
    ("j1_request_rate", ops.RATE_SQL, ops.rate),
    ("j2_error_rate", ops.ERROR_SQL, ops.errors),
    ("j3_latency_quantiles", ops.QUANTILE_SQL, ops.quantiles),
    ("j3_sketched_quantiles", ops.SKETCH_SQL, ops.sketches),
    ("j4_low_confidence_rate", ops.LOW_SQL, ops.low),
    ("j4_very_low_confidence_rate", ops.VERY_LOW_SQL, ops.very_low),
    ("j7_label_counts", ops.LABEL_SQL, ops.labels),
    ("j8_sla_violation", ops.SLA_SQL, ops.sla),
):
    _register(_name, _sql, _shape)


@query("j5_admit_stream", CATALOG["j5_admit"].sql)
def admit_stream(spark, sf):
    e = ops.fast_events(_stream(spark, sf)).select("event_id", "event_type", "ts")
    out = _land(spark, folds.admit_stream(e, client="event_type", limit=30, burst=2))
    return long(out.select("event_id", "allowed", "remaining", "retry_after"), "remaining", "retry_after")


@query("j13_cached_query_hits_stream", CATALOG["j13_cached_query_hits"].sql)
def cached_query_hits_stream(spark, sf):
    e = ops.fast_events(_stream(spark, sf)).select("event_id", "event_type", "user_id", "ts")
    return _land(spark, folds.cached_query_hits_stream(e, ["user_id", "event_type"], ttl=300)).select("event_id", "hit")


@query("j6_sustained_alert_stream", f"select * from ({CATALOG['j6_sustained_alert'].sql}) where window_start + interval 5 minute <= (select max(ts) - interval 10 minute from events)")
def sustained_alert_stream(spark, sf):
    # The closed windows of the rate stream are landed; the alert reads them as a stream of its own.
    rates = latency.request_rate(_stream(spark, sf), "event_type").withColumn("busy", F.col("requests") >= 1)
    base = f"{shared_dir(spark)}/alert-{uuid.uuid4().hex}"
    runs.run_available(rates, f"{base}/rates", f"{base}/rates-checkpoint")
    rows = spark.readStream.schema(rates.schema).parquet(f"{base}/rates")
    return ops.naive(_land(spark, folds.sustained_alert_stream(rows, ["event_type"], "busy", 60, 600)))


@query("j15_dedupe_stream", "select user_id, event_type, count(*) as n from (select distinct user_id, event_type, props from events) group by all")
def dedupe_stream(spark, sf):
    # One batch holds the whole test table, so no key comes back after its state is gone.
    s = _stream(spark, sf).withColumn("doc_hash", F.sha2(F.concat_ws("|", "user_id", "event_type", "props"), 256))
    kept = _land(spark, runs.dedupe_stream(s, ["doc_hash"]).select("user_id", "event_type"))
    return kept.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def prepare(batch):
    """Normalise, chunk and key a batch of documents."""
    clean = computed(spread(batch, "doc_id"), "text", normalize_text(F.col("text")), lambda t: F.length(t) >= 20)
    chunks = chunking.chunk_corpus(clean.select("doc_id", "text"), chunking.chunk_windows(F.col("text"), 800, 100, boundary=False))
    return chunks.withColumn("point_id", point_id(F.col("chunk_id")))


@query(
    "j9_incremental_update",
    f"""
    select doc_id, count(*) as chunks, sum(length(piece))::bigint as chars from (
      select doc_id, {sql_strip("substring(text, s + 1, 800)")} as piece from (
        select doc_id, text, unnest(range(0, length(text), 700)) as s from (select doc_id, {sql_normalize('text')} as text from documents) where length(text) >= 20))
    where piece <> '' group by 1
    """,
)
def incremental_update(spark, sf):
    base = f"{shared_dir(spark)}/update-{uuid.uuid4().hex}"
    docs = _documents(spark, sf)
    runs.incremental_update(docs, prepare, f"{base}/store", f"{base}/checkpoint")
    points = runs.current_points(spark, f"{base}/store", document="doc_id")
    return points.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query(
    "j9_two_sources",
    f"""
    select doc_id, count(*) as chunks, sum(length(piece))::bigint as chars from (
      select doc_id, {sql_strip("substring(text, s + 1, 800)")} as piece from (
        select doc_id, text, unnest(range(0, length(text), 700)) as s from (
          select doc_id, {sql_normalize("case when lang = 'de' then left(text, 900) else text end")} as text from documents) where length(text) >= 20))
    where piece <> '' group by 1
    """,
)
def two_sources(spark, sf):
    """All documents by one stream, then the German ones again, cut short, by a second one with its own checkpoint."""
    base = f"{shared_dir(spark)}/update-{uuid.uuid4().hex}"
    docs = _documents(spark, sf)
    runs.incremental_update(docs, prepare, f"{base}/store", f"{base}/first")
    short = docs.filter("lang = 'de'").withColumn("text", F.substring("text", 1, 900))
    runs.incremental_update(short, prepare, f"{base}/store", f"{base}/second")
    points = runs.current_points(spark, f"{base}/store", document="doc_id")
    return points.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query(
    "j9_removed_documents",
    f"""
    select doc_id, count(*) as chunks, sum(length(piece))::bigint as chars from (
      select doc_id, {sql_strip("substring(text, s + 1, 800)")} as piece from (
        select doc_id, text, unnest(range(0, length(text), 700)) as s from (
          select doc_id, {sql_normalize('text')} as text from documents where coalesce(lang, '') not in ('de', 'fr') and coalesce(source, '') <> 'src3')
        where length(text) >= 20))
    where piece <> '' group by 1
    """,
)
def removed_documents(spark, sf):
    """All documents, then the German ones again with a text too short for a chunk and the French ones as removed, then
    those of one source taken out by their ids: what is left is the rest."""
    base = f"{shared_dir(spark)}/update-{uuid.uuid4().hex}"
    docs = _documents(spark, sf)
    gone = F.lit(False)
    runs.incremental_update(docs.withColumn("gone", gone), prepare, f"{base}/store", f"{base}/first", document="doc_id")
    again = docs.filter("lang in ('de', 'fr')").withColumn("text", F.when(F.col("lang") == "de", "short").otherwise(F.col("text")))
    again = again.withColumn("gone", F.col("lang") == "fr")
    runs.incremental_update(again, prepare, f"{base}/store", f"{base}/second", document="doc_id", removed=F.col("gone"))
    ids = table(spark, sf, "documents").filter("source = 'src3'").select("doc_id")
    runs.remove_documents(ids, f"{base}/store", "doc_id", "without-src3")
    points = runs.current_points(spark, f"{base}/store", document="doc_id")
    return points.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query("j10_staged_run", f"select lang, count(*) as n from (select lang, {sql_normalize('text')} as text from documents) where length(text) >= 20 group by 1")
def staged_run(spark, sf):
    from ..sources.records import normalize_corpus

    root, run_id = shared_dir(spark), f"run-{uuid.uuid4().hex}"
    return runs.staged_run(
        spark, root, run_id,
        [
            ("fetched", lambda _: table(spark, sf, "documents")),
            ("normalized", lambda d: normalize_corpus(d)),
            ("counted", lambda d: d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))),
        ],
    )
