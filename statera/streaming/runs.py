"""Streaming runs: sources with event time, incremental corpus updates, deduplication, staged runs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import bounded_batches, union_rows
from ..operators.chunking import paragraph_chunks
from ..sources.files import _exists, append_stage, write_stage
from ..sources.store import latest_per_id


def event_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts", delay: str = "10 minutes",
                 files_per_trigger: int | None = None, pattern: str = "*.parquet") -> DataFrame:
    """File stream with a watermark. Naive timestamps become UTC instants: watermarks need them."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop. The checkpoint is the resume point."""
    q = (
        df.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def dedupe_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """First row per key; the state of a key is dropped once the watermark has passed it."""
    return events.dropDuplicatesWithinWatermark(keys)


# A store is a folder of point rows, one sub-folder per run and batch. Beside them, in folders that a plain read of the
# store does not see, lie a row for every document of every batch, and the number of every batch.
VERSION = ["commit", "run", "batch_id"]
VERSIONS, COMMITS = "_versions", "_commits"


def _beside(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/{name}"


def _versions(spark: SparkSession, store: str) -> DataFrame | None:
    path = _beside(store, VERSIONS)
    return spark.read.parquet(path).withColumn("run", F.col("run").cast("string")) if _exists(spark, path) else None


def _points(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).withColumn("run", F.col("run").cast("string"))


def commit_number(spark: SparkSession, store: str, run: str, batch_id: int) -> int:
    """The number of a batch in the order of the store. It is given before the batch is first written and kept when the
    batch is repeated, so a late repeat of an old batch stays old."""
    path = _beside(store, COMMITS)
    last = 0
    if _exists(spark, path):
        given = spark.read.parquet(path)
        mine = (F.col("run").cast("string") == run) & (F.col("batch_id") == batch_id)
        known, last = given.agg(F.max(F.when(mine, F.col("number"))), F.max("number")).first()
        if known is not None:
            return known
    number = spark.range(1).select(F.lit((last or 0) + 1).cast("long").alias("number"))
    append_stage(number, path, batch_id, run=run)
    return (last or 0) + 1


def current_points(spark: SparkSession, store: str, row_id: str = "point_id", document: str | None = None) -> DataFrame:
    """Store as of the last write. With ``document`` the rows of a document's newest batch count and those of its
    earlier ones do not: chunks that a shorter text no longer has are gone, and so are all chunks of a document whose
    newest batch gave none or removed it. Without, the newest row of an id."""
    rows = _points(spark, store)
    if document is not None:
        seen = rows.select(F.col(document).alias("_doc"), *VERSION)
        versions = _versions(spark, store)
        if versions is not None:
            seen = union_rows(seen, versions.select(F.col("document").cast(rows.schema[document].dataType).alias("_doc"), *VERSION))
        newest = seen.groupBy("_doc").agg(F.max(F.struct(*VERSION)).alias("_newest"))
        same = F.col(document).eqNullSafe(F.col("_doc")) & (F.struct(*VERSION) == F.col("_newest"))
        rows = rows.join(newest, same).drop("_doc", "_newest")
    return latest_per_id(rows, row_id, VERSION).drop(*VERSION)


def compact(spark: SparkSession, store: str, out: str, row_id: str = "point_id", document: str | None = None) -> None:
    """Write the current rows as the one batch of a new store, so that reads do not fold all batches for ever. Removed and
    empty documents leave nothing behind; the new store numbers on from the old one."""
    last = spark.read.parquet(_beside(store, COMMITS)).agg(F.max("number")).first()[0]
    rows = current_points(spark, store, row_id, document).withColumn("commit", F.lit(last).cast("long"))
    append_stage(spark.range(1).select(F.lit(last).cast("long").alias("number")), _beside(out, COMMITS), 0, run="compacted")
    append_stage(rows, out, 0, run="compacted")


def _write_versions(documents: DataFrame, store: str, commit: int, batch_id: int, run: str) -> None:
    append_stage(documents.withColumn("commit", F.lit(commit).cast("long")), _beside(store, VERSIONS), batch_id, run=run)


def incremental_update(source: DataFrame, prepare: Callable[[DataFrame], DataFrame], store: str, checkpoint: str,
                       document: str | None = None, removed: Column | None = None) -> None:
    """Stream of documents -> ``prepare`` (normalise, chunk, encode) -> idempotent upsert.

    A batch writes only its own rows, so the cost of an update does not grow with the store. The
    stream's checkpoint advances after the write, so a failed batch is repeated into the same folder. The run is
    the id in the checkpoint: several streams, or one with a new checkpoint, do not meet in a folder.

    ``document`` names the id of a source row: every document of a batch then leaves a version row, also one that gives no
    chunk or that ``removed`` marks; such a tombstone hides what earlier batches wrote of it. A document with both removed
    and other rows in a batch is kept.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        commit = commit_number(spark, store, run, batch_id)
        gone = F.lit(False) if removed is None else F.coalesce(removed, F.lit(False))
        live = batch if removed is None else batch.filter(~gone)
        append_stage(prepare(live).withColumn("commit", F.lit(commit).cast("long")), store, batch_id, run=run)
        if document is not None:
            versions = batch.groupBy(F.col(document).cast("string").alias("document")).agg(F.min(gone).alias("removed"))
            _write_versions(versions, store, commit, batch_id, run)

    q = source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def remove_documents(ids: DataFrame, store: str, document: str, run: str) -> None:
    """Tombstones for the documents of ``ids``. ``run`` names the removal: the same one again is the same batch."""
    commit = commit_number(ids.sparkSession, store, run, 0)
    gone = ids.select(F.col(document).cast("string").alias("document"), F.lit(True).alias("removed")).distinct()
    _write_versions(gone, store, commit, 0, run)


def guarded_chunks(df: DataFrame, text: str = "text", size: int = 800, overlap: int = 100, separator: str = "\n\n") -> DataFrame:
    """Adds ``_chunks`` and ``error``; a document that fails does not stop the others."""

    @F.pandas_udf("struct<chunks:array<string>,error:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        chunks, errors = [], []
        for t in s:
            try:
                made = paragraph_chunks(t, size, overlap, separator)
                chunks.append(made)
                errors.append(None if made else "empty text")
            except Exception as e:  # noqa: BLE001 - the reason is the result
                chunks.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"chunks": chunks, "error": errors})

    out = bounded_batches(df).withColumn("_g", run(F.col(text)))
    return out.withColumn("_chunks", F.col("_g.chunks")).withColumn("error", F.col("_g.error")).drop("_g")


def bad_record_report(df: DataFrame, checks: dict[str, Column], row_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the failures with the first reason."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(list(checks.items())):
        reason = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(reason)
    marked = df.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull()).select(row_id, "reason")


Stage = tuple[str, Callable[[DataFrame | None], DataFrame]]


def staged_run(spark: SparkSession, root: str, run_id: str, stages: list[Stage]) -> DataFrame:
    """Persisted stages: a finished one (``_SUCCESS``) is read back, the rest run; states are appended."""
    data: DataFrame | None = None
    for name, step in stages:
        path = f"{root.rstrip('/')}/{run_id}/{name}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            _log(spark, root, run_id, name, "running", None)
            try:
                write_stage(step(data), path)
            except Exception:
                _log(spark, root, run_id, name, "failed", None)
                raise
            _log(spark, root, run_id, name, "completed", spark.read.parquet(path).count())
        data = spark.read.parquet(path)
    return data


def _log(spark: SparkSession, root: str, run_id: str, stage: str, status: str, rows: int | None) -> None:
    spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), F.lit(status).alias("status"),
        F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("last_updated"),
    ).write.mode("append").parquet(f"{root.rstrip('/')}/_runs")


def latest_run(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Newest state per run (or overall without keys)."""
    keys = ["run_id"] if keys is None else keys
    rest = [c for c in states.columns if c not in keys]
    return states.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("last_updated", "run_id", "stage")).alias("_s")
    ).select(*keys, "_s.*")


def resumable_runs(states: DataFrame) -> DataFrame:
    return latest_run(states).filter(F.col("status").isin("running", "failed"))


__all__ = [
    "bad_record_report", "commit_number", "compact", "current_points", "dedupe_stream", "event_stream", "guarded_chunks",
    "incremental_update", "latest_run", "remove_documents", "resumable_runs", "run_available", "staged_run",
]
