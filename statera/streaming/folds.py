"""Sequential per-key logic: admission under a rate limit, cache hits with a time to live.

A refused request does not count, so no window frame can express these. One fold serves the batch and
the streaming form. In batch, a key is first cut wherever it was silent long enough for its state to
be empty; the parts are spread over tasks and streamed through in order, so a task holds the state
of one part (bounded by the limit), never the rows of a key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import with_changes
from ..session import STATE_STORE

# Requests per minute by endpoint.
ENDPOINT_LIMITS = {"index": 10, "analyze": 60, "default": 100}
WINDOW_US = 60_000_000
ADMIT_FIELDS = [
    T.StructField("allowed", T.BooleanType()),
    T.StructField("remaining", T.IntegerType()),
    T.StructField("retry_after", T.IntegerType()),
]
HIT_FIELDS = [T.StructField("hit", T.BooleanType())]


class Admission:
    """Sliding minute with a burst check over the last second; only admitted requests count."""

    def __init__(self, limit: int = 60, burst: int | None = 10, admitted: list[int] | None = None):
        self.limit, self.burst = limit, burst
        self.admitted: deque[int] = deque(admitted or [])

    def step(self, now: int, limit: int | None = None) -> tuple[bool, int, int | None]:
        limit = limit or self.limit
        while self.admitted and self.admitted[0] < now - WINDOW_US:
            self.admitted.popleft()
        used = len(self.admitted)
        if self.burst is not None:
            recent = 0
            for t in reversed(self.admitted):
                if t <= now - 1_000_000:
                    break
                recent += 1
            if recent >= self.burst:
                return False, max(0, limit - used), 1
        if used >= limit:
            wait = self.admitted[0] + WINDOW_US - now
            return False, 0, int(wait / 1_000_000) + 1
        self.admitted.append(now)
        return True, limit - used - 1, None


class CachedHits:
    """A repeat within the time to live of the last stored miss is a hit; empty results are not stored."""

    def __init__(self, ttl_seconds: int = 3600, stored: int | None = None):
        self.ttl, self.stored = ttl_seconds * 1_000_000, stored

    def step(self, now: int, has_results: bool = True) -> tuple[bool]:
        if self.stored is not None and now < self.stored + self.ttl:
            return (True,)
        if has_results:
            self.stored = now
        return (False,)


class Hold:
    """A condition that has held without a break for the given time; a missing step breaks it."""

    def __init__(self, step_seconds: int, hold_seconds: int, since: int | None = None, last: int | None = None):
        self.gap, self.hold = step_seconds * 1_000_000, hold_seconds * 1_000_000
        self.since, self.last = since, last

    def step(self, now: int, on: bool) -> bool:
        if not on:
            self.since = None
        elif self.since is None or self.last is None or now - self.last > self.gap:
            self.since = now
        self.last = now
        return self.since is not None and now - self.since >= self.hold


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def silent_parts(df: DataFrame, keys: list[str], row_id: str, gap_us: int) -> DataFrame:
    """Adds ``_part``: a new part starts after a silence longer than the gap. Needs ``_us``."""
    begins = lambda prev, cur: prev.isNull() | (cur - prev > gap_us)
    return with_changes(df, keys, ["_us", row_id], "_us", begins, "_prev", "_part").drop("_prev")


def _fold_batch(df: DataFrame, keys: list[str], ts: str, row_id: str, gap_us: int, make, arg: str | None,
                fields: list[T.StructField]) -> DataFrame:
    out_schema = T.StructType(df.schema.fields + fields)
    names = df.columns
    parts = silent_parts(df.withColumn("_us", micros(ts)), keys, row_id, gap_us)
    group = [*keys, "_part"]
    ordered = parts.repartition(*group).sortWithinPartitions(*group, "_us", row_id)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            results = []
            ids = list(zip(*[pdf[g] for g in group]))
            args = pdf[arg] if arg else [None] * len(pdf)
            for key, now, a in zip(ids, pdf["_us"], args):
                if key != current:
                    current, state = key, make()
                results.append(state.step(int(now), a) if arg else state.step(int(now)))
            out = pdf[names].copy()
            for i, f in enumerate(fields):
                values = [r[i] for r in results]
                out[f.name] = pd.Series(values, index=out.index, dtype="Int32" if isinstance(f.dataType, T.IntegerType) else None)
            yield out

    return ordered.mapInPandas(work, out_schema)


def admit(requests: DataFrame, client: str = "user_id", ts: str = "ts", row_id: str = "event_id", limit: int = 60,
          burst: int | None = 10, limit_column: str | None = None) -> DataFrame:
    """Replay of the rate limiter over a request log: allowed, remaining, retry_after (seconds).

    ``limit_column`` gives a limit per request (for instance by endpoint); the counter stays shared.
    """
    return _fold_batch(
        requests, [client], ts, row_id, WINDOW_US, lambda: Admission(limit, burst), limit_column, ADMIT_FIELDS
    )


def cached_query_hits(queries: DataFrame, keys: list[str], ts: str = "ts", row_id: str = "event_id", ttl: int = 3600,
                      has_results: str | None = None) -> DataFrame:
    return _fold_batch(
        queries, keys, ts, row_id, ttl * 1_000_000, lambda: CachedHits(ttl), has_results, HIT_FIELDS
    )


def _state_store(df: DataFrame) -> None:
    """Arbitrary state needs the RocksDB store; a session that names another one is switched."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def admit_stream(requests: DataFrame, client: str = "user_id", ts: str = "ts", row_id: str = "event_id",
                 limit: int = 60, burst: int | None = 10) -> DataFrame:
    """The same fold over a stream (column names must not start with an underscore there); the state per client is the list of admitted instants of a minute."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    _state_store(requests)
    fields = [requests.schema[client], requests.schema[row_id], T.StructField("us", T.LongType())]
    out_schema = T.StructType([requests.schema[client], requests.schema[row_id]] + ADMIT_FIELDS)
    client_, row_ = client, row_id

    class Limiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("admitted", T.StructType([T.StructField("us", T.ArrayType(T.LongType()))]))

        def handleInputRows(self, key, rows, timerValues):
            before = list(self.state.get()[0]) if self.state.exists() else []
            fold = Admission(limit, burst, before)
            # One micro-batch of one client, put into event order (size it by maxFilesPerTrigger).
            pdf = pd.concat(rows).sort_values(["us", row_])
            results = [fold.step(int(u)) for u in pdf["us"]]
            self.state.update((list(fold.admitted),))
            out = pdf[[client_, row_]].copy()
            out["allowed"] = [r[0] for r in results]
            out["remaining"] = [r[1] for r in results]
            out["retry_after"] = pd.Series([r[2] for r in results], index=out.index, dtype="Int32")
            yield out

        def close(self) -> None:
            pass

    slim = requests.withColumn("us", micros(ts)).select(*[f.name for f in fields])
    return slim.groupBy(client).transformWithStateInPandas(
        statefulProcessor=Limiter(), outputStructType=out_schema, outputMode="Append", timeMode="None"
    )


def cached_query_hits_stream(queries: DataFrame, keys: list[str], ts: str = "ts", row_id: str = "event_id",
                             ttl: int = 3600) -> DataFrame:
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    _state_store(queries)
    out_schema = T.StructType([queries.schema[row_id]] + HIT_FIELDS)
    row_ = row_id

    class Cache(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("stored", T.StructType([T.StructField("us", T.LongType())]))

        def handleInputRows(self, key, rows, timerValues):
            fold = CachedHits(ttl, self.state.get()[0] if self.state.exists() else None)
            pdf = pd.concat(rows).sort_values(["us", row_])
            hits = [fold.step(int(u))[0] for u in pdf["us"]]
            if fold.stored is not None:
                self.state.update((fold.stored,))
            yield pd.DataFrame({row_: pdf[row_].to_numpy(), "hit": hits})

        def close(self) -> None:
            pass

    slim = queries.withColumn("us", micros(ts)).select(*keys, row_id, "us")
    return slim.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Cache(), outputStructType=out_schema, outputMode="Append", timeMode="None"
    )


def sustained_alert_stream(rows: DataFrame, keys: list[str], condition: str, step_seconds: int, hold_seconds: int,
                           ts: str = "window_start") -> DataFrame:
    """Alert state over a stream of window rows; per key only the start of the hold and the last step are kept."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    _state_store(rows)
    out_schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("us", T.LongType()), T.StructField("firing", T.BooleanType())])
    names = out_schema.names

    class Alert(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState(
                "hold", T.StructType([T.StructField("since", T.LongType()), T.StructField("last", T.LongType())])
            )

        def handleInputRows(self, key, batches, timerValues):
            since, last = self.state.get() if self.state.exists() else (None, None)
            fold = Hold(step_seconds, hold_seconds, since, last)
            pdf = pd.concat(batches).sort_values("us")
            pdf["firing"] = [fold.step(int(u), bool(on)) for u, on in zip(pdf["us"], pdf["on"])]
            self.state.update((fold.since, fold.last))
            yield pdf[names]

        def close(self) -> None:
            pass

    slim = rows.select(*keys, micros(ts).alias("us"), F.col(condition).alias("on"))
    out = slim.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Alert(), outputStructType=out_schema, outputMode="Append", timeMode="None"
    )
    return out.select(*keys, F.timestamp_micros("us").alias(ts), "firing")
