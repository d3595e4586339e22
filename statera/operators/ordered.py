"""Order-dependent values (previous row, running sum, rank, islands) that survive hot keys.

A plain window puts a whole key into one task. Here rows are dealt to ranges of (key, order) of about equal counts, as
a global sort would, and the ranges are written down once. The scan then has two passes: every range is worked on
by itself, and what a key carries over the end of a range is added back to the range behind. Only the first key of
a range can have begun before it, so all carries together are fewer rows than there are ranges: they are broadcast.
How a key is spread follows from the data; nobody chooses a bucket. Keys are compared as structs, so null keys match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

CELL = "_cell"
KEY = "_key"


def time_bucket(ts: str | Column, seconds: int) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def dealt(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Rows with the number of their range in ``_cell`` and their key in ``_key``, written once: the bounds come from a
    sample, so a second evaluation might deal differently. Equal (key, order) share a range."""
    spark = df.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    return stored(df.withColumn(KEY, key).repartitionByRange(n, KEY, *order).withColumn(CELL, F.spark_partition_id()))


def _local(order: list[str]) -> "Window":
    return Window.partitionBy(CELL, KEY).orderBy(*order)


def _carried(rows: DataFrame, ends: list[Column], carry: Callable[["Window"], dict[str, Column]], heads: DataFrame,
             scanned: Callable[[DataFrame], DataFrame] = lambda some: some) -> DataFrame:
    """Per range the carry of its first key, from what ``ends`` says of that key in the ranges before it. ``carry``
    builds columns over the window of a key's ranges in order."""
    spanning = heads.select(KEY).distinct()
    totals = scanned(rows.join(F.broadcast(spanning), KEY, "left_semi")).groupBy(CELL, KEY).agg(*ends)
    across = Window.partitionBy(KEY).orderBy(CELL)
    return totals.withColumns(carry(across)).withColumn("_place", F.struct(CELL, KEY))


def _heads(rows: DataFrame) -> DataFrame:
    return rows.groupBy(CELL).agg(F.min(KEY).alias(KEY))


def _with_carry(rows: DataFrame, carries: DataFrame, *columns: str) -> DataFrame:
    here = rows.withColumn("_place", F.struct(CELL, KEY))
    return here.join(F.broadcast(carries.select("_place", *columns)), "_place", "left").drop("_place")


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including this row; null until a value is not null.

    ``order`` should be unique within a key, else ties are ranked in any order within their range.
    """
    rows = dealt(df.withColumn("_v", value), keys, order, parts)
    before = lambda w: {"_carry": F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1))}
    carries = _carried(rows, [F.sum("_v").alias("_t")], before, _heads(rows))
    inside = F.sum("_v").over(_local(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = _with_carry(rows.withColumn("_in", inside), carries, "_carry")
    total = F.when(F.col("_in").isNull(), F.col("_carry")).otherwise(F.col("_in") + F.coalesce("_carry", F.lit(0)))
    return joined.withColumn(out, total).drop("_carry", "_in", "_v", CELL, KEY)


def with_changes(df: DataFrame, keys: list[str], order: list[str], value: str,
                 begins: Callable[[Column, Column], Column], previous: str, number: str, parts: int | None = None) -> DataFrame:
    """Adds the value of the preceding row and the running number of ``begins(previous, current)``.

    ``begins`` decides from two values alone whether the current row starts something new; the
    previous value is null at the first row of a key.
    """

    def flag(prev: Column, cur: Column) -> Column:
        return F.coalesce(begins(prev, cur), F.lit(False)).cast("long")

    rows = dealt(df.withColumn("_v", F.struct(F.col(value).alias("v"))), keys, order, parts)
    inside = _local(order)

    def scanned(some: DataFrame) -> DataFrame:
        return (
            some.withColumn("_p", F.lag("_v").over(inside))
            .withColumn("_first", F.row_number().over(inside) == 1)
            .withColumn("_f", F.when(F.col("_first"), F.lit(0)).otherwise(flag(F.col("_p.v"), F.col("_v.v"))))
        )

    local = (
        scanned(rows)
        .withColumn("_run", F.sum("_f").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_fv", F.first("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    at = F.struct(*order)
    ends = [F.min_by("_v", at).alias("_head"), F.max_by("_v", at).alias("_tail"), F.sum("_f").alias("_t")]

    def carry(w: "Window") -> dict[str, Column]:
        last = F.lag("_tail").over(w)
        edge = flag(last["v"], F.col("_head.v"))
        before = F.coalesce(F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return {"_cp": last, "_edge": edge, "_before": before}

    # Only keys that run over the end of a range are scanned for their carries.
    slim = [c for c in rows.columns if c in {CELL, KEY, "_v", *order}]
    carries = _carried(rows.select(*slim), ends, carry, _heads(rows), scanned)
    edges = F.sum("_edge").over(Window.partitionBy(KEY).orderBy(CELL).rowsBetween(Window.unboundedPreceding, 0))
    carries = carries.withColumn("_base", F.col("_before") + edges)
    nothing = F.lit(None).cast(df.schema[value].dataType)
    return (
        _with_carry(local, carries, "_cp", "_base")
        .withColumn(previous, F.when(F.col("_first"), F.col("_cp.v")).otherwise(F.col("_p.v")))
        .withColumn(number, F.coalesce("_base", flag(nothing, F.col("_fv.v"))) + F.col("_run"))
        .drop("_p", "_first", "_f", "_v", "_fv", "_run", "_cp", "_base", CELL, KEY)
    )


def count_in_last(df: DataFrame, key: str, ts: str, seconds: int, out: str, parts: int | None = None) -> DataFrame:
    """Rows of the key in the closed interval ``[ts - seconds, ts]``.

    The count up to an instant less the count before the interval: both are places in one running sum, in which
    every instant stands twice, once with its rows and once, moved back by ``seconds``, to be looked up. Rows of one
    instant are added up first. Neither the interval nor a hot key bounds the work of a task. A row without a time
    counts the rows without a time.
    """
    span = seconds * 1_000_000
    instant = F.struct(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    rows = df.withColumn("_at", instant)
    per_instant = rows.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    # A lookup stands before the rows of its own instant: those belong to the interval.
    places = F.array(
        F.struct(F.col("_at.us").alias("us"), F.lit(1).alias("kind"), F.col("_n").alias("n")),
        F.struct((F.col("_at.us") - span).alias("us"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")),
    )
    marks = per_instant.select("_at", F.col("_at.key").alias("k"), F.explode(places).alias("m")).select("_at", "k", "m.*")
    run = with_running_sum(marks, ["k"], ["us", "kind"], F.col("n"), "_run", parts)
    kinds = [F.max(F.when(F.col("kind") == i, F.col("_run"))) for i in (0, 1)]
    counted = run.groupBy("_at").agg((kinds[1] - F.when(F.col("_at.us").isNull(), F.lit(0)).otherwise(kinds[0])).alias(out))
    return rows.join(counted, "_at").drop("_at")


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark prunes to ``k`` per key and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def values_at_ranks(df: DataFrame, column: str, ranks: list[int], parts: int | None = None) -> list[float]:
    """Exact order statistics (0-based ranks) from one range-partitioned sort.

    Equal values are counted first, so a value that holds a third of all rows is one row of the sort. The ranges'
    counts give their offsets, and only the ranges that hold a wanted rank are looked into. One scan of the data.
    Nulls do not count; infinities are the ends of the order, and NaN comes after all, as in Spark's own order.
    """
    counts = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    rows = dealt(counts, [], ["v"], parts)
    offset, below = {}, 0
    for r in rows.groupBy(CELL).agg(F.sum("n").alias("n")).orderBy(CELL).collect():  # a row per range
        offset[r[CELL]] = (below, below + r["n"])
        below += r["n"]
    wanted = {c: [r for r in set(ranks) if lo <= r < hi] for c, (lo, hi) in offset.items()}
    wanted = {c: rs for c, rs in wanted.items() if rs}
    found: dict[int, float] = {}
    if wanted:
        upto = F.sum("n").over(Window.partitionBy(CELL).orderBy("v"))
        base = F.create_map(*[F.lit(x) for c in wanted for x in (c, offset[c][0])])
        seen = rows.filter(F.col(CELL).isin(list(wanted))).withColumn("hi", upto + base[F.col(CELL)]).withColumn("lo", F.col("hi") - F.col("n"))
        hit = F.exists(F.array(*[F.lit(r).cast("long") for rs in wanted.values() for r in rs]), lambda r: (r >= F.col("lo")) & (r < F.col("hi")))
        for row in seen.filter(hit).select("v", "lo", "hi").collect():
            found.update({r: row["v"] for r in set(ranks) if row["lo"] <= r < row["hi"]})
    return [found[r] for r in ranks]
