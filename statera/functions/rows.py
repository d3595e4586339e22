"""Row shaping that keeps costly expressions to one evaluation.

Spark copies a projected expression into the filters it pushes below the projection, also into those
it infers from an inner explode; inside a lambda the copy would run once per element. Nothing is
pushed below an outer explode, so these helpers explode outer and drop the empty rows afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column) -> Column:
    """A value for a projection that no later step copies into itself: an outer explode of one element stands round it."""
    return F.explode_outer(F.array(value))


def computed(df: DataFrame, name: str, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Set a column and keep the rows whose new value passes; the value is computed once."""
    rest = [c for c in df.columns if c != name]
    one = F.filter(F.array(value), lambda v: F.coalesce(keep(v), F.lit(False)))
    return df.select(*rest, F.explode_outer(one).alias(name)).filter(F.col(name).isNotNull())


def exploded(df: DataFrame, keep: list[str], array: Column, position: str, value: str) -> DataFrame:
    """One row per element with its position; rows without elements vanish."""
    return df.select(*keep, F.posexplode_outer(array).alias(position, value)).filter(F.col(position).isNotNull())


UNION_SETTING = "spark.sql.unionOutputPartitioning"


def union_rows(*dfs: DataFrame, fill: bool = False) -> DataFrame:
    """Union by name, safe to group or join afterwards.

    Spark 4.1 takes a union of equally partitioned inputs for partitioned itself and skips the
    exchange behind it; together with a reused exchange that loses matches. The session setting
    that allows this is switched off here (other versions ignore it).
    """
    dfs[0].sparkSession.conf.set(UNION_SETTING, "false")
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=fill)
    return out


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a Python worker is handed at once.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame ahead of Python work on long rows: batches end at ``BATCH_BYTES``, not only at 10,000 rows, so that a
    worker's memory does not grow with the rows. A session setting; a lower one of the caller stays."""
    conf = df.sparkSession.conf
    given = conf.get(BATCH_SETTING, None)
    if given is None or not given.isdigit() or not 0 < int(given) <= BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a key that is often null: rows without it match nothing and take no part in the shuffle, where
    they would all meet in one task."""
    held = left.filter(F.col(key).isNotNull()).join(right, key, "left")
    rest = left.filter(F.col(key).isNull())
    return union_rows(held, rest, fill=True).select(*held.columns)


def spread(df: DataFrame, *ids: str) -> DataFrame:
    """Give costly per-row work one task per core when the input has fewer splits than that.

    For scans: counting the splits of a shuffled frame would run it. A large input has more splits
    than cores and is left alone: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *ids)
