"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir

WORD = r"[^\x20\x09-\x0D]+"
#: A table of this many narrow rows may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Narrow rows that one task takes of a counted table.
PER_TASK = 200_000


def col(name: str) -> Column:
    """A column by its plain name, dots and blanks included."""
    return F.col(f"`{name}`")


def stored(df: DataFrame) -> DataFrame:
    """A narrow intermediate table written to the shared checkpoint folder: read often, computed once."""
    return cut_lineage(df)


def stored_parquet(df: DataFrame) -> DataFrame:
    """A wide intermediate table, written compressed to the shared folder and read by columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A stored narrow table in as many partitions as its counted rows need, whatever number it was written in, and the
    count: a small one leaves few shuffle files, a large one keeps its partitions."""
    rows = df.count()
    return df.coalesce(1 + rows // PER_TASK), rows


def sized(df: DataFrame) -> DataFrame:
    """``counted`` without the count."""
    return counted(df)[0]


def blocks_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by integer keys as tables of whole blocks (rows of equal keys), with the first row of each block.
    A block that runs over the end of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.Table, np.ndarray]:
        part = pa.Table.from_batches(held)
        where = [part.column(k).to_numpy() for k in keys]
        new = np.ones(part.num_rows, bool)
        new[1:] = np.any([w[1:] != w[:-1] for w in where], axis=0)
        return part, np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in keys]
        same = np.all([c == c[-1] for c in columns], axis=0)
        cut = 0 if same.all() else b.num_rows - int(np.argmin(same[::-1]))
        ends = held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != c[0] for k, c in zip(keys, columns))
        if cut:
            held.append(b.slice(0, cut))
        if cut or ends:
            yield out()
            held = []
        held.append(b.slice(cut))
    if held:
        yield out()


#: Text that a task works on at a time.
PART_BYTES = 4 << 20


def parts_of(column: pa.Array, most: int = PART_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Places and texts of a column (null as empty) in parts of bounded bytes; a longer text is a part of its own."""
    part: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append((i, t))
        size += len(t)
    if part:
        yield part


def is_small(df: DataFrame) -> bool:
    """Whether a stored table may be broadcast, by its count."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join_stored(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", few: bool | None = None) -> DataFrame:
    """Join a stored table with unique keys: broadcast it if its counted rows stay within ``BROADCAST_ROWS``, else
    shuffle. ``few``: what an earlier count has shown.

    In the shuffle join Spark may split a hot key of the big side, as the other side has one row per key.
    Keys compare null-safe.
    """
    few = is_small(small) if few is None else few
    right = small.select(*(col(c).alias(f"_r_{c}") if c in keys else col(c) for c in small.columns))
    on = None
    for k in keys:
        same = col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    joined = big.join(F.broadcast(right) if few else right, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_r_{k}" for k in keys))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(x: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(x) == F.char_length(x)
    return F.when(plain, F.lower(x)).otherwise(F.translate(x, upper, upper.lower()))


def unit(h: Column) -> Column:
    """A 64-bit hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
