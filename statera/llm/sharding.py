"""Minimax contiguous partition of atomic groups into shards, by binary search over the shard capacity.

Groups of equal texts are ordered by the hash of their text. The smallest capacity for which a greedy fill needs
no more than the given shards is found on sums of hash ranges: a few thousand ranges first, then only those in
which a cut may fall are split, until each of them holds one group. The driver sees sums of ranges, never groups
of all documents, and the capacity found is that of a search over all groups.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, join_stored, stored

FIRST_BITS = 12
MORE_BITS = 6
CELL_ROWS = 1024


@dataclass
class Part:
    """A range of hashes that starts at ``low``: its bytes and groups. ``bits``: the hash bits that name it."""

    low: int
    size: int
    groups: int
    bits: int


def greedy_cuts(sums: list[int], capacity: float, shards: int) -> list[int] | None:
    """Where a greedy fill cuts a list of prefix sums (positions after the last item of each shard but the last);
    None if it needs more shards."""
    cuts, at, n = [], 0, len(sums) - 1
    for _ in range(shards):
        at = bisect.bisect_right(sums, sums[at] + capacity) - 1
        if at == n:
            return cuts + [n] * (shards - 1 - len(cuts))
        cuts.append(at)
    return None


def smallest_capacity(sums: list[int], shards: int, low: int) -> int:
    """Least whole capacity, ``low`` or more, that a greedy fill of the items can keep."""
    high = max(low, sums[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sums, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def prefix(parts: list[Part]) -> list[int]:
    sums = [0]
    for p in parts:
        sums.append(sums[-1] + p.size)
    return sums


def unsettled(parts: list[Part], shards: int, low: int) -> tuple[list[int], int, list[int]]:
    """Ranges of several groups in which the cut of some still possible capacity may fall; the capacity and
    the cuts if there are none."""
    sums = prefix(parts)
    high = smallest_capacity(sums, shards, low)
    # A cut of any capacity from low to high lies at or after the one that whole ranges give for low (first),
    # and at or before the one that the sum alone allows for high (last).
    first = last = 0
    wanted: set[int] = set()
    for _ in range(shards - 1):
        first = bisect.bisect_right(sums, sums[first] + low) - 1
        last = min(bisect.bisect_right(sums, sums[last] + high), len(parts))
        wanted.update(range(first, min(last + 1, len(parts))))
    cuts = greedy_cuts(sums, high, shards) or []
    return sorted(i for i in wanted if parts[i].groups > 1), high, cuts


def minimax_cuts(
    first: list[Part], split: Callable[[list[Part]], list[Part]], shards: int, largest: int,
) -> tuple[int, list[int]]:
    """The smallest capacity and the hashes at which the second, third, ... shard begins."""
    parts = sorted(first, key=lambda p: p.low)
    low = max(largest, -(-sum(p.size for p in parts) // shards))
    while True:
        wanted, capacity, cuts = unsettled(parts, shards, low)
        if not wanted:
            ends = [parts[c].low if c < len(parts) else None for c in cuts]
            return capacity, [e for e in ends if e is not None]
        drop = set(wanted)
        parts = sorted(
            [p for i, p in enumerate(parts) if i not in drop] + split([parts[i] for i in wanted]), key=lambda p: p.low
        )


def group_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("key").agg(F.sum("size").alias("bytes"))


def _ranges(groups: DataFrame, bits: int) -> list[Part]:
    at = F.shiftright("key", 64 - bits).alias("at")
    found = groups.groupBy(at).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    return [Part(r["at"] << (64 - bits), r["bytes"], r["n"], bits) for r in found]


def shard_sizes(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """What sharding needs of a document: id, size (UTF-8 bytes and 1), checksum and the hash of the text."""
    body = F.coalesce(col(text), F.lit(""))
    return df.select(
        col(id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.xxhash64(body).alias("key"),
    )


def minimax_shards(df: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, size, checksum, law, shard (from 0), slot within the shard (gapless from 0) and
    grown_shard (null under this law). The law is ``bytes``: the largest shard is as small as whole groups allow.

    Equal texts share a shard; null and empty texts count as equal and have size 1. A group as large as the mean
    of what is left stands alone in the first shards, so that it does not swell the capacity of the others.
    Repeated rows and ids each get a slot of their own; rows alike in all that is read are interchangeable. Other
    columns are not read. An empty table gives an empty result; more shards than groups leave shards empty.
    """
    docs = stored(shard_sizes(df, id, text))
    groups = stored(group_sizes(docs))
    total = groups.agg(F.sum("bytes")).first()[0]
    alone: list[int] = []
    largest, rest = 0, total or 0
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        largest = r["bytes"]
        if len(alone) >= shards - 1 or largest * (shards - len(alone)) < rest:
            break
        alone.append(r["key"])
        rest -= largest
        largest = 0
    left = groups.filter(~F.col("key").isin(alone)) if alone else groups

    def split(parts: list[Part]) -> list[Part]:
        found: list[Part] = []
        for bits in {p.bits for p in parts}:
            at = [p.low >> (64 - bits) for p in parts if p.bits == bits]
            some = left.filter(F.shiftright("key", 64 - bits).isin(at))
            found += _ranges(some, min(64, bits + MORE_BITS))
        return found

    starts: list[int] = []
    if rest:
        _, starts = minimax_cuts(_ranges(left, FIRST_BITS), split, shards - len(alone), largest)
    shard = F.lit(len(alone))
    for s in starts:
        shard = shard + (F.col("key") >= s).cast("int")
    for i, k in enumerate(alone):
        shard = F.when(F.col("key") == k, F.lit(i)).otherwise(shard)
    return with_slots(docs.withColumn("shard", shard.cast("int")), shards)


def with_slots(docs: DataFrame, shards: int) -> DataFrame:
    """Number the rows of each shard from 0. Rows are dealt into small cells by their hash, so that a large shard
    is not one window; a cell begins where the cells before it end."""
    cells = max(1, -(-docs.count() // (shards * CELL_ROWS)))
    dealt = docs.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "key", F.lit(7)), F.lit(cells)).cast("int"))
    counts = dealt.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    running = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("_n").over(running) - F.col("_n")
    offsets = stored(counts.select("shard", "_cell", before.alias("_before")))
    order = Window.partitionBy("shard", "_cell").orderBy("doc_id", "key")
    numbered = dealt.withColumn("_row", F.row_number().over(order) - 1)
    out = join_stored(numbered, offsets, ["shard", "_cell"], "inner")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_before") + F.col("_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

