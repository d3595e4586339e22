"""Connected components of a table of links by alternating star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PER_TASK, stored


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as stars: every node but the least of its component, and that least node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            break
        low = new
    far = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[low[far]], nodes[far]


def contracted(links: DataFrame, parts: int) -> DataFrame:
    """Links with the same components, dealt to ``parts`` tasks of bounded rows, each of which gives its part as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            low, far = spanning(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(far)], names=["a", "b"])

    return links.repartition(parts).mapInArrow(run, "a long, b long")


def whole(links: DataFrame) -> DataFrame:
    """(node, root) of links that one task may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            low, far = spanning(*(np.concatenate(c) for c in zip(*held)))
            roots = np.unique(low)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(far, roots)), pa.array(np.append(low, roots))], names=["node", "root"])

    return links.repartition(1).mapInArrow(run, "node long, root long")


def _pulled(links: DataFrame) -> DataFrame:
    """Links (node, next) with ``low``, the least of a node and its neighbours. The join key may be hot: the other
    side has one row per node, so Spark may split it."""
    low = links.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("low"))
    return links.join(low, "node")


def _both(links: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))
    return links.select(F.explode(ends).alias("e")).select("e.*")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node (a long) of the links (a, b): its component's least node, the root included.

    Up to ``PER_TASK`` links are joined within one task, in one query: the plans of star steps, which take more of the
    driver's memory than so few rows are worth, are left to more links. Of these first every ``PER_TASK`` become stars
    within one task. Then a large step links every greater neighbour of a
    node to the least of its neighbourhood, a small step the node itself and its lesser neighbours; both keep
    components whole, and together they end in stars. The links are counted, and each table is held in as many
    partitions as its rows need. Links to oneself and repeated links do not matter; no links give no rows.
    """
    links = links.filter("a <> b").select("a", "b")
    parts = 1 + links.count() // PER_TASK
    if parts == 1:
        return whole(links)
    now = stored(contracted(links, parts))
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        large = _pulled(_both(now)).filter("next > node").select(F.col("low").alias("a"), F.col("next").alias("b"))
        down = large.filter("a <> b").coalesce(parts).distinct().select(F.col("b").alias("node"), F.col("a").alias("next"))
        small = _pulled(down)
        own = small.select(F.col("low").alias("a"), F.col("node").alias("b"))
        others = small.select(F.col("low").alias("a"), F.col("next").alias("b"))
        now = stored(own.unionAll(others).filter("a <> b").coalesce(parts).distinct().coalesce(parts))
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct().coalesce(parts)
    )
