"""Centroid clustering of vectors in integers, with a vantage-point tree over the centroids.

The tree is built anew from the centroids of each round and broadcast. Every vector searches it best first: the node
with the smallest lower bound is opened next, and the search ends when that bound lies beyond the best distance found.
Bounds are rational only in floating point and therefore loosened by more than their rounding; all distances that
decide are exact integers, and a bound equal to the best distance is still opened, so that ties go to the smaller number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stored_parquet
from .partials import added, packed

LEAF = 2
#: Components beyond this make squared distances of 64 of them leave 64 bits; such a vector is refused.
LARGEST = 1 << 27
_BATCH = 4096


class Node(NamedTuple):
    vantage: int  # number of its centroid, -1 in a leaf
    centroids: tuple[int, ...]  # of a leaf
    near: int  # child nodes, and the range of distances of their centroids from the vantage point
    far: int
    near_range: tuple[float, float]
    far_range: tuple[float, float]


class Tree(NamedTuple):
    centroids: np.ndarray
    nodes: list[Node]


def build_tree(centroids: np.ndarray) -> Tree:
    """The vantage point of a node is the centroid farthest from the first one of its set; the rest is halved by its
    distance from there."""
    nodes: list[Node] = []

    def squares(point: int, others: np.ndarray) -> np.ndarray:
        gap = centroids[others] - centroids[point]
        return np.einsum("ij,ij->i", gap, gap)

    def add(members: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(Node(-1, tuple(members.tolist()), -1, -1, (0.0, 0.0), (0.0, 0.0)))
        if len(members) > LEAF:
            vantage = int(members[np.argmax(squares(members[0], members))])
            rest = members[members != vantage]
            d = squares(vantage, rest)
            order = np.argsort(d, kind="stable")
            half = (len(rest) + 1) // 2
            sides = [np.sort(rest[order[:half]]), np.sort(rest[order[half:]])]
            ranges = [(math.sqrt(int(d[s].min())), math.sqrt(int(d[s].max()))) if len(s) else (0.0, 0.0) for s in (order[:half], order[half:])]
            near = add(sides[0])
            far = add(sides[1]) if len(sides[1]) else -1
            nodes[at] = Node(vantage, (), near, far, *ranges)
        return at

    if len(centroids):
        add(np.arange(len(centroids)))
    return Tree(centroids, nodes)


def nearest(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of every row; of equally near ones the smaller number.

    All rows search at once: each has a bound for every node that waits, and in a step opens its best one."""
    n = len(x)
    rows = np.arange(n)
    best = np.full(n, np.iinfo(np.int64).max)
    label = np.full(n, len(tree.centroids))
    bound = np.full((n, len(tree.nodes)), np.inf)
    bound[:, 0] = 0.0

    def measure(at: np.ndarray, c: int) -> np.ndarray:
        gap = x[at] - tree.centroids[c]
        d = np.einsum("ij,ij->i", gap, gap)
        better = (d < best[at]) | ((d == best[at]) & (c < label[at]))
        best[at[better]], label[at[better]] = d[better], c
        return d

    live = rows
    while len(live):
        node = bound[live].argmin(axis=1)
        low = bound[live, node]
        open_ = low <= np.sqrt(best[live].astype(np.float64)) * (1 + 1e-12)  # inclusive radius, rounded up
        live, node, low = live[open_], node[open_], low[open_]
        for k in np.unique(node):
            here = node == k
            at, floor = live[here], low[here]
            bound[at, k] = np.inf
            one = tree.nodes[k]
            for c in one.centroids:
                measure(at, c)
            if one.vantage >= 0:
                d = np.sqrt(measure(at, one.vantage).astype(np.float64))
                for child, (least, most) in ((one.near, one.near_range), (one.far, one.far_range)):
                    if child >= 0:
                        gap = np.maximum(d - most, least - d) - 1e-12 * (d + most) - 1e-9
                        bound[at, child] = np.maximum(floor, gap)
    return label, best


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def kept_vectors(df: DataFrame, id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """vec_id and q: the components as integers, of vectors with exactly ``dims`` finite components."""
    x = F.transform(col(vector), lambda v: v.cast("double"))
    fine = F.coalesce(F.size(x) == dims, F.lit(False)) & F.coalesce(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(F.coalesce(v, F.lit(0.0))) & (F.abs(F.coalesce(v, F.lit(0.0))) < F.lit(math.inf))), F.lit(False)
    )
    whole = F.transform(x, lambda v: F.floor(v * scale))
    refused = F.raise_error(F.lit(f"a component of {LARGEST // scale} or more: squared distances do not fit 64 bits"))
    checked = F.when(F.exists(x, lambda v: F.abs(v * scale) >= LARGEST), refused.cast("array<bigint>")).otherwise(whole)
    return df.filter(fine).select(col(id).alias("vec_id"), checked.alias("q"))


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hash of their id; equal ids by their components, null ids last."""
    mark = F.coalesce(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), F.lit("~"))
    return np.array([r.q for r in kept.select("q", mark.alias("mark")).orderBy("mark", "q").limit(k).collect()], np.int64)


def next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector goes to its nearest centroid, every non-empty centroid becomes the floor of their mean.
    A task sends one row of sums."""
    spark = kept.sparkSession
    k, dims = centroids.shape
    sent = spark.sparkContext.broadcast(build_tree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            for a in range(0, b.num_rows, _BATCH):
                x = matrix(b.column(0).slice(a, _BATCH), dims)
                label, _ = nearest(sent.value, x)
                order = np.argsort(label, kind="stable")
                used, starts = np.unique(label[order], return_index=True)
                total[used, :dims] += np.add.reduceat(x[order], starts, axis=0)
                total[:, dims] += np.bincount(label, minlength=k)
        yield packed(total)

    total = added(kept.select("q").mapInArrow(run, "sums binary"), k * (dims + 1)).reshape(k, dims + 1)
    sent.destroy()
    some = total[:, dims] > 0
    return np.where(some[:, None], total[:, :dims] // np.maximum(total[:, dims:], 1), centroids)


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]
    sent = kept.sparkSession.sparkContext.broadcast(build_tree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, _BATCH):
                part = b.slice(a, _BATCH)
                label, d = nearest(sent.value, matrix(part.column(1), dims))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, f"vec_id {dict(kept.dtypes)['vec_id']}, cluster int, distance long")


def clustered(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024,
    salt: str = "3:",
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    ``k`` centroids travel to every task and ``k`` x (``dims`` + 1) sums come back from it: meant for up to some thousand
    centroids. Vectors are turned into integers once and stored; a round is one pass over them without a shuffle of
    vectors. Vectors that are null, of another length, or hold a null or non-finite component are left out; a component
    too large for exact 64-bit distances ends the job with an error. Null ids are clustered like others and chosen as
    first centroids last; repeated rows count each; with fewer vectors than ``k`` there are fewer centroids; a centroid
    without vectors stays where it is. Other columns are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    kept = stored_parquet(kept_vectors(df, id, vector, dims, scale))
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        kind = dict(kept.dtypes)["vec_id"]
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids)
    rows = stored_parquet(assigned(kept, centroids))
    sums = {r.cluster: r.total for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(c, total, sum(sums.values()), marks[c]) for c, total in sums.items()]
    side = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
