"""A stored inverted-file index over unit vectors: built once, searched without fitting anything.

The folder holds three tables. ``centers`` and ``codebooks`` are small. ``codes`` has, under a partition column for
the list, the ids of its vectors and their product-quantised residuals; a vector stands in its ``copies`` nearest lists, as
in high dimensions the nearest list alone is often not the one a query looks into. ``vectors`` has every vector once, under its
nearest list. A query opens its nearest lists (partition pruning), ranks their codes by the vectors they stand for, and has
the best candidates measured exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .blocks import best_k, unit_rows

#: Centers and code books are fitted on this many vectors at most, chosen by the hash of their id. All vectors are indexed.
TRAIN_ROWS = 1 << 16
#: Queries of one pass over the index.
PASS_QUERIES = 4096
WORDS = 256
#: Codes of the sample that says what a candidate of a query must reach at least; it changes the speed only.
FLOOR_ROWS = 1 << 16
#: Numbers that a task holds at once: distances to the centers, scores, candidates of all queries of a pass.
CELLS = 1 << 20


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of as many rows as give ``CELLS`` numbers of that width; empty ones are left out."""
    step = max(1, CELLS // max(1, width))
    for b in batches:
        for a in range(0, b.num_rows, step):
            yield b.slice(a, step)


@dataclass(frozen=True)
class Layout:
    """``lists`` 0: the square root of the number of vectors. ``parts``: sub-vectors with a code byte each, 0: one for
    every four components. ``copies``: lists that a vector stands in."""

    lists: int = 0
    parts: int = 0
    copies: int = 4
    seed: int = 7


@dataclass(frozen=True)
class Index:
    path: str
    id: str
    lists: int
    rows: int
    centers: np.ndarray  # lists x dims
    books: np.ndarray  # parts x WORDS x dims of a part

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/codes")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means of a bounded sample; an empty cell takes the row that is farthest from its center."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    step = max(1, CELLS // k)
    for _ in range(rounds):
        label, least = np.empty(len(x), np.int64), np.empty(len(x))
        for a in range(0, len(x), step):
            part = x[a : a + step]
            d = (part * part).sum(1)[:, None] - 2 * (part @ centers.T) + (centers * centers).sum(1)[None]
            label[a : a + step], least[a : a + step] = d.argmin(1), d.min(1)
        n = np.bincount(label, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, label, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centers[empty] = x[np.argsort(-least, kind="stable")[: len(empty)]] if len(x) >= len(empty) else centers[empty]
    return centers


def _rows(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if len(m) != len(column) * dims:
        raise ValueError(f"vectors must have {dims} components")
    return unit_rows(list(m.reshape(-1, dims)))


def _typed(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.schema[column].dataType.simpleString()}"


def _encoded(residuals: np.ndarray, books: np.ndarray) -> np.ndarray:
    """A byte per part: the nearest word of its code book."""
    n, step = len(residuals), books.shape[2]
    out = np.empty((n, len(books)), np.uint8)
    for p, book in enumerate(books):
        x = residuals[:, p * step : (p + 1) * step]
        out[:, p] = ((book * book).sum(1)[None] - 2 * (x @ book.T)).argmin(1)
    return out


def build_index(store: DataFrame, path: str, id: str = "vec_id", vec: str = "vec", layout: Layout = Layout()) -> Index:
    """Write the index of all rows with a vector; ``store`` is read three times and shuffled once.

    Vectors of other lengths than the first one's are refused. Hot lists are spread over files by the id. The sample
    that is fitted on (``TRAIN_ROWS``) and the centers are all that the driver sees: lists grow with the square root of the
    store, so 10 billion vectors of 64 components have 100,000 lists, 50 MB.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions.vectors import l2_normalize

    spark = store.sparkSession
    rows = store.select(id, F.col(vec).cast("array<float>").alias("vec")).filter(F.col("vec").isNotNull())
    n = rows.count()
    sample = rows.filter(F.xxhash64(id) % max(1, -(-n // TRAIN_ROWS)) == 0) if n > TRAIN_ROWS else rows
    lists = min(layout.lists or max(1, math.isqrt(n)), max(1, n))
    if n == 0:
        centers, books = np.zeros((1, 1)), np.zeros((1, 1, 1))
    else:
        unit = sample.select(array_to_vector(l2_normalize(F.col("vec"))).alias("u"))
        model = KMeans(k=lists, seed=layout.seed, featuresCol="u", maxIter=10).fit(unit)
        centers = np.array(model.clusterCenters())
        lists = len(centers)
        books = _code_books(sample, centers, layout)
    dims, parts = centers.shape[1], len(books)
    copies = min(layout.copies, lists)
    sent = spark.sparkContext.broadcast((centers, books))
    kind = _typed(store, id)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, books = sent.value
        for some in _slices(batches, len(centers)):
            x = _rows(some.column(1), dims)
            near = np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :copies]
            at = np.repeat(np.arange(len(x)), copies)
            codes = _encoded(x[at] - centers[near.ravel()], books)
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0).take(pa.array(at)), pa.array(near[at, 0].astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(near.ravel().astype(np.int32)),
                ],
                names=[id, "home", "code", "list"],
            )

    def house(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, len(sent.value[0])):
            near = (_rows(b.column(1), dims) @ sent.value[0].T).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32))], names=[id, "vec", "home"])

    # Ranges of (list, id) cut a large list into several files.
    placed = rows.mapInArrow(place, f"{kind}, home int, code binary, list int")
    placed.repartitionByRange("list", F.xxhash64(id)).write.partitionBy("list").parquet(f"{path}/codes")
    housed = rows.mapInArrow(house, f"{kind}, vec array<float>, home int")
    housed.repartitionByRange("home", F.xxhash64(id)).write.partitionBy("home").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    spark.createDataFrame(
        [(p, w, books[p, w].tolist()) for p in range(parts) for w in range(books.shape[1])], "part int, word int, value array<double>"
    ).coalesce(1).write.parquet(f"{path}/codebooks")
    spark.createDataFrame([(id, n)], "id string, rows long").coalesce(1).write.parquet(f"{path}/about")
    return Index(path, id, lists, n, centers, books)


def _code_books(sample: DataFrame, centers: np.ndarray, layout: Layout) -> np.ndarray:
    """A code book for the residuals of each part of the components, one task a part, each over the bounded sample."""
    dims = centers.shape[1]
    parts = layout.parts or max(1, dims // 4)
    if dims % parts:
        parts = next(p for p in range(parts, 0, -1) if dims % p == 0)
    step, seed = dims // parts, layout.seed
    sent = sample.sparkSession.sparkContext.broadcast(centers)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, len(sent.value)):
            x = _rows(b.column(0), dims)
            r = (x - sent.value[(x @ sent.value.T).argmax(1)]).reshape(len(x), parts, step)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(parts, dtype=np.int32), len(x))), pa.array(list(r.reshape(-1, step)), pa.list_(pa.float64()))], names=["part", "x"]
            )

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(sorted(map(tuple, pdf["x"])))  # the order of rows must not matter
        book = lloyd(x, WORDS, seed + int(key[0]))
        return pd.DataFrame({"part": int(key[0]), "word": np.arange(WORDS), "value": list(book)})

    made = sample.select("vec").mapInArrow(residuals, "part int, x array<double>").groupBy("part").applyInPandas(fit, "part int, word int, value array<double>")
    books = np.zeros((parts, WORDS, step))
    for r in made.collect():
        books[r.part, r.word] = r.value
    return books


def open_index(spark: SparkSession, path: str) -> Index:
    about = spark.read.parquet(f"{path}/about").first()
    centers = np.array([r.center for r in spark.read.parquet(f"{path}/centers").orderBy("list").collect()])
    words = spark.read.parquet(f"{path}/codebooks").orderBy("part", "word").collect()
    books = np.array([r.value for r in words]).reshape(1 + words[-1].part, -1, len(words[0].value))
    return Index(path, about.id, len(centers), about.rows, centers, books)


def _best_of(held: list[tuple], keep: int, floor: np.ndarray) -> tuple:
    """Of (queries, ids, homes, scores) the ``keep`` best ids of every query, each once; ``floor`` is lifted to the worst of full lists."""
    query, ids, home, near = (np.concatenate(c) for c in zip(*held))
    same = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((-near, same, query))
    q, i = query[order], same[order]
    order = order[np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])][: len(order)]]
    order = order[np.lexsort((same[order], -near[order], query[order]))]
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    full = order[rank == keep - 1]
    floor[query[full]] = near[full]
    order = order[rank < keep]
    return query[order], ids[order], home[order], near[order]


def _decoded(code: np.ndarray, homes: np.ndarray, centers: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes of lists stand for: their product with a query is the sum of its lookup tables."""
    parts = np.concatenate([book[code[:, p]] for p, book in enumerate(books)], axis=1)
    return parts + centers[homes]


def _codes_of(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def _least(codes: DataFrame, index: Index, sent, queries: int, keep: int) -> np.ndarray:
    """What the ``keep``-th best row of a query reaches at least: that of a bounded sample of its lists, as more rows only lift
    it. Where the sample has fewer rows of these lists, nothing."""
    spark = codes.sparkSession
    own = codes.filter(F.col("list") == F.col("home"))
    share = max(1, -(-index.rows // FLOOR_ROWS))
    some = own.filter(F.pmod(F.xxhash64(index.id), F.lit(share)) == 0) if share > 1 else own
    table = some.select("code", "home").toArrow().combine_chunks()
    if table.num_rows < keep:
        return np.full(queries, -np.inf, np.float32)
    parts = len(index.books)
    sample = spark.sparkContext.broadcast((_codes_of(table.column(0), parts), table.column(1).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, centers, books, opened = sent.value
        code, homes = sample.value
        x = _decoded(code, homes, centers, books).T
        for b in _slices(batches, len(homes)):
            at = b.column(0).to_numpy()
            s = q[at] @ x
            if opened is not None:
                s[~opened[at][:, homes]] = -np.inf
            least = np.partition(s, len(homes) - keep, axis=1)[:, len(homes) - keep]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(least)], names=["query", "least"])

    cores = spark.sparkContext.defaultParallelism
    found = spark.range(0, queries, 1, min(queries, cores)).select(F.col("id").alias("query")).mapInArrow(run, "query long, least float").toArrow()
    out = np.empty(queries, np.float32)
    # Single precision: a product of other shape may differ in its last digits.
    out[found.column(0).to_numpy()] = found.column(1).to_numpy() - np.float32(1e-5)
    return out


def _candidates(codes: DataFrame, index: Index, q: np.ndarray, probed: np.ndarray, keep: int) -> DataFrame:
    """The ``keep`` rows with the best approximate score for every query, from the lists it opens."""
    spark = codes.sparkSession
    parts, id = len(index.books), index.id
    wide = probed.shape[1] >= index.lists
    opened = None
    if not wide:
        opened = np.zeros((len(q), index.lists), bool)
        opened[np.arange(len(q))[:, None], probed] = True
    sent = spark.sparkContext.broadcast((q.astype(np.float32), index.centers.astype(np.float32), index.books.astype(np.float32), opened))
    least = spark.sparkContext.broadcast(_least(codes, index, sent, len(q), keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, centers, books, opened = sent.value
        floor = least.value.copy()  # what a row must reach to be among the best of a query
        held: list[tuple] = []
        size, kind = 0, None
        for b in _slices(batches, len(q)):
            kind = b.column(0).type
            ids, homes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            lists = b.column(3).to_numpy(zero_copy_only=False)
            s = q @ _decoded(_codes_of(b.column(2), parts), lists, centers, books).T
            good = s >= floor[:, None]
            if opened is not None:
                good &= opened[:, lists]
            one, row = np.nonzero(good)
            held.append((one.astype(np.int32), ids[row], homes[row], s[one, row]))
            size += len(one)
            if size > 2 * max(CELLS, len(q) * keep):
                held = [_best_of(held, keep, floor)]
                size = len(held[0][0])
        if held:
            query, id_, home, near = _best_of(held, keep, floor)
            for a in range(0, len(query), 1 << 16):
                z = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query[z]), pa.array(id_[z], kind), pa.array(home[z]), pa.array(near[z].astype(np.float64))], names=["query", id, "home", "near"]
                )

    # Where every list is open, a vector is ranked once, in its nearest list; else once of the opened lists that hold it.
    rows = codes.filter(F.col("list") == F.col("home")) if wide else codes.filter(F.col("list").isin([int(c) for c in np.unique(probed)]))
    found = rows.select(id, "home", "code", "list").mapInArrow(run, f"query int, {_typed(codes, id)}, home int, near double")
    once = found if wide else found.groupBy("query", id).agg(F.max("near").alias("near"), F.first("home").alias("home"))
    return best_k(once.withColumnRenamed("near", "score"), ["query"], id, keep).drop("score", "rank")


def probes_of(index: Index, q: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(q @ index.centers.T), axis=1, kind="stable")[:, :probes]


def search_index(queries: DataFrame, index: Index, k: int = 5, probes: int | None = None, candidates: int | None = None,
                 query_id: str = "query_id", vec: str = "vec", exact: bool = False) -> DataFrame:
    """Approximate cosine top-k: ``query_id, <id>, score, rank``; scores are exact.

    A query opens ``probes`` lists, a quarter of them by default, and has ``candidates`` rows measured, by default 40 a
    result. The query side is a stated set: it is taken in passes of ``PASS_QUERIES``, each of which reads
    the codes of the lists its queries open and the vectors of its candidates. Query ids are unique; queries without a vector
    have no result.

    ``exact`` checks the result: the vectors are read once more a pass, and every one that scores at least as much as the k-th best
    measured candidate of a query takes its place. Good candidates let few of them through; whatever they are, nothing is missed.
    """
    spark = queries.sparkSession
    probes = probes or max(1, index.lists // 4)
    keep = candidates or 40 * k
    wanted = queries.select(query_id, F.col(vec).alias("vec")).filter(F.col("vec").isNotNull())
    n = wanted.count()
    passes = max(1, -(-n // max(1, min(PASS_QUERIES, CELLS // keep))))
    dims = index.centers.shape[1]
    out_type = queries.schema[query_id].dataType
    out = None
    for p in range(passes if index.rows else 0):
        part = (wanted.filter(F.pmod(F.xxhash64(query_id), F.lit(passes)) == p) if passes > 1 else wanted).collect()
        if not part:
            continue
        if {len(r.vec) for r in part} != {dims}:
            raise ValueError(f"query vectors must have {dims} components")
        q = unit_rows([r.vec for r in part])
        near = stored(_candidates(index.codes(spark), index, q, probes_of(index, q, probes), keep))
        homes = [r.home for r in near.select("home").distinct().collect()]  # at most one per list
        vectors = index.vectors(spark).filter(F.col("home").isin(homes))
        # At most ``keep`` rows a query of the pass: a stated bound on what is broadcast.
        hit = vectors.join(F.broadcast(near.select("query", index.id)), index.id)
        names = [r[query_id] for r in part]
        if exact:
            rows = _checked(hit, index.vectors(spark), index.id, q, names, query_id, out_type, k)
        else:
            rows = _measured(hit, index.id, q, names, query_id, out_type)
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        id_type = index.vectors(spark).schema[index.id].dataType if index.rows else T.LongType()
        empty = T.StructType([T.StructField(query_id, out_type), T.StructField(index.id, id_type), T.StructField("score", T.DoubleType())])
        out = spark.createDataFrame([], empty)
    return best_k(out, [query_id], index.id, k)


def _checked(hits: DataFrame, vectors: DataFrame, id: str, q: np.ndarray, names: list, query_id: str, query_type: T.DataType, k: int) -> DataFrame:
    """All vectors that score at least what the k-th best hit of a query does."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = hits.sparkSession
    best = best_k(_measured(hits, id, q, list(range(len(q))), "_q", T.IntegerType()), ["_q"], id, k)
    floor = np.full(len(q), -np.inf)
    for r in best.filter(F.col("rank") == k).select("_q", "score").collect():  # one row a query of the pass
        floor[r["_q"]] = r["score"] - 1e-8  # scores are rounded to nine digits
    sent = spark.sparkContext.broadcast((q, names, floor))
    arrow, dims = to_arrow_type(query_type), q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names, floor = sent.value
        full = np.full(len(q), -np.inf)  # the k-th best of the task's rows
        held: list[tuple] = []
        size, kind = 0, None

        def best() -> list[tuple]:
            return [_best_of(held, k, full)]

        for b in _slices(batches, len(q)):
            kind = b.column(0).type
            x = _rows(b.column(1), dims)
            one, row = np.nonzero(q @ x.T >= np.maximum(floor, full - 1e-8)[:, None])
            if len(one):
                ids = b.column(0).to_numpy(zero_copy_only=False)
                held.append((one.astype(np.int32), ids[row], one, np.round((q[one] * x[row]).sum(1), 9)))
                size += len(one)
            if size > max(CELLS, 2 * len(q) * k):
                held = best()
                size = len(held[0][0])
        if held:
            one, ids, _, score = best()[0]
            for a in range(0, len(one), 1 << 16):
                z = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in one[z]], arrow), pa.array(ids[z], kind), pa.array(score[z])], names=[query_id, id, "score"]
                )

    schema = T.StructType([T.StructField(query_id, query_type), T.StructField(id, hits.schema[id].dataType), T.StructField("score", T.DoubleType())])
    return vectors.select(id, "vec").mapInArrow(run, schema)


def _measured(hits: DataFrame, id: str, q: np.ndarray, names: list, query_id: str, query_type: T.DataType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    spark = hits.sparkSession
    sent = spark.sparkContext.broadcast((q, names))
    arrow, dims = to_arrow_type(query_type), q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = sent.value
        for b in batches:
            if b.num_rows:
                at = b.column(0).to_numpy()
                score = np.round((q[at] * _rows(b.column(2), dims)).sum(1), 9)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], arrow), b.column(1), pa.array(score)], names=[query_id, id, "score"])

    schema = T.StructType([T.StructField(query_id, query_type), T.StructField(id, hits.schema[id].dataType), T.StructField("score", T.DoubleType())])
    return hits.select("query", id, "vec").mapInArrow(run, schema)
