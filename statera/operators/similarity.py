"""Vector search and text encoding."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import content_hash
from ..functions.rows import bounded_batches, exploded, union_rows
from ..functions.text import strip, tokens
from .blocks import _top, best_k, match_vectors, unit_rows

QUERY_BYTES = 64 << 20  # the query side is sent to every task only below this size
QUERY_ROWS = 4096
SCORE_CELLS = 1 << 21  # scores that a task holds at once


def payload_filter(df: DataFrame, filters: dict | None) -> DataFrame:
    """Conjunction of equality tests; they reach the parquet scan."""
    if not filters:
        return df
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in filters.items()]))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int | None = None) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(arr)
    lengths = np.unique(pa.compute.list_value_length(arr).to_numpy(zero_copy_only=False))
    if len(lengths) != 1 or (dim is not None and lengths[0] != dim):
        raise ValueError(f"vectors must share one length, found {lengths.tolist()}" + (f" with queries of {dim}" if dim else ""))
    m = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def knn(queries: DataFrame, store: DataFrame, k: int = 5, filters: dict | None = None,
        match_on: str | None = None, query_id: str = "query_id", store_id: str = "vec_id",
        vec: str = "vec") -> DataFrame:
    """Exact cosine top-k: ``query_id, store_id, score, rank``.

    ``filters`` holds for all queries; ``match_on`` names a payload column that must equal the query's own value. A small
    query side (size checked) goes to every task: the store is scanned once, never shuffled, and each task
    returns k rows per query. A larger one is a stated set: with ``match_on`` it meets the store in blocks of a key, without
    it is taken in passes of that size, each a scan of the store. Where that is too much, see ``vector_index``.
    """
    store = payload_filter(store, filters).filter(F.col(vec).isNotNull())
    extra = [match_on] if match_on else []
    wanted = queries.select(query_id, vec, *extra).filter(F.col(vec).isNotNull())
    if match_on:  # a null key equals nothing
        wanted, store = wanted.filter(F.col(match_on).isNotNull()), store.filter(F.col(match_on).isNotNull())
    head = wanted.limit(QUERY_ROWS + 1).collect()
    dim = max((len(r[vec]) for r in head), default=1)
    most = max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * dim)))
    if len(head) > most:
        if match_on:
            right = store.select(store_id, vec, match_on)
            return match_vectors(
                wanted.withColumnRenamed(vec, "vec"), right.withColumnRenamed(vec, "vec"), match_on, [query_id], store_id, k
            )
        # Parts of about half the limit: a hash deals unevenly.
        passes = -(-2 * wanted.count() // most)
        part = F.pmod(F.xxhash64(query_id), F.lit(passes))
        return reduce(
            DataFrame.unionAll,
            [_scanned(wanted.filter(part == p).collect(), queries, store, k, None, query_id, store_id, vec) for p in range(passes)],
        )
    return _scanned(head, queries, store, k, match_on, query_id, store_id, vec)


def _scanned(head: list, queries: DataFrame, store: DataFrame, k: int, match_on: str | None, query_id: str, store_id: str,
             vec: str) -> DataFrame:
    """Top-k of the queries at hand by one scan of the store."""
    extra = [match_on] if match_on else []
    groups: dict = {}
    for r in head:
        groups.setdefault(r[match_on] if match_on else None, []).append(r)
    packed = {g: (unit_rows([r[vec] for r in rows]), [r[query_id] for r in rows]) for g, rows in groups.items()}
    dims = {q.shape[1] for q, _ in packed.values()}
    if len(dims) > 1:
        raise ValueError(f"query vectors must share one length, found {sorted(dims)}")
    dim = next(iter(dims), None)
    shared = store.sparkSession.sparkContext.broadcast(packed)
    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(store_id, store.schema[store_id].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        # The worst score of a full list: rows below it change nothing.
        floors = {g: np.full(len(qids), -np.inf) for g, (_, qids) in shared.value.items()}
        step = max(1, SCORE_CELLS // max((len(qids) for _, qids in shared.value.values()), default=1))
        for table in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            ids_all = table.column(0).to_numpy(zero_copy_only=False)
            m_all = _matrix(table.column(1), dim)
            tags = np.array(table.column(2).to_pylist(), dtype=object) if match_on else None
            for g, (q, qids) in shared.value.items():
                pick = slice(None) if g is None and not match_on else np.flatnonzero(tags == g)
                ids, m = ids_all[pick], m_all[pick]
                if not len(ids):
                    continue
                scores = q @ m.T
                lowest = floors[g] - 1e-9  # rounding lifts a score by less
                for i in np.flatnonzero(np.fmax.reduce(scores, axis=1) >= lowest):
                    key = (g, qids[i])
                    at = np.flatnonzero(scores[i] >= lowest[i])
                    s, sid = np.round(scores[i][at], 9), ids[at]
                    if key in best:
                        s, sid = np.concatenate([best[key][0], s]), np.concatenate([best[key][1], sid])
                    at = _top(s, sid, k, None)
                    best[key] = (s[at], sid[at])
                    if k is not None and len(at) >= k:
                        floors[g][i] = best[key][0][-1]
        rows = [(qid, i, sc) for (_, qid), (ss, ii) in best.items() for sc, i in zip(ss, ii)]
        cols = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=t) for c, t in zip(cols, arrow_types)], names=schema.names
        )

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_types = [to_arrow_type(f.dataType) for f in schema.fields]
    hits = store.select(store_id, vec, *extra).mapInArrow(search, schema)
    return best_k(hits, [query_id], store_id, k)


def match_chunks(queries: DataFrame, chunks: DataFrame, threshold: float = 0.7, k: int = 5,
                 document: str = "document_id", query_id: str = "query_id", chunk_id: str = "chunk_id") -> DataFrame:
    """Top-k chunks of the query's own document with similarity strictly above the threshold."""
    return match_vectors(queries, chunks, document, [query_id], chunk_id, k, floor=threshold)


def encode(df: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]],
           out: str = "vec", prefix: str | None = None) -> DataFrame:
    """Add a vector per row; rows with empty text are dropped. ``encoder`` builds the model once per task."""
    kept = bounded_batches(df).filter(strip(F.col(text)) != "")
    schema = T.StructType(kept.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for pdf in batches:
            if len(pdf):
                texts = [f"{prefix}: {t}" if prefix else t for t in pdf[text]]
                pdf[out] = list(np.asarray(model(texts), dtype=np.float32))
                yield pdf

    return kept.mapInPandas(work, schema)


def hashed_terms(dim: int = 256) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Default encoder: unit vectors of hashed term counts, no model needed."""

    def build():
        import re

        word = re.compile(r"[^\W_]+")

        def run(texts: list[str]) -> np.ndarray:
            m = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in word.findall(t.lower()):
                    m[i, zlib.crc32(w.encode()) % dim] += 1.0
            return unit_rows(m)

        return run

    return build


def encode_with_cache(texts: DataFrame, text: str, cache: DataFrame, encoder, prefix: str | None = None) -> DataFrame:
    """One row per distinct text: ``text_hash, text, vec, hit``; only misses are encoded."""
    distinct = texts.select(content_hash(F.col(text)).alias("text_hash"), F.col(text)).dropDuplicates(["text_hash"])
    known = cache.select("text_hash", F.col("vec").cast("array<float>").alias("vec"))
    hits = distinct.join(known, "text_hash").withColumn("hit", F.lit(True))
    misses = encode(distinct.join(known, "text_hash", "left_anti"), text, encoder, prefix=prefix)
    return union_rows(hits, misses.withColumn("hit", F.lit(False)))


def term_string(c: Column) -> Column:
    """Tokens joined by a space, the form the term kernel reads."""
    return F.array_join(tokens(c), " ")


def term_cosine(pairs: DataFrame, pair_id: list[str], a: str, b: str) -> DataFrame:
    """Term-count cosine of two texts per row, by two partial aggregations and no join."""
    side = F.concat(
        F.transform(tokens(F.col(a)), lambda t: F.struct(t.alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
        F.transform(tokens(F.col(b)), lambda t: F.struct(t.alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b"))),
    )
    counts = exploded(pairs, pair_id, side, "n", "s").groupBy(*pair_id, "s.t").agg(
        F.sum("s.a").cast("double").alias("ta"), F.sum("s.b").cast("double").alias("tb")
    )
    sums = counts.groupBy(*pair_id).agg(
        F.sum(F.col("ta") * F.col("tb")).alias("d"),
        F.sum(F.col("ta") * F.col("ta")).alias("na"),
        F.sum(F.col("tb") * F.col("tb")).alias("nb"),
    )
    scale = F.sqrt("na") * F.sqrt("nb")
    return sums.select(*pair_id, F.when(scale > 0, F.col("d") / scale).otherwise(0.0).alias("score"))
