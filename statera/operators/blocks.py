"""Best matches between two sides of a shared key, in bounded blocks.

Rows of a key meet in cells of at most about ``block`` rows per side. A key that fits is one cell; a
hot key is cut on both sides, each row is sent to the cells of its row or column, and a cell gives
back at most ``k`` rows per left row. So no task sees a whole hot key, no list of all pairs is ever
built, and nothing is dropped: every pair is scored in exactly one cell.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import bounded_batches, union_rows


def _blocks_of(left: DataFrame, right: DataFrame, key: str, block: int, sizes: DataFrame | None) -> DataFrame:
    """Number of blocks per side for the keys that need more than one."""
    weights = left.select(key, F.lit(1).alias("l")) if sizes is None else sizes.select(key, F.col("rows").alias("l"))
    sides = union_rows(
        weights.select(key, F.col("l").cast("long").alias("l"), F.lit(0).alias("r")),
        right.select(key, F.lit(0).cast("long").alias("l"), F.lit(1).alias("r")),
    )
    counts = sides.groupBy(key).agg(F.sum("l").alias("nl"), F.sum("r").alias("nr"))
    return counts.filter((F.col("nl") > block) | (F.col("nr") > block)).select(
        F.col(key).alias("_hot"),
        F.ceil(F.col("nl") / block).cast("int").alias("_bl"),
        F.ceil(F.col("nr") / block).cast("int").alias("_br"),
    )


def cells(left: DataFrame, right: DataFrame, key: str, left_ids: list[str], right_id: str,
          left_cols: list[str], right_cols: list[str], block: int = 1024, sizes: DataFrame | None = None) -> DataFrame:
    """One row per cell: ``key``, ``lefts`` and ``rights`` (arrays of structs). One shuffle of the rows.

    ``sizes`` (key, rows) may estimate the left rows of a key where counting them would repeat costly
    work; it only steers how far a key is cut. A null key equals nothing, so rows with one take no part.
    """
    left, right = left.filter(F.col(key).isNotNull()), right.filter(F.col(key).isNotNull())
    hot = _blocks_of(left, right, key, block, sizes)

    def place(df: DataFrame, side: str, row_ids: list[str], cols: list[str]) -> DataFrame:
        own, other = ("_bl", "_br") if side == "l" else ("_br", "_bl")
        j = df.select(key, *cols).join(hot, F.col(key) == F.col("_hot"), "left")
        mine = F.pmod(F.xxhash64(*row_ids), F.greatest(F.coalesce(own, F.lit(1)), F.lit(1))).cast("int")
        theirs = F.explode(
            F.sequence(F.lit(0), F.greatest(F.coalesce(other, F.lit(1)), F.lit(1)) - 1)
        )
        j = j.select(key, F.struct(*cols).alias("row"), mine.alias("_own"), theirs.alias("_other"))
        lb, rb = ("_own", "_other") if side == "l" else ("_other", "_own")
        return j.select(
            key,
            F.col(lb).alias("_lb"),
            F.col(rb).alias("_rb"),
            F.col("row").alias("_l" if side == "l" else "_r"),
        )

    both = union_rows(place(left, "l", left_ids, left_cols), place(right, "r", [right_id], right_cols), fill=True)
    return both.groupBy(key, "_lb", "_rb").agg(
        F.collect_list("_l").alias("lefts"), F.collect_list("_r").alias("rights")
    )


Kernel = Callable[[list, list], Iterator[tuple]]


def run_kernel(cell_rows: DataFrame, kernel: Kernel, schema: T.StructType) -> DataFrame:
    """Apply ``kernel(lefts, rights)`` to every cell; many small cells share one Arrow batch, large ones are few to a batch."""
    names = [f.name for f in schema.fields]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for lefts, rights in zip(pdf["lefts"], pdf["rights"]):
                if len(lefts) and len(rights):
                    out.extend(kernel(lefts, rights))
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return bounded_batches(cell_rows).select("lefts", "rights").mapInPandas(work, schema)


def best_k(df: DataFrame, left_ids: list[str], right_id: str, k: int | None) -> DataFrame:
    """Merge the cells: best ``k`` per left row, ties by the id of the right row."""
    w = Window.partitionBy(*left_ids).orderBy(F.desc("score"), F.asc(right_id))
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def _top(scores: np.ndarray, ids: np.ndarray, k: int | None, floor: float | None) -> list[int]:
    """Positions of the ``k`` best scores, ties by id; all ties at the border are considered."""
    pos = np.arange(len(scores)) if floor is None else np.flatnonzero(scores > floor)
    if k is not None and len(pos) > k:
        border = np.partition(scores[pos], len(pos) - k)[len(pos) - k]
        pos = pos[scores[pos] >= border]
    order = np.lexsort((ids[pos], -scores[pos]))[:k]
    return [int(i) for i in pos[order]]


def term_kernel(left_ids: list[str], right_id: str, k: int | None = 1) -> Kernel:
    """Cosine of term counts. ``terms`` is a space-joined token string on both sides."""

    def kernel(lefts, rights):
        ids = np.array([r[right_id] for r in rights])
        postings: dict[str, tuple[list[int], list[int]]] = {}
        sizes = np.zeros(len(rights))
        for i, r in enumerate(rights):
            counts = Counter(r["terms"].split(" ")) if r["terms"] else {}
            sizes[i] = np.sqrt(float(sum(c * c for c in counts.values())))
            for t, c in counts.items():
                at, tf = postings.setdefault(t, ([], []))
                at.append(i)
                tf.append(c)
        for row in lefts:
            counts = Counter(row["terms"].split(" ")) if row["terms"] else {}
            at: list[int] = []
            w: list[int] = []
            for t, c in counts.items():
                hit = postings.get(t)
                if hit:
                    at.extend(hit[0])
                    w.extend([c * x for x in hit[1]])
            dots = np.bincount(np.array(at, dtype=np.int64), weights=w, minlength=len(rights)) if at else np.zeros(len(rights))
            scale = np.sqrt(float(sum(c * c for c in counts.values()))) * sizes
            scores = np.divide(dots, scale, out=np.zeros(len(rights)), where=scale > 0)
            for i in _top(scores, ids, k, None):
                yield (*[row[c] for c in left_ids], ids[i].item(), float(scores[i]))

    return kernel


def unit_rows(vectors) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def dense_kernel(left_ids: list[str], right_id: str, k: int | None, floor: float | None = None) -> Kernel:
    """Cosine of dense vectors (field ``vec`` on both sides); scores are rounded so that ties are stable."""

    def kernel(lefts, rights):
        ids = np.array([r[right_id] for r in rights])
        store = unit_rows([r["vec"] for r in rights])
        scores = np.round(unit_rows([r["vec"] for r in lefts]) @ store.T, 9)
        for row, s in zip(lefts, scores):
            for i in _top(s, ids, k, floor):
                yield (*[row[c] for c in left_ids], ids[i].item(), float(s[i]))

    return kernel


def _match(left, right, key, left_ids, right_id, payload, kernel, k, block, sizes=None) -> DataFrame:
    c = cells(left, right, key, left_ids, right_id, [*left_ids, payload], [right_id, payload], block, sizes)
    schema = T.StructType(
        [T.StructField(i, left.schema[i].dataType) for i in left_ids]
        + [T.StructField(right_id, right.schema[right_id].dataType), T.StructField("score", T.DoubleType())]
    )
    return best_k(run_kernel(c, kernel, schema), left_ids, right_id, k)


def match_terms(left: DataFrame, right: DataFrame, key: str, left_ids: list[str], right_id: str,
                k: int | None = 1, block: int = 1024, sizes: DataFrame | None = None) -> DataFrame:
    """Best ``k`` right rows for each left row of the same key by term cosine (``None``: all of them)."""
    return _match(left, right, key, left_ids, right_id, "terms", term_kernel(left_ids, right_id, k), k, block, sizes)


def match_vectors(left: DataFrame, right: DataFrame, key: str, left_ids: list[str], right_id: str,
                  k: int | None, floor: float | None = None, block: int = 1024) -> DataFrame:
    """Best ``k`` right rows for each left row of the same key by vector cosine (> ``floor``)."""
    kernel = dense_kernel(left_ids, right_id, k, floor)
    return _match(left, right, key, left_ids, right_id, "vec", kernel, k, block)
