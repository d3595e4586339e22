"""Ranked lexical search by presence masks.

Two passes over the documents. The first counts, for the terms of the queries only, in how many documents they are.
The second takes documents block by block: every query term has a bitmap over the block, the bitmaps of a query's
terms group the block's documents by the mask of the terms they hold, and masks are scored in the order of the most
they could reach, until no further mask can enter the task's best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import col, parts_of
from .partials import added, packed

#: Text of the queries that is searched for in one pass; more queries are taken in several passes.
QUERY_BYTES = 4 << 20
#: Entries of a block's table of term weights.
BLOCK_CELLS = 8 << 20
_SLICE = 1 << 20
_TERMS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_NO_ID = np.iinfo(np.int64).max


class Queries(NamedTuple):
    ids: list  # of the items
    terms: dict[bytes, int]
    of: list[list[tuple[int, int]]]  # (term, times) of every item


class Weights(NamedTuple):
    n_docs: int
    n_terms: int
    w: np.ndarray  # of every query term


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a slice at a time; slices end between terms."""
    data, a = data.translate(_TERMS), 0
    while a < len(data):
        end = data.find(b" ", a + _SLICE)
        b = len(data) if end < 0 else end
        yield data[a:b].split()
        a = b


def queries_of(items: list[tuple]) -> Queries:
    terms: dict[bytes, int] = {}
    of = []
    for _, text in items:
        times: dict[int, int] = {}
        for part in terms_of(text.encode()):
            for t in part:
                i = terms.setdefault(t, len(terms))
                times[i] = times.get(i, 0) + 1
        of.append(sorted(times.items()))
    return Queries([i for i, _ in items], terms, of)


class Postings(NamedTuple):
    """Query terms in a part of the documents, by term, then document."""

    lengths: np.ndarray
    term: np.ndarray
    doc: np.ndarray
    tf: np.ndarray


def postings(texts: list[str], terms: dict[bytes, int]) -> Postings:
    lengths = np.zeros(len(texts), np.int64)
    keys = []
    for i, text in enumerate(texts):
        for part in terms_of(text.encode()):
            lengths[i] += len(part)
            found = np.fromiter(map(terms.get, part, repeat(-1)), np.int64, len(part))
            keys.append(found[found >= 0] * len(texts) + i)
    keys, tf = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    return Postings(lengths, keys // len(texts), keys % len(texts), tf.astype(np.int64))


def statistics(docs: DataFrame, queries: Queries) -> Weights:
    """Documents with a term, all terms, and the weight of every query term. One row of counts a task."""
    n = len(queries.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 2, np.int64)
        for b in batches:
            for part in parts_of(b.column(1)):
                found = postings([t for _, t in part], queries.terms)
                total[:n] += np.bincount(found.term, minlength=n)
                total[n:] += np.count_nonzero(found.lengths), found.lengths.sum()
        yield packed(total)

    counts = added(docs.mapInArrow(count, "sums binary"), n + 2)
    n_docs, n_terms = int(counts[n]), int(counts[n + 1])
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in counts[:n]]
    return Weights(n_docs, n_terms, np.array(weight, np.int64))


def masks_of(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks of the columns of a table of bits (terms by documents): a document of each mask, and the mask
    of each document. Masks are 64 bits a word; longer ones are named word by word."""
    rows = np.packbits(present, axis=0, bitorder="little")
    words = -(-len(rows) // 8)
    filled = np.zeros((words * 8, present.shape[1]), np.uint8)
    filled[: len(rows)] = rows
    masks = np.ascontiguousarray(filled.T).view(np.uint64)
    _, first, name = np.unique(masks[:, 0], return_index=True, return_inverse=True)
    for k in range(1, words):
        _, word = np.unique(masks[:, k], return_inverse=True)
        _, first, name = np.unique(name * (int(word.max()) + 1) + word, return_index=True, return_inverse=True)
    return first, name


class Best:
    """The best k (score, id) of a task for every item; equal scores by the smaller id, no id last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * n
        self.id = [np.zeros(0, np.int64)] * n

    def least(self, item: int) -> int:
        """What a score must reach to matter."""
        return int(self.score[item][-1]) if len(self.score[item]) == self.k else 1

    def add(self, item: int, score: np.ndarray, id: np.ndarray) -> None:
        take = score >= self.least(item)
        score, id = np.append(self.score[item], score[take]), np.append(self.id[item], id[take])
        order = np.lexsort((id, -score))[: self.k]
        self.score[item], self.id[item] = score[order], id[order]


def length_norms(lengths: np.ndarray, weights: Weights) -> np.ndarray:
    return np.array([100 - 25 + (25 * n * weights.n_docs) // weights.n_terms for n in lengths.tolist()], np.int64)


def search_block(found: Postings, ids: np.ndarray, queries: Queries, weights: Weights, best: Best) -> None:
    """Score one block of documents for all items."""
    here, row = np.unique(found.term, return_inverse=True)
    if not len(here):
        return
    m = length_norms(found.lengths, weights)
    part = (1_000_000_000 * found.tf) // (1000 * found.tf + 12 * m[found.doc])
    gain = np.zeros((len(here), len(ids)), np.int64)
    gain[row, found.doc] = weights.w[found.term] * part
    present = np.zeros(gain.shape, bool)
    present[row, found.doc] = True
    most = gain.max(axis=1)
    at = np.full(len(queries.terms), -1, np.int64)
    at[here] = np.arange(len(here))
    for item, terms in enumerate(queries.of):
        rows = [(at[t], times) for t, times in terms if at[t] >= 0]
        if not rows:
            continue
        of = np.array([r for r, _ in rows])
        times = np.array([t for _, t in rows], np.int64)
        if int((most[of] * times).sum()) < best.least(item):
            continue
        bits = present[of]
        first, name = masks_of(bits)
        reach = (most[of] * times) @ bits[:, first]
        order = np.argsort(-reach, kind="stable")
        by_mask = np.argsort(name, kind="stable")
        ends = np.cumsum(np.bincount(name, minlength=len(first)))
        done = 0
        while done < len(order) and reach[order[done]] >= best.least(item):
            group = []
            size = 0
            # Masks until there are enough documents to fill the best, then at least as many again.
            while done < len(order) and size < best.k and reach[order[done]] >= best.least(item):
                mask = order[done]
                group.append(by_mask[(ends[mask - 1] if mask else 0) : ends[mask]])
                size += len(group[-1])
                done += 1
            docs = np.concatenate(group)
            best.add(item, times @ gain[np.ix_(of, docs)], ids[docs])


def blocks(found: Postings, n_docs: int) -> Iterator[tuple[slice, Postings]]:
    """Runs of documents whose table of term weights stays within ``BLOCK_CELLS``."""
    step = max(1, BLOCK_CELLS // max(1, len(np.unique(found.term))))
    if step >= n_docs:
        yield slice(0, n_docs), found
        return
    for a in range(0, n_docs, step):
        take = (found.doc >= a) & (found.doc < a + step)
        yield slice(a, a + step), Postings(found.lengths[a : a + step], found.term[take], found.doc[take] - a, found.tf[take])


def _best_of_tasks(docs: DataFrame, queries: Queries, weights: Weights, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.of), k)
        for b in batches:
            ids = b.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for part in parts_of(b.column(1)):
                found = postings([t for _, t in part], queries.terms)
                mine = ids[part[0][0] : part[0][0] + len(part)]
                for where, some in blocks(found, len(part)):
                    search_block(some, mine[where], queries, weights, best)
        item = np.repeat(np.arange(len(queries.of)), [len(s) for s in best.score])
        score, id = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (best.score, best.id))
        slot = np.full(len(item), TaskContext.get().partitionId() % 64, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(slot), pa.array(id, pa.int64(), mask=id == _NO_ID), pa.array(score)],
            names=["item", "slot", "doc_id", "score"],
        )

    return docs.mapInArrow(run, "item int, slot int, doc_id long, score long")


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score; only scores above 0.

    ``items`` is the stated set of queries: their text travels to every task, at most ``QUERY_BYTES`` in one pass over the
    documents and in as many passes as it takes. A task keeps k rows an item, so k rows an item and task are shuffled,
    merged in 64 slots first. Equal (id, text) items count once; one id with two texts is two searches, each with its own
    ranks. Items with null, empty or unmatched texts give no row. Documents: ids are integers, null ids come last among
    equal scores; a null or empty text has no terms and does not count; very long texts are read in slices; repeated rows
    are documents of their own, with ranks of their own. Other columns are not read. Empty tables give an empty result.
    """
    docs = docs.select(col(id).cast("long").alias("doc_id"), col(text).alias("text"))
    items = items.select(col(item_id).alias("item_id"), col(item_text).alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(size / QUERY_BYTES))
    out = None
    for p in range(passes):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).sort("item_id", "text").collect()
        queries = queries_of([tuple(r) for r in mine])
        weights = statistics(docs, queries) if queries.terms else Weights(0, 0, np.zeros(0, np.int64))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        rows = _best_of_tasks(docs, queries, weights, k)
        for keys in (("item", "slot"), ("item",)):
            rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame(list(enumerate(queries.ids)), f"item int, item_id {dict(items.dtypes)['item_id']}")
        rows = rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionAll(rows)
    return out
