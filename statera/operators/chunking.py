"""Chunks: paragraphs, boundary windows, fixed stride."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import bounded_batches, exploded
from ..functions.text import strip

# Where a window may end, tried in this order.
SENTENCE_ENDS = (".\n", ". ", ".\n\n", "!", "?")

SoftEnd = Callable[[int, int], int]


def _spans(n: int, size: int, overlap: int, soft_end: SoftEnd) -> Iterator[tuple[int, int]]:
    """Windows over ``n`` characters. A window that does not reach the end stops at its soft end, if that lies beyond
    the overlap with the next window; else at its full size. So every window starts after the one before."""
    at = 0
    while at < n:
        hard = at + size
        soft = soft_end(at, hard) if hard < n else 0
        stop = soft if soft > at + overlap else hard
        yield at, stop
        at = stop - overlap


def boundary_windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows that end at a sentence in their last fifth, else after the last space, else hard."""

    def soft_end(at: int, hard: int) -> int:
        ends = (text.rfind(mark, hard - int(size * 0.2), hard) + len(mark) for mark in SENTENCE_ENDS)
        found = [e for e, mark in zip(ends, SENTENCE_ENDS) if e >= len(mark)]
        return found[0] if found else text.rfind(" ", at + 1, hard) + 1

    pieces = (text[a:b].strip() for a, b in _spans(len(text), size, overlap, soft_end))
    return [p for p in pieces if p]


def section_pieces(content: str, size: int, overlap: int) -> list[str]:
    """Windows of a long section that end at their last full stop, else hard; none begins in the overlap with the end."""
    n, out = len(content), []
    for a, b in _spans(n, size, overlap, lambda at, hard: content.rfind(". ", at, hard) + 1):
        out.append(content[a:b].strip())
        if b >= n:
            break
    return out


def _filled(lengths: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of paragraphs that fill a chunk. A paragraph costs its length and a separator of two; the first
    chunk also pays for the separator after its last one. With an overlap every further chunk begins with the
    last paragraph of the one before; it takes at least one new paragraph."""
    cost = [0, *accumulate(n + 2 for n in lengths)]
    first, fresh, spare = 0, 0, 0
    while fresh < len(lengths):
        stop = max(fresh + 1, bisect_right(cost, cost[first] + size + spare) - 1)
        yield first, stop
        first, fresh, spare = (stop - 1 if overlap > 0 else stop), stop, 2


def paragraph_chunks(text: str, size: int, overlap: int, separator: str) -> list[str]:
    """Chunks of whole paragraphs; one that is too long is cut into windows on its own."""
    if len(text) <= size:
        return [text] if text else []
    parts = [p for p in map(str.strip, text.split(separator)) if p]
    chunks: list[str] = []
    for long, run in groupby(parts, key=lambda p: len(p) > size):
        run = list(run)
        if long:
            chunks += [w for p in run for w in boundary_windows(p, size, overlap)]
        else:
            chunks += [separator.join(run[a:b]) for a, b in _filled(list(map(len, run)), size, overlap)]
    return chunks


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")


def chunk_paragraphs(c: Column, size: int = 800, overlap: int = 100, separator: str = "\n\n") -> Column:
    """array<string> of paragraph chunks."""
    _check(size, overlap)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: paragraph_chunks(t, size, overlap, separator), na_action="ignore")

    return run(c)


def chunk_windows(c: Column, size: int = 800, overlap: int = 100, boundary: bool = True) -> Column:
    """array<string> of windows. The fixed-stride form stays in the JVM."""
    _check(size, overlap)
    if boundary:

        @F.pandas_udf("array<string>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: boundary_windows(t, size, overlap), na_action="ignore")

        return run(c)
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(size - overlap)))
    pieces = F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: strip(F.substring(c, i + 1, F.lit(size))))
    return F.filter(pieces, lambda p: p != "")


def chunk_corpus(df: DataFrame, chunks: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk with inherited metadata."""
    staged = bounded_batches(df).withColumn("_chunks", chunks).withColumn("total_chunks", F.size("_chunks"))
    keep = [c for c in df.columns if c != text]
    return exploded(staged, [*keep, "total_chunks"], F.col("_chunks"), "chunk_index", text).withColumn(
        "chunk_id",
        F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("unknown")), F.lit("_chunk_"), F.col("chunk_index")),
    )


def chunk_stats(chunks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    per_doc = chunks.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n"))
    return per_doc.agg(
        F.sum("n").alias("chunks"),
        F.count(F.lit(1)).alias("documents"),
        F.avg("n").alias("chunks_per_document"),
        F.max("n").alias("most_chunks"),
    )
