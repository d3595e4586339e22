"""Scans over arrays within a row, in column expressions.

A fold that appends to an array copies it at every step, which is quadratic. Here an array of n elements is cut into
pieces of sqrt(n): each piece is scanned by such a fold, and so are the ends of the pieces, so that n sqrt(n) references are
copied in all; for a million elements that is a thousandth of the plain fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive scan by an associative combination (of the earlier and the later value)."""

    def folded(v: Column) -> Column:
        def step(done: Column, x: Column) -> Column:
            return F.array_append(done, F.when(F.size(done) == 0, x).otherwise(combine(F.get(done, F.size(done) - 1), x)))

        return F.aggregate(v, F.slice(v, 1, 0), step)

    def joined(pieces: Column) -> Column:
        ends = F.transform(pieces, lambda p: F.get(p, F.size(p) - 1))

        def carried(before: Column) -> Column:
            return F.flatten(
                F.transform(pieces, lambda p, j: F.when(j == 0, p).otherwise(F.transform(p, lambda x: combine(F.get(before, j - 1), x))))
            )

        return let(folded(ends), carried)

    def cut(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int"))
        pieces = F.transform(starts, lambda j: folded(F.slice(v, j * size + 1, size)))
        return F.when(F.size(v) < 2, v).otherwise(let(pieces, joined))

    return let(values, cut)


def running_sums(values: Column) -> Column:
    return scanned(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return scanned(values, lambda a, b: F.greatest(a, b))


def matches(c: Column, pattern: str) -> Column:
    """array<struct<start,stop,text>> of all matches of a pattern that never matches nothing, with their places in
    the text (from 0). The text between matches gives the places, so the pattern is run twice and no text leaves the JVM."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        before = F.transform(F.slice(F.split(c, pattern, -1), F.lit(1), F.size(m)), F.length)
        both = F.zip_with(before, m, lambda b, t: b + F.length(t))
        return F.zip_with(
            running_sums(both), m, lambda stop, t: F.struct((stop - F.length(t)).alias("start"), stop.alias("stop"), t.alias("text"))
        )

    return F.when(F.size(found) > 0, let(found, placed)).otherwise(F.when(c.isNotNull(), F.array().cast("array<struct<start:int,stop:int,text:string>>")))
