"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by class and containment.

One automaton pass over a text finds which keywords it holds; only rules with all their keywords present are tried.
A detection that lies within another one of the same or a stronger class is suppressed; of equal intervals in one
class the earlier rule stays. Base phrases are counted by themselves and always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, parts_of
from .license_rules import LEVELS, WORTH, Rule, all_rules

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_WORTH = 0.5

_GAP = r"(?:[\x00-\x2f\x3a-\x60\x7b-\x7f]+)"
_CHAR = r"[0-9a-z\x80-\xff]"
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SLICE = 4 << 20


class Found(NamedTuple):
    start: int  # bytes of the UTF-8 text
    end: int
    rule: int


def compiled(pattern: str) -> re.Pattern:
    """A rule's pattern over the bytes of a text in lower case: blanks stand for gaps, ends are ends of words."""
    body = pattern.replace(" ", _GAP).replace(r"\w", _CHAR)
    return re.compile(f"(?<!{_CHAR})(?:{body})(?!{_CHAR})".encode())


def unsuppressed(found: list[Found], level: Sequence[int]) -> list[Found]:
    """Detections that lie in no other one of their own or a stronger class. One sort and one search per class."""
    kept: list[Found] = []
    starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of stronger classes: starts in order, largest end so far
    for one in sorted({level[f.rule] for f in found}):
        mine = sorted((f for f in found if level[f.rule] == one), key=lambda f: (f.start, -f.end, f.rule))
        reach = -1
        for f in mine:
            before = int(np.searchsorted(starts, f.start, "right"))
            if f.end > reach and not (before and ends[before - 1] >= f.end):
                kept.append(f)
            reach = max(reach, f.end)
        order = np.argsort(starts := np.append(starts, [f.start for f in mine]), kind="stable")
        starts, ends = starts[order], np.maximum.accumulate(np.append(ends, [f.end for f in mine])[order])
    return sorted(kept)


class Scanner:
    """All rules of a scan, compiled where they are used."""

    def __init__(self, rules: Sequence[Rule], base: Sequence[tuple[str, str]]):
        self.rules, self.base = tuple(rules), tuple(base)
        self.levels = [r.level for r in rules]

    def __reduce__(self):
        return Scanner, (self.rules, self.base)

    @cached_property
    def patterns(self) -> list[re.Pattern]:
        return [compiled(r.pattern) for r in self.rules]

    @cached_property
    def phrases(self) -> list[tuple[re.Pattern, frozenset]]:
        return [(compiled(p), frozenset(p.split())) for p, _ in self.base]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        words = {w for r in self.rules for w in r.needs} | {w for p, _ in self.base for w in p.split()}
        found = ahocorasick.Automaton()
        for w in words:
            found.add_word(w, w)
        found.make_automaton()
        return found

    @cached_property
    def by_word(self) -> dict[str, list[int]]:
        """Rules by the keyword under which they are looked up: the longest one, as it is the rarest by guess."""
        out: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            out.setdefault(max(r.needs, key=len), []).append(i)
        return out

    def scan(self, text: str, prefilter: bool = True) -> tuple[int, list[tuple[str, int]], list[Found]]:
        """Number of words, (label, word) of all base places, and the detections that stay."""
        data = text.encode().lower()  # bytes: only A-Z change
        held = {w for _, w in self.automaton.iter(data.decode("latin-1"))}
        base = [
            (m.start(), label) for (pattern, needs), (_, label) in zip(self.phrases, self.base) if needs <= held
            for m in pattern.finditer(data)
        ]
        n_words, at = word_starts(data, bool(base))
        places = [(label, int(np.searchsorted(at, start))) for start, label in sorted(base)]
        tried = [i for w in held for i in self.by_word.get(w, ()) if held.issuperset(self.rules[i].needs)] if prefilter else range(len(self.rules))
        found = [Found(*m.span(), i) for i in tried for m in self.patterns[i].finditer(data)]
        return n_words, places, unsuppressed(found, self.levels)


def word_starts(data: bytes, where: bool) -> tuple[int, np.ndarray]:
    """Number of words of a text in lower case and, if asked for, their first bytes; in slices of bounded memory."""
    raw = np.frombuffer(data, np.uint8)
    n, at, last = 0, [], False
    for a in range(0, len(raw), _SLICE):
        word = _IS_WORD[raw[a : a + _SLICE]]
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[0] &= not last
        last = bool(word[-1])
        n += int(np.count_nonzero(first))
        if where:
            at.append(np.flatnonzero(first) + a)
    return n, np.concatenate(at) if at else np.zeros(0, np.int64)


_PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])
_DETECTION = pa.struct([("label", pa.string()), ("class", pa.string()), ("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("worth", pa.float64())])


def license_scan(
    df: DataFrame, id: str = "doc_id", text: str = "text", rules: Sequence[Rule] | None = None,
    base: Sequence[tuple[str, str]] = BASE,
) -> DataFrame:
    """One row per input row: id, n_words, base (label and word of every base phrase, in order) and detections (label,
    class, number of the rule, first byte and end of the UTF-8 text, worth), in order of their place.

    No shuffle: a text is judged by itself. A null or empty text has no words, places and detections. A very long
    text is worked on whole; memory is a few times its bytes. Null ids stay null, repeated rows give repeated
    results, ties between rules end as the module says. Other columns are not read, whatever their names. An empty
    table gives an empty result.
    """
    scanner = Scanner(all_rules() if rules is None else rules, base)
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts_of(b.column(1)):
                n_words, places, found = zip(*(scanner.scan(t) for _, t in part))
                hits = [
                    [{"label": (r := scanner.rules[f.rule]).label, "class": LEVELS[r.level], "rule": f.rule, "start": f.start, "end": f.end, "worth": WORTH[r.level]} for f in fs]
                    for fs in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(part[0][0], len(part)), pa.array(n_words, pa.int64()),
                        pa.array([[{"label": p, "word": w} for p, w in ps] for ps in places], pa.list_(_PLACE)), pa.array(hits, pa.list_(_DETECTION)),
                    ],
                    names=["doc_id", "n_words", "base", "detections"],
                )

    out = (
        f"doc_id {kind}, n_words long, base array<struct<label:string,word:long>>, "
        "detections array<struct<label:string,`class`:string,rule:int,start:long,`end`:long,worth:double>>"
    )
    return df.select(col(id).alias("doc_id"), col(text).alias("text")).mapInArrow(run, out)


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts, labels and score of every scanned text. The score is the chance that at least one label holds, if
    each counts with the worth of its best detection (a base phrase with ``BASE_WORTH``)."""
    base = F.transform("base", lambda p: p["label"])
    words = F.transform("base", lambda p: p["word"])
    all_of = F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"])))
    best = F.transform(
        all_of,
        lambda name: F.greatest(
            F.coalesce(F.array_max(F.transform(F.filter("detections", lambda d: d["label"] == name), lambda d: d["worth"])), F.lit(0.0)),
            F.when(F.array_contains(base, name), F.lit(BASE_WORTH)).otherwise(F.lit(0.0)),
        ),
    )
    miss = F.aggregate(best, F.lit(1.0), lambda left, worth: left * (1 - worth))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"), joined(base).alias("base_labels"), joined(all_of).alias("labels"),
        (1 - miss).alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )
