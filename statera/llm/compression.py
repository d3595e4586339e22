"""Quality rules: zstandard ratios of whole documents and of fixed chunks against length-specific bands."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import col

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits of the rules. ``limits``: from this many bytes on, the lowest and highest ratio of a plain text.

    Short texts hardly compress and long ones always do, so both ends rise with the length; the last
    row that a length reaches holds. A document goes if its whole ratio leaves its band, or if chunks that
    leave theirs hold more than ``chunk_share`` of its bytes.
    """

    level: int = 3
    chunk: int = 4096
    chunk_share: float = 0.25
    limits: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 2.5),
        (128, 0.8, 3.0),
        (512, 1.15, 3.0),
        (2048, 1.45, 3.2),
        (8192, 1.6, 3.5),
        (65536, 1.7, 4.0),
    )
    min_words: int = 20
    window: int = 8
    repeat_percent: int = 30

    def holds(self, size: int, ratio: float) -> bool:
        low, high = next((lo, hi) for least, lo, hi in reversed(self.limits) if size >= least)
        return low <= ratio <= high


def repeated_words(words: list, window: int) -> int:
    """Words inside windows that occur twice or more in the text, first occurrences included.

    Windows are named exactly by doubling: the name of 2k words is the pair of names of its halves.
    """
    n = len(words)
    if n <= window:
        return 0
    ids: defaultdict = defaultdict(count().__next__)
    names = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    span = 1
    while span < window:
        step = min(span, window - span)
        pairs = names[:-step] * (int(names.max()) + 1) + names[step:]
        uniq, names = np.unique(pairs, return_inverse=True)
        if len(uniq) == len(names):
            return 0
        span += step
    twice = np.flatnonzero(np.bincount(names)[names] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def chunks_of(data: bytes, size: int) -> list[bytes]:
    """Fixed chunks; a rest of less than half a chunk stays with the last one."""
    cuts = list(range(0, len(data), size)) or [0]
    if len(cuts) > 1 and len(data) - cuts[-1] < size // 2:
        cuts.pop()
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]


def measure(text: str | None, rules: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """All columns of ``FIELDS`` after the id, for one text."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes split at exactly 09-0D and 20
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    n_repeat = repeated_words(words, rules.window)
    failed = len(words) < rules.min_words or 100 * n_repeat > rules.repeat_percent * len(words)
    ratio = len(data) / len(packer.compress(data)) if data else None
    low = high = ratio
    outside = 0
    if len(data) > rules.chunk:
        rates = []
        for part in chunks_of(data, rules.chunk):
            rates.append(len(part) / len(packer.compress(part)))
            outside += 0 if rules.holds(len(part), rates[-1]) else len(part)
        low, high = min(rates), max(rates)
    share = outside / len(data) if data else 0.0
    inside = bool(data) and rules.holds(len(data), ratio) and share <= rules.chunk_share
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        n_repeat, ratio, low, high, share, failed, not failed and inside,
    )


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, "
    "chunk_low double, chunk_high double, outside_share double, base_failed boolean, kept boolean"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [(n, pa.float64()) for n in ("ratio", "chunk_low", "chunk_high", "outside_share")]
    + [(n, pa.bool_()) for n in ("base_failed", "kept")]
)


def compression_bands(df: DataFrame, id: str = "doc_id", text: str = "text", rules: Bands = Bands()) -> DataFrame:
    """One row per input row: the id, the base counts and ratios, and whether the text is kept.

    No shuffle: a row is judged by itself. A null or empty text has no words and ratios, fails the base rule
    and is not kept. A null id stays null. Repeated rows give repeated results. Other columns of the input are
    not read, whatever their names. An empty table gives an empty result.
    """
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=rules.level)
        for b in batches:
            found = [measure(t.as_py(), rules, packer) for t in b.column(1)]
            values = list(zip(*found)) or [()] * len(_ARROW)
            arrays = [pa.array(v, f.type) for v, f in zip(values, _ARROW)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", *_ARROW.names])

    return df.select(col(id).alias("doc_id"), col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {FIELDS}")
