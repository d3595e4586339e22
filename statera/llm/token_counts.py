"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens, and only their encoded lengths are looked up: first in a broadcast table of frequent
ones, made from a bounded sample, then in a cache of the Python worker, which encodes what it has not met. No
pre-token reaches over white space and its length depends on nothing around it, so both tiers hold runs of
pre-tokens between white space ("word," is two), and the sum is the library's own count.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Lookup:
    """Bounds of the two tiers; they change the speed only.

    ``frequent``: pre-tokens in the broadcast table. ``sample`` and ``sample_bytes``: the texts it is made from, and the most
    bytes of such a text (64 MB in all). ``cache``: entries of a worker's cache before it is emptied.
    """

    frequent: int = 1 << 16
    sample: int = 1 << 12
    sample_bytes: int = 1 << 14
    cache: int = 1 << 19


# The normal form of a text of these characters is its lower case, and its white space is Python's. Other texts
# are normalised and cut by the library itself.
_SIMPLE = re.compile("[\t\n\r\x20-\x7e\xa0-įı-ȳ‐-‧‰-⁞]*")
# Fixed value: the pre-token pattern of the tokenizer file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Cutter:
    """Runs of pre-tokens of texts for one tokenizer file, and their encoded lengths."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Special strings are cut out of the raw text; one that lower case makes is ordinary text.
        self.tokenizer.encode_special_tokens = True
        with open(path) as f:
            spec = json.load(f)
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        steps = spec["pre_tokenizer"].get("pretokenizers", []) if spec.get("pre_tokenizer") else []
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        plain = bool(steps) and steps[0].get("pattern", {}).get("Regex") == SPLIT and kinds == ["NFC", "Replace", "Lowercase"]
        flags = [t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")]
        if not plain or any(flags):
            raise ValueError("this tokenizer file is cut in another way than the operator knows")

    def runs(self, text: str) -> tuple[list[str], int]:
        """Runs of pre-tokens of a text, and the special tokens in it."""
        if self.special is None or "<|" not in text:
            return self.plain(text), 0
        parts = self.special.split(text)
        return [p for x in parts for p in self.plain(x)], len(parts) - 1

    def plain(self, text: str) -> list[str]:
        if not _SIMPLE.fullmatch(text):
            text = self.tokenizer.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return text.lower().split()

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]


_CUTTERS: dict[str, Cutter] = {}
_CACHES: dict[str, dict[str, int]] = {}


def _cutter(path: str) -> Cutter:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _CUTTERS:
        _CUTTERS[path] = Cutter(path)
    return _CUTTERS[path]


def frequent_pieces(texts: DataFrame, path: str, bounds: Lookup = Lookup()) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens (at most ``bounds.frequent``) of a bounded sample: the ``bounds.sample`` texts
    with the smallest hash among those of at most ``bounds.sample_bytes``. The table decides where a length is looked up,
    never what it is, so no pre-token of the other texts is counted or sent anywhere."""
    short = texts.filter(F.octet_length("text").between(1, bounds.sample_bytes))
    some = short.orderBy(F.xxhash64("text"), "text").limit(bounds.sample).collect()
    cutter, seen = _cutter(path), Counter()
    for r in some:
        seen.update(cutter.runs(r["text"])[0])
    pieces = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: bounds.frequent]]
    return dict(zip(pieces, cutter.lengths(pieces)))


def text_counter(path: str, table: dict[str, int], limit: int) -> Callable[[str | None], int]:
    """The token count of a text, with the worker's cache behind the table of frequent pre-tokens."""
    cutter, cache = _cutter(path), _CACHES.setdefault(path, {})
    known = table.get

    def count(text: str | None) -> int:
        pieces, total = cutter.runs(text or "")
        lengths = list(map(known, pieces))
        if None in lengths:
            missed = [p for p, n in zip(pieces, lengths) if n is None]
            if new := [p for p in dict.fromkeys(missed) if p not in cache]:
                if len(cache) >= limit:
                    cache.clear()
                    new = list(dict.fromkeys(missed))
                cache.update(zip(new, cutter.lengths(new)))
            total += sum(map(cache.__getitem__, missed)) + sum(n for n in lengths if n is not None)
            return total
        return total + sum(lengths)

    return count


def token_counts(
    df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 2048,
    bounds: Lookup = Lookup(),
) -> DataFrame:
    """Id, UTF-8 bytes, tokens and whether the tokens exceed ``limit``, one row per input row.

    Equal to the library's encoding without begin, end or template tokens, truncation and padding; special
    strings inside a text count as their tokens. A null text counts as empty: 0 bytes, 0 tokens. Ids, null ones
    included, and repeated rows pass through. Other columns are not read. An empty table gives an empty result.
    """
    path = path or default_tokenizer()
    rows = df.select(col(id).alias("doc_id"), col(text).alias("text"))
    table = df.sparkSession.sparkContext.broadcast(frequent_pieces(rows.select("text"), path, bounds))
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = text_counter(path, table.value, bounds.cache)
        for b in batches:
            n_bytes, n_tokens = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                n_bytes.append(len(t.encode()))
                n_tokens.append(count(t))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
