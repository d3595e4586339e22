"""Benchmark decontamination: windows of training words against a broadcast set of benchmark windows.

Each document is read once. Inside the row every window of its words is reduced to a hash of three of its
words and tested against a bit table of the benchmark's windows; the few that pass carry their whole text to a
broadcast join, which verifies them. Only verified hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, col, is_small, join_stored, lower_ascii, stored

WINDOW = 10
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the first test for each benchmark window.
BITS_PER_WINDOW = 64


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(col(text)), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _mark(words: Column, at: Column, width: int) -> Column:
    """Hash of the first, middle and last word of the window that begins at ``at`` (from 1)."""
    return F.xxhash64(
        F.lit(width), F.get(words, at - 1), F.get(words, at - 1 + width // 2), F.get(words, at - 2 + width)
    )


def _text(words: Column, at: Column, width: int) -> Column:
    return F.array_join(F.slice(words, at, width), " ")


def _starts(words: Column, width: int) -> Column:
    n = F.size(words)
    return F.when(n >= width, F.sequence(F.lit(1), n - (width - 1))).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """Distinct (item_id, width, window, mark): all windows of an item, or the whole of a shorter one."""
    items = benchmark.select(col(id).cast("string").alias("item_id"), words_of(text).alias("words")).filter(F.size("words") > 0)
    parts = []
    for width in range(1, window + 1):
        some = items.filter(F.size("words") >= width if width == window else F.size("words") == width)
        at = some.select("item_id", "words", F.explode(_starts(F.col("words"), width)).alias("at"))
        parts.append(
            at.select(
                "item_id", F.lit(width).alias("width"), _text(F.col("words"), F.col("at"), width).alias("window"),
                _mark(F.col("words"), F.col("at"), width).alias("mark"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def _bit_table(windows: DataFrame, n: int) -> tuple[list[int], int]:
    """Words of 64 bits with the bits of all marks set; the bits that address a word. Its size follows the
    number of windows, which is checked before."""
    power = max(4, (max(1, n) * BITS_PER_WINDOW // 64 - 1).bit_length())
    word = F.shiftrightunsigned("mark", 64 - power).cast("int")
    bit = F.expr("shiftleft(1L, cast(mark & 63 as int))")
    table = [0] * (1 << power)
    for r in windows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        table[r["word"]] = r["bits"]
    return table, power


def _may_hit(mark: Column, table: Column, power: int) -> Column:
    bits = F.get(table, F.shiftrightunsigned(mark, 64 - power).cast("int"))
    return F.call_function("getbit", bits, mark.bitwiseAND(F.lit(63)).cast("int")) == 1


def _candidates(words: Column, width: int, table: Column | None, power: int) -> Column:
    starts = _starts(words, width)
    if table is not None:
        starts = F.filter(starts, lambda at: _may_hit(_mark(words, at, width), table, power))
    return F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(width).alias("width"), _text(words, at, width).alias("window")))


def benchmark_hits(
    df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Verified hits: (doc_id, hash, at, width, item_id), the window's first word from 1 and its words."""
    windows = stored(item_windows(benchmark, item_id, item_text, window))
    widths = [r["width"] for r in windows.select("width").distinct().collect()]  # at most ``window`` values
    few = is_small(windows)
    table, power = None, 0
    if few:
        bits, power = _bit_table(windows, BROADCAST_ROWS if windows.limit(4097).count() > 4096 else 4096)
        table = F.from_json(F.lit(str(bits)), "array<bigint>")
    words = F.col("words")
    found = F.array().cast("array<struct<at:int,width:int,window:string>>")
    for width in sorted(widths):
        found = F.concat(found, _candidates(words, width, table, power))
    docs = df.select(col(id).alias("doc_id"), row_hash(id, text), words_of(text).alias("words"))
    # An outer explode keeps Spark from copying the word split into the filters below it.
    rows = docs.select("doc_id", "hash", F.explode_outer(found).alias("hit")).filter(F.col("hit").isNotNull())
    rows = rows.select("doc_id", "hash", "hit.at", "hit.width", "hit.window")
    known = windows.drop("mark")
    return rows.join(F.broadcast(known) if few else known, ["width", "window"]).select("doc_id", "hash", "at", "width", "item_id")


def row_hash(id: str, text: str) -> Column:
    """Names a row together with its id: two texts under one id stay apart."""
    return F.xxhash64(col(id), F.coalesce(col(text), F.lit(""))).alias("hash")


def _summaries(hits: DataFrame) -> DataFrame:
    """Per row with hits: the words hit, and the items with occurring windows."""
    spots = F.flatten(F.transform(F.collect_set(F.struct("at", "width")), lambda s: F.sequence(s["at"], s["at"] + s["width"] - 1)))
    return hits.groupBy("doc_id", "hash").agg(
        F.array_sort(F.array_distinct(spots)).alias("spots"), F.array_sort(F.collect_set("item_id")).alias("items")
    )


def contamination(
    df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit (words inside an occurrence of a benchmark window), n_items,
    items_sha256 (of the sorted, comma-joined item ids) and contaminated.

    Null and empty texts have no words and no hits; items without words have no windows; an item of fewer
    words than a window is one window. Null ids and repeated rows pass through, each with its own figures.
    Other columns are not read. Without benchmark windows nothing is hit; an empty table gives an empty result.
    """
    hits = benchmark_hits(df, benchmark, id, text, item_id, item_text, window)
    sums = stored(_summaries(hits).select("doc_id", "hash", F.size("spots").alias("n_hit"), "items"))
    n_words = F.coalesce(F.regexp_count(col(text), F.lit(WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))), F.lit(0))
    rows = df.select(col(id).alias("doc_id"), row_hash(id, text), n_words.cast("long").alias("n_words"))
    out = join_stored(rows, sums, ["doc_id", "hash"])
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(
    df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, spans: bool = False,
) -> DataFrame:
    """The input without contaminated documents, or with ``spans`` without the words hit (the text between
    stays). Rows and columns of the input otherwise stay as they are; ``contamination`` says how odd rows count.
    """
    sums = stored(_summaries(benchmark_hits(df, benchmark, id, text, item_id, item_text, window)).drop("items"))
    keys = df.select(F.struct(*(col(c) for c in df.columns)).alias("_row"), col(id).alias("doc_id"), row_hash(id, text))
    if not spans:
        return join_stored(keys, sums.select("doc_id", "hash"), ["doc_id", "hash"], "left_anti").select("_row.*")
    rows = join_stored(keys, sums, ["doc_id", "hash"])
    body = F.col("_row").getField(text)
    both = WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    gaps, words = F.split(body, both, -1), F.regexp_extract_all(body, F.lit(both), F.lit(0))
    spots = F.col("spots")
    left = F.transform(words, lambda w, i: F.when(F.array_contains(spots, i + 1), F.lit("")).otherwise(w))
    woven = F.zip_with(gaps, left, lambda g, w: F.concat(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit(""))))
    new = F.when(spots.isNull(), body).otherwise(F.array_join(woven, ""))
    return rows.select(*(new.alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in df.columns))
