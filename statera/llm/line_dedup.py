"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z in lower case). Words are ordered by rarity in the corpus. Two sets with a
Jaccard similarity of at least ``percent`` share a word in their prefixes (the rarest fifth and one more), have sizes
within the length filter, and their first common word is among the leading ones of the smaller. Pairs that pass, and
whose parity maps allow it, are verified on their arrays. A line goes if an earlier line (by document id, then line)
matches it.

1. The entries of all but very frequent words go, as arrays, to buckets of words. Sets that share a word there are
   compared by length and by parity maps; the most alike earlier partner of a set is verified first, the others only
   if it fails.
2. Of frequent words, and of those whose sets are all alike, the entries are passed on as they are (the texts are not
   read again for them), and every set is paired with the earliest set that passes the filters; where that is verified
   the line goes, whatever else it matches.
3. Only sets that are still there and had more than one such partner are paired with all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import bounded_batches
from .common import blocks_of, col, is_small, join_stored, parts_of, stored, stored_parquet
from .ngram_join import _ODD, IDS, _mixed
from .partials import added, packed

LOOK = 1 << 21
#: Text whose words a task holds as numbers at a time: what they take stays in the processor's cache.
TEXT_BYTES = 1 << 19
#: Entries that a task gathers before it deals them to buckets.
GATHERED = 1 << 19
#: Pairs for each set of a word from which on the word is dense.
DENSE = 8
#: Times the mean count of the table of word counts above which a word is kept out of the buckets (if above a tile, too).
FREQUENT = 8
#: Bits of the hash, the place of its count first, that order the words of a line; the line's number stands before them.
ORDER_BITS = 42


@dataclass(frozen=True)
class Similar:
    """``percent``: least Jaccard similarity. ``rarity_bits``: size of the table of word counts (fixed, whatever the
    corpus). ``tile``: sets that meet in one piece; words of more sets are cut by length and into blocks."""

    percent: int = 80
    rarity_bits: int = 18
    tile: int = 4096


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Lines:
    """Lines with a word of some texts: text, place in the text, and the distinct hashes of the words from ``start`` on,
    in the order of ``seen`` (in how many lines a word occurs, by the given table; else all 0) and hash."""

    text: np.ndarray
    place: np.ndarray
    start: np.ndarray
    size: np.ndarray
    words: np.ndarray
    seen: np.ndarray
    names: np.ndarray  # a 64-bit name for each set of words


def _word_hashes(raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the words of a buffer (with 8 bytes to spare) that mix in 8 bytes at a time; words of more than 64 bytes
    are hashed one by one."""
    eight = np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,))
    out = _mixed((eight[begin] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64))
    for k in range(8, 64, 8):
        at = np.flatnonzero(length > k)
        if not len(at):
            break
        out[at] = _mixed(out[at] * _ODD[0] + (eight[begin[at] + k] & _MASK[np.minimum(length[at] - k, 8)]))
    for i in np.flatnonzero(length > 64):
        out[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : begin[i] + length[i]].tobytes())
    return out


def order_of(often: np.ndarray) -> np.ndarray:
    """Rank of each place of a table of word counts, the rarest first."""
    rank = np.empty(len(often), np.uint64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often), dtype=np.uint64)
    return rank


def lines_of(texts: list[str], often: np.ndarray | None = None, order: np.ndarray | None = None) -> Lines:
    """All lines of the texts at once. ``order``: ``order_of`` the counts, where they are used more than once."""
    raw = np.frombuffer("\n".join(texts).encode().lower() + b"\n" + bytes(8), np.uint8)
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    space[-8:] = True
    edge = np.flatnonzero(np.diff(space, prepend=True))
    begin, length = edge[::2], edge[1::2] - edge[::2]
    hashes = _word_hashes(raw, begin, length)
    per_line = np.diff(np.searchsorted(begin, np.flatnonzero(raw == 10)), prepend=0)
    line = np.repeat(np.arange(len(per_line)), per_line)
    first = hashes
    if often is not None:
        order = order_of(often) if order is None else order
        bits = len(often).bit_length() - 1
        first = (order[_bin(hashes, often)] << np.uint64(64 - bits)) | ((hashes << np.uint64(bits)) >> np.uint64(bits))
    key = (line.astype(np.uint64) << np.uint64(ORDER_BITS)) | (first >> np.uint64(64 - ORDER_BITS))
    rank = np.argsort(key, kind="stable")  # faster than the default, as the lines are in order
    key, by = key[rank], hashes[rank]
    same = key[1:] == key[:-1]
    if (same & (by[1:] != by[:-1])).any() or len(per_line) >> (64 - ORDER_BITS):  # the bits of the key do not tell all words apart
        rank = np.lexsort((first, line))
        by = hashes[rank]
        same = (by[1:] == by[:-1]) & (line[rank][1:] == line[rank][:-1])
    new = np.append(True, ~same)[: len(by)]
    line, by = line[rank][new], by[new]
    start = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(line)))
    first_line = np.cumsum([0, *(t.count("\n") + 1 for t in texts)])
    text = np.searchsorted(first_line, line[start], "right") - 1
    sums = np.add.reduceat(by, start) if len(start) else np.zeros(0, np.uint64)
    names = _mixed(sums + size.astype(np.uint64)).view(np.int64)
    seen = np.zeros(len(by), np.int32) if often is None else often[_bin(by, often)]
    return Lines(text, line[start] - first_line[text], start, size, by, seen, names)


def _bin(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of words in a table of counts: the first bits of their hash."""
    return (hashes >> np.uint64(65 - len(table).bit_length())).astype(np.int64)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def _bytes(sizes: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def chosen(lines: Lines, keep: np.ndarray) -> Lines:
    """Some of the lines."""
    words = np.repeat(keep, lines.size)
    size = lines.size[keep]
    return Lines(lines.text[keep], lines.place[keep], np.cumsum(size) - size, size, lines.words[words], lines.seen[words], lines.names[keep])


def _rows(df: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(col(text), F.lit(""))
    return bounded_batches(df).select(col(id).alias("doc_id"), F.xxhash64(col(id), body).alias("row"), body.alias("text"))


def read_lines(rows: DataFrame, rule: Similar) -> tuple[DataFrame, np.ndarray]:
    """Per row the places and set names of its lines; and in how many lines words occur, by the first bits of their
    hash, over all documents. One pass over the texts."""
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", "row", "lines", "sums"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, schema = np.zeros(1 << rule.rarity_bits, np.int64), None
        for b in batches:
            bins = [np.zeros(0, np.int64)]
            for part in parts_of(b.column(2), TEXT_BYTES):
                lines = lines_of([t for _, t in part])
                bins.append(_bin(lines.words, seen))
                counts = np.bincount(lines.text, minlength=len(part))
                found = pa.StructArray.from_arrays([pa.array(lines.place.astype(np.int32)), pa.array(lines.names)], names=["line", "set"])
                at = pa.array([i for i, _ in part])
                out = pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), _lists(counts, found), pa.nulls(len(part), pa.binary())], names=names)
                schema = out.schema
                yield out
            seen += np.bincount(np.concatenate(bins), minlength=len(seen))
        if schema:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in schema)][:3] + packed(seen).columns, names=names)

    found = stored_parquet(rows.mapInArrow(read, f"doc_id {kind}, row long, lines array<struct<line:int,set:long>>, sums binary"))
    sums = added(found.filter("sums is not null").select("sums"), 1 << rule.rarity_bits)
    return found.filter("sums is null").drop("sums"), np.minimum(sums, np.iinfo(np.int32).max).astype(np.int32)


def prefix(lines: Lines, rule: Similar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line, place among the line's words, and place in ``words`` of the words of each prefix that occur in other lines
    too, and whether the word is among the first by which a set finds those as large or larger: of a pair the smaller
    set has all but 1 - 2 p / (100 + p) of its words in common."""
    n = lines.size
    line = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(line)) - np.repeat(lines.start, n)
    some = np.flatnonzero((pos < np.repeat(n - -(-rule.percent * n // 100) + 1, n)) & (lines.seen > 1))
    line, pos = line[some], pos[some]
    lead = pos < n[line] - -(-2 * rule.percent * n[line] // (100 + rule.percent)) + 1
    return line, pos, some, lead


def placed(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a word, and 32 bits that tell it from the others there (words that share them only give more pairs to
    look at)."""
    return ((words >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32), words.astype(np.uint32)


def whole_word(bucket: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Bucket and bits of a word as one number."""
    return (bucket.astype(np.int64) << 32) | short.astype(np.int64)


def widths(n: np.ndarray) -> np.ndarray:
    """64-bit numbers in the parity map of a set: at least a bit for a word up to 512."""
    return np.where(n <= 64, 1, np.where(n <= 128, 2, np.where(n <= 256, 4, 8)))


def parities(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Maps of all lines one behind the other, and where each begins. A bit tells whether the number of words at it
    is odd, so two maps differ in no more bits than their sets in words."""
    wide = widths(lines.size)
    base = np.cumsum(wide) - wide
    bit = (lines.words & np.repeat(64 * wide - 1, lines.size).astype(np.uint64)).astype(np.int64)
    ones = np.bincount(64 * np.repeat(base, lines.size) + bit, minlength=64 * int(wide.sum())) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view(np.uint64), base


def ragged(values: np.ndarray, base: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The runs of ``wide`` values from each ``base`` on, one behind the other."""
    return values[np.arange(int(wide.sum())) + np.repeat(base - (np.cumsum(wide) - wide), wide)]


def word_chunks(rows: DataFrame, often: np.ndarray, rule: Similar, buckets: int) -> DataFrame:
    """Prefix entries of all lines, as arrays: a row holds those of one bucket of words that a task gathered (about
    ``GATHERED``): words, names of the sets, sizes with the lead bit, parity maps. Entries of very frequent words need
    not meet: they are dealt to places below 0, with their whole words."""
    table = rows.sparkSession.sparkContext.broadcast(often)
    limit = max(rule.tile, FREQUENT * int(often.mean()))

    def chunks(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        name, n, maps = (np.concatenate(c) for c in list(zip(*held))[:3])
        before = np.cumsum([0, *(len(h[0]) for h in held)])
        line = np.concatenate([h[3] + k for h, k in zip(held, before)])
        bucket, short, lead, often = (np.concatenate(c) for c in list(zip(*held))[4:])
        fresh = np.zeros(len(name), bool)
        fresh[np.unique(name, return_index=True)[1]] = True
        wide, word = widths(n), whole_word(bucket, short)
        base = np.cumsum(wide) - wide
        for kind in (False, True):
            order = np.flatnonzero(fresh[line] & (often == kind))
            if not len(order):
                continue
            order = order[np.argsort(word[order])]
            of, own = line[order], bucket[order]
            first = np.zeros(1, np.int64) if kind else np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            rows, numbers = np.diff(np.append(first, len(order))), np.add.reduceat(wide[of], first)
            size = (2 * n[of] + lead[order]).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1 - int(name[0]) % buckets], pa.int32()) if kind else pa.array(own[first]),
                    _bytes(8 * rows, word[order].tobytes()) if kind else _bytes(4 * rows, short[order].tobytes()),
                    _bytes(8 * rows, name[of].tobytes()), _bytes(4 * rows, size.tobytes()), _bytes(8 * numbers, ragged(maps, base[of], wide[of]).tobytes()),
                ],
                names=["bucket", "words", "sets", "sizes", "maps"],
            )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, held, size = order_of(table.value), [], 0
        for b in batches:
            for part in parts_of(b.column(0), TEXT_BYTES):
                lines = lines_of([t for _, t in part], table.value, order)
                lines = chosen(lines, lines.size > 3)
                line, _, at, lead = prefix(lines, rule)
                held.append((lines.names, lines.size, parities(lines)[0], line, *placed(lines.words[at], buckets), lead, lines.seen[at] > limit))
                size += len(line) + len(lines.size)
                if size >= GATHERED:
                    yield from chunks(held)
                    held, size = [], 0
        if held:
            yield from chunks(held)

    return rows.select("text").mapInArrow(deal, "bucket int, words binary, sets binary, sizes binary, maps binary")


class Maps:
    """Parity maps folded to 1, 2, 4 and 8 numbers, of the sets that have as many."""

    def __init__(self, maps: np.ndarray, base: np.ndarray, wide: np.ndarray):
        self.wide, self.fold, self.place = wide, {}, {}
        for w in (1, 2, 4, 8):
            who = np.flatnonzero(wide >= w)
            self.place[w] = np.cumsum(wide >= w) - 1
            self.fold[w] = np.zeros((len(who), w), np.uint64)
            for v in (1, 2, 4, 8):
                of = np.flatnonzero(wide[who] == v)
                if len(of):
                    m = maps[base[who[of]][:, None] + np.arange(v)]
                    self.fold[w][of] = np.bitwise_xor.reduce(m.reshape(len(of), v // w, w), axis=1)

    def near(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs' maps differ in at most so many bits, and in how many these differ."""
        some, differ = np.arange(len(x)), np.zeros(len(x), np.int64)
        for w in (1, 2, 4, 8):
            at = np.flatnonzero(np.minimum(self.wide[x[some]], self.wide[y[some]]) >= w) if w > 1 else np.arange(len(some))
            if not len(at):
                break
            differ[at] = np.bitwise_count(self.fold[w][self.place[w][x[some[at]]]] ^ self.fold[w][self.place[w][y[some[at]]]]).sum(1)
            ok = differ <= most[some]
            some, differ = some[ok], differ[ok]
        return some, differ


def bucket_pairs(short: np.ndarray, name: np.ndarray, size: np.ndarray, maps: np.ndarray, rule: Similar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets that share a word of a bucket and pass the length and parity filters, each with the share of bits
    that differ; and the words with many sets or many pairs for their sets, whose pairs are left out."""
    n = (size >> 1).astype(np.int64)
    wide = widths(n)
    base = np.cumsum(wide) - wide
    order = np.lexsort((name, (short.astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)))
    short, name, n, lead, wide, base = short[order], name[order], n[order], (size & 1)[order] > 0, wide[order], base[order]
    fresh = np.append(True, (short[1:] != short[:-1]) | (name[1:] != name[:-1]))
    short, name, n, lead, wide, base = (v[fresh] for v in (short, name, n, lead, wide, base))
    key = (short.astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
    alike = Maps(maps, base, wide)
    group = np.cumsum(np.append(0, short[1:] != short[:-1]))
    many = np.bincount(group) > rule.tile
    low = np.searchsorted(key, (short.astype(np.uint64) << np.uint64(32)) | (-(-rule.percent * n // 100)).astype(np.uint64))
    leads, before = np.flatnonzero(lead), np.append(0, np.cumsum(lead))
    least = before[low]
    looks = np.where(many[group], 0, before[:-1] - least)
    cuts = np.append(0, np.cumsum(looks))
    found: list[tuple] = []
    s, total = 0, len(n)
    while s < total:
        e = max(s + 1, int(np.searchsorted(cuts, cuts[s] + LOOK, "right")) - 1)
        k = looks[s:e]
        x = np.repeat(np.arange(s, e), k)
        y = leads[np.arange(len(x)) - np.repeat(np.cumsum(k) - k - least[s:e], k)]
        most = (100 - rule.percent) * (n[x] + n[y]) // (100 + rule.percent)
        some, differ = alike.near(x, y, most)
        x, y = x[some], y[some]
        found.append((x, y, differ / (n[x] + n[y])))
        s = e
    x, y, far = (np.concatenate(c) for c in zip(*found))
    dense = many | (np.bincount(group[x], minlength=group[-1] + 1) > DENSE * np.bincount(group))
    usual = ~dense[group[x]]
    a, b, far = np.minimum(name[x], name[y])[usual], np.maximum(name[x], name[y])[usual], far[usual]
    order = np.lexsort((b, a))
    order = order[np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))] if len(order) else order
    return np.stack([a[order], b[order]]), far[order], short[np.flatnonzero(np.append(True, short[1:] != short[:-1]))[dense]]


def shared_words(chunks: DataFrame, rule: Similar) -> DataFrame:
    """Pairs (a, b, far) over all buckets, and as rows of their own the entries of dense and very frequent words: the word,
    set, size with the lead bit, and map."""
    kinds = {"sets": np.int64, "sizes": np.uint32, "maps": np.uint64}
    types = {"a": pa.int64(), "b": pa.int64(), "far": pa.float32(), "dense": pa.int64(), "set": pa.int64(), "size": pa.int32(), "map": pa.binary()}

    def batch(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in types.items()], names=list(types))

    def passed(word: np.ndarray, name: np.ndarray, size: np.ndarray, maps: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        wide = widths(size >> 1)
        base = np.cumsum(wide) - wide
        some = some[np.lexsort((name[some], word[some]))]
        some = some[np.append(True, (word[some][1:] != word[some][:-1]) | (name[some][1:] != name[some][:-1]))]
        return batch(
            dense=pa.array(word[some]), set=pa.array(name[some]), size=pa.array(size[some].astype(np.int32)), map=_bytes(8 * wide[some], ragged(maps, base[some], wide[some]).tobytes()),
        )

    def compared(bucket: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(b"".join(h["words"] for h in held), np.int64 if bucket < 0 else np.uint32)
        own = [np.frombuffer(b"".join(h[c] for h in held), t) for c, t in kinds.items()]
        if bucket < 0:
            yield passed(words, *own, np.arange(len(words)))
            return
        pairs, far, dense = bucket_pairs(words, *own, rule)
        yield batch(a=pa.array(pairs[0]), b=pa.array(pairs[1]), far=pa.array(far.astype(np.float32)))
        if len(dense):
            at = np.minimum(np.searchsorted(dense, words), len(dense) - 1)
            yield passed(whole_word(np.full(len(words), bucket), words), *own, np.flatnonzero(dense[at] == words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = 0, []
        for b in batches:
            for r in b.to_pylist():
                if held and (r["bucket"] != now or now < 0):
                    yield from compared(now, held)
                    held = []
                now = r["bucket"]
                held.append(r)
        if held:
            yield from compared(now, held)

    return chunks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, far float, dense long, set long, size int, map binary")


def entries(sets: DataFrame, rule: Similar, words: DataFrame | None = None) -> DataFrame:
    """Entries (word, set, at, size, map) dealt to cells. A word of up to a tile of sets is one cell. Others are cut by
    length bands, and a band of many sets into pairs of blocks, so that a cell has at most about two tiles of sets."""
    rows = sets if words is None else join_stored(sets, words, ["word"], "left_semi")
    frequent = stored(sets.groupBy("word").count().filter(F.col("count") > rule.tile).select("word"))
    few = is_small(frequent)
    cells = join_stored(rows, frequent, ["word"], "left_anti", few)
    cells = cells.select("word", F.lit(-1).alias("band"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "at", "set", "size", "map")
    band = F.floor(F.log(F.shiftright("size", 1).cast("double")) / float(np.log(100 / rule.percent)) + 1e-9).cast("int")
    hot = join_stored(rows, frequent, ["word"], "left_semi", few).withColumn("band", F.explode(F.array(band, band + 1)))
    sizes = stored(hot.groupBy("word", "band").agg(F.ceil(F.count("*") / rule.tile).cast("int").alias("blocks")))
    many = join_stored(hot, sizes, ["word", "band"], "inner").withColumn("block", F.pmod(F.xxhash64("set", F.lit(5)), "blocks").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda q: F.struct(F.least("block", q).alias("i"), F.greatest("block", q).alias("j")))
    many = many.withColumn("c", F.explode(others)).select("word", "band", "c.i", "c.j", "block", "at", "set", "size", "map")
    return cells.unionAll(many)


def cell_pairs(part: pa.Table, starts: np.ndarray, rule: Similar, first_only: bool) -> dict[str, np.ndarray]:
    """Pairs (later, earlier) of rows of the same cell that pass the length, lead and parity filters; rows of a cell come
    in the order of their first line. ``first_only``: of each row the earliest partner, and whether it has more."""
    total = part.num_rows
    ends = np.append(starts[1:], total)
    begin = np.repeat(starts, ends - starts)
    size = part.column("size").to_numpy().astype(np.int64)
    n, lead = size >> 1, (size & 1) > 0
    sets = part.column("set").to_numpy()
    i, j, block = (part.column(k).to_numpy() for k in ("i", "j", "block"))
    probe = part.column("open").to_numpy() if "open" in part.column_names else np.ones(total, bool)
    wide = widths(n)
    alike = Maps(np.frombuffer(b"".join(part.column("map").to_pylist()), np.uint64), np.cumsum(wide) - wide, wide)
    earlier = np.where(probe, np.arange(total) - begin, 0)
    found: dict[str, list] = {"x": [], "y": [], "more": []}
    cuts = np.append(0, np.cumsum(earlier))
    s = 0
    while s < total:
        e = max(s + 1, int(np.searchsorted(cuts, cuts[s] + LOOK, "right")) - 1)
        k = earlier[s:e]
        x = np.repeat(np.arange(s, e), k)
        y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + begin[x]
        ok = (i[x] == j[x]) | (block[x] != block[y])
        ok &= sets[x] != sets[y]
        ok &= 100 * np.minimum(n[x], n[y]) >= rule.percent * np.maximum(n[x], n[y])
        ok &= (lead[x] | (n[x] > n[y])) & (lead[y] | (n[y] > n[x]))
        x, y = x[ok], y[ok]
        some, _ = alike.near(x, y, (100 - rule.percent) * (n[x] + n[y]) // (100 + rule.percent))
        x, y = x[some], y[some]
        if first_only and len(x):
            x, at, times = np.unique(x, return_index=True, return_counts=True)
            y, more = y[at], times > 1
        else:
            more = np.zeros(len(x), bool)
        found["x"].append(sets[x]), found["y"].append(sets[y]), found["more"].append(more)
        found.setdefault("word", []).append(part.column("word").to_numpy()[x])
        s = e
    return {k: np.concatenate(v) for k, v in found.items()}


def paired(cells: DataFrame, rule: Similar, first_only: bool) -> DataFrame:
    keys = ["word", "band", "i", "j"]
    rows = cells.repartition(*keys).sortWithinPartitions(*keys, "at", "set").drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in blocks_of(batches, keys):
            got = cell_pairs(part, starts, rule, first_only)
            yield pa.RecordBatch.from_arrays([pa.array(got[k]) for k in ("word", "x", "y", "more")], names=["word", "x", "y", "more"])

    return rows.mapInArrow(run, "word long, x long, y long, more boolean")


def word_arrays(wanted: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """The words of some sets (a stored table of distinct names), each from the text of one row that has the set."""
    few = wanted.limit(IDS + 1).count() <= IDS
    holders = stored(join_stored(first.select("set", "row"), wanted, ["set"], "left_semi", few))
    held = holders.toPandas().sort_values("set") if few else None
    known = rows.sparkSession.sparkContext.broadcast((held["set"].to_numpy(), held["row"].to_numpy()) if few else None)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0).to_numpy()
            for part in parts_of(b.column(1), TEXT_BYTES):
                lines = lines_of([t for _, t in part])
                of = row[[i for i, _ in part]][lines.text]
                keep = np.zeros(len(of), bool)
                keep[np.unique(np.stack([lines.names, of]), axis=1, return_index=True)[1] if len(of) else []] = True
                if few and len(known.value[0]):
                    at = np.minimum(np.searchsorted(known.value[0], lines.names), len(known.value[0]) - 1)
                    keep &= (known.value[0][at] == lines.names) & (known.value[1][at] == of)
                lines, of = chosen(lines, keep), of[keep]
                yield pa.RecordBatch.from_arrays([pa.array(lines.names), pa.array(of), _bytes(8 * lines.size, lines.words.tobytes())], names=["set", "row", "words"])

    some = join_stored(rows.select("row", "text"), holders.select("row").distinct(), ["row"], "left_semi", few)
    made = some.mapInArrow(arrays, "set long, row long, words binary")
    if not few:
        made = made.join(holders, ["set", "row"], "left_semi")
    made = stored_parquet(made.select("set", "words"))
    # Rows equal in id and text all give the set.
    return made if made.count() == holders.count() else made.dropDuplicates(["set"])


def verified(pairs: DataFrame, made: DataFrame, rule: Similar) -> DataFrame:
    """The pairs whose arrays reach the similarity."""

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= rule.percent * (len(x) + len(y) - common))
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(made.select(F.col("set").alias("x"), F.col("words").alias("wx")), "x")
    both = both.join(made.select(F.col("set").alias("y"), F.col("words").alias("wy")), "y").select("x", "y", "wx", "wy")
    return both.mapInArrow(intersect, "x long, y long")


def _sets_of(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct())


def first_lines(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """The first line of some sets (a stored table of distinct names), and a row that has the set."""
    lines = names.select("doc_id", "row", F.explode("lines").alias("l")).select("row", F.col("l.set").alias("set"), F.struct("doc_id", "l.line").alias("at"))
    lines = join_stored(lines, wanted, ["set"], "left_semi", wanted.limit(IDS + 1).count() <= IDS)
    return stored(lines.groupBy("set").agg(F.min("at").alias("at"), F.min("row").alias("row")))


def later_first(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs (a, b, far) as (x, y, far), x the set whose first line is the later one."""
    both = pairs.join(first.select(F.col("set").alias("a"), F.col("at").alias("at_a")), "a").join(first.select(F.col("set").alias("b"), F.col("at").alias("at_b")), "b")
    later = F.struct(F.col("at_a").alias("at"), F.col("a").alias("set")) > F.struct(F.col("at_b").alias("at"), F.col("b").alias("set"))
    return both.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("y"), "far")


def matched_sets(rows: DataFrame, names: DataFrame, often: np.ndarray, rule: Similar) -> DataFrame:
    """Sets that an earlier, different set matches."""
    buckets = 4 * max(1, rows.rdd.getNumPartitions())
    shared = stored_parquet(shared_words(word_chunks(rows, often, rule, buckets), rule))
    near = stored(shared.filter("a is not null").groupBy("a", "b").agg(F.min("far").alias("far")))
    sets = shared.filter("dense is not null").select(F.col("dense").alias("word"), "set", "size", "map")
    first = first_lines(stored(near.select(F.explode(F.array("a", "b")).alias("set")).unionAll(sets.select("set")).distinct()), names)
    pairs, left = later_first(near, first), None
    if not sets.isEmpty():
        sets = stored_parquet(sets.dropDuplicates(["word", "set"]).join(first.select("set", "at"), "set"))
        left = stored(paired(entries(sets, rule), rule, True))
        pairs = pairs.unionAll(left.select("x", "y", F.lit(0.0).cast("float").alias("far")))
    pairs = stored(pairs.groupBy("x", "y").agg(F.min("far").alias("far")))
    made = word_arrays(_sets_of(pairs), rows, first)
    best = stored(pairs.groupBy("x").agg(F.min(F.struct("far", "y")).alias("best")).select("x", "best.y"))
    gone = stored(verified(best, made, rule).select(F.col("x").alias("set")).distinct())
    few = gone.limit(IDS + 1).count() <= IDS
    others = pairs.select(F.col("x").alias("set"), "y").join(best.select(F.col("x").alias("set"), "y"), ["set", "y"], "left_anti")
    others = stored(join_stored(others, gone, ["set"], "left_anti", few).select(F.col("set").alias("x"), "y"))
    if not others.isEmpty():
        gone = stored(gone.unionAll(verified(others, made, rule).select(F.col("x").alias("set")).distinct()))
        few = gone.limit(IDS + 1).count() <= IDS
    if left is None:
        return gone
    left = stored(join_stored(left.filter("more").select("word", F.col("x").alias("set")).distinct(), gone, ["set"], "left_anti", few))
    if left.isEmpty():
        return gone
    again = entries(sets, rule, stored(left.select("word").distinct()))
    again = again.join(left.withColumn("open", F.lit(True)), ["word", "set"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    two = stored(paired(again, rule, False).select("x", "y").distinct())
    return stored(gone.unionAll(verified(two, word_arrays(_sets_of(two), rows, first), rule).select(F.col("x").alias("set"))).distinct())


def repeated_lines(df: DataFrame, id: str = "doc_id", text: str = "text", rule: Similar = Similar()) -> DataFrame:
    """One row per input row: id, n_lines (lines with a word), n_removed and removed (their places from 0, in order).

    A line goes if an earlier one, in the order of document id (null first) and line, has a similarity of at least
    ``percent``; equal sets of words have 1. Lines without words never go. Null and empty texts have no lines.
    Rows equal in id and text count as one document and get equal results; of different
    lines at one place (texts under one id) the hash of the set says which is earlier, equal ones both stay. Other columns are
    not read; an empty table gives an empty result. Exact up to collisions of 64-bit hashes.
    """
    rows = _rows(df, id, text)
    names, often = read_lines(rows, rule)
    gone = matched_sets(rows, names, often, rule)
    lines = names.select("doc_id", "row", F.explode("lines").alias("l")).select("doc_id", "row", "l.line", "l.set")
    at = F.struct("doc_id", "line")
    often = lines.groupBy("set").agg(F.min(at).alias("first"), F.count("*").alias("k")).filter("k > 1").select("set", "first")
    marks = often.join(gone.withColumn("gone", F.lit(True)), "set", "full")
    marks = stored(marks.select("set", "first", F.coalesce("gone", F.lit(False)).alias("gone")))
    marked = join_stored(lines, marks, ["set"], "inner", marks.limit(IDS + 1).count() <= IDS)
    out = marked.filter(F.col("gone") | (at > F.col("first"))).groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    every = names.select("doc_id", "row", F.size("lines").cast("long").alias("n_lines"))
    every = join_stored(every, stored(out), ["doc_id", "row"])
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return every.select("doc_id", "row", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_repeated_lines(df: DataFrame, id: str = "doc_id", text: str = "text", rule: Similar = Similar()) -> DataFrame:
    """The input with its repeated lines taken out of the text; null texts and all other columns stay."""
    found = repeated_lines(df, id, text, rule).filter("n_removed > 0").select("row", "removed").dropDuplicates(["row"])
    rows = df.select(F.struct(*(col(c) for c in df.columns)).alias("_row"), F.xxhash64(col(id), F.coalesce(col(text), F.lit(""))).alias("row"))
    rows = join_stored(rows, stored(found), ["row"])
    body = F.col("_row").getField(text)
    kept = F.filter(F.split(body, "\n", -1), lambda line, i: ~F.array_contains(F.col("removed"), i))
    new: Column = F.when(F.col("removed").isNull(), body).otherwise(F.array_join(kept, "\n"))
    return rows.select(*(new.alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in df.columns))
