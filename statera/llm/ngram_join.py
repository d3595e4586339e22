"""N-gram Jaccard join: size-banded tiles with hashed bitmaps, then exact intersection of sorted arrays.

A document is the set of its word shingles, held as a sorted array of 64-bit hashes; equal sets are one set from
then on. Two sets can only link if they share one of their rarest shingles (the first 15 % and one more in a common
order) and if their sizes lie in the same or in neighbouring bands. Sets meet in tiles of one shared shingle and
two bands:

1. of shingles with the very same sets one is kept: they stand for the same tiles;
2. each set of a tile is compared with the tile's least set; verified links make first components;
3. in tiles that still hold several components, sets of different components are compared with each other, the
   largest component's sets only with the others. Pairs within a component need no look: they are connected. The first
   rounds take small shares of the shingles (``SHARES``) and only the most promising pair of every set, so that
   copies of one text grow together while few pairs leave a tile. Tiles in which pairs were passed over are looked at
   again, in the end with every pair.

A comparison first counts common bits of two bitmaps, which bounds the intersection from above; only pairs that
pass are intersected exactly. Every link is found or implied, and no group is expanded into all its pairs.
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
from .common import blocks_of, col, counted, join_stored, parts_of, sized, stored, stored_parquet
from .components import components
from .partials import added, packed

RARITY_BITS = 18
CACHE = 1 << 18
#: Sets of a tile that are compared with each other at a time.
SIDE, OTHER = 2048, 8192
#: Shares of the shingles (one in so many) whose tiles are compared, one share after the other; the last is all.
SHARES = (256, 32, 1)
#: Rounds over the tiles of all shingles in which only the best pair of every set counts; after them every pair does.
BEST_ROUNDS = 2
#: Ids that may be broadcast (8 bytes each).
IDS = 500_000


@dataclass(frozen=True)
class Likeness:
    """Words to a shingle; two sets link if 100 * common >= percent * union."""

    words: int = 4
    percent: int = 85

    @property
    def band(self) -> float:
        return float(np.log(100 / self.percent))


class _Words(dict):
    """Hashes of words, kept by the worker; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of k words (the whole text if it has fewer, none if it has none)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(k, len(codes))
    runs = len(codes) - width + 1
    total = np.full(runs, np.uint64(width), np.uint64)
    for i in range(width):
        total = total * _ODD[0] + codes[i : i + runs]
    return np.unique(_mixed(total))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bits at the hashes' low bits; at least four bits for each hash, a power of two in all."""
    m = 64
    while m < 4 * len(hashes):
        m *= 2
    bits = np.zeros(m, np.uint8)
    bits[(hashes & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def folded(bits: bytes, size: int) -> bytes:
    """The bitmap of the same set with ``size`` bytes."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x.tobytes()


def _texts(df: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(col(text), F.lit(""))
    return bounded_batches(df).select(col(id).alias("doc_id"), F.xxhash64(col(id), body).alias("row"), body.alias("text"))


def rarity(texts: DataFrame, like: Likeness) -> np.ndarray:
    """How often shingles occur, by the first bits of their hash: a table of fixed size over all documents, one row of
    it from every task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << RARITY_BITS, np.int64)
        for b in batches:
            for part in parts_of(b.column(0)):
                found = np.concatenate([shingles(t, like.words) for _, t in part])
                seen += np.bincount((found >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=1 << RARITY_BITS)
        yield packed(seen)

    return added(texts.select("text").mapInArrow(count, "sums binary"), 1 << RARITY_BITS)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def set_table(texts: DataFrame, like: Likeness) -> DataFrame:
    """Per row: its set's name (null if empty), size, rarest shingles and bitmap."""
    spark = texts.sparkSession
    often = spark.sparkContext.broadcast(rarity(texts, like))
    kind = dict(texts.dtypes)["doc_id"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, prefixes, maps = [], [], [], []
            for t in b.column(2):
                h = shingles(t.as_py(), like.words)
                n = len(h)
                sizes.append(n)
                if not n:
                    names.append(None), prefixes.append(None), maps.append(None)
                    continue
                names.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                order = np.lexsort((h, often.value[(h >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]))
                prefixes.append(h[order[: n - -(-like.percent * n // 100) + 1]].view(np.int64))
                maps.append(bitmap(h).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                names=["doc_id", "row", "set", "n", "rare", "bits"],
            )

    return texts.mapInArrow(describe, f"doc_id {kind}, row long, set long, n long, rare array<long>, bits binary")


def band_of(n: Column, like: Likeness) -> Column:
    return F.floor(F.log(n.cast("double")) / like.band + 1e-9).cast("int")


def shared_entries(sets: DataFrame, like: Likeness) -> DataFrame:
    """(gram, set, n, lead) of rare shingles that two sets or more have, one of them with the shingle among the first by
    which a set finds those as large or larger (``lead``). Of shingles with the same sets, told by their number
    and the sum of their hashes without carry, the least one. The counting is a partial aggregation and the join has
    one row per shingle on one side: a shingle of very many sets is no group."""
    # The smaller set of a link has more than its share in common, 2 p / (100 + p), so its shared shingle is among fewer.
    first = F.col("n") - F.ceil(2 * like.percent * F.col("n") / (100 + like.percent) - 1e-9) + 1
    grams = sets.select(F.posexplode("rare").alias("at", "gram"), "set", "n").select("gram", "set", "n", (F.col("at") < first).alias("lead"))
    groups = grams.groupBy("gram").agg(
        F.count("*").cast("int").alias("k"), F.bit_xor(F.xxhash64("set", "lead")).alias("who"), F.max("lead").alias("led")
    ).filter("k > 1 and led")
    kept = groups.groupBy("k", "who").agg(F.min("gram").alias("gram")).select("gram")
    return grams.join(kept, "gram").select("gram", "set", "n", "lead")


def tiled(entries: DataFrame, like: Likeness) -> DataFrame:
    """Every entry in the tile of its set's band and in the next one, ``own`` in the first."""
    band = band_of(F.col("n"), like)
    tiles = F.array(F.struct(band.alias("tile"), F.lit(True).alias("own")), F.struct((band + 1).alias("tile"), F.lit(False).alias("own")))
    return entries.select("gram", F.explode(tiles).alias("t"), "set", "n", "lead").select("gram", "t.tile", "t.own", "set", "n", "lead")


def _within(a: Column, b: Column, like: Likeness) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * like.percent)


def star_pairs(entries: DataFrame, like: Likeness) -> DataFrame:
    """Each set of a tile with the tile's least set, if their sizes allow a link."""
    least = entries.groupBy("gram", "tile").agg(F.min(F.struct("set", "n")).alias("least"), F.count("*").alias("k")).filter("k > 1")
    pairs = entries.join(least.select("gram", "tile", "least"), ["gram", "tile"])
    pairs = pairs.filter((F.col("set") != F.col("least.set")) & _within(F.col("n"), F.col("least.n"), like))
    return pairs.select(F.col("least.set").alias("a"), F.col("set").alias("b")).distinct()


def links_bound(na, nb, common, pa_, pb, like: Likeness):
    """Whether bit counts allow a link: a bit of one set that the other lacks is at least one shingle it lacks."""
    most = np.minimum(na - (pa_ - common), nb - (pb - common))
    return 100 * most >= like.percent * (na + nb - most)


def _bound_pairs(like: Likeness):
    """Keep the pairs (a, b, na, nb, x, y) whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, nb, x, y in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                size = min(len(x), len(y))
                x, y = np.frombuffer(folded(x, size), np.uint64), np.frombuffer(folded(y, size), np.uint64)
                ones = [int(np.bitwise_count(v).sum()) for v in (x, y, x & y)]
                keep.append(bool(links_bound(na, nb, ones[2], ones[0], ones[1], like)))
            out = b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield out

    return run


def bounded(pairs: DataFrame, maps: DataFrame, like: Likeness) -> DataFrame:
    x = maps.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    y = maps.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y")
    return both.mapInArrow(_bound_pairs(like), "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs of sets that link, by the exact intersection of their arrays. ``rows``: set and row of one
    document each. Arrays are made again from the texts of the sets in pairs, and of no others."""
    wanted, many = counted(stored(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(rows, "set")))
    kind = F.broadcast if many <= IDS else (lambda d: d)
    some = texts.select("row", "text").join(kind(wanted), "row").select("set", "text")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([shingles(t.as_py(), like.words).tobytes() for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=["set", "hashes"])

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= like.percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # A row's text may stand in several rows of the input; any of them has the set's array.
    made = some.mapInArrow(arrays, "set long, hashes binary").dropDuplicates(["set"])
    made = stored(made)
    both = pairs.join(made.select(F.col("set").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(made.select(F.col("set").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(intersect, "a long, b long"))


def open_tiles(entries: DataFrame, roots: DataFrame, few: bool) -> DataFrame:
    """Entries of tiles with several components: with their component (``root``) and whether it is the tile's
    most frequent one (``major``). ``few``: whether the roots may be broadcast."""
    marked = join_stored(entries, roots.select(F.col("node").alias("set"), "root"), ["set"], few=few)
    marked = marked.withColumn("root", F.coalesce("root", "set"))
    sizes = marked.groupBy("gram", "tile", "root").agg(F.count("*").alias("k"), F.max("own").alias("own"), F.max("lead").alias("led"))
    tiles = sizes.groupBy("gram", "tile").agg(
        F.count("*").alias("roots"), F.max("own").alias("owned"), F.max("led").alias("led"), F.sum("k").alias("all"),
        F.max(F.struct("k", "root")).alias("most"),
    ).filter("roots > 1 and owned and led")
    out = marked.join(tiles, ["gram", "tile"])
    return out.select(
        "gram", "tile", "own", "set", "n", "lead", "root", (F.col("root") == F.col("most.root")).alias("major"), "all",
        (F.col("all") - F.col("most.k")).alias("rest"),
    )


def dealt(tiles: DataFrame) -> DataFrame:
    """Blocks of a tile: its lesser components' sets (side 0) against all its sets (side 1). Both sides are cut into
    bounded blocks by the hash of the set; a tile of usual size is one block, in which a set stands once (side 2: both)."""
    lefts, rights = F.ceil(F.col("rest") / SIDE).cast("int"), F.ceil(F.col("all") / OTHER).cast("int")
    spot = F.xxhash64("set")
    left = F.when(~F.col("major"), F.transform(F.sequence(F.lit(0), rights - 1), lambda j: F.struct(F.lit(0).alias("side"), F.pmod(spot, lefts).cast("int").alias("i"), j.alias("j"))))
    right = F.transform(F.sequence(F.lit(0), lefts - 1), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), F.pmod(spot, rights).cast("int").alias("j")))
    places = F.concat(F.coalesce(left, F.array().cast("array<struct<side:int,i:int,j:int>>")), right)
    one = F.array(F.struct(F.when(F.col("major"), 1).otherwise(2).alias("side"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    places = F.when((lefts == 1) & (rights == 1), one).otherwise(places)
    columns = ["own", "set", "n", "lead", "root", "major"]
    return tiles.select("gram", "tile", *columns, F.explode(places).alias("p")).select("gram", "tile", "p.i", "p.j", "p.side", *columns)


def best_pairs(a: np.ndarray, b: np.ndarray, promise: np.ndarray) -> np.ndarray:
    """Places of the pairs that are the most promising one of either of their sets: as many as sets at most."""
    order = np.argsort(-promise, kind="stable")
    return np.union1d(order[np.unique(a[order], return_index=True)[1]], order[np.unique(b[order], return_index=True)[1]])


def _block_pairs(block: dict[str, np.ndarray], maps: list[bytes], like: Likeness, best: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of one block that may link: side 0 with side 1, of different components, not both from the
    lower band (they meet in their own tile), each pair once; with ``best`` only the best pair of every set, and whether
    others were passed over."""
    width = min(map(len, maps))
    bits = np.frombuffer(b"".join(folded(m, width) for m in maps), np.uint64).reshape(len(maps), -1)
    ones = np.bitwise_count(bits).sum(1).astype(np.int64)
    left, right = np.flatnonzero(block["side"] != 1), np.flatnonzero(block["side"] != 0)
    passed = 0
    found_a, found_b, hope = [], [], []
    step = max(1, (1 << 22) // max(1, len(right) * bits.shape[1]))
    for s in range(0, len(left), step):
        some = left[s : s + step]
        na, nb = block["n"][some][:, None], block["n"][right][None, :]
        ok = (block["root"][some][:, None] != block["root"][right][None, :]) & (block["own"][some][:, None] | block["own"][right][None, :])
        ok &= block["major"][right][None, :] | (block["set"][some][:, None] < block["set"][right][None, :])
        ok &= 100 * np.minimum(na, nb) >= like.percent * np.maximum(na, nb)
        ok &= (block["lead"][some][:, None] | (na > nb)) & (block["lead"][right][None, :] | (nb > na))
        i, j = np.nonzero(ok)
        i, j = some[i], right[j]
        for q in range(0, len(i), 1 << 16):
            x, y = i[q : q + (1 << 16)], j[q : q + (1 << 16)]
            common = np.bitwise_count(bits[x] & bits[y]).sum(1).astype(np.int64)
            may = links_bound(block["n"][x], block["n"][y], common, ones[x], ones[y], like)
            found_a.append(block["set"][x[may]]), found_b.append(block["set"][y[may]])
            hope.append(common[may] / (ones[x[may]] + ones[y[may]] - common[may]))
            if best and len(hope) > 1:  # keep no more than the best so far
                found_a, found_b, hope = ([np.concatenate(v)] for v in (found_a, found_b, hope))
                keep = best_pairs(found_a[0], found_b[0], hope[0])
                passed += len(found_a[0]) - len(keep)
                found_a, found_b, hope = [found_a[0][keep]], [found_b[0][keep]], [hope[0][keep]]
    a, b = np.concatenate([np.zeros(0, np.int64), *found_a]), np.concatenate([np.zeros(0, np.int64), *found_b])
    if best and len(a):
        keep = best_pairs(a, b, np.concatenate(hope))
        passed += len(a) - len(keep)
        a, b = a[keep], b[keep]
    return a, b, passed > 0


def tile_pairs(blocks: DataFrame, maps: DataFrame, like: Likeness, best: bool) -> DataFrame:
    """Pairs (a, b) of different components that bit counts let pass, over all blocks, and as rows of their own the
    tiles (gram, tile) in which pairs were passed over."""
    keys = ["gram", "tile", "i", "j"]
    rows = blocks.join(maps.select("set", "bits"), "set").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in blocks_of(batches, keys):
            columns = {k: part.column(k).to_numpy() for k in ("side", "own", "set", "n", "lead", "root", "major")}
            maps = part.column("bits").to_pylist()
            got = [
                _block_pairs({k: v[s:e] for k, v in columns.items()}, maps[s:e], like, best)
                for s, e in zip(starts, np.append(starts[1:], part.num_rows))
            ]
            a, b = (np.concatenate([g[x] for g in got]) for x in (0, 1))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            again = starts[[g[2] for g in got]] if len(got) else starts
            n, m = pairs.shape[1], len(again)
            grams, tiles = part.column("gram").to_numpy()[again], part.column("tile").to_numpy()[again]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(pairs[0]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(pairs[1]), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(grams)]), pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(tiles, pa.int32())]),
                ],
                names=["a", "b", "gram", "tile"],
            )

    found = rows.select(*keys, "side", "own", "set", "n", "lead", "root", "major", "bits").mapInArrow(run, "a long, b long, gram long, tile int")
    return found.distinct()


def set_links(sets: DataFrame, rows: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) of sets that give the components of all links."""
    entries = stored_parquet(shared_entries(sets, like))
    named = entries.select("set").distinct()
    # Bitmaps of sets without a shared rare shingle are not needed.
    maps = stored_parquet(sets.select("set", "n", "bits").join(named, "set", "left_semi"))
    every = tiled(entries, like)
    share_of = lambda k: F.pmod(F.xxhash64("gram"), F.lit(k)) == 0
    links = sized(verified(sized(stored(bounded(star_pairs(every.filter(share_of(SHARES[1])), like), maps, like))), rows, texts, like))

    def compared(tiles: DataFrame, best: bool) -> DataFrame | None:
        """Look into tiles, add what links there; the tiles to look at again."""
        nonlocal links
        roots, many = counted(stored(components(links)))
        found = stored(tile_pairs(dealt(open_tiles(tiles, roots, many <= IDS)), maps, like, best))
        pairs, many = counted(found.filter("a is not null").select("a", "b"))
        if not many:
            return None
        links = sized(links.unionAll(verified(pairs, rows, texts, like)))
        again, many = counted(found.filter("gram is not null").select("gram", "tile"))
        return again if many else None

    for share in SHARES:
        again = compared(every.filter(share_of(share)), True)
    done = 1
    while again is not None:
        some = every.join(again, ["gram", "tile"], "left_semi")
        again = compared(some, done < BEST_ROUNDS)
        done += 1
    return links


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """One row per input row: id, n_shingles (size of its set) and component_id (the least id reachable by links, its
    own included).

    Null and empty texts and those of white space have the empty set, link with nothing and keep their own id. Equal
    sets link. A null id takes part, but is never a component's id unless all ids of the component are null. Repeated
    rows pass through. Other columns are not read. An empty table gives an empty result. Exact up to collisions
    of 64-bit hashes.
    """
    return _joined(df, id, text, like).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _joined(df: DataFrame, id: str, text: str, like: Likeness) -> DataFrame:
    texts = _texts(df, id, text)
    every = stored_parquet(set_table(texts, like))
    full = every.filter(F.col("set").isNotNull())
    rows = stored(full.groupBy("set").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")))
    sets = full.select("set", "n", "rare", "bits").dropDuplicates(["set"])
    roots = components(set_links(sets, rows.select("set", "row"), texts, like))
    roots = stored(roots.select(F.col("node").alias("set"), "root"))
    named = rows.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = named.join(ids, "root").select("set", "root", "component_id")
    out = every.select("doc_id", "row", "set", "n").join(of_set, "set", "left")
    return out.withColumn("component_id", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """The input with one document of each component, all columns as they are: one with the least id.

    Of rows with that id the one with the least hash stays, and of rows equal in id and text only one; a row without
    an id stays only if its whole component has none. Components are told apart by their sets, so unlinked texts under
    one id all stay; documents without words all stay.
    """
    every = stored(_joined(df, id, text, like).select("doc_id", "row", "set", "root"))
    full = every.filter(F.col("set").isNotNull())
    least = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row"))
    first = stored(full.groupBy("root").agg(least.alias("least")).select("least.row"))
    few = first.limit(IDS + 1).count() <= IDS
    times = join_stored(full.select("row"), first, ["row"], "left_semi", few).groupBy("row").agg((F.count("*") > 1).alias("again"))
    empty = every.filter(F.col("set").isNull()).select("row", F.lit(False).alias("again"))
    keep = stored(times.unionAll(empty).distinct())
    marked = df.select(F.struct(*(col(c) for c in df.columns)).alias("_row"), F.xxhash64(col(id), F.coalesce(col(text), F.lit(""))).alias("row"))
    few = keep.limit(IDS + 1).count() <= IDS
    once = join_stored(marked, keep.filter(~F.col("again")).select("row"), ["row"], "left_semi", few)
    more = keep.filter("again")
    if not more.isEmpty():
        once = once.unionAll(join_stored(marked, more.select("row"), ["row"], "left_semi", few).dropDuplicates(["row"]))
    return once.select("_row.*")
