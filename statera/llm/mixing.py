"""Mixing sources to target weights by entropy balancing.

Every document gets the rate that stays closest in entropy to one copy while each source's expected words meet
its target. The convex dual has one multiplier per source; its solution tilts a document's odds exponentially in
its size, ``rate = 2 / (1 + exp(-multiplier * size / scale))``, which keeps every rate between 0 and 2 copies.
Newton steps on the dual are sums over (source, size) counts. Rates become whole copies by sequential sampling: the
fractions of a source are taken in the order of a hash until its target is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, is_small, join_stored, stored, unit, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
STEPS = 40
CLOSE = 1e-9
BINS = 4096


def document_sizes(df: DataFrame, id: str, text: str, source: str) -> DataFrame:
    return df.select(
        col(id).alias("doc_id"), col(source).alias("source"), word_count(text).alias("size"),
        F.xxhash64(col(id), F.coalesce(col(text), F.lit(""))).alias("hash"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per source its size and target. Sources in code-point order, null last, take the weights in turn; ``share`` of
    all words is dealt by weight, no source gets more than twice its size, and what is left over goes to
    the others by weight: one level for all, found from the running sums in the order in which sources fill up."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turns = F.array(*map(F.lit, weights))
    per = per.withColumn("weight", F.element_at(turns, (rank % len(weights) + 1).cast("int")).cast("double"))
    most = F.col("source_size") * float(MOST)
    fill = Window.orderBy(most / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    sums = per.select(
        "source", "source_size", "weight", most.alias("most"),
        (F.sum(most).over(upto) - most).alias("full"),
        (F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")).alias("open"),
        (F.sum("source_size").over(everything) * float(share)).alias("total"),
    )
    # With the sources before this one full, the level of those still open; the first that holds is the level.
    level = (F.col("total") - F.col("full")) / F.col("open")
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    holds = F.first(F.when(level * F.col("weight") <= F.col("most"), level), ignorenulls=True).over(whole)
    target = F.least(F.col("most"), F.coalesce(holds * F.col("weight"), F.col("most")))
    return sums.select("source", "source_size", target.alias("target"))


def _start(sources: DataFrame, scales: DataFrame, few: bool) -> DataFrame:
    """Multipliers before the first step. A source that takes all twice, or nothing, needs none (``done``)."""
    part = F.col("target") / (F.col("source_size") * float(MOST))
    done = (F.col("source_size") == 0) | (part >= 1 - 1e-12)
    guess = F.when(done, F.lit(0.0)).otherwise(F.log(part / (1 - part)))
    return join_stored(sources, scales, ["source"], few=few).select(
        "source", "source_size", "target", "scale", guess.alias("tilt"), F.lit(float("-inf")).alias("low"),
        F.lit(float("inf")).alias("high"), done.alias("full"), done.alias("done"),
    )


def _rate(size: Column, tilt: Column, scale: Column) -> Column:
    return F.lit(float(MOST)) / (1 + F.exp(-tilt * size / scale))


def balanced(sizes: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Per source the multiplier that meets its target, by safeguarded Newton steps on the dual.

    A step sums the dual's slope and curvature over the counts of (source, size); a step that leaves the
    interval known to hold the solution is replaced by its middle.
    """
    counts = stored(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    words = F.col("n") * F.col("size")
    scales = stored(
        counts.groupBy("source").agg(
            F.greatest(F.coalesce(F.sum(words * F.col("size").cast("double")) / F.sum(words), F.lit(1.0)), F.lit(1.0)).alias("scale")
        )
    )
    state = stored(_start(sources, scales, few))
    for _ in range(STEPS):
        if state.filter(~F.col("done")).isEmpty():
            break
        at = join_stored(counts, state.filter(~F.col("done")), ["source"], "inner", few)
        rate = _rate(F.col("size"), F.col("tilt"), F.col("scale"))
        step = at.groupBy("source").agg(
            (F.sum(words * rate) - F.first("target")).alias("gap"),
            F.sum(words * (F.col("size") / F.col("scale")) * rate * (1 - rate / MOST)).alias("slope"),
        )
        moved = join_stored(state, step, ["source"], few=few)
        low = F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.col("gap") / F.col("slope")
        inside = (newton > low) & (newton < high) & (F.abs(newton - F.col("tilt")) <= 8)
        middle = (
            F.when(F.isnan(low + high) | (F.abs(low) == float("inf")), high - 4)
            .when(high == float("inf"), low + 4)
            .otherwise((low + high) / 2)
        )
        near = F.abs(F.col("gap")) <= F.col("target") * CLOSE
        still = F.col("done") | near
        state = stored(
            moved.select(
                "source", "source_size", "target", "scale",
                F.when(still, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"),
                F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
                "full", still.alias("done"),
            )
        )
    return state


def _with_rates(sizes: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """Sizes with their rate, its whole copies, and the place of its fraction in the order of sampling."""
    at = join_stored(sizes, state, ["source"], few=few)
    rate = F.when(F.col("source_size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(MOST))).otherwise(
        F.least(F.lit(float(MOST)), _rate(F.col("size"), F.col("tilt"), F.col("scale")))
    )
    whole = F.floor(F.col("rate"))
    part = F.col("rate") - F.floor(F.col("rate"))
    # A fraction f drawn at u comes at u / f: below 1 with the chance f.
    turn = unit(F.xxhash64("hash", F.lit(11))) / part
    place = F.when((part > 0) & (F.col("size") > 0), turn / (1 + turn))
    return at.withColumn("rate", rate).withColumn("whole", whole.cast("long")).withColumn("place", place)


def _crossing(open_rows: DataFrame, bin: Column, filled: DataFrame, few: bool) -> DataFrame:
    """Per source the bin in which the words taken so far reach what is wanted, and the words before it."""
    sums = open_rows.groupBy("source", bin.alias("bin")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = join_stored(sums.withColumn("upto", F.sum("words").over(run)), filled, ["source"], "inner", few)
    over = at.filter(F.col("upto") > F.col("wanted"))
    return over.groupBy("source").agg(
        F.min("bin").alias("bin"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("before")
    )


def _bins(place: Column) -> tuple[Column, Column]:
    first = F.floor(place * BINS)
    return first.cast("int"), F.floor((place * BINS - first) * BINS).cast("int")


def mixture(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per source all that turns a document's size and hash into copies: see ``with_copies``.

    The fractions are taken in order of their place up to a bin of a bin (one of 16 million); of the
    rest, the document whose words come nearest to what is still wanted follows.
    """
    sources = stored(source_targets(sizes, weights, share))
    few = is_small(sources)

    def by_source(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
        return join_stored(left, right, ["source"], how, few)

    state = balanced(sizes, sources, few)
    rows = _with_rates(sizes, state, few)
    first, second = _bins(F.col("place"))
    got = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("got"))
    wanted = stored(by_source(state, got).select("source", (F.col("target") - F.col("got")).alias("wanted")))
    open_rows = rows.filter(F.col("place").isNotNull())
    one = stored(_crossing(open_rows, first, wanted, few))
    rest = by_source(wanted, one, "inner").select("source", (F.col("wanted") - F.col("before")).alias("wanted"))
    inner = by_source(open_rows, one.select("source", F.col("bin").alias("_first")), "inner").filter(first == F.col("_first"))
    two = stored(_crossing(inner, second, rest, few))
    cuts = by_source(state, one.select("source", F.col("bin").alias("cut_first"), F.col("before").alias("b1")))
    cuts = by_source(cuts, two.select("source", F.col("bin").alias("cut_second"), F.col("before").alias("b2")))
    cuts = stored(
        by_source(cuts, wanted).withColumn(
            "short", F.col("wanted") - F.coalesce(F.col("b1"), F.lit(0.0)) - F.coalesce(F.col("b2"), F.lit(0.0))
        ).drop("b1", "b2", "wanted")
    )
    left = by_source(open_rows, cuts.select("source", "cut_first", "cut_second", "short")).filter(~_taken(first, second))
    off = F.abs(F.col("size") - F.col("short"))
    near = left.filter(F.col("cut_first").isNotNull() & (off < F.col("short"))).groupBy("source").agg(
        F.min(F.struct(off.alias("off"), "hash")).alias("_near")
    )
    last = near.select("source", F.col("_near.hash").alias("last_hash"))
    return stored(by_source(cuts.drop("short"), last))


def _taken(first: Column, second: Column) -> Column:
    """Whether a fraction's place lies before its source's cut; a source without a cut takes all its fractions."""
    before = (first < F.col("cut_first")) | ((first == F.col("cut_first")) & (second < F.coalesce(F.col("cut_second"), F.lit(0))))
    return F.col("place").isNotNull() & (F.col("cut_first").isNull() | before)


def with_copies(sizes: DataFrame, mix: DataFrame) -> DataFrame:
    """Rows with ``source``, ``size`` and ``hash`` (other columns stay), and their source's size and target, rate, copies and taken."""
    kept = sizes.columns
    rows = _with_rates(sizes, mix, is_small(mix))
    first, second = _bins(F.col("place"))
    more = _taken(first, second) | (F.col("place").isNotNull() & F.col("hash").eqNullSafe(F.col("last_hash")))
    copies = F.col("whole") + more.cast("long")
    return rows.withColumn("copies", copies).select(
        *(col(c) for c in kept), "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix_sources(
    df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
) -> DataFrame:
    """One row per input row: id, size (words), source_size, target, rate, copies (0 to 2) and taken words.

    A null or empty text has size 0 and one copy; a null source is a source of its own, the last in order. Rows with
    equal id and text share a hash, so they are drawn alike. Reruns agree: the draw is a function of the row.
    Other columns are not read. An empty table gives an empty result.
    """
    sizes = stored(document_sizes(df, id, text, source))
    out = with_copies(sizes, mixture(sizes, weights, share))
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", "taken")


def mixed_documents(
    df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
) -> DataFrame:
    """The mix itself: every input row as often as its copies say, with the columns of the input only.

    Texts are read again instead of shuffled: a document's copies follow from its size, its hash and the few
    figures of its source.
    """
    mix = mixture(stored(document_sizes(df, id, text, source).drop("doc_id")), weights, share)
    keep = F.struct(*(col(c) for c in df.columns)).alias("_row")
    sizes = df.select(
        keep, col(source).alias("source"), word_count(text).alias("size"),
        F.xxhash64(col(id), F.coalesce(col(text), F.lit(""))).alias("hash"),
    )
    times = with_copies(sizes, mix).filter(F.col("copies") > 0)
    return times.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")
