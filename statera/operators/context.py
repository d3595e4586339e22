"""Parent and sibling context of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import left_join, union_rows
from ..functions.text import fixed
from .ordered import with_running_sum
from .similarity import match_chunks


def with_parent(chunks: DataFrame) -> DataFrame:
    """Adds ``parent_content`` (null without a parent)."""
    parents = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("parent_content"))
    return left_join(chunks, parents, "parent_id")


def sibling_rows(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every sibling of the given chunks as a row: ``chunk_id``, ``sibling_id``, ``position``, ``content``.

    ``targets`` has ``chunk_id`` and ``parent_id``. The rows of a large family stay rows, so Spark may split them.
    """
    family = chunks.filter(F.col("parent_id").isNotNull()).select(
        "parent_id", F.col("chunk_id").alias("sibling_id"), "position", "content"
    )
    seek = targets.filter(F.col("parent_id").isNotNull()).select("chunk_id", "parent_id")
    return seek.join(family, "parent_id").filter(F.col("chunk_id") != F.col("sibling_id")).drop("parent_id")


def families(chunks: DataFrame) -> DataFrame:
    """Every family once: ``parent_id``, ``rank`` (from 1, by position), ``chunk_id``, ``position``, ``content``.

    With ``with_family`` this says who is whose sibling without a row or a text for every pair: the siblings of a chunk are the
    rows of its family but its own. Ranks come from a prefix scan, so a family with most of the chunks is no single task.
    """
    kids = chunks.filter(F.col("parent_id").isNotNull()).select("parent_id", "chunk_id", "position", "content")
    return with_running_sum(kids, ["parent_id"], ["position", "chunk_id"], F.lit(1), "rank").select("parent_id", "rank", "chunk_id", "position", "content")


def with_family(chunks: DataFrame, family: DataFrame) -> DataFrame:
    """Adds a chunk's ``rank`` in its family (null without a parent) and its ``sibling_count``. One row a chunk."""
    sizes = family.groupBy("parent_id").agg(F.count(F.lit(1)).alias("_n"))
    placed = family.select("chunk_id", "rank").join(chunks.drop("rank"), "chunk_id", "right")
    out = left_join(placed, sizes, "parent_id")
    return out.withColumn("sibling_count", F.coalesce(F.col("_n") - 1, F.lit(0))).drop("_n")


def shown_siblings(targets: DataFrame, family: DataFrame, first: int = 1, count: int = 5) -> DataFrame:
    """A page of the siblings of each target (``chunk_id``, ``parent_id``, ``rank`` of ``with_family``): ``chunk_id``,
    ``place`` (from ``first``), ``sibling_id``, ``content``. Only the ranks of the page are looked up, so the work follows what is
    shown, not the families."""
    seek = targets.filter(F.col("rank").isNotNull()).select("chunk_id", "parent_id", F.col("rank").alias("_own"))
    page = F.sequence(F.lit(first).cast("long"), F.lit(first + count - 1).cast("long"))
    wanted = seek.select("chunk_id", "parent_id", "_own", F.explode(page).alias("place"))
    wanted = wanted.withColumn("rank", F.when(F.col("place") < F.col("_own"), F.col("place")).otherwise(F.col("place") + 1))
    kin = family.select("parent_id", "rank", F.col("chunk_id").alias("sibling_id"), "content")
    return wanted.join(kin, ["parent_id", "rank"]).select("chunk_id", "place", "sibling_id", "content")


def _all_siblings(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    kin = sibling_rows(targets, chunks).groupBy("chunk_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "sibling_id", "content"))).alias("_kin")
    )
    return kin.select("chunk_id", F.size("_kin").alias("sibling_count"), F.col("_kin.content").alias("siblings"))


def with_siblings(chunks: DataFrame, shown: int | None = 5) -> DataFrame:
    """Adds ``sibling_count`` and the siblings by position: for display the first ``shown``, or all of them with None.

    All siblings of all chunks are the square of a family: ask for that only where families are known to be small, else take
    ``families``. With ``shown`` the first ``shown + 1`` children of a parent hold the first ``shown`` siblings of every child, so
    the work is linear in the chunks: no self join of a parent's children with each other.
    """
    if shown is None:
        return (
            chunks.join(_all_siblings(chunks, chunks), "chunk_id", "left")
            .withColumn("sibling_count", F.coalesce("sibling_count", F.lit(0)))
            .withColumn("siblings", F.coalesce("siblings", F.array().cast("array<string>")))
        )
    family = chunks.filter(F.col("parent_id").isNotNull())
    w = Window.partitionBy("parent_id").orderBy("position", "chunk_id")
    first = (
        family.select("parent_id", "position", "chunk_id", "content")
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= shown + 1)
        .groupBy("parent_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id", "content"))).alias("_first"))
    )
    sizes = family.groupBy("parent_id").agg(F.count(F.lit(1)).alias("_children"))
    joined = left_join(chunks, first.join(sizes, "parent_id"), "parent_id")
    others = F.slice(F.filter("_first", lambda s: s["chunk_id"] != F.col("chunk_id")), 1, shown)
    return (
        joined.withColumn("sibling_count", F.coalesce(F.col("_children") - 1, F.lit(0)))
        .withColumn("siblings", F.coalesce(F.transform(others, lambda s: s["content"]), F.array().cast("array<string>")))
        .drop("_first", "_children")
    )


def context_chunks(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Target, parent and sibling rows of the given chunk ids, tagged by relation.

    ``targets`` has a column ``target_id``; the output is as large as the families asked for.
    """
    cols = ["chunk_id", "section_id", "content", "chunk_type", "position"]
    ids = targets.select("target_id").distinct()
    wanted = ids.join(chunks.withColumnRenamed("chunk_id", "target_id"), "target_id").select(
        "target_id", F.col("parent_id").alias("target_parent"),
        *[F.col("target_id").alias(c) if c == "chunk_id" else F.col(c) for c in cols],
    )
    self_rows = wanted.select("target_id", *cols, F.lit("target").alias("relation"))
    # Without a parent there is neither a parent row nor a sibling row.
    seek = wanted.filter(F.col("target_parent").isNotNull()).select("target_id", "target_parent")
    parents = seek.join(chunks, F.col("target_parent") == F.col("chunk_id")).select(
        "target_id", *cols, F.lit("parent").alias("relation")
    )
    siblings = seek.join(
        chunks, (F.col("target_parent") == F.col("parent_id")) & (F.col("target_id") != F.col("chunk_id"))
    ).select("target_id", *cols, F.lit("sibling").alias("relation"))
    return union_rows(self_rows, parents, siblings)


def retrieve_with_context(queries: DataFrame, chunks: DataFrame, threshold: float = 0.7, k: int = 5,
                          shown: int | None = None) -> DataFrame:
    """Top-k chunks per query with parent content and siblings (all, or the first ``shown``)."""
    hits = match_chunks(queries, chunks, threshold, k)
    light = chunks.drop("vec")
    found = hits.join(light, "chunk_id")
    # Only families of hits are looked up.
    families = found.select("parent_id").filter(F.col("parent_id").isNotNull()).distinct()
    kin = light.join(families, "parent_id", "left_semi")
    wanted = found.select("chunk_id", "parent_id").distinct()
    sib = _all_siblings(wanted, kin) if shown is None else with_siblings(kin, shown).select("chunk_id", "siblings", "sibling_count")
    parents = light.select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("parent_content"))
    return (
        left_join(found, parents, "parent_id")
        .join(sib, "chunk_id", "left")
        .withColumn("siblings", F.coalesce("siblings", F.array().cast("array<string>")))
        .withColumn("sibling_count", F.coalesce("sibling_count", F.lit(0)))
    )


def format_context(results: DataFrame, query_id: str = "query_id", limit: int = 200, shown: int = 3) -> DataFrame:
    """Prompt text per query from its (at most k) ranked results; of the related sections it shows the first
    ``shown``, up to ``limit`` characters each."""
    related = F.when(
        F.size("siblings") > 0,
        F.concat(
            F.lit("**Related Sections:**\n"),
            F.array_join(
                F.transform(
                    F.slice("siblings", 1, shown),
                    lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(s, 1, limit), F.lit("...\n")),
                ),
                "",
            ),
        ),
    ).otherwise("")
    section = F.concat(
        F.format_string("### Retrieved Section %d: %s\n\n", F.col("rank"), F.col("section_id")),
        F.when(
            F.col("parent_content").isNotNull() & (F.col("parent_content") != ""),
            F.concat(F.lit("**Parent Context:**\n"), F.col("parent_content"), F.lit("\n\n")),
        ).otherwise(""),
        F.lit("**Target Content:**\n"), F.col("content"), F.lit("\n\n"),
        related,
        F.lit("\n*(Relevance: "), fixed(F.col("score") * 100, 2), F.lit("%)*\n"),
        F.lit("-" * 80 + "\n\n"),
    )
    return (
        results.select(query_id, "rank", section.alias("section"))
        .groupBy(query_id)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "section"))).alias("s"))
        .select(query_id, F.array_join("s.section", "\n").alias("context"))
    )


def chunk_by_section_id(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """First chunk of a document with exactly the referenced section id; null when there is none."""
    first = chunks.groupBy("document_id", "section_id").agg(
        F.min_by(F.struct("chunk_id", "content"), F.struct("position", "chunk_id")).alias("_c")
    )
    return refs.join(first, ["document_id", "section_id"], "left").select(
        *refs.columns, F.col("_c.chunk_id").alias("chunk_id"), F.col("_c.content").alias("content")
    )


def chunks_in_order(chunks: DataFrame, document_id) -> DataFrame:
    return chunks.filter(F.col("document_id") == F.lit(document_id)).orderBy("position")
