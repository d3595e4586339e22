"""Section markers, spans, hierarchy and numbered chunks. All of it stays within the row of a text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, matches, running_max
from ..functions.rows import bounded_batches, exploded, once
from ..functions.text import strip, unicode_ws, word_count
from .chunking import section_pieces

# Marker forms with their type and level.
GERMAN_MARKERS = (
    (r"§\s*(\d+(?:\.\d+)*[a-z]?)\s*", "section", 0),
    (r"Artikel\s+(\d+(?:\.\d+)*[a-z]?)\s*", "section", 0),
    (r"Absatz\s+(\d+)", "subsection", 1),
    (r"Abs\.\s*(\d+)", "subsection", 1),
    (r"Ziffer\s+(\d+\.?\d*)", "clause", 2),
    (r"Ziff\.\s*(\d+\.?\d*)", "clause", 2),
    (r"Nr\.\s*(\d+\.?\d*)", "clause", 2),
    (r"Nummer\s+(\d+\.?\d*)", "clause", 2),
    (r"Buchstabe\s+([a-z])", "paragraph", 3),
    (r"lit\.\s*([a-z])", "paragraph", 3),
    (r"\(([a-z])\)", "paragraph", 3),
)

# Heading markers of web pages, the same idea for markup.
PAGE_MARKERS = (
    (r"<h1[^>]*>", "section", 0),
    (r"<p[^>]*>", "subsection", 1),
    (r"<b>", "clause", 2),
)

def extract_markers(c: Column, markers=GERMAN_MARKERS) -> Column:
    """All marker matches with offsets, in order of their start, those of earlier forms first."""

    def form(i: int, pattern: str, kind: str, level: int) -> Column:
        def hit(m: Column) -> Column:
            return F.struct(
                m["start"].alias("start"), F.lit(i).alias("form"), m["stop"].alias("stop"), strip(m["text"]).alias("section_id"),
                F.lit(level).alias("level"), F.lit(kind).alias("chunk_type"),
            )

        return F.transform(matches(c, "(?iu)" + unicode_ws(pattern)), hit)

    hits = F.array_sort(F.concat(*[form(i, *m) for i, m in enumerate(markers)]))
    return F.transform(hits, lambda h: F.struct(*[h[n].alias(n) for n in ("start", "stop", "section_id", "level", "chunk_type")]))


def section_spans(c: Column, markers: Column) -> Column:
    """Text between a marker and the next one; empty sections are left out."""

    def span(m: Column, i: Column) -> Column:
        following = F.get(markers, i + 1)
        stop = F.coalesce(following["start"], F.length(c))
        return F.struct(
            m["section_id"].alias("section_id"),
            strip(F.substring(c, m["stop"] + 1, F.greatest(stop - m["stop"], F.lit(0)))).alias("content"),
            m["level"].alias("level"),
            m["chunk_type"].alias("chunk_type"),
        )

    return F.filter(F.transform(markers, span), lambda s: s["content"] != "")


def section_parents(levels: Column, depth: int = 4) -> Column:
    """Position of the nearest preceding section of a lower level (array<int>, null at the top): the greatest of the
    last positions seen so far of the levels below one's own."""

    def last_of(level: int) -> Column:
        return running_max(F.transform(levels, lambda lv, i: F.when(lv == level, i).otherwise(-1)))

    def pick(last: Column) -> Column:
        def parent(lv: Column, i: Column) -> Column:
            seen = [F.when(lv > level, F.get(last[f"l{level}"], i)).otherwise(-1) for level in range(depth - 1)]
            top = F.greatest(*seen, F.lit(-1))
            return F.when(top >= 0, top).cast("int")

        return F.transform(levels, parent)

    if depth < 2:
        return F.transform(levels, lambda lv: F.lit(None).cast("int"))
    return let(F.struct(*[last_of(level).alias(f"l{level}") for level in range(depth - 1)]), pick)


def parse_sections(df: DataFrame, doc_id: str, text: Column, markers=GERMAN_MARKERS) -> DataFrame:
    """One row per section: position, id, content, level, type and position of the parent."""
    depth = max(lv for _, _, lv in markers) + 1
    staged = (
        df.select(F.col(doc_id), text.alias("_text"))
        .select(doc_id, once(let(extract_markers(F.col("_text"), markers), lambda m: section_spans(F.col("_text"), m))).alias("_sections"))
        .withColumn("_parents", section_parents(F.col("_sections.level"), depth))
    )
    return exploded(staged, [doc_id], F.arrays_zip("_sections", "_parents"), "position", "_s").select(
        doc_id,
        "position",
        F.col("_s._sections.section_id").alias("section_id"),
        F.col("_s._sections.content").alias("content"),
        F.col("_s._sections.level").alias("level"),
        F.col("_s._sections.chunk_type").alias("chunk_type"),
        F.col("_s._parents").alias("parent_position"),
    )


def split_sections(contents: Column, size: int = 1000, overlap: int = 100) -> Column:
    """array<array<string>>: the pieces of every section of a document; null where none is longer than ``size``, so that
    only documents with something to cut travel to Python."""

    @F.pandas_udf("array<array<string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(
            lambda parts: [section_pieces(p, size, overlap) if len(p) > size else [p] for p in parts],
            na_action="ignore",
        )

    return run(F.when(F.exists(contents, lambda p: F.length(p) > size), contents))


def number_chunks(df: DataFrame, doc_id: str, text: Column, markers=GERMAN_MARKERS, size: int = 1000,
                  overlap: int = 100) -> DataFrame:
    """Sections and their splits under one running position per document."""
    staged = (
        bounded_batches(df).select(F.col(doc_id), text.alias("_text"))
        .select(doc_id, once(let(extract_markers(F.col("_text"), markers), lambda m: section_spans(F.col("_text"), m))).alias("_sections"))
        .withColumn("_pieces", split_sections(F.col("_sections.content"), size, overlap))
    )

    def spread(s: Column, i: Column) -> Column:
        pieces = F.coalesce(F.get(F.col("_pieces"), i), F.array(s["content"]))
        split = F.size(pieces) > 1
        return F.transform(
            pieces,
            lambda p, j: F.struct(
                F.when(split, F.concat(s["section_id"], F.lit("_"), j)).otherwise(s["section_id"]).alias("section_id"),
                p.alias("content"),
                s["chunk_type"].alias("chunk_type"),
                split.alias("is_split"),
                F.when(split, j).alias("split_index"),
                F.when(split, s["section_id"]).alias("parent_section_id"),
            ),
        )

    flat = F.flatten(F.transform("_sections", spread))
    return (
        exploded(staged, [doc_id], flat, "position", "_c")
        .select(doc_id, "position", "_c.*")
        .withColumn("char_count", F.length("content"))
        .withColumn("word_count", word_count(F.col("content")))
    )


def extract_section_ids(c: Column, markers=GERMAN_MARKERS) -> Column:
    """Sorted distinct section ids in free text."""
    found = [F.regexp_extract_all(c, F.lit("(?i)" + unicode_ws(p)), F.lit(0)) for p, _, _ in markers]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found), strip)))


def search_in_sections(df: DataFrame, term: str, content: str = "content", title: str = "section_id") -> DataFrame:
    needle = term.lower()
    return df.filter(
        F.lower(F.col(content)).contains(needle) | F.lower(F.coalesce(F.col(title), F.lit(""))).contains(needle)
    )
