"""Page text: text-layer quality, merge of embedded and recognised text, recognition reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed, strip

QUALITIES = ("excellent", "good", "poor", "none", "unknown")


def text_layer_quality(pages: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    has_text = F.length(strip(F.coalesce(F.col(text), F.lit("")))) > 10
    share = F.avg(has_text.cast("double")) * 100
    out = pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.sum(has_text.cast("long")).alias("pages_with_text"),
        share.alias("_share"),
        F.sum(F.when(has_text, F.length(text)).otherwise(0)).alias("total_chars"),
    )
    quality = (
        F.when(F.col("_share") >= 90, "excellent")
        .when(F.col("_share") >= 70, "good")
        .when(F.col("_share") > 0, "poor")
        .otherwise("none")
    )
    return (
        out.withColumn("text_coverage_pct", F.round("_share", 2))
        .withColumn("text_layer_quality", quality)
        .withColumn("needs_ocr", F.col("text_layer_quality").isin("poor", "none"))
        .drop("_share")
    )


def merge_pages(embedded: DataFrame, ocr: DataFrame, quality: Column, threshold: float = 0.75,
                *, order: Column) -> DataFrame:
    """Choose the text of every page. ``quality`` is the document's text-layer quality (nullable).

    ``embedded``: doc_id, page_num, text (+ quality inputs). ``ocr``: doc_id, page_num, full_text,
    avg_confidence, error; rows with an error do not count. Of several rows of a page the last by ``order`` (when
    it was read) wins, of equally late ones the most confident.
    """
    rank = F.struct(order, "avg_confidence", "full_text")
    usable = (
        ocr.filter(F.coalesce(F.col("error"), F.lit("")) == "")
        .groupBy("doc_id", "page_num")
        .agg(F.max_by(F.struct("full_text", "avg_confidence"), rank).alias("_o"))
    )
    j = embedded.withColumn("_q", F.lower(quality)).withColumn("_raw", quality).join(
        usable, ["doc_id", "page_num"], "left"
    )
    q, conf, ocr_text = F.col("_q"), F.col("_o.avg_confidence"), F.col("_o.full_text")
    two = lambda c: fixed(c, 2)
    given = F.coalesce(F.col("_raw"), F.lit("")) != ""
    rules = [
        (F.col("_o").isNull(), F.col("text"), "embedded", F.lit(0.9), F.lit("No OCR result available")),
        (
            given & ~q.isin(*QUALITIES), F.col("text"), "embedded", F.lit(0.8),
            F.concat(F.lit("Unknown quality '"), F.col("_raw"), F.lit("' - using embedded")),
        ),
        (given & (q == "excellent"), F.col("text"), "embedded", F.lit(0.95), F.lit("Embedded quality: excellent")),
        (given & (q == "good"), F.col("text"), "embedded", F.lit(0.85), F.lit("Embedded quality: good")),
        (given & (q == "none"), ocr_text, "ocr", conf, F.lit("No embedded text")),
        (
            given & (q == "poor") & (conf >= threshold), ocr_text, "ocr", conf,
            F.concat(F.lit("OCR conf ("), two(conf), F.lit(") > threshold")),
        ),
        (
            given & (q == "poor"), F.col("text"), "fallback", F.lit(0.6),
            F.concat(F.lit("Low OCR conf ("), two(conf), F.lit(")")),
        ),
    ]
    choice = F.when(
        F.lit(False), F.struct(F.lit("").alias("text"), F.lit("").alias("source"), F.lit(0.0).alias("confidence"), F.lit("").alias("reason"))
    )
    for cond, text, source, c, reason in rules:
        choice = choice.when(
            cond, F.struct(text.alias("text"), F.lit(source).alias("source"), c.alias("confidence"), reason.alias("reason"))
        )
    choice = choice.otherwise(
        F.struct(
            F.col("text").alias("text"), F.lit("embedded").alias("source"), F.lit(0.7).alias("confidence"),
            F.lit("Unknown quality").alias("reason"),
        )
    )
    return j.withColumn("_m", choice).select("doc_id", "page_num", "_m.*")


def merge_report(merged: DataFrame) -> DataFrame:
    """Per document: pages per source and mean confidence."""
    count = lambda s: F.count_if(F.col("source") == s)
    return merged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        count("embedded").alias("embedded"),
        count("ocr").alias("ocr"),
        count("hybrid").alias("hybrid"),
        count("fallback").alias("fallback"),
        F.avg("confidence").alias("avg_confidence"),
    )


def merged_text(merged: DataFrame, pages_per_part: int = 1000, text: str = "text") -> DataFrame:
    """Joined page text in parts of a bounded number of pages, so no document becomes one row without end."""
    return (
        merged.filter(F.coalesce(F.col(text), F.lit("")) != "")
        .withColumn("part", F.floor(F.col("page_num") / pages_per_part).cast("long"))
        .groupBy("doc_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("page_num", F.col(text).alias("t")))).alias("p"))
        .select("doc_id", "part", F.array_join("p.t", "\n\n").alias("full_text"))
    )


def ocr_page(regions: DataFrame) -> DataFrame:
    """Page figures from recognised regions (text, confidence, region_type)."""
    typed = F.avg((F.col("region_type") == "typed").cast("double")) * 100
    hand = F.avg((F.col("region_type") == "handwritten").cast("double")) * 100
    return regions.groupBy("doc_id", "page_num").agg(
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        typed.alias("typed_text_pct"),
        hand.alias("handwritten_text_pct"),
        F.count(F.lit(1)).alias("regions_count"),
    )


def ocr_document(pages: DataFrame) -> DataFrame:
    """Document means over the pages without an error, and the number of failed ones."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    return pages.groupBy("doc_id").agg(
        F.avg(F.when(ok, F.col("avg_confidence"))).alias("avg_confidence"),
        F.avg(F.when(ok, F.col("typed_text_pct"))).alias("typed_text_pct"),
        F.avg(F.when(ok, F.col("handwritten_text_pct"))).alias("handwritten_text_pct"),
        F.count_if(ok).alias("pages_processed"),
        F.count_if(~ok).alias("pages_failed"),
    )


def ocr_errors(pages: DataFrame) -> DataFrame:
    """One row per failed page."""
    return pages.filter(F.coalesce(F.col("error"), F.lit("")) != "").select(
        "doc_id", "page_num",
        F.concat(F.lit("Page "), F.col("page_num").cast("string"), F.lit(": "), F.col("error")).alias("message"),
    )
