"""API and page records to corpus rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import computed, exploded, once, union_rows
from ..functions.text import INVISIBLE, decode_markup, html_to_text, normalize_text, strip, text_nodes


def _filled(*cs: str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cs])


#: Records with less text than this are no corpus rows; ``rejected_records`` says which.
LEAST = 50


def _case_text() -> Column:
    return F.coalesce(html_to_text(F.col("content")), F.lit(""))


def _law_text() -> Column:
    return F.coalesce(html_to_text(F.when(F.col("content") != "", F.col("content"))), F.col("text"), F.lit(""))


def _court_text() -> Column:
    head = F.coalesce("leitsatz", F.lit(""))
    body = F.coalesce(_filled("text", "volltext"), F.lit(""))
    return F.concat_ws(
        "\n\n",
        F.when(head != "", F.concat(F.lit("Leitsatz: "), head)),
        F.when(body != "", F.concat(F.lit("\n\n"), body)),
    )


def _case_id() -> Column:
    return F.coalesce("slug", F.concat(F.lit("case-"), F.col("id")))


def _law_id() -> Column:
    return F.coalesce("slug", F.concat(F.lit("law-"), F.col("id")))


def _court_id() -> Column:
    return F.regexp_replace(F.concat_ws("-", "court", _filled("aktenzeichen", "id")), "[/ ]", "-")


def rejected_records(df: DataFrame, kind: str, least: int = LEAST) -> DataFrame:
    """The records of a kind (case, law or court) that its normaliser leaves out: doc_id and reason."""
    ids, texts = {"case": (_case_id, _case_text), "law": (_law_id, _law_text), "court": (_court_id, _court_text)}[kind]
    return short_texts(df.select(ids().alias("doc_id"), once(texts()).alias("text")), ["doc_id"], least)


def short_texts(df: DataFrame, keep: list[str], least: int, text: str = "text") -> DataFrame:
    """Rows with too little text, and why: no text, or fewer than so many characters."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    reason = F.when(n == 0, "no text").otherwise(f"fewer than {least} characters")
    return df.filter(n < least).select(*keep, reason.alias("reason"))


def normalize_case_records(df: DataFrame, base_url: str = "") -> DataFrame:
    text = _case_text()
    na = lambda c: F.coalesce(F.col(c), F.lit("N/A"))
    return (
        computed(df, "_text", text, lambda t: F.length(t) >= LEAST)
        .select(
            _case_id().alias("doc_id"),
            F.concat_ws(
                " - ", F.coalesce("court.name", F.lit("Unknown Court")), na("file_number"), na("date")
            ).alias("title"),
            F.col("_text").alias("text"),
            F.concat(F.lit(f"{base_url}/case/"), F.coalesce("slug", F.lit(""))).alias("url"),
            F.lit("case").alias("type"),
            F.lit("DE").alias("jurisdiction"),
            F.upper(F.coalesce("court.slug", F.lit("unknown"))).alias("court"),
            F.col("file_number").alias("case_id"),
            "date",
            F.col("type").alias("decision_type"),
        )
    )


def normalize_law_records(df: DataFrame, base_url: str = "") -> DataFrame:
    text = _law_text()
    abbreviation = F.coalesce("abbreviation", F.upper(F.coalesce("slug", F.lit("Unknown"))))
    return (
        computed(df, "_text", text, lambda t: F.length(t) >= LEAST)
        .select(
            _law_id().alias("doc_id"),
            F.concat_ws(" - ", abbreviation, F.coalesce(F.col("title"), abbreviation)).alias("title"),
            F.col("_text").alias("text"),
            F.concat(F.lit(f"{base_url}/law/"), F.coalesce("slug", F.lit(""))).alias("url"),
            F.lit("statute").alias("type"),
            F.lit("DE").alias("jurisdiction"),
            abbreviation.alias("law"),
            F.col("latest_date").alias("date"),
        )
    )


def normalize_court_records(df: DataFrame, base_url: str = "") -> DataFrame:
    case_id = _filled("aktenzeichen", "id")
    title = F.coalesce(_filled("title", "leitsatz"), F.lit(""))
    return (
        computed(df, "_text", _court_text(), lambda t: F.length(t) >= LEAST)
        .select(
            _court_id().alias("doc_id"),
            # The headnote serves as the title when there is none.
            title.alias("title"),
            F.col("_text").alias("text"),
            F.coalesce(_filled("url"), F.concat(F.lit(f"{base_url}/u/"), case_id)).alias("url"),
            F.lit("case").alias("type"),
            F.lit("DE").alias("jurisdiction"),
            "court",
            case_id.alias("case_id"),
            F.coalesce(_filled("datum", "date"), F.lit("")).alias("date"),
        )
    )


def extract_sections_from_pages(df: DataFrame, keep: list[str], html: str = "html", element: str = "p",
                                min_chars: int = 20) -> DataFrame:
    """Text of the page's paragraph elements joined by blank lines; short pages are dropped.

    An element ends at its closing tag or where the next one begins.
    """
    return computed(df, "text", _page_text(html, element), lambda t: F.length(t) >= min_chars).select(*keep, "text")


def rejected_pages(df: DataFrame, keep: list[str], html: str = "html", element: str = "p", min_chars: int = 20) -> DataFrame:
    """The pages that ``extract_sections_from_pages`` drops, and why."""
    return short_texts(df.select(*keep, once(_page_text(html, element)).alias("text")), keep, min_chars)


def _page_text(html: str, element: str) -> Column:
    visible = F.regexp_replace(html, INVISIBLE, "")
    parts = F.split(visible, f"(?i)<{element}(?: [^>]*)?>")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    inner = F.transform(parts, lambda p: F.array_join(text_nodes(F.get(F.split(p, f"(?i)</{element}>", 2), F.lit(0))), ""))
    return decode_markup(F.array_join(F.filter(inner, lambda p: p != ""), "\n\n"))


LINK = r"(?is)<a\b[^>]*\bhref=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def extract_toc_links(df: DataFrame, keep: list[str], html: str = "html", marker: str = "__") -> DataFrame:
    """Links whose href holds the marker: id (behind the marker, no ``.html``), title and href."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))
    titles = F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(2))
    links = exploded(df, keep, F.arrays_zip(hrefs.alias("href"), titles.alias("title")), "link_no", "l")
    section = F.replace(F.get(F.split(F.col("l.href"), f"\\Q{marker}\\E"), F.lit(1)), F.lit(".html"), F.lit(""))
    return (
        links.filter(F.col("l.href").contains(marker))
        .select(
            *keep, "link_no", section.alias("section_id"),
            strip(F.regexp_replace(F.col("l.title"), "<[^>]+>", "")).alias("title"),
            F.col("l.href").alias("href"),
        )
        .filter(F.col("title") != "")
    )


def normalize_corpus(df: DataFrame, min_len: int = 20, use_nfc: bool = True) -> DataFrame:
    """Normalise text and title, drop what is too short afterwards."""
    out = computed(df, "text", normalize_text(F.col("text"), use_nfc), lambda t: F.length(t) >= min_len)
    if "title" in df.columns:
        out = out.withColumn("title", normalize_text(F.col("title"), use_nfc))
    return out


def statutes_to_corpus(df: DataFrame, created: Column | None = None) -> DataFrame:
    return df.select(
        "source", "type", F.col("slug").alias("doc_id"), "slug", "title", F.col("content").alias("text"), "url",
        (created if created is not None else F.current_date().cast("string")).alias("created_date"),
        F.lit("DE").alias("jurisdiction"), F.col("slug").alias("law"),
    )


def eu_to_corpus(df: DataFrame, created: Column | None = None) -> DataFrame:
    return df.select(
        F.lit("eurlex").alias("source"), F.coalesce("type", F.lit("eu_law")).alias("type"), "doc_id",
        F.col("doc_id").alias("slug"), "title", "text", "url",
        (created if created is not None else F.current_date().cast("string")).alias("created_date"),
        F.coalesce("jurisdiction", F.lit("EU")).alias("jurisdiction"),
        "concepts",
    )


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Sources with different columns as one table; what a source lacks is null."""
    return union_rows(*dfs, fill=True)
