"""Citations of an answer matched to retrieved chunks, unsupported claims, answer verdict.

Everything an answer says (citations, sentences) is bounded by its text and stays in its row as an
array. Hits are joined to that row; only matches leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import exploded
from ..functions.text import WS, contains_any, cut, strip, words
from ..functions.vectors import jaccard

MISSING = "[Citation not found in retrieved sections]"

# Words that make a sentence a claim (matched as substrings).
CLAIM_WORDS = (
    "must", "shall", "muss", "ist", "hat", "kann", "darf",
    "requires", "states", "provides", "besagt", "regelt",
)
CLAIM_SPLIT = f"[.!?]{WS}+"
MARKER = f"§{WS}*[0-9]+\\.?[0-9]*"


def word_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def match_citations(answers: DataFrame, hits: DataFrame, key: str = "answer_id") -> DataFrame:
    """First hit in rank order whose section id or content contains the cited id.

    ``answers``: key, ``text``, ``citations`` (array). ``hits``: key, ``rank``, ``chunk_id``,
    ``section_id``, ``content``, ``similarity``. Citations without a hit keep null chunk columns.
    """
    held = answers.select(key, "citations")
    i = F.lower(F.coalesce("section_id", F.lit("")))
    t = F.lower(F.coalesce("content", F.lit("")))
    found = F.filter("citations", lambda c: i.contains(F.lower(c)) | t.contains(F.lower(c)))
    matched = exploded(
        hits.join(held, key), [key, "rank", "chunk_id", "content", "similarity"], found, "n", "citation"
    ).drop("n")
    first = matched.groupBy(key, "citation").agg(
        F.min_by(F.struct("chunk_id", "content", "similarity", "rank"), F.struct("rank", "chunk_id")).alias("_hit")
    )
    cited = held.select(key, F.explode("citations").alias("citation"))
    return cited.join(first, [key, "citation"], "left").select(key, "citation", "_hit.*")


def citation_confidence(answers: DataFrame, hits: DataFrame, key: str = "answer_id") -> DataFrame:
    """Similarity of the matched chunk, +0.15 per citing sentence that shares most of its words, at most 1."""
    matched = match_citations(answers, hits, key)
    j = matched.join(answers.select(key, "text"), key)
    sentences = F.filter(
        F.split("text", CLAIM_SPLIT), lambda s: F.lower(s).contains(F.lower(F.col("citation")))
    )
    chunk_words = word_set(F.col("content"))
    backing = F.size(
        F.filter(sentences, lambda s: jaccard(word_set(strip(F.regexp_replace(s, MARKER, ""))), F.col("_w")) > 0.5)
    )
    boosted = F.least(F.lit(1.0), F.col("similarity") + F.col("_n") * 0.15)
    value = F.when(F.col("chunk_id").isNull(), F.lit(0.0)).when(F.col("_n") > 0, boosted).otherwise(F.col("similarity"))
    return (
        j.withColumn("_w", chunk_words)
        .withColumn("_n", F.when(F.col("chunk_id").isNotNull(), backing).otherwise(0))
        .select(
            key, "citation", "chunk_id", "rank",
            F.when(F.col("chunk_id").isNull(), F.lit(MISSING)).otherwise(F.col("content")).alias("content"),
            value.alias("confidence"),
        )
    )


def unsupported_claims(answers: DataFrame, citations: DataFrame, key: str = "answer_id") -> DataFrame:
    """Claim sentences (5 words or more) that hold no citation of confidence above 0.5."""
    # At most one row per citation of the answer's own text, so the list is bounded by the text.
    strong = citations.filter(F.col("confidence") > 0.5).groupBy(key).agg(F.collect_set("citation").alias("_ok"))
    rows = exploded(answers, [key], F.split("text", CLAIM_SPLIT), "sentence_index", "sentence")
    claims = rows.filter((F.size(words(F.col("sentence"))) >= 5) & contains_any(F.lower("sentence"), CLAIM_WORDS))
    j = claims.join(strong, key, "left")
    supported = F.exists(F.coalesce("_ok", F.array().cast("array<string>")), lambda c: F.col("sentence").contains(c))
    return j.filter(~supported).select(key, "sentence_index", strip(F.col("sentence")).alias("sentence"))


def verify_citations(answers: DataFrame, hits: DataFrame, key: str = "answer_id", verdicts: DataFrame | None = None) -> DataFrame:
    """Per answer: mean citation confidence (0.5 without citations), x 0.6 with unsupported claims.

    ``verdicts`` (key, ``is_supported``) is an outside check that can only take support away.
    """
    cited = citation_confidence(answers, hits, key)
    per = cited.groupBy(key).agg(
        F.avg("confidence").alias("_mean"),
        F.count(F.lit(1)).alias("citations"),
        F.count_if(F.col("confidence") > 0.7).alias("strong_citations"),
    )
    bad = unsupported_claims(answers, cited, key).groupBy(key).agg(F.count(F.lit(1)).alias("unsupported"))
    out = answers.select(key).join(per, key, "left").join(bad, key, "left")
    n = F.coalesce("unsupported", F.lit(0))
    supported = n == 0
    if verdicts is not None:
        out = out.join(verdicts.select(key, F.col("is_supported").alias("_ext")), key, "left")
        supported = supported & F.coalesce("_ext", F.lit(True))
    return out.select(
        key,
        supported.alias("is_supported"),
        F.coalesce("citations", F.lit(0)).alias("citations"),
        F.coalesce("strong_citations", F.lit(0)).alias("strong_citations"),
        n.alias("unsupported"),
        (F.coalesce("_mean", F.lit(0.5)) * F.when(n > 0, 0.6).otherwise(1.0)).alias("confidence"),
    )


__all__ = ["citation_confidence", "cut", "match_citations", "unsupported_claims", "verify_citations", "word_set"]
