"""Sentences, their offsets and citations, and the per-answer analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domains import DomainPack, LanguagePack
from ..functions.arrays import let, matches
from ..functions.rows import exploded
from ..functions.text import WS, WS_CHARS, strip, word_count

SENTENCE_END = f"[.!?]+{WS}+"


def split_sentences(c: Column, min_len: int = 3) -> Column:
    parts = F.transform(F.split(c, SENTENCE_END), strip)
    return F.filter(parts, lambda s: F.length(s) >= min_len)


def sentence_spans(c: Column, min_len: int = 3) -> Column:
    """array<struct<sentence,start,stop>>: the places follow from the lengths of the sentence ends between them."""

    def spans(ends: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            begin = F.coalesce(F.get(ends, i - 1)["stop"], F.lit(0))
            kept = F.length(F.ltrim(part, F.lit(WS_CHARS)))
            start = begin + F.length(part) - kept
            s = strip(part)
            return F.struct(s.alias("sentence"), start.alias("start"), (start + F.length(s)).alias("stop"))

        return F.filter(F.transform(F.split(c, SENTENCE_END), one), lambda s: F.length(s["sentence"]) >= min_len)

    return let(matches(c, SENTENCE_END), spans)


def sentence_table(df: DataFrame, keys: list[str], text: str, language: LanguagePack, domain: DomainPack,
                   min_len: int = 3) -> DataFrame:
    """One row per sentence: index, offsets in the normalised text, tokens, citation flag."""
    staged = df.select(*keys, language.normalize(F.col(text)).alias("_norm"))
    return (
        exploded(staged, keys, sentence_spans(F.col("_norm"), min_len), "sentence_index", "_s")
        .select(*keys, "sentence_index", "_s.*")
        .withColumn("tokens", word_count(F.col("sentence")))
        .withColumn("has_citation", domain.has_citation(F.col("sentence")))
    )


def analyze_answers(df: DataFrame, keys: list[str], text: str, language: LanguagePack, domain: DomainPack,
                    min_len: int = 3) -> DataFrame:
    """Per answer: normalised text, sentences (array), totals and citations. No shuffle: it is all in the row."""
    staged = df.withColumn("normalized", language.normalize(F.col(text))).withColumn(
        "sentences", split_sentences(F.col("normalized"), min_len)
    )
    return (
        staged.withColumn("total_sentences", F.size("sentences"))
        .withColumn(
            "total_tokens",
            F.aggregate("sentences", F.lit(0), lambda n, s: n + word_count(s)),
        )
        .withColumn("citations", domain.citations(F.col(text)))
        .withColumn("has_citations", F.size("citations") > 0)
    )
