"""Answer audit: sentence by source matching, confidence and trust label, in one plan for all answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.domains import DomainPack, LanguagePack
from ..functions.ids import content_hash, short_hash
from ..functions.rows import exploded, union_rows
from ..session import cut_lineage
from .blocks import match_terms
from .sentences import analyze_answers, sentence_table
from .similarity import term_string


def match_sentences(sentences: DataFrame, sources: DataFrame, key: str, sentence_ids: list[str],
                    source_id: str = "source_id", threshold: float = scoring.SENTENCE_THRESHOLD,
                    k: int | None = 1, sizes: DataFrame | None = None) -> DataFrame:
    """Best sources of every sentence under the same key by term cosine.

    ``sentences``: key, ids, ``sentence``; ``sources``: key, id, ``text``. ``k=None`` returns the full
    score list of each sentence (as many rows as there are pairs, by its nature).
    """
    left = sentences.withColumn("terms", term_string(F.col("sentence")))
    right = sources.withColumn("terms", term_string(F.col("text")))
    hits = match_terms(left, right, key, sentence_ids, source_id, k, sizes=sizes)
    return hits.withColumn("verified", F.col("score") >= threshold)


def verify_answers(matches: DataFrame, answer_ids: list[str], threshold: float = scoring.SENTENCE_THRESHOLD) -> DataFrame:
    """Per answer from its best score per sentence: counts, rate, mean and the score signals."""
    low = (F.col("score") < threshold).cast("double")
    return matches.groupBy(*answer_ids).agg(
        F.count(F.lit(1)).alias("scored_sentences"),
        F.count_if(F.col("score") >= threshold).alias("verified_sentences"),
        F.avg("score").alias("mean_score"),
        F.var_samp("score").alias("score_variance"),
        F.avg(low).alias("low_share"),
    )


def source_signals(sources: DataFrame, key: str, source_id: str = "source_id", score: str = "score") -> DataFrame:
    """Per key: number of sources and the three best retrieval scores (0.5 where none is given)."""
    scored = sources.select(key, source_id, F.coalesce(F.col(score), F.lit(0.5)).alias("_s"))
    w = Window.partitionBy(key).orderBy(F.desc("_s"), F.asc(source_id))
    top = (
        scored.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= 3)
        .groupBy(key)
        .agg(F.collect_list("_s").alias("top_scores"))
    )
    n = scored.groupBy(key).agg(F.count(F.lit(1)).alias("source_count"))
    return n.join(top, key)


def source_fingerprints(sources: DataFrame, key: str, source_id: str = "source_id") -> DataFrame:
    """Link rows (key, source, full hash, display hash) instead of one unbounded list per audit."""
    return sources.select(
        key, source_id, content_hash(F.col("text")).alias("source_hash"), short_hash(F.col("text")).alias("fingerprint")
    )


def _scored(base: DataFrame, threshold: float, weights, overall: float) -> DataFrame:
    n = F.coalesce(F.col("scored_sentences"), F.lit(0))
    verified = F.coalesce(F.col("verified_sentences"), F.lit(0))
    error = F.when(F.col("total_sentences") == 0, "no_sentences").when(F.col("source_count").isNull(), "no_sources")
    ok = error.isNull()

    def part(c: Column) -> Column:
        return F.when(ok, c).otherwise(F.lit(0.0))

    parts = {
        "semantic_similarity": part(
            scoring.semantic_score(F.col("mean_score"), F.col("score_variance"), n, F.col("low_share"))
        ),
        "retrieval_quality": part(scoring.retrieval_score(F.col("top_scores"))),
        "citation_presence": part(scoring.citation_score(F.size("citations"))),
        "coverage": part(scoring.coverage_score(verified, n)),
    }
    conf = part(scoring.confidence(parts, weights))
    out = base.withColumn("error", error)
    for name, c in parts.items():
        out = out.withColumn(name, c)
    return (
        out.withColumn("verified_sentences", verified)
        .withColumn("verification_rate", F.col("coverage"))
        .withColumn("confidence_score", conf)
        .withColumn("verified", (F.col("confidence_score") >= overall) & ok)
        .withColumn("trust_label", F.when(ok, scoring.trust_label(F.col("confidence_score"), overall)).otherwise(scoring.REJECTED))
        .withColumn("source_count", F.coalesce("source_count", F.lit(0)))
    )


def audit_batch(answers: DataFrame, sources: DataFrame, key: str, answer_ids: list[str], text: str,
                language: LanguagePack, domain: DomainPack, threshold: float = scoring.SENTENCE_THRESHOLD,
                overall: float = scoring.OVERALL_THRESHOLD, weights: dict[str, float] | None = None) -> DataFrame:
    """Audit all answers against the sources that share their key.

    ``key`` may be the answer id, or a wider group when answers share their sources (then the sources
    are not copied per answer). An answer without sentences or sources is rejected with a reason.
    """
    analysed = analyze_answers(answers, answer_ids, text, language, domain)
    rows = exploded(
        analysed, list(dict.fromkeys([key, *answer_ids])), F.col("sentences"), "sentence_index", "sentence"
    )
    # A sentence has about forty characters; counting them exactly would split all texts once more.
    sizes = answers.select(key, (F.floor(F.length(text) / 40) + 1).alias("rows"))
    best = match_sentences(rows, sources, key, [*answer_ids, "sentence_index"], threshold=threshold, sizes=sizes)
    base = (
        analysed.drop("sentences")
        .join(verify_answers(best, answer_ids, threshold), answer_ids, "left")
        .join(source_signals(sources, key), key, "left")
        .withColumn("answer_hash", content_hash(F.col(text)))
    )
    cols = [
        *answer_ids, "answer_hash", "total_sentences", "total_tokens", "has_citations", "citations", "source_count",
        "verified_sentences", "verification_rate", "semantic_similarity", "retrieval_quality",
        "citation_presence", "coverage", "confidence_score", "verified", "trust_label", "error",
    ]
    extra = [c for c in (key, text) if c not in cols]
    return _scored(base, threshold, weights, overall).select(*extra, *cols)


def audit_with_retry(answers: DataFrame, rounds: list[DataFrame], key: str, answer_ids: list[str], text: str,
                     language: LanguagePack, domain: DomainPack, max_retries: int = 2,
                     retry_below: float = scoring.REVIEW_THRESHOLD, **kwargs) -> DataFrame:
    """Audit; answers below the retry threshold are audited again with the next (wider) source table.

    ``rounds[0]`` serves the first attempt. Each round keeps its finished answers and hands only the
    rest on, so a round's work shrinks; the table between rounds is checkpointed, not recomputed.
    """
    todo, done = answers, None
    last = min(max_retries, len(rounds) - 1)
    for attempt, sources in enumerate(rounds[: last + 1]):
        result = cut_lineage(
            audit_batch(todo, sources, key, answer_ids, text, language, domain, **kwargs).withColumn(
                "retry_attempts", F.lit(attempt)
            )
        )
        final = result if attempt == last else result.filter(~scoring.should_retry(F.col("confidence_score"), retry_below))
        done = final if done is None else union_rows(done, final)
        if attempt < last:
            low = result.filter(scoring.should_retry(F.col("confidence_score"), retry_below))
            todo = answers.join(low.select(*answer_ids), answer_ids, "left_semi")
    return done


def explain_confidence(audits: DataFrame) -> DataFrame:
    parts = {n: F.col(n) for n in scoring.WEIGHTS}
    return audits.withColumn(
        "explanation",
        scoring.explain(
            F.col("confidence_score"), F.col("trust_label"), parts, F.col("verified_sentences"), F.col("total_sentences")
        ),
    )


__all__ = [
    "audit_batch", "audit_with_retry", "explain_confidence", "match_sentences", "sentence_table",
    "source_fingerprints", "source_signals", "verify_answers",
]
