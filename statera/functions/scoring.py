"""Confidence scoring as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fixed

# Signal weights, thresholds and labels.
WEIGHTS = {
    "semantic_similarity": 0.60,
    "retrieval_quality": 0.25,
    "citation_presence": 0.10,
    "coverage": 0.05,
}
SENTENCE_THRESHOLD = 0.75
OVERALL_THRESHOLD = 0.80
REVIEW_THRESHOLD = 0.60
VERIFIED = "✅ Verified"
REVIEW = "⚠️ Review"
REJECTED = "🚫 Rejected"


def strict_threshold(value: float, strict: bool) -> float:
    return min(1.0, value + 0.05) if strict else value


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if abs(total - 1.0) > 0.01:
        raise ValueError(f"weights must sum to 1.0, got {total}")
    return weights


def semantic_score(mean: Column, variance: Column, n: Column, low_share: Column) -> Column:
    """Mean, minus a variance penalty (sample variance, at most 0.15), minus 0.2 x share of low scores."""
    spread = F.when(n > 1, F.least(F.lit(0.15), variance * 0.5)).otherwise(F.lit(0.0))
    return F.when(n > 0, F.greatest(F.lit(0.0), mean - spread - low_share * 0.20)).otherwise(F.lit(0.0))


def retrieval_score(top3: Column) -> Column:
    """Mean of the three best retrieval scores; ``top3`` may be longer and unsorted."""
    best = F.slice(F.sort_array(top3, asc=False), 1, 3)
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.coalesce(F.size(best), F.lit(0)) > 0, total / F.size(best)).otherwise(F.lit(0.5))


def citation_score(count: Column) -> Column:
    return (
        F.when(count <= 0, 0.3)
        .when(count == 1, 0.7)
        .when(count == 2, 0.85)
        .otherwise(F.least(F.lit(1.0), F.lit(0.85) + (count - 2) * 0.05))
    )


def coverage_score(verified: Column, total: Column) -> Column:
    return F.when(total > 0, verified / total).otherwise(F.lit(0.0))


def confidence(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    weights = check_weights(weights or WEIGHTS)
    total = F.lit(0.0)
    for name in WEIGHTS:
        total = total + parts[name] * F.lit(float(weights[name]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def trust_label(conf: Column, overall: float = OVERALL_THRESHOLD) -> Column:
    return (
        F.when(conf >= overall, VERIFIED).when(conf >= REVIEW_THRESHOLD, REVIEW).otherwise(REJECTED)
    )


def should_retry(conf: Column, threshold: float = REVIEW_THRESHOLD) -> Column:
    return conf < threshold


def explain(conf: Column, label: Column, parts: dict[str, Column], verified: Column, total: Column,
            weights: dict[str, float] | None = None) -> Column:
    """Readable breakdown of one score."""
    weights = weights or WEIGHTS
    names = {
        "semantic_similarity": "Semantic Similarity",
        "retrieval_quality": "Retrieval Quality",
        "citation_presence": "Citation Presence",
        "coverage": "Coverage",
    }
    lines = [F.concat(F.lit("Confidence: "), fixed(conf, 2), F.lit(" ("), label, F.lit(")\n")), F.lit("Component Breakdown:")]
    for key, name in names.items():
        lines.append(F.concat(F.lit(f"  • {name}: "), fixed(parts[key], 2), F.lit(f" (weight: {weights[key]:.0%})")))
    lines.append(F.lit("\nStatistics:"))
    lines.append(F.format_string("  • Verified Sentences: %d/%d", verified.cast("long"), total.cast("long")))
    lines.append(F.concat(F.lit("  • Verification Rate: "), fixed(coverage_score(verified, total) * 100, 1), F.lit("%")))
    lines.append(
        F.when(should_retry(conf), F.lit("\n⚠️ Recommendation: Retry with improved context"))
    )
    return F.concat_ws("\n", *lines)
