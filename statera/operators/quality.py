"""Corpus and retrieval quality: breakdowns, duplicates, coverage, hit metrics, the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import union_rows
from ..functions.text import fixed


def corpus_info(store: DataFrame, name: str) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("points_count")).select(
        F.lit(name).alias("name"),
        "points_count",
        F.when(F.col("points_count") > 0, "green").otherwise("empty").alias("status"),
    )


def corpus_breakdown(store: DataFrame, source: str = "source", doc_type: str = "type") -> DataFrame:
    """Counts and percent by source, by type and in total, in one pass over the store."""
    rows = store.groupingSets([[F.col(source)], [F.col(doc_type)], []], F.col(source), F.col(doc_type)).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")
    )
    dim = F.when(F.col("_g") == 1, "source").when(F.col("_g") == 2, "type").otherwise("total")
    value = F.when(F.col("_g") == 1, F.col(source)).when(F.col("_g") == 2, F.col(doc_type)).otherwise(F.lit("all"))
    # The window runs over the aggregated rows only: one per source and type.
    total = F.sum("n").over(Window.partitionBy("dimension"))
    return (
        rows.select(dim.alias("dimension"), value.alias("value"), "n")
        .withColumn("percent", F.col("n") * 100.0 / total)
    )


def breakdown_check(breakdown: DataFrame, expected: DataFrame) -> DataFrame:
    """Total against the expected one, the single row ``expected`` of a table."""
    n, expected_n = F.col("n"), F.col("expected")
    total = breakdown.filter(F.col("dimension") == "total").withColumn("_one", F.lit(1))
    return total.join(F.broadcast(expected.select("expected", F.lit(1).alias("_one"))), "_one").select(
        F.lit("vector_count_breakdown").alias("check"),
        F.when(n < expected_n * 0.9, "fail").when(n > expected_n * 1.2, "warn").otherwise("pass").alias("status"),
        n.cast("double").alias("value"),
    )


def duplicates(store: DataFrame, key: str) -> DataFrame:
    return store.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def duplicate_report(store: DataFrame, key: Column) -> DataFrame:
    per = store.select(key.alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(
        F.count(F.lit(1)).alias("distinct_ids"),
        F.count_if(F.col("c") > 1).alias("duplicate_ids"),
        (F.count_if(F.col("c") > 1) * 100.0 / F.count(F.lit(1))).alias("duplicate_percent"),
    )


def duplicate_sample(store: DataFrame, key: Column, k: int = 10) -> DataFrame:
    """The report's sample: the ``k`` ids with most copies."""
    per = store.select(key.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    return per.filter(F.col("copies") > 1).orderBy(F.desc("copies"), F.asc("id")).limit(k)


def missing_values(expected: DataFrame, store: DataFrame, column: str) -> DataFrame:
    """Expected values that the store lacks."""
    return expected.select(column).distinct().join(store.select(column).distinct(), column, "left_anti")


def coverage_report(store: DataFrame, expected: DataFrame, column: str) -> DataFrame:
    want = expected.select(column).distinct()
    have = store.select(column).distinct().withColumn("_in", F.lit(1))
    pct = F.count("_in") * 100.0 / F.count(F.lit(1))
    return want.join(have, column, "left").agg(
        F.count("_in").alias("found"), F.count(F.lit(1)).alias("expected"), pct.alias("coverage_percent")
    ).withColumn(
        "status",
        F.when(F.col("coverage_percent") >= 95, "pass").when(F.col("coverage_percent") >= 85, "warn").otherwise("fail"),
    )


def score_distribution(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Max, min, mean and mean of the ten best per query; ``rank`` starts at 1.

    The last one divides by ten, also when there are fewer results.
    """
    return hits.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("results"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.avg("score").alias("avg_score"),
        (F.coalesce(F.sum(F.when(F.col("rank") <= 10, F.col("score"))), F.lit(0.0)) / 10).alias("top_10_avg"),
    )


def filtered_retrieval_check(hits: DataFrame, queries: DataFrame, query_id: str = "query_id", floor: float = 0.5,
                             share: float = 0.8) -> DataFrame:
    top = hits.groupBy(query_id).agg(F.max("score").alias("top"))
    j = queries.select(query_id).join(top, query_id, "left")
    good = F.coalesce(F.col("top") > floor, F.lit(False))
    return j.agg(
        F.count(F.lit(1)).alias("queries_tested"),
        F.count_if(good).alias("passed"),
        F.avg("top").alias("avg_score"),
    ).withColumn("status", F.when(F.col("passed") >= F.col("queries_tested") * share, "pass").otherwise("fail"))


def cross_source_check(hits: DataFrame, queries: DataFrame, source: str, query_id: str = "query_id") -> DataFrame:
    """Two or more sources in the top ten give full credit, one source half, no result none."""
    n = hits.filter(F.col("rank") <= 10).groupBy(query_id).agg(F.count_distinct(source).alias("sources"))
    j = queries.select(query_id).join(n, query_id, "left")
    credit = F.when(F.col("sources") >= 2, 1.0).when(F.col("sources").isNotNull(), 0.5).otherwise(0.0)
    return j.agg(
        F.count(F.lit(1)).alias("queries_tested"), F.sum(credit).alias("credit")
    ).withColumn("status", F.when(F.col("credit") >= F.col("queries_tested") * 0.5, "pass").otherwise("fail"))


def is_relevant(text: Column, keywords: Column) -> Column:
    """At least half of the expected keywords occur."""
    low = F.lower(text)
    hits = F.size(F.filter(keywords, lambda k: low.contains(F.lower(k))))
    return hits >= F.size(keywords) * 0.5


def retrieval_metrics(hits: DataFrame, expected: DataFrame, min_score: float, query_id: str = "query_id",
                      text: str = "text") -> DataFrame:
    """Precision, recall (of 3) and reciprocal rank per query; queries without hits get zeros."""
    judged = hits.join(expected.select(query_id, "keywords"), query_id).withColumn(
        "_rel", (F.col("score") >= min_score) & is_relevant(F.coalesce(F.col(text), F.lit("")), F.col("keywords"))
    )
    rel = lambda k: F.count_if(F.col("_rel") & (F.col("rank") <= k))
    per = judged.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("results"),
        F.max("score").alias("top_score"),
        rel(5).alias("_r5"),
        rel(10).alias("_r10"),
        F.min(F.when(F.col("_rel"), F.col("rank"))).alias("_first"),
    )
    j = expected.select(query_id).join(per, query_id, "left")
    n = F.coalesce("results", F.lit(0))
    at = lambda c, k: F.when(n > 0, F.col(c) / F.least(F.lit(k), n)).otherwise(0.0)
    return j.select(
        query_id,
        n.alias("results"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        at("_r5", 5).alias("precision_at_5"),
        at("_r10", 10).alias("precision_at_10"),
        (F.coalesce("_r5", F.lit(0)) / 3.0).alias("recall_at_5"),
        (F.coalesce("_r10", F.lit(0)) / 3.0).alias("recall_at_10"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def keywords_found(hits: DataFrame, expected: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Expected keywords that occur in the five best results, and those that do not."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    top = hits.filter(F.col("rank") <= 5).join(expected.select(query_id, "keywords"), query_id)
    seen = top.select(query_id, F.explode(F.filter("keywords", lambda k: low.contains(F.lower(k)))).alias("k"))
    found = seen.groupBy(query_id).agg(F.array_sort(F.collect_set("k")).alias("found"))
    none = F.array().cast("array<string>")
    return expected.select(query_id, "keywords").join(found, query_id, "left").select(
        query_id,
        F.coalesce("found", none).alias("found"),
        F.array_except("keywords", F.coalesce("found", none)).alias("missing"),
    )


def retrieval_verdict(metrics: DataFrame, min_score: float) -> DataFrame:
    reason = (
        F.when(F.col("results") == 0, "No results returned")
        .when(F.col("top_score") < min_score, F.concat(F.lit("Top score "), fixed(F.col("top_score"), 4), F.lit(f" < threshold {min_score}")))
        .when(F.col("precision_at_5") < 0.4, F.concat(F.lit("Precision@5 "), fixed(F.col("precision_at_5"), 2), F.lit(" too low")))
        .when(F.col("reciprocal_rank") < 0.2, F.concat(F.lit("MRR "), fixed(F.col("reciprocal_rank"), 2), F.lit(" too low")))
    )
    return metrics.withColumn("failure_reason", reason).withColumn("passed", reason.isNull())


def retrieval_summary(verdicts: DataFrame, category: str = "category") -> DataFrame:
    """Pass rate and mean metrics by category and overall (category null)."""
    return verdicts.rollup(category).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        F.avg("precision_at_5").alias("precision_at_5"),
        F.avg("precision_at_10").alias("precision_at_10"),
        F.avg("recall_at_5").alias("recall_at_5"),
        F.avg("recall_at_10").alias("recall_at_10"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("top_score").alias("top_score"),
    )


def quality_gate(checks: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All checks (``check, status, value``) as one table, and the overall verdict."""
    table = union_rows(*checks)
    count = lambda s: F.count_if(F.col("status") == s)
    verdict = table.agg(
        count("pass").alias("passed"), count("fail").alias("failed"), count("warn").alias("warnings")
    ).withColumn("verdict", F.when(F.col("failed") == 0, "pass").otherwise("fail"))
    return table, verdict
