"""Page merge reports, corpus and retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rows import union_rows
from ..operators import pages, quality, similarity
from .catalog import query, sql_strip, table
from .retrieval import QUERIES, SCORE, _store, label_means

# Orders are pages of the document of their customer; the market segment stands for the quality of
# the document's text layer, price for the recognition confidence.
EMB = "(select o_custkey as doc_id, o_orderkey as page_num, 'p' || o_orderkey as text from orders)"
OCR = """(select o_custkey as doc_id, o_orderkey as page_num, 'ocr ' || o_orderkey as full_text, o_totalprice / 500000.0 as avg_confidence,
     o_totalprice % 100 as typed_text_pct, 100 - o_totalprice % 100 as handwritten_text_pct,
     case when o_orderstatus = 'P' then 'timeout' end as error from orders where o_orderpriority <> '5-LOW')"""
QUALITY = "case c_mktsegment when 'AUTOMOBILE' then 'Excellent' when 'BUILDING' then 'good' when 'FURNITURE' then 'poor' when 'HOUSEHOLD' then 'none' else c_mktsegment end"
MERGED = f"""
    select e.doc_id, e.page_num,
      case when o.doc_id is null or q not in ('poor', 'none') then e.text when q = 'none' or o.avg_confidence >= 0.75 then o.full_text else e.text end as text,
      case when o.doc_id is null or q not in ('poor', 'none') then 'embedded' when q = 'none' or o.avg_confidence >= 0.75 then 'ocr' else 'fallback' end as source,
      case when o.doc_id is null then 0.9 when q = 'excellent' then 0.95 when q = 'good' then 0.85 when q = 'none' or (q = 'poor' and o.avg_confidence >= 0.75) then o.avg_confidence
           when q = 'poor' then 0.6 else 0.8 end as confidence,
      case when o.doc_id is null then 'No OCR result available' when q in ('excellent', 'good') then 'Embedded quality: ' || q when q = 'none' then 'No embedded text'
           when q = 'poor' and o.avg_confidence >= 0.75 then 'OCR conf (' || printf('%.2f', o.avg_confidence) || ') > threshold'
           when q = 'poor' then 'Low OCR conf (' || printf('%.2f', o.avg_confidence) || ')' else 'Unknown quality ''' || raw || ''' - using embedded' end as reason
    from {EMB} e join (select c_custkey, {QUALITY} as raw, lower({QUALITY}) as q from customer) c on c.c_custkey = e.doc_id
    left join {OCR} o on o.doc_id = e.doc_id and o.page_num = e.page_num and o.error is null
"""


def ocr_pages(spark, sf):
    return table(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_num"),
        F.concat(F.lit("ocr "), "o_orderkey").alias("full_text"), (F.col("o_totalprice") / 500000.0).alias("avg_confidence"),
        (F.col("o_totalprice") % 100).alias("typed_text_pct"), (100 - F.col("o_totalprice") % 100).alias("handwritten_text_pct"),
        F.when(F.col("o_orderstatus") == "P", "timeout").alias("error"), F.lit(1).alias("read_at"),
    )


def merged_pages(spark, sf, ocr=None):
    segment = F.col("c_mktsegment")
    raw = (
        F.when(segment == "AUTOMOBILE", "Excellent").when(segment == "BUILDING", "good")
        .when(segment == "FURNITURE", "poor").when(segment == "HOUSEHOLD", "none").otherwise(segment)
    )
    quality_of = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), raw.alias("quality"))
    embedded = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_num"), F.concat(F.lit("p"), "o_orderkey").alias("text")
    )
    return pages.merge_pages(embedded.join(quality_of, "doc_id"), ocr_pages(spark, sf) if ocr is None else ocr, F.col("quality"), order=F.col("read_at"))


@query("d9_merge_pages", f"select doc_id, page_num, text, source, round(confidence, 6) as confidence, reason from ({MERGED})")
def merge_pages(spark, sf):
    return merged_pages(spark, sf).withColumn("confidence", F.round("confidence", 6))


# Every third page was read a second time, with less confidence and, every ninth, with an error.
AGAIN = f"""(select doc_id, page_num, full_text, avg_confidence, typed_text_pct, handwritten_text_pct, error from (
    select *, 1 as read_at from {OCR}
    union all select doc_id, page_num, 'late ' || page_num, avg_confidence / 2, typed_text_pct, handwritten_text_pct, case when page_num % 9 = 0 then 'timeout' end, 2
    from {OCR} where page_num % 3 = 0)
    where error is null qualify row_number() over (partition by doc_id, page_num order by read_at desc) = 1)"""


@query(
    "d9_last_reading",
    f"select doc_id, page_num, text, source, round(confidence, 6) as confidence from ({MERGED.replace(f'left join {OCR} o', f'left join {AGAIN} o')})",
)
def last_reading(spark, sf):
    first = ocr_pages(spark, sf)
    late = first.filter("page_num % 3 = 0").withColumns(
        {
            "full_text": F.concat(F.lit("late "), "page_num"), "avg_confidence": F.col("avg_confidence") / 2, "read_at": F.lit(2),
            "error": F.when(F.col("page_num") % 9 == 0, "timeout"),
        }
    )
    out = merged_pages(spark, sf, union_rows(first, late))
    return out.select("doc_id", "page_num", "text", "source", F.round("confidence", 6).alias("confidence"))


@query(
    "e26_merge_report",
    f"""select doc_id, count(*) as total_pages, count(*) filter (source = 'embedded') as embedded, count(*) filter (source = 'ocr') as ocr, 0::bigint as hybrid,
               count(*) filter (source = 'fallback') as fallback, round(avg(confidence), 6) as avg_confidence from ({MERGED}) group by 1""",
)
def merge_report(spark, sf):
    return pages.merge_report(merged_pages(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    "e26_merged_text",
    f"""select doc_id, page_num // 1000 as part, string_agg(text, chr(10) || chr(10) order by page_num) as full_text from ({MERGED}) group by all""",
)
def merged_text(spark, sf):
    return pages.merged_text(merged_pages(spark, sf), 1000)


@query(
    "e27_ocr_document",
    f"""select doc_id, round(avg(avg_confidence) filter (error is null), 6) as avg_confidence, round(avg(typed_text_pct) filter (error is null), 4) as typed_text_pct,
               round(avg(handwritten_text_pct) filter (error is null), 4) as handwritten_text_pct, count(*) filter (error is null) as pages_processed,
               count(*) filter (error is not null) as pages_failed from {OCR} group by 1""",
)
def ocr_document(spark, sf):
    out = pages.ocr_document(ocr_pages(spark, sf))
    return out.withColumns(
        {"avg_confidence": F.round("avg_confidence", 6), "typed_text_pct": F.round("typed_text_pct", 4), "handwritten_text_pct": F.round("handwritten_text_pct", 4)}
    )


@query(
    "e27_ocr_page",
    """select l_orderkey as doc_id, l_linenumber::bigint as page_num, round(avg(l_discount), 6) as avg_confidence, round(100.0 * avg((l_linestatus = 'F')::int), 6) as typed_text_pct,
              round(100.0 * avg((l_linestatus = 'O')::int), 6) as handwritten_text_pct, count(*) as regions_count from lineitem group by all""",
)
def ocr_page(spark, sf):
    regions = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page_num"), F.col("l_discount").alias("confidence"),
        F.when(F.col("l_linestatus") == "F", "typed").otherwise("handwritten").alias("region_type"),
    )
    out = pages.ocr_page(regions)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_confidence", "typed_text_pct", "handwritten_text_pct")})


@query("e27_ocr_errors", f"select doc_id, page_num, 'Page ' || page_num || ': ' || error as message from {OCR} where error is not null")
def ocr_errors(spark, sf):
    return pages.ocr_errors(ocr_pages(spark, sf))


@query(
    "e25_text_layer_quality",
    f"""
    with p as (select source as doc_id, case when n_chars % 4 = length(source) % 4 then 'short' else text end as text from documents),
    g as (select doc_id, count(*) as total_pages, count(*) filter (length({sql_strip('text')}) > 10) as pages_with_text,
                 coalesce(sum(length(text)) filter (length({sql_strip('text')}) > 10), 0)::bigint as total_chars from p group by 1)
    select *, round(100.0 * pages_with_text / total_pages, 2) as text_coverage_pct,
           case when 100.0 * pages_with_text / total_pages >= 90 then 'excellent' when 100.0 * pages_with_text / total_pages >= 70 then 'good'
                when pages_with_text > 0 then 'poor' else 'none' end as text_layer_quality,
           100.0 * pages_with_text / total_pages < 70 as needs_ocr from g
    """,
)
def text_layer_quality(spark, sf):
    p = table(spark, sf, "documents").select(
        F.col("source").alias("doc_id"),
        F.when(F.col("n_chars") % 4 == F.length("source") % 4, "short").otherwise(F.col("text")).alias("text"),
    )
    return pages.text_layer_quality(p)


# --- corpus ---------------------------------------------------------------------------------


@query("e32_corpus_info", "select 'corpus' as name, count(*) as points_count, case when count(*) > 0 then 'green' else 'empty' end as status from embeddings")
def corpus_info(spark, sf):
    return quality.corpus_info(table(spark, sf, "embeddings"), "corpus")


BREAKDOWN = """
    select case when g = 1 then 'source' when g = 2 then 'type' else 'total' end as dimension, case when g = 1 then source when g = 2 then lang else 'all' end as value, n,
           n * 100.0 / sum(n) over (partition by g) as percent
    from (select source, lang, grouping_id(source, lang) as g, count(*) as n from documents group by grouping sets ((source), (lang), ()))
"""


def _breakdown(spark, sf):
    return quality.corpus_breakdown(table(spark, sf, "documents"), "source", "lang")


@query("e13_corpus_breakdown", f"select dimension, value, n, round(percent, 6) as percent from ({BREAKDOWN})")
def corpus_breakdown(spark, sf):
    return _breakdown(spark, sf).withColumn("percent", F.round("percent", 6))


@query(
    "e14_duplicate_report",
    """select count(*) as distinct_ids, count(*) filter (c > 1) as duplicate_ids, round(count(*) filter (c > 1) * 100.0 / count(*), 6) as duplicate_percent
       from (select sha256(text), count(*) as c from documents group by 1)""",
)
def duplicate_report(spark, sf):
    d = table(spark, sf, "documents")
    return quality.duplicate_report(d, F.sha2("text", 256)).withColumn("duplicate_percent", F.round("duplicate_percent", 6))


@query("e14_duplicate_sample", "select sha256(text) as id, count(*) as copies from documents group by 1 having count(*) > 1 order by copies desc, id limit 10")
def duplicate_sample(spark, sf):
    return quality.duplicate_sample(table(spark, sf, "documents"), F.sha2("text", 256))


@query("e14_duplicates", "select event_type || user_id as k, count(*) as copies from events group by 1 having count(*) > 1")
def duplicates(spark, sf):
    return quality.duplicates(table(spark, sf, "events").select(F.concat("event_type", "user_id").alias("k")), "k")


COVER = """
    select count(h.doc_id) as found, count(*) as expected, count(h.doc_id) * 100.0 / count(*) as coverage_percent
    from (select distinct doc_id from labels) w left join (select distinct doc_id from documents where lang <> 'es') h on h.doc_id = w.doc_id
"""


def _coverage(spark, sf):
    return quality.coverage_report(table(spark, sf, "documents").filter("lang <> 'es'"), table(spark, sf, "labels"), "doc_id")


@query(
    "e15_coverage_report",
    f"select found, expected, round(coverage_percent, 6) as coverage_percent, case when coverage_percent >= 95 then 'pass' when coverage_percent >= 85 then 'warn' else 'fail' end as status from ({COVER})",
)
def coverage_report(spark, sf):
    return _coverage(spark, sf).withColumn("coverage_percent", F.round("coverage_percent", 6))


@query("g5_missing_laws", "select distinct doc_id from labels where doc_id not in (select doc_id from documents where lang <> 'es')")
def missing_laws(spark, sf):
    return quality.missing_values(table(spark, sf, "labels"), table(spark, sf, "documents").filter("lang <> 'es'"), "doc_id")


# --- retrieval: label means as queries, the document with the id of the vector as its text -----

HITS = f"""
    (select h.query_id, h.vec_id, h.score, h.rank, d.text, d.lang from (
       select query_id, vec_id, score, rank from (
          select q.query_id, s.vec_id, {SCORE} as score, row_number() over (partition by q.query_id order by {SCORE} desc, s.vec_id) as rank
          from {QUERIES} q, (select vec_id, embedding::double[] as vec from embeddings) s) where rank <= 50) h join documents d on d.doc_id = h.vec_id)
"""
KEYWORDS = "case when query_id % 2 = 0 then ['the', 'of', 'And', 'zzz'] else ['der', 'Die', 'le', 'que'] end"
EXPECTED = f"(select query_id, {KEYWORDS} as keywords, case when query_id % 3 = 0 then 'reference' else 'concept' end as category from {QUERIES})"
MIN = 0.2
METRICS = f"""
    with j as (select x.query_id, h.vec_id, h.score, h.rank,
                      coalesce(h.score >= {MIN} and len(list_filter(x.keywords, lambda k: contains(lower(h.text), lower(k)))) >= len(x.keywords) * 0.5, false) as rel
               from {EXPECTED} x left join {HITS} h on x.query_id = h.query_id),
    m as (select query_id, count(vec_id) as results, coalesce(max(score), 0.0) as top_score, coalesce(count(*) filter (rel and rank <= 5) / nullif(least(5, count(vec_id)), 0), 0.0) as precision_at_5,
                 coalesce(count(*) filter (rel and rank <= 10) / nullif(least(10, count(vec_id)), 0), 0.0) as precision_at_10, count(*) filter (rel and rank <= 5) / 3.0 as recall_at_5,
                 count(*) filter (rel and rank <= 10) / 3.0 as recall_at_10, coalesce(1.0 / min(rank) filter (rel), 0.0) as reciprocal_rank from j group by 1),
    v as (select m.*, x.category, case when results = 0 then 'No results returned' when top_score < {MIN} then 'Top score ' || printf('%.4f', top_score) || ' < threshold {MIN}'
                 when precision_at_5 < 0.4 then 'Precision@5 ' || printf('%.2f', precision_at_5) || ' too low'
                 when reciprocal_rank < 0.2 then 'MRR ' || printf('%.2f', reciprocal_rank) || ' too low' end as failure_reason
          from m join {EXPECTED} x on x.query_id = m.query_id)
"""


def search_hits(spark, sf):
    h = similarity.knn(label_means(spark, sf), _store(spark, sf), 50)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    return h.join(d, "vec_id")


def _queries(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("label").alias("query_id")).distinct()


def expected(spark, sf):
    even = F.array(*[F.lit(k) for k in ("the", "of", "And", "zzz")])
    odd = F.array(*[F.lit(k) for k in ("der", "Die", "le", "que")])
    return _queries(spark, sf).select(
        "query_id", F.when(F.col("query_id") % 2 == 0, even).otherwise(odd).alias("keywords"),
        F.when(F.col("query_id") % 3 == 0, "reference").otherwise("concept").alias("category"),
    )


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "e16_score_distribution",
    f"""select query_id, count(*) as results, round(max(score), 6) as max_score, round(min(score), 6) as min_score, round(avg(score), 6) as avg_score,
               round(sum(score) filter (rank <= 10) / 10, 6) as top_10_avg from {HITS} group by 1""",
)
def score_distribution(spark, sf):
    return _round(quality.score_distribution(search_hits(spark, sf)), "max_score", "min_score", "avg_score", "top_10_avg")


FILTERED = f"""(select count(*) as queries_tested, count(*) filter (top > 0.5) as passed, avg(top) as avg_score from (select q.query_id, max(h.score) as top from {QUERIES} q left join {HITS} h on h.query_id = q.query_id group by 1))"""


@query(
    "e17_filtered_retrieval_check",
    f"select queries_tested, passed, round(avg_score, 6) as avg_score, case when passed >= queries_tested * 0.8 then 'pass' else 'fail' end as status from {FILTERED}",
)
def filtered_retrieval_check(spark, sf):
    return _round(quality.filtered_retrieval_check(search_hits(spark, sf), _queries(spark, sf)), "avg_score")


CROSS = f"""(select count(*) as queries_tested, sum(case when n >= 2 then 1.0 when n = 1 then 0.5 else 0.0 end)::double as credit
    from (select q.query_id, count(distinct h.lang) as n from {QUERIES} q left join (select * from {HITS} where rank <= 10) h on h.query_id = q.query_id group by 1))"""


@query("e18_cross_source_check", f"select queries_tested, credit, case when credit >= queries_tested * 0.5 then 'pass' else 'fail' end as status from {CROSS}")
def cross_source_check(spark, sf):
    return quality.cross_source_check(search_hits(spark, sf), _queries(spark, sf), "lang")


METRIC_NAMES = ("precision_at_5", "precision_at_10", "recall_at_5", "recall_at_10", "reciprocal_rank")
ROUNDED = ", ".join(f"round({m}, 6) as {m}" for m in ("top_score", *METRIC_NAMES))


def _metrics(spark, sf):
    return quality.retrieval_metrics(search_hits(spark, sf), expected(spark, sf), MIN)


@query("e19_retrieval_metrics", METRICS + f"select query_id, results, {ROUNDED} from m")
def retrieval_metrics(spark, sf):
    return _round(_metrics(spark, sf), "top_score", *METRIC_NAMES)


@query("e20_retrieval_verdict", METRICS + "select query_id, failure_reason, failure_reason is null as passed from v")
def retrieval_verdict(spark, sf):
    return quality.retrieval_verdict(_metrics(spark, sf), MIN).select("query_id", "failure_reason", "passed")


FOUND = f"""
    with f as (select h.query_id, unnest(list_filter(x.keywords, lambda k: contains(lower(h.text), lower(k)))) as k from {HITS} h join {EXPECTED} x on x.query_id = h.query_id where rank <= 5),
    g as (select query_id, list(distinct k) as found from f group by 1)
"""


@query("e20_keywords_found", FOUND + f"select x.query_id, array_to_string(list_sort(coalesce(g.found, [])), ',') as found from {EXPECTED} x left join g on g.query_id = x.query_id")
def keywords_found(spark, sf):
    return quality.keywords_found(search_hits(spark, sf), expected(spark, sf)).select("query_id", F.array_join("found", ",").alias("found"))


@query("g4_missing_keywords", FOUND + f"select x.query_id, unnest(list_filter(x.keywords, lambda k: not list_contains(coalesce(g.found, []), k))) as missing from {EXPECTED} x left join g on g.query_id = x.query_id")
def missing_keywords(spark, sf):
    return quality.keywords_found(search_hits(spark, sf), expected(spark, sf)).select("query_id", F.explode("missing").alias("missing"))


@query(
    "e21_retrieval_summary",
    METRICS + """select category, count(*) as total, count(*) filter (failure_reason is null) as passed, round(avg((failure_reason is null)::int), 6) as pass_rate,
       round(avg(precision_at_5), 6) as precision_at_5, round(avg(recall_at_10), 6) as recall_at_10, round(avg(reciprocal_rank), 6) as mrr, round(avg(top_score), 6) as top_score
       from v group by rollup (category)""",
)
def retrieval_summary(spark, sf):
    verdicts = quality.retrieval_verdict(_metrics(spark, sf), MIN).join(expected(spark, sf).select("query_id", "category"), "query_id")
    out = quality.retrieval_summary(verdicts).drop("precision_at_10", "recall_at_5")
    return _round(out, "pass_rate", "precision_at_5", "recall_at_10", "mrr", "top_score")


GATE = f"""
    select 'collection_stats' as "check", case when count(*) > 0 then 'pass' else 'fail' end as status, count(*)::double as value from documents
    union all select 'vector_count_breakdown', case when n < 0.9 * 2.5 * (select count(*) from labels) then 'fail' when n > 1.2 * 2.5 * (select count(*) from labels) then 'warn' else 'pass' end, n::double from ({BREAKDOWN}) where dimension = 'total'
    union all select 'filtered_retrieval', case when passed >= queries_tested * 0.8 then 'pass' else 'fail' end, passed::double from {FILTERED}
    union all select 'cross_source_retrieval', case when credit >= queries_tested * 0.5 then 'pass' else 'fail' end, credit from {CROSS}
    union all select 'embedding_quality', case when avg(t) > 0.6 then 'pass' else 'warn' end, round(avg(t), 6) from (select query_id, sum(score) filter (rank <= 10) / 10 as t from {HITS} group by 1)
    union all select 'duplicate_detection', case when p < 1 then 'pass' else 'fail' end, round(p, 6) from (select count(*) filter (c > 1) * 100.0 / count(*) as p from (select sha256(text), count(*) as c from documents group by 1))
    union all select 'coverage_validation', case when coverage_percent >= 95 then 'pass' when coverage_percent >= 85 then 'warn' else 'fail' end, round(coverage_percent, 6) from ({COVER})
    union all select 'retrieval_verdicts', case when r >= 0.8 then 'pass' else 'fail' end, r from ({METRICS} select round(avg((failure_reason is null)::int), 6) as r from v)
"""


def gate(spark, sf):
    d = table(spark, sf, "documents")
    hits, q = search_hits(spark, sf), _queries(spark, sf)

    # Labels are drawn from two fifths of the documents.
    expected = table(spark, sf, "labels").agg((F.count(F.lit(1)) * 2.5).alias("expected"))

    def check(name, status, value, df):
        return df.select(F.lit(name).alias("check"), status.alias("status"), value.cast("double").alias("value"))

    ok = lambda c, other: F.when(c, "pass").otherwise(other)
    top = quality.score_distribution(hits).agg(F.round(F.avg("top_10_avg"), 6).alias("t"))
    verdicts = quality.retrieval_verdict(_metrics(spark, sf), MIN).agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("r"))
    dup = quality.duplicate_report(d, F.sha2("text", 256))
    return quality.quality_gate(
        [
            check("collection_stats", ok(F.col("points_count") > 0, "fail"), F.col("points_count"), quality.corpus_info(d, "documents")),
            quality.breakdown_check(_breakdown(spark, sf), expected),
            check("filtered_retrieval", F.col("status"), F.col("passed"), quality.filtered_retrieval_check(hits, q)),
            check("cross_source_retrieval", F.col("status"), F.col("credit"), quality.cross_source_check(hits, q, "lang")),
            check("embedding_quality", ok(F.col("t") > 0.6, "warn"), F.col("t"), top),
            check("duplicate_detection", ok(F.col("duplicate_percent") < 1, "fail"), F.round("duplicate_percent", 6), dup),
            check("coverage_validation", F.col("status"), F.round("coverage_percent", 6), _coverage(spark, sf)),
            check("retrieval_verdicts", ok(F.col("r") >= 0.8, "fail"), F.col("r"), verdicts),
        ]
    )


@query("e39_quality_gate", GATE)
def quality_gate(spark, sf):
    return gate(spark, sf)[0]


@query(
    "e39_gate_verdict",
    f"""select count(*) filter (status = 'pass') as passed, count(*) filter (status = 'fail') as failed, count(*) filter (status = 'warn') as warnings,
               case when count(*) filter (status = 'fail') = 0 then 'pass' else 'fail' end as verdict from ({GATE})""",
)
def gate_verdict(spark, sf):
    return gate(spark, sf)[1]


