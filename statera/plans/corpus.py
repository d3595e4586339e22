"""Sources, cleaning and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, scoring, text, vectors
from ..functions.rows import union_rows
from ..functions.domains import GERMAN
from ..operators import lineage, similarity, validation
from ..sources import records, store
from .catalog import (
    INVISIBLE, WS, lit, query, sql_collapse, sql_decode, sql_normalize, sql_replace, sql_strip, sql_text_nodes,
    sql_words, table, texts,
)

VISIBLE = f"regexp_replace(html, {lit(INVISIBLE)}, '', 'g')"
INNER = sql_text_nodes("regexp_split_to_array(p, '(?i)</p>')[1]")


@query(
    "a10_extract_sections",
    f"""
    select page_id, text from (
      select page_id, {sql_decode(f'''array_to_string(list_filter(list_transform(
        regexp_split_to_array({VISIBLE}, '(?i)<p(?: [^>]*)?>')[2:],
        lambda p: array_to_string({INNER}, '')), lambda p: p <> ''), chr(10) || chr(10))''')} as text from pages)
    where length(text) >= 20
    """,
)
def extract_sections(spark, sf):
    return records.extract_sections_from_pages(texts(spark, sf, "pages"), ["page_id"])


@query(
    "a11_toc_links",
    f"""
    with l as (
      select page_id, unnest(regexp_extract_all(html, {lit(records.LINK)}, 1)) as href,
             unnest(regexp_extract_all(html, {lit(records.LINK)}, 2)) as title,
             unnest(range(len(regexp_extract_all(html, {lit(records.LINK)}, 1)))) as link_no
      from pages)
    select page_id, link_no, replace(split_part(href, '/', 2), '.html', '') as section_id,
           {sql_strip("regexp_replace(title, '<[^>]+>', '', 'g')")} as title, href
    from l where contains(href, '/') and {sql_strip("regexp_replace(title, '<[^>]+>', '', 'g')")} <> ''
    """,
)
def toc_links(spark, sf):
    return records.extract_toc_links(texts(spark, sf, "pages"), ["page_id"], marker="/").withColumn(
        "link_no", F.col("link_no").cast("long")
    )


@query(
    "a15_upsert_points",
    """
    with new as (
      select vec_id + 100 as point_id, label + 100 as label, vec_id as seq from embeddings
      union all select vec_id + 100, label + 200, vec_id + 1000000 from embeddings where label = 3),
    fresh as (select point_id, label from new qualify row_number() over (partition by point_id order by seq desc) = 1)
    select vec_id as point_id, label from embeddings where vec_id not in (select point_id from fresh)
    union all select point_id, label from fresh
    """,
)
def upsert_points(spark, sf):
    e = table(spark, sf, "embeddings")
    new = e.select((F.col("vec_id") + 100).alias("point_id"), (F.col("label") + 100).alias("label"), F.col("vec_id").alias("seq"))
    again = e.filter("label = 3").select(
        (F.col("vec_id") + 100).alias("point_id"), (F.col("label") + 200).alias("label"), (F.col("vec_id") + 1000000).alias("seq")
    )
    fresh = store.latest_per_id(union_rows(new, again), "point_id", ["seq"]).drop("seq")
    return store.upsert_points(fresh, e.select(F.col("vec_id").alias("point_id"), "label"))


@query(
    "a16_incremental_scan",
    """select event_id, user_id, ts from events
       where ts >= (select date_trunc('day', max(ts) - interval 7 day) from events where event_type = 'signup')""",
)
def incremental_scan(spark, sf):
    e = table(spark, sf, "events")
    # The state row of the last run: one value.
    last = e.filter("event_type = 'signup'").agg((F.max("ts") - F.expr("interval 7 days")).alias("d")).first()["d"]
    return store.incremental_scan(e, "ts", F.lit(last)).select("event_id", "user_id", "ts")


@query(
    "a17_update_state",
    """select max(ts) as last_update, cast(arg_max(user_id, (ts, event_id)) as bigint) as last_update_docs_count,
              count(*) as total_runs from events where event_type <> 'error'""",
)
def update_state(spark, sf):
    e = table(spark, sf, "events").select(F.struct("ts", "event_id").alias("k"), "ts", "user_id", "event_type")
    return store.update_state(e, ts="k", docs="user_id", ok=F.col("event_type") != "error").withColumn(
        "last_update", F.col("last_update.ts")
    )


@query(
    "a19_query_log",
    f"""select conv_id, turn, sha256({sql_strip('text')}) as query_hash, sha256(role) as response_hash,
               cast(ts as date) as log_date
        from (select *, timestamp '2024-01-01' + to_days(cast(turn as integer)) as ts from conversations)""",
)
def query_log(spark, sf):
    c = table(spark, sf, "conversations").withColumn(
        "ts", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.col("turn").cast("int"))
    )
    return store.query_log_rows(c, "ts", "text", "role", ["conv_id", "turn"]).drop("created_at")


@query("a20_scan_payload", "select vec_id, label from embeddings")
def scan_payload(spark, sf):
    return store.scan_payload(table(spark, sf, "embeddings"), "embedding")


@query("b1_normalize_text", f"select doc_id, {sql_normalize('text')} as text from documents")
def normalize_text(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query(
    "b2_normalize_corpus",
    f"""select * from (select page_id, {sql_normalize('url')} as title, {sql_normalize('html')} as text from pages)
        where length(text) >= 20""",
)
def normalize_corpus(spark, sf):
    p = texts(spark, sf, "pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("text"))
    return records.normalize_corpus(p)


SIGNS = {"„": '"', "“": '"', "‚": "'", "‘": "'", "–": "-", "—": "-", "§§": "§ "}


def sql_answer(x: str) -> str:
    return sql_replace(sql_collapse(x), {**SIGNS, **GERMAN.abbreviations})


@query("b3_normalize_answer", f"select conv_id, turn, {sql_answer('text')} as text from conversations")
def normalize_answer(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", GERMAN.normalize(F.col("text")).alias("text"))


@query("b4_html_to_text", f"select page_id, {sql_decode(f'array_to_string({sql_text_nodes(chr(104) + chr(116) + chr(109) + chr(108))}, chr(10))')} as text from pages")
def html_to_text(spark, sf):
    return texts(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


def sql_mail(x: str) -> str:
    kept = f"""array_to_string(list_filter(string_split({x}, chr(10)), lambda l: not starts_with({sql_strip('l')}, '>')), chr(10))"""
    for m in text.SIGNATURE_MARKERS:
        kept = f"split_part({kept}, {lit(m)}, 1)"
    return sql_strip(kept)


@query("b5_clean_mail_body", f"select conv_id, turn, {sql_mail('text')} as text from conversations")
def clean_mail_body(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.clean_mail_body(F.col("text")).alias("text"))


@query(
    "b6_strip_page_furniture",
    f"""select doc_id, {sql_strip(f"regexp_replace(regexp_replace(text, {lit(WS + '+')}, ' ', 'g'), {lit(f'Seite{WS}+[0-9]+{WS}+von{WS}+[0-9]+')}, '', 'g')")} as text
        from documents""",
)
def strip_page_furniture(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", text.strip_page_furniture(F.col("text")).alias("text"))


STANDARD = """
    select source, 'law' as type, cast(doc_id as varchar) as doc_id, lang as title, text, source || '/' || doc_id as url,
           'DE' as jurisdiction, cast(doc_id as varchar) as law, '' as concepts from documents where lang = 'de'
    union all
    select 'eurlex', 'eu_regulation', cast(doc_id as varchar), lang, text, source || '/' || doc_id, 'EU', null,
           source || ',' || lang from documents where lang <> 'de'
"""


def _standard(spark, sf):
    d = texts(spark, sf, "documents").withColumn("url", F.concat_ws("/", "source", "doc_id"))
    day = F.lit("2024-01-01")
    laws = records.statutes_to_corpus(
        d.filter("lang = 'de'").select(
            "source", F.lit("law").alias("type"), F.col("doc_id").cast("string").alias("slug"), F.col("lang").alias("title"),
            F.col("text").alias("content"), "url",
        ),
        day,
    )
    eu = records.eu_to_corpus(
        d.filter("lang <> 'de'").select(
            F.lit("eu_regulation").alias("type"), F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("title"),
            "text", "url", F.lit("EU").alias("jurisdiction"), F.array("source", "lang").alias("concepts"),
        ),
        day,
    )
    return records.union_sources(laws, eu)


@query("b7_to_standard_corpus", STANDARD)
def to_standard_corpus(spark, sf):
    return _standard(spark, sf).select(
        "source", "type", "doc_id", "title", "text", "url", "jurisdiction", "law",
        F.coalesce(F.array_join("concepts", ","), F.lit("")).alias("concepts"),
    )


@query(
    "g1_union_sources",
    f"select source, jurisdiction, count(*) as n, count(law) as with_law, sum(length(text))::bigint as chars from ({STANDARD}) group by all",
)
def union_sources(spark, sf):
    return _standard(spark, sf).groupBy("source", "jurisdiction").agg(
        F.count(F.lit(1)).alias("n"), F.count("law").alias("with_law"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "b8_classify_doc_type",
    """select doc_id, case when contains(lower(source), '1') then 'eu_directive' when contains(lower(source), '2') then 'eu_decision'
              else 'eu_regulation' end as type from documents""",
)
def classify_doc_type(spark, sf):
    concepts = F.array("lang", F.translate("source", "12", "").alias("s"),
                       F.when(F.col("source").contains("1"), "Council Directive").otherwise(
                           F.when(F.col("source").contains("2"), "DECISION").otherwise("x")))
    return table(spark, sf, "documents").select("doc_id", text.classify_doc_type(concepts).alias("type"))


@query(
    "b9_classify_source",
    """select page_id, case when contains(lower(url), 'm.') then 'eurlex' when contains(url, '/de/') then 'gesetze_github'
              when contains(lower(replace(url, 'example', 'Gesetze')), 'gesetze') then 'gesetze_github' else 'unknown' end as source from pages""",
)
def classify_source(spark, sf):
    p = table(spark, sf, "pages")
    url = F.replace(F.col("url"), F.lit("example"), F.lit("Gesetze"))
    kind = F.when(F.lower("url").contains("m."), "eurlex")
    law = F.when(F.col("url").contains("/de/"), "BGB").otherwise("")
    return p.select("page_id", text.classify_source(kind, url, law).alias("source"))


GERMAN_SQL = " + ".join(
    f"contains(' ' || lower(text) || ' ', {lit(f' {w} ')})::int" for w in text.GERMAN_MARKERS
)


@query(
    "b10_detect_german",
    f"select doc_id, case when length(text) >= 50 and {GERMAN_SQL} >= 3 then 'de' else 'other' end as detected from documents",
)
def detect_german(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", text.detect_german(F.col("text")).alias("detected"))


@query("b11_payload_filter", "select vec_id, label from embeddings where label = 3")
def payload_filter(spark, sf):
    return similarity.payload_filter(table(spark, sf, "embeddings"), {"label": 3}).select("vec_id", "label")


LOG_SQL = f"""(select o_orderkey as verification_id, o_orderdate as created_at, o_totalprice / 500000.0 as confidence_score,
    case o_orderstatus when 'F' then '{scoring.VERIFIED}' when 'O' then '{scoring.REVIEW}' else '{scoring.REJECTED}' end as trust_label,
    o_orderpriority <> '5-LOW' as is_valid from orders)"""


def log_table(spark, sf):
    """Orders in the role of the verification log."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("verification_id"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_totalprice") / 500000.0).alias("confidence_score"),
        F.when(F.col("o_orderstatus") == "F", scoring.VERIFIED)
        .when(F.col("o_orderstatus") == "O", scoring.REVIEW)
        .otherwise(scoring.REJECTED).alias("trust_label"),
        (F.col("o_orderpriority") != "5-LOW").alias("is_valid"),
    )


@query(
    "b12_filter_verifications",
    f"select verification_id, round(confidence_score, 6) as confidence_score from {LOG_SQL} where confidence_score >= 0.6 and trust_label = '{scoring.REVIEW}' and is_valid",
)
def filter_verifications(spark, sf):
    return lineage.filter_verifications(log_table(spark, sf), 0.6, scoring.REVIEW, True).select(
        "verification_id", F.round("confidence_score", 6).alias("confidence_score")
    )


SQL_FLAG = "(?i)" + "|".join(text.unicode_ws(p) for p in validation.SQL_PATTERNS)


@query(
    "b15_filter_valid_queries",
    f"""select conv_id, turn, clean, k, suspicious, reason from (
          select *, case when clean = '' then 'Query cannot be empty' when length(clean) > 1000 then 'Query too long'
                         when k < 1 then 'top_k must be at least 1' when k > 20 then 'top_k too large' end as reason,
                 regexp_matches(clean, {lit(SQL_FLAG)}) as suspicious
          from (select conv_id, turn, {sql_strip('text')} as clean,
                       cast(coalesce(case when role <> 'system' then turn * 4 end, 5) as bigint) as k from conversations))""",
)
def filter_valid_queries(spark, sf):
    c = table(spark, sf, "conversations").withColumn("top_k", F.when(F.col("role") != "system", F.col("turn") * 4))
    return validation.check_queries(c, text="text").select(
        "conv_id", "turn", "clean", F.col("k").cast("long").alias("k"), "suspicious", "reason"
    )


@query(
    "b14_filter_valid_files",
    """select page_id, name, case when ext not in ('pdf', 'docx', 'odt', 'txt', 'eml') then 'File type not supported'
              when size = 0 then 'File is empty' when size > 52428800 then 'File too large' end as reason
       from (select page_id, 'p ' || page_id || '.' || ext as name, ext, size from (
         select page_id, case page_id % 4 when 0 then 'pdf' when 1 then 'html' when 2 then 'eml' else 'txt' end as ext,
                case when page_id % 7 = 0 then 0 else length(html) * 30000 end as size from pages))""",
)
def filter_valid_files(spark, sf):
    p = table(spark, sf, "pages")
    ext = F.element_at(F.array(F.lit("pdf"), F.lit("html"), F.lit("eml"), F.lit("txt")), (F.col("page_id") % 4 + 1).cast("int"))
    files = p.select(
        "page_id", F.concat(F.lit("p "), "page_id", F.lit("."), ext).alias("name"),
        F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.length("html").cast("long") * 30000).alias("size"),
    )
    return validation.check_files(files).select("page_id", "name", "reason")


@query(
    "b16_sanitize_metadata",
    """select event_id, regexp_replace('k ' || event_type, '[^a-zA-Z0-9_]', '_', 'g') || '=' || props as entry from events
       union all select event_id, 'user=' || user_id from events""",
)
def sanitize_metadata(spark, sf):
    m = F.create_map(
        F.concat(F.lit("k "), "event_type"), F.col("props"), F.lit("user"), F.col("user_id").cast("string")
    )
    e = table(spark, sf, "events").select("event_id", F.explode(validation.sanitize_metadata(m)).alias("k", "v"))
    return e.select("event_id", F.concat_ws("=", "k", "v").alias("entry"))


@query("b17_content_hash", "select doc_id, sha256(text) as content_hash, left(sha256(text), 16) as short_hash from documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", ids.content_hash(F.col("text")).alias("content_hash"), ids.short_hash(F.col("text")).alias("short_hash")
    )


@query(
    "b18_point_id",
    "select doc_id, cast(('0x' || left(md5(doc_id || '_chunk_0'), 16))::ubigint as varchar) as point_id from documents",
)
def point_id(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", ids.point_id(F.concat("doc_id", F.lit("_chunk_0"))).cast("string").alias("point_id"))


@query(
    "b19_result_projection",
    """select doc_id as query_id, n_chars as rank, case when lang <> 'en' then lang else source end as source,
              round(1.0 / (1 + n_chars), 9) as score, lang || '/' || source as metadata from documents""",
)
def result_projection(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("n_chars").alias("rank"), "text",
        F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("law"), F.col("source").alias("court"),
        F.round(1.0 / (1 + F.col("n_chars")), 9).alias("score"), "lang",
    )
    out = store.result_projection(d, ["lang", "court"])
    return out.select("query_id", "rank", "source", "score", F.concat_ws("/", "metadata.lang", "metadata.court").alias("metadata"))


@query(
    "h1_cosine",
    """select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine
       from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
)
def cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query(
    "h2_l2_normalize",
    """with v as (select vec_id, unnest(range(len(embedding))) as pos, unnest(embedding::double[]) as x,
                         sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from embeddings)
       select vec_id, pos, round(x / n, 6) as value from v""",
)
def l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")
    )


@query("h3_prefix", "select item_id, 'query: ' || text as q, 'passage: ' || text as p from benchmark")
def prefix(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", vectors.with_prefix(F.col("text"), "query").alias("q"), vectors.with_prefix(F.col("text"), "passage").alias("p")
    )


@query(
    "h4_regex",
    r"""select doc_id, len(regexp_extract_all(text, '\([0-9]+\)'))::bigint as refs, regexp_matches(text, '[0-9]{3,}') as has_number,
              length(regexp_replace(text, '[aeiou]', '', 'g'))::bigint as consonants from documents""",
)
def regex(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id",
        F.size(F.regexp_extract_all("text", F.lit(r"\([0-9]+\)"), F.lit(0))).cast("long").alias("refs"),
        F.col("text").rlike("[0-9]{3,}").alias("has_number"),
        F.length(F.regexp_replace("text", "[aeiou]", "")).cast("long").alias("consonants"),
    )


@query("h5_cut", "select doc_id, case when length(text) > 80 then left(text, 80) || '...' else text end as shown from documents")
def cut(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.cut(F.col("text"), 80).alias("shown"))


@query("h6_counts", f"select doc_id, len({sql_words('text')})::bigint as words, length(text)::bigint as chars from documents")
def counts(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id", text.word_count(F.col("text")).cast("long").alias("words"), F.length("text").cast("long").alias("chars")
    )


@query(
    "h7_dates",
    "select event_id, strftime(ts, '%Y-%m') as month, ts + interval 90 day as expires_at, strftime(ts, '%Y-%m-%d') as day from events",
)
def dates(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM").alias("month"),
        (F.col("ts") + F.make_dt_interval(F.lit(90))).alias("expires_at"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


@query("h8_clamp", "select event_id, greatest(0.0, least(1.0, round(value / 100, 6))) as score from events")
def clamp(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.col("value") / 100, 6))).alias("score")
    )


@query("h9_variance", "select event_type, round(var_samp(value), 6) as variance, round(avg(value), 6) as mean from events group by 1")
def variance(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.round(F.var_samp("value"), 6).alias("variance"), F.round(F.avg("value"), 6).alias("mean")
    )


@query("h10_json_field", "select event_id, cast(props ->> '$.k' as bigint) as k from events")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "h11_strict_threshold",
    f"select trust_label, count(*) filter (confidence_score >= 0.8) as normal, count(*) filter (confidence_score >= 0.85) as strict from {LOG_SQL} group by 1",
)
def strict(spark, sf):
    c = F.col("confidence_score")
    return log_table(spark, sf).groupBy("trust_label").agg(
        F.count_if(c >= scoring.strict_threshold(0.8, False)).alias("normal"),
        F.count_if(c >= round(scoring.strict_threshold(0.8, True), 10)).alias("strict"),
    )
