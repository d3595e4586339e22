"""Answer audit, citations, lineage and the audit log.

Assistant turns are the answers, the other turns of their conversation the sources.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.domains import GERMAN
from ..functions.rows import exploded, union_rows
from ..functions.text import tokens
from ..functions.vectors import jaccard
from ..operators import audit, citations, lineage, sentences
from ..session import shared_dir, stored
from ..sources import store
from .catalog import lit, query, sql_strip, sql_tokens, sql_words, table, texts
from .corpus import LOG_SQL, log_table, sql_answer
from .segments import REFS, long, sql_citations, sql_sentences

KEYS = ["conv_id", "turn"]
T = 0.35  # sentence threshold of the test runs: invented prose matches less than real answers do

# Best source per sentence by term cosine, as joins of term counts.
BEST = f"""
    with recursive a as (select conv_id, turn, text, {sql_sentences(sql_answer('text'))} as s from conversations where role = 'assistant'),
    st as (select conv_id, turn, unnest(range(len(s))) as i, unnest(s) as sentence from a),
    tt as (select conv_id, turn, i, t, count(*)::double as n from (select conv_id, turn, i, unnest({sql_tokens('sentence')}) as t from st) group by all),
    tn as (select conv_id, turn, i, sqrt(sum(n * n)) as z from tt group by all),
    src as (select conv_id, turn as source_id, text, 1.0 / (1 + turn) as score from conversations where role <> 'assistant'),
    ss as (select conv_id, source_id, t, count(*)::double as n from (select conv_id, source_id, unnest({sql_tokens('text')}) as t from src) group by all),
    sn as (select conv_id, source_id, sqrt(sum(n * n)) as z from ss group by all),
    d as (select tt.conv_id, tt.turn, tt.i, ss.source_id, sum(tt.n * ss.n) as d from tt join ss on ss.conv_id = tt.conv_id and ss.t = tt.t group by all),
    pr as (select st.conv_id, st.turn, st.i, src.source_id, coalesce(d.d / (tn.z * sn.z), 0.0) as score
           from st join src on src.conv_id = st.conv_id
           left join d on d.conv_id = st.conv_id and d.turn = st.turn and d.i = st.i and d.source_id = src.source_id
           left join tn on tn.conv_id = st.conv_id and tn.turn = st.turn and tn.i = st.i
           left join sn on sn.conv_id = st.conv_id and sn.source_id = src.source_id),
    best as (select * from pr qualify row_number() over (partition by conv_id, turn, i order by score desc, source_id) = 1)
"""
AUDIT = BEST + f""",
    va as (select conv_id, turn, count(*) as n, count(*) filter (score >= {T}) as v, avg(score) as mean, var_samp(score) as var,
                  avg((score < {T})::int) as low from best group by all),
    sg as (select conv_id, count(*) as source_count, list_sort(list(score), 'DESC')[1:3] as top from src group by 1),
    cs as (select conv_id, turn, len({sql_citations('text')}) as c from a),
    j as (select a.conv_id, a.turn, sha256(a.text) as answer_hash, len(a.s) as total_sentences, coalesce(sg.source_count, 0) as source_count, coalesce(va.v, 0) as v,
                 cs.c, case when len(a.s) = 0 then 'no_sentences' when sg.source_count is null then 'no_sources' end as error,
                 va.*exclude(conv_id, turn, v), sg.top
          from a left join va on va.conv_id = a.conv_id and va.turn = a.turn left join sg on sg.conv_id = a.conv_id
          join cs on cs.conv_id = a.conv_id and cs.turn = a.turn),
    k as (select *, case when error is null then greatest(0.0, mean - case when n > 1 then least(0.15, var * 0.5) else 0 end - low * 0.2) else 0.0 end as semantic,
                 case when error is null then list_sum(top) / len(top) else 0.0 end as retrieval,
                 case when error is not null then 0.0 when c = 0 then 0.3 when c = 1 then 0.7 when c = 2 then 0.85 else least(1.0, 0.85 + (c - 2) * 0.05) end as citation,
                 case when error is null then v / n else 0.0 end as coverage from j),
    r as (select *, case when error is null then greatest(0.0, least(1.0, semantic * 0.60 + retrieval * 0.25 + citation * 0.10 + coverage * 0.05)) else 0.0 end as conf from k)
"""
LABEL = f"case when conf >= 0.8 then '{scoring.VERIFIED}' when conf >= 0.6 then '{scoring.REVIEW}' else '{scoring.REJECTED}' end"


def answers(spark, sf):
    return texts(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")


def sources(spark, sf):
    return table(spark, sf, "conversations").filter("role <> 'assistant'").select(
        "conv_id", F.col("turn").alias("source_id"), "text", (1.0 / (1 + F.col("turn"))).alias("score")
    )


def _best(spark, sf):
    rows = exploded(
        sentences.analyze_answers(answers(spark, sf), KEYS, "text", GERMAN, REFS), KEYS, F.col("sentences"), "sentence_index", "sentence"
    )
    return audit.match_sentences(rows, sources(spark, sf), "conv_id", [*KEYS, "sentence_index"], threshold=T)


def audits(spark, sf):
    return audit.audit_batch(answers(spark, sf), sources(spark, sf), "conv_id", KEYS, "text", GERMAN, REFS, threshold=T)


@query(
    "d7_match_sentences",
    BEST + f"select conv_id, turn, i as sentence_index, source_id, round(score, 6) as score, score >= {T} as verified from best",
)
def match_sentences(spark, sf):
    return long(_best(spark, sf).drop("rank").withColumn("score", F.round("score", 6)), "sentence_index")


@query(
    "d7_all_scores",
    BEST + "select conv_id, turn, i as sentence_index, source_id, round(score, 6) as score, row_number() over (partition by conv_id, turn, i order by score desc, source_id) as rank from pr",
)
def all_scores(spark, sf):
    rows = exploded(
        sentences.analyze_answers(answers(spark, sf), KEYS, "text", GERMAN, REFS), KEYS, F.col("sentences"), "sentence_index", "sentence"
    )
    out = audit.match_sentences(rows, sources(spark, sf), "conv_id", [*KEYS, "sentence_index"], k=None)
    return long(out.drop("verified").withColumn("score", F.round("score", 6)), "sentence_index", "rank")


@query(
    "e1_verify_answers",
    BEST + f"""select conv_id, turn, count(*) as scored_sentences, count(*) filter (score >= {T}) as verified_sentences,
                      round(avg(score), 6) as mean_score, round(count(*) filter (score >= {T}) / count(*), 6) as verification_rate
               from best group by all""",
)
def verify_answers(spark, sf):
    out = audit.verify_answers(_best(spark, sf), KEYS, T)
    rate = scoring.coverage_score(F.col("verified_sentences"), F.col("scored_sentences"))
    return out.select(
        *KEYS, "scored_sentences", "verified_sentences", F.round("mean_score", 6).alias("mean_score"),
        F.round(rate, 6).alias("verification_rate"),
    )


@query("e2_semantic_score", AUDIT + "select conv_id, turn, round(semantic, 6) as semantic_score from r")
def semantic_score(spark, sf):
    return audits(spark, sf).select(*KEYS, F.round("semantic_similarity", 6).alias("semantic_score"))


@query("e3_retrieval_score", AUDIT + "select conv_id, round(list_sum(top) / len(top), 6) as retrieval_score, source_count from sg")
def retrieval_score(spark, sf):
    return audit.source_signals(sources(spark, sf), "conv_id").select(
        "conv_id", F.round(scoring.retrieval_score(F.col("top_scores")), 6).alias("retrieval_score"), "source_count"
    )


@query(
    "e4_citation_score",
    f"""select doc_id, round(case when c = 0 then 0.3 when c = 1 then 0.7 when c = 2 then 0.85 else least(1.0, 0.85 + (c - 2) * 0.05) end, 6) as score
        from (select doc_id, len({sql_citations('text')}) as c from documents)""",
)
def citation_score(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.round(scoring.citation_score(F.size(REFS.citations(F.col("text")))), 6).alias("score")
    )


@query("e5_coverage_score", AUDIT + "select conv_id, turn, round(coverage, 6) as coverage from r")
def coverage_score(spark, sf):
    return audits(spark, sf).select(*KEYS, F.round("coverage", 6).alias("coverage"))


@query("e6_confidence", AUDIT + "select conv_id, turn, round(conf, 6) as confidence, conf >= 0.8 as verified from r")
def confidence(spark, sf):
    return audits(spark, sf).select(*KEYS, F.round("confidence_score", 6).alias("confidence"), "verified")


@query("e7_trust_label", f"select verification_id, {LABEL.replace('conf', 'confidence_score')} as label, confidence_score < 0.6 as retry from {LOG_SQL}")
def trust_label(spark, sf):
    c = F.col("confidence_score")
    return log_table(spark, sf).select("verification_id", scoring.trust_label(c).alias("label"), scoring.should_retry(c).alias("retry"))


def _pct(x: str) -> str:
    return f"printf('%.2f', {x})"


@query(
    "e8_explain_confidence",
    AUDIT + f"""select conv_id, turn, 'Confidence: ' || {_pct('conf')} || ' (' || {LABEL} || ')' || chr(10) || chr(10) || 'Component Breakdown:' || chr(10)
      || '  • Semantic Similarity: ' || {_pct('semantic')} || ' (weight: 60%)' || chr(10) || '  • Retrieval Quality: ' || {_pct('retrieval')} || ' (weight: 25%)' || chr(10)
      || '  • Citation Presence: ' || {_pct('citation')} || ' (weight: 10%)' || chr(10) || '  • Coverage: ' || {_pct('coverage')} || ' (weight: 5%)' || chr(10) || chr(10)
      || 'Statistics:' || chr(10) || '  • Verified Sentences: ' || v || '/' || total_sentences || chr(10)
      || '  • Verification Rate: ' || printf('%.1f', 100.0 * case when total_sentences > 0 then v / total_sentences else 0 end) || '%'
      || case when conf < 0.6 then chr(10) || chr(10) || '⚠️ Recommendation: Retry with improved context' else '' end as explanation from r""",
)
def explain_confidence(spark, sf):
    return audit.explain_confidence(audits(spark, sf)).select(*KEYS, "explanation")


AUDIT_COLUMNS = f"""conv_id, turn, answer_hash, total_sentences::bigint as total_sentences, c::bigint as citations, source_count::bigint as source_count, v::bigint as verified_sentences,
    round(semantic, 6) as semantic_similarity, round(retrieval, 6) as retrieval_quality, round(citation, 6) as citation_presence, round(coverage, 6) as coverage,
    round(conf, 6) as confidence_score, {LABEL} as trust_label, error"""


def _flat(df):
    out = df.select(
        *KEYS, "answer_hash", "total_sentences", F.size("citations").alias("citations"), "source_count", "verified_sentences",
        *[F.round(c, 6).alias(c) for c in ("semantic_similarity", "retrieval_quality", "citation_presence", "coverage", "confidence_score")],
        "trust_label", "error",
    )
    return long(out, "total_sentences", "citations", "source_count", "verified_sentences")


@query("e9_audit_batch", AUDIT + f"select {AUDIT_COLUMNS} from r")
def audit_batch(spark, sf):
    return _flat(audits(spark, sf))


# Answers and sources that reach every outcome: of every three conversations one is quoted sentence by sentence and
# cites five times, one has its whole answer as a source, one is as it is. Some have no source, some no sentence.
LABELLED = AUDIT.replace(
    "from conversations where role = 'assistant'),\n    st",
    "from (select conv_id, turn, role, case when conv_id % 11 = 0 then '' when conv_id % 3 = 0 then text || ' (1) (2) (3) (4) (5)' else text end as text from conversations) where role = 'assistant'),\n    st",
).replace(
    "src as (select conv_id, turn as source_id, text, 1.0 / (1 + turn) as score from conversations where role <> 'assistant')",
    """src as (select * from (
        select conv_id, turn as source_id, text, 1.0 / (1 + turn) as score from conversations where role <> 'assistant' and conv_id % 3 = 2
        union all select conv_id, 1000 * turn + i, sentence, 1.0 from st where conv_id % 3 = 0
        union all select conv_id, turn, text, 0.9 from a where conv_id % 3 = 1) where conv_id % 7 <> 0)""",
)


def _labelled(spark, sf):
    mod = F.col("conv_id") % 3
    made = F.when(F.col("conv_id") % 11 == 0, "").when(mod == 0, F.concat("text", F.lit(" (1) (2) (3) (4) (5)"))).otherwise(F.col("text"))
    a = answers(spark, sf).withColumn("text", made)
    quoted = sentences.analyze_answers(a.filter(mod == 0), KEYS, "text", GERMAN, REFS)
    quoted = exploded(quoted, KEYS, F.col("sentences"), "i", "text").select(
        "conv_id", (1000 * F.col("turn") + F.col("i")).alias("source_id"), "text", F.lit(1.0).alias("score")
    )
    whole = a.filter(mod == 1).select("conv_id", F.col("turn").alias("source_id"), "text", F.lit(0.9).alias("score"))
    return a, union_rows(sources(spark, sf).filter(mod == 2), quoted, whole).filter("conv_id % 7 <> 0")


@query("e9_all_outcomes", LABELLED + f"select {AUDIT_COLUMNS} from r")
def all_outcomes(spark, sf):
    """Verified, Review and Rejected answers, and both errors."""
    return _flat(audit.audit_batch(*_labelled(spark, sf), "conv_id", KEYS, "text", GERMAN, REFS, threshold=T))


@query(
    "e9_outcome_counts",
    LABELLED + f"select {LABEL} as trust_label, coalesce(error, '') as error, count(*) as n, round(avg(conf), 6) as confidence from r group by all",
)
def outcome_counts(spark, sf):
    out = audit.audit_batch(*_labelled(spark, sf), "conv_id", KEYS, "text", GERMAN, REFS, threshold=T)
    return out.groupBy("trust_label", F.coalesce("error", F.lit("")).alias("error")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence_score"), 6).alias("confidence")
    )


# The second round's sources are the user turns only, with a full retrieval score.
WIDER = AUDIT.replace("1.0 / (1 + turn) as score from conversations where role <> 'assistant'", "1.0 as score from conversations where role = 'user'")


@query(
    "e10_audit_with_retry",
    f"""select *, 0::bigint as retry_attempts from ({AUDIT} select {AUDIT_COLUMNS} from r where conf >= 0.6)
        union all select *, 1::bigint from ({WIDER} select {AUDIT_COLUMNS} from r) w
        where (conv_id, turn) in (select (conv_id, turn) from ({AUDIT} select conv_id, turn from r where conf < 0.6))""",
)
def audit_with_retry(spark, sf):
    c = table(spark, sf, "conversations")
    wider = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("source_id"), "text", F.lit(1.0).alias("score"))
    out = audit.audit_with_retry(
        answers(spark, sf), [sources(spark, sf), wider], "conv_id", KEYS, "text", GERMAN, REFS, threshold=T
    )
    flat = _flat(out)
    return out.select(*KEYS, F.col("retry_attempts").cast("long").alias("retry_attempts")).join(flat, KEYS)


# The third round's sources are the answers themselves.
WIDEST = AUDIT.replace("1.0 / (1 + turn) as score from conversations where role <> 'assistant'", "1.0 as score from conversations where role = 'assistant'")


@query(
    "e10_two_retries",
    f"""with first as ({AUDIT} select {AUDIT_COLUMNS} from r), second as ({WIDER} select {AUDIT_COLUMNS} from r), third as ({WIDEST} select {AUDIT_COLUMNS} from r),
    low as (select conv_id, turn from ({AUDIT} select conv_id, turn from r where conf < 0.6)),
    lower as (select w.conv_id, w.turn from ({WIDER} select conv_id, turn from r where conf < 0.6) w join low using (conv_id, turn))
    select *, 0::bigint as retry_attempts from first where (conv_id, turn) not in (select (conv_id, turn) from low)
    union all select *, 1::bigint from second where (conv_id, turn) in (select (conv_id, turn) from low) and (conv_id, turn) not in (select (conv_id, turn) from lower)
    union all select *, 2::bigint from third where (conv_id, turn) in (select (conv_id, turn) from lower)""",
)
def two_retries(spark, sf):
    c = table(spark, sf, "conversations")
    of = lambda role: c.filter(F.col("role") == role).select("conv_id", F.col("turn").alias("source_id"), "text", F.lit(1.0).alias("score"))
    out = audit.audit_with_retry(
        answers(spark, sf), [sources(spark, sf), of("user"), of("assistant")], "conv_id", KEYS, "text", GERMAN, REFS, threshold=T
    )
    return out.select(*KEYS, F.col("retry_attempts").cast("long").alias("retry_attempts")).join(_flat(out), KEYS)


@query(
    "a18_append_verifications",
    AUDIT + f"""select conv_id || '-' || turn as verification_id, answer_hash, total_sentences::bigint as answer_sentences, v::bigint as verified_sentences,
      round(coverage, 6) as verification_rate, round(conf, 6) as confidence_score, {LABEL} as trust_label, 0::bigint as retry_attempts, true as is_valid from r""",
)
def append_verifications(spark, sf):
    rows = store.verification_rows(audits(spark, sf), KEYS, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return long(
        rows.select(
            "verification_id", "answer_hash", "answer_sentences", "verified_sentences", F.round("verification_rate", 6).alias("verification_rate"),
            F.round("confidence_score", 6).alias("confidence_score"), "trust_label", "retry_attempts", "is_valid",
        ),
        "retry_attempts",
    )


@query(
    "a18_whole_log_rows",
    AUDIT + f"""select conv_id || '-' || turn as verification_id, a.text as answer_text, answer_hash, total_sentences::bigint as answer_sentences, source_count::bigint as source_count,
      round(conf, 6) as confidence_score, {LABEL} as trust_label, 'conversations' as origin, (total_sentences * 3)::bigint as duration_ms,
      (select count(distinct text) from src where src.conv_id = r.conv_id)::bigint as fingerprints, error
      from r join a using (conv_id, turn)""",
)
def whole_log_rows(spark, sf):
    """Log rows and the links to their sources, appended to a store in two batches and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/verifications-{uuid.uuid4().hex}"
    done = audits(spark, sf)
    made = store.verification_rows(
        done, KEYS, F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(days=(F.col("conv_id") % 3).cast("int")),
        metadata=F.create_map(F.lit("origin"), F.lit("conversations")), duration_ms=F.col("total_sentences") * 3,
    )
    made = stored(made)
    used = store.verification_links(done, KEYS, audit.source_fingerprints(sources(spark, sf), "conv_id"), "conv_id")
    odd = F.crc32("verification_id") % 2 == 1
    for part in (odd, ~odd):
        store.append_verifications(made.filter(part), path, used.filter(part))
    log, links = store.read_verifications(spark, path)
    n = links.groupBy("verification_id").agg(F.count_distinct("source_hash").alias("fingerprints"))
    out = log.join(n, "verification_id", "left").select(
        "verification_id", "answer_text", "answer_hash", "answer_sentences", "source_count", F.round("confidence_score", 6).alias("confidence_score"),
        "trust_label", F.col("metadata")["origin"].alias("origin"), "duration_ms", F.coalesce("fingerprints", F.lit(0)).alias("fingerprints"), "error",
    )
    return long(out, "answer_sentences", "source_count", "duration_ms", "fingerprints")


@query(
    "a21_export_fingerprints",
    "select conv_id, turn as source_id, sha256(text) as source_hash, left(sha256(text), 16) as fingerprint from conversations where role <> 'assistant'",
)
def fingerprints(spark, sf):
    return audit.source_fingerprints(sources(spark, sf), "conv_id")


# --- citations ------------------------------------------------------------------------------
# Terms of four or more letters that open a sentence stand in for section ids.

CITE = "[A-ZÀ-Ý][a-zß-ÿ]{3,}"
ANSWERS = f"(select conv_id, turn, conv_id || '-' || turn as answer_id, text, list_sort(list_distinct(regexp_extract_all(text, '{CITE}'))) as citations from conversations where role = 'assistant')"
HITS = """(select a.conv_id || '-' || a.turn as answer_id, s.turn as rank, s.turn as chunk_id, s.role as section_id, s.text as content, 0.9 / (1 + s.turn) as similarity
           from conversations a join conversations s on s.conv_id = a.conv_id and s.turn = a.turn - 1 where a.role = 'assistant')"""
CITED = f"""
    c as (select answer_id, text, unnest(citations) as citation from {ANSWERS}),
    m as (select c.answer_id, c.citation, h.* exclude (answer_id) from c left join {HITS} h
            on h.answer_id = c.answer_id and (contains(lower(h.section_id), lower(c.citation)) or contains(lower(h.content), lower(c.citation)))
          qualify row_number() over (partition by c.answer_id, c.citation order by h.rank, h.chunk_id) = 1)
"""


def _ws(x: str) -> str:
    return f"list_distinct({sql_words(f'lower({x})')})"


def _jac(a: str, b: str) -> str:
    return f"case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) else 0.0 end"


CONF = f"""
    s as (select c.answer_id, c.citation, unnest(regexp_split_to_array(c.text, {lit(citations.CLAIM_SPLIT)})) as sentence from c),
    w as (select s.answer_id, s.citation, {_ws(sql_strip(f"regexp_replace(sentence, {lit(citations.MARKER)}, '', 'g')"))} as ws, {_ws('m.content')} as wc
          from s join m on m.answer_id = s.answer_id and m.citation = s.citation
          where m.chunk_id is not null and contains(lower(sentence), lower(s.citation))),
    b as (select answer_id, citation, count(*) filter ({_jac('ws', 'wc')} > 0.5) as n from w group by all),
    cc as (select m.answer_id, m.citation, m.chunk_id, case when m.chunk_id is null then 0.0 when coalesce(b.n, 0) > 0 then least(1.0, m.similarity + b.n * 0.15) else m.similarity end as confidence
           from m left join b on b.answer_id = m.answer_id and b.citation = m.citation)
"""
CLAIMS = f"""
    ok as (select answer_id, list(citation) as ok from cc where confidence > 0.5 group by 1),
    cl as (select x.answer_id, x.i as sentence_index, {sql_strip('x.sentence')} as sentence from (
             select answer_id, unnest(range(len(l))) as i, unnest(l) as sentence from (select answer_id, regexp_split_to_array(text, {lit(citations.CLAIM_SPLIT)}) as l from {ANSWERS})) x
           left join ok on ok.answer_id = x.answer_id
           where len({sql_words('x.sentence')}) >= 5 and ({' or '.join(f"contains(lower(x.sentence), {lit(k)})" for k in citations.CLAIM_WORDS)})
             and len(list_filter(coalesce(ok.ok, []), lambda k: contains(x.sentence, k))) = 0)
"""


def cited_answers(spark, sf):
    return answers(spark, sf).select(
        F.concat_ws("-", *KEYS).alias("answer_id"), "text",
        F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(CITE), F.lit(0)))).alias("citations"),
    )


def hits(spark, sf):
    """The turn before an answer is what it was given to read."""
    c = table(spark, sf, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("at"), (F.col("turn") - 1).alias("turn"))
    return a.join(c, KEYS).select(
        F.concat_ws("-", "conv_id", "at").alias("answer_id"), F.col("turn").alias("rank"), F.col("turn").alias("chunk_id"),
        F.col("role").alias("section_id"), F.col("text").alias("content"), (0.9 / (1 + F.col("turn"))).alias("similarity"),
    )


@query("d8_match_citations", f"with {CITED} select answer_id, citation, chunk_id, round(similarity, 6) as similarity from m")
def match_citations(spark, sf):
    return citations.match_citations(cited_answers(spark, sf), hits(spark, sf)).select(
        "answer_id", "citation", "chunk_id", F.round("similarity", 6).alias("similarity")
    )


@query("e34_citation_confidence", f"with {CITED}, {CONF} select answer_id, citation, chunk_id, round(confidence, 6) as confidence from cc")
def citation_confidence(spark, sf):
    return citations.citation_confidence(cited_answers(spark, sf), hits(spark, sf)).select(
        "answer_id", "citation", "chunk_id", F.round("confidence", 6).alias("confidence")
    )


@query("e35_unsupported_claims", f"with {CITED}, {CONF}, {CLAIMS} select answer_id, sentence_index, sentence from cl")
def unsupported_claims(spark, sf):
    a = cited_answers(spark, sf)
    out = citations.unsupported_claims(a, citations.citation_confidence(a, hits(spark, sf)))
    return long(out, "sentence_index")


@query(
    "e36_verify_citations",
    f"""with {CITED}, {CONF}, {CLAIMS}
    select a.answer_id, coalesce(u.n, 0) = 0 as is_supported, coalesce(p.n, 0) as citations, coalesce(p.strong, 0) as strong_citations, coalesce(u.n, 0) as unsupported,
           round(coalesce(p.mean, 0.5) * case when coalesce(u.n, 0) > 0 then 0.6 else 1 end, 6) as confidence
    from {ANSWERS} a left join (select answer_id, avg(confidence) as mean, count(*) as n, count(*) filter (confidence > 0.7) as strong from cc group by 1) p on p.answer_id = a.answer_id
    left join (select answer_id, count(*) as n from cl group by 1) u on u.answer_id = a.answer_id""",
)
def verify_citations(spark, sf):
    return citations.verify_citations(cited_answers(spark, sf), hits(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query(
    "e37_jaccard",
    f"""select a.conv_id, a.turn, round({_jac('x', 'y')}, 6) as overlap from (
          select a.conv_id, a.turn, {_ws('a.text')} as x, {_ws('b.text')} as y
          from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1) a""",
)
def word_jaccard(spark, sf):
    c = table(spark, sf, "conversations").select(*KEYS, citations.word_set(F.col("text")).alias("x"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return c.join(nxt, KEYS).select(*KEYS, F.round(jaccard(F.col("x"), F.col("y")), 6).alias("overlap"))


@query(
    "g6_word_set_overlap",
    f"""select a.conv_id, a.turn, len(list_intersect(x, y))::bigint as common, len(list_distinct(x || y))::bigint as total from (
          select a.conv_id, a.turn, list_distinct({sql_tokens('a.text')}) as x, list_distinct({sql_tokens('b.text')}) as y
          from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1) a""",
)
def word_set_overlap(spark, sf):
    c = table(spark, sf, "conversations").select(*KEYS, F.array_distinct(tokens(F.col("text"))).alias("x"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    j = c.join(nxt, KEYS)
    return j.select(
        *KEYS, F.size(F.array_intersect("x", "y")).cast("long").alias("common"), F.size(F.array_union("x", "y")).cast("long").alias("total")
    )


# --- lineage: orders are verifications, their line items the sources they used ---------------

LINKS = "(select distinct l_orderkey as verification_id, sha256(l_partkey::varchar) as source_hash from lineitem)"


def links(spark, sf):
    # Distinct by the short key: its hash is eight times as long, and many readers only count the links.
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("verification_id"), "l_partkey").distinct()
    return used.select("verification_id", F.sha2(F.col("l_partkey").cast("string"), 256).alias("source_hash"))


def snapshots(spark, sf):
    """Price snapshots of parts: a source text that changes over time."""
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("source_id"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("n"), F.sha2(F.col("l_returnflag"), 256).alias("source_hash"), F.col("l_extendedprice").alias("p"),
    )


SNAP = "select l_partkey as source_id, l_shipdate as ts, l_orderkey as o, l_linenumber as n, sha256(l_returnflag) as source_hash, l_extendedprice as p from lineitem"
VERSIONS = f"""
    select source_id, ts, o, n, p, source_hash, previous_hash, changed, 1 + sum(changed::int) over (partition by source_id order by ts, o, n, p rows unbounded preceding) as version
    from (select *, coalesce(previous_hash <> source_hash, false) as changed from (
      select *, lag(source_hash) over (partition by source_id order by ts, o, n, p) as previous_hash from ({SNAP})))
"""


def _versions(spark, sf):
    return lineage.source_versions(snapshots(spark, sf), order=["ts", "o", "n", "p"])


@query("f2_source_versions", f"select source_id, ts, o, n::bigint as n, p, left(previous_hash, 16) as previous_hash, changed, version::bigint as version from ({VERSIONS})")
def source_versions(spark, sf):
    return long(
        _versions(spark, sf).select("source_id", "ts", "o", "n", "p", F.substring("previous_hash", 1, 16).alias("previous_hash"), "changed", "version"),
        "n", "version",
    )


@query(
    "f2_affected_verifications",
    f"""
    with v as ({VERSIONS}), l as (select distinct l_orderkey as verification_id, sha256(l_returnflag) as source_hash from lineitem),
    c as (select source_hash, count(distinct verification_id) as n from l group by 1)
    select source_id, version::bigint as version, case when changed then coalesce(c.n, 0) else 0 end as affected_verifications, count(*) as snapshots
    from v left join c on c.source_hash = v.previous_hash group by all
    """,
)
def affected(spark, sf):
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("verification_id"), F.sha2("l_returnflag", 256).alias("source_hash"))
    out = lineage.affected_verifications(_versions(spark, sf), used)
    return out.groupBy("source_id", "version", "affected_verifications").agg(F.count(F.lit(1)).alias("snapshots"))


@query(
    "f3_latest_fingerprint",
    f"select source_id, source_hash, ts from ({SNAP}) qualify row_number() over (partition by source_id order by ts desc, o desc, n desc, p desc) = 1",
)
def latest_fingerprint(spark, sf):
    return lineage.latest_fingerprint(snapshots(spark, sf), order=["ts", "o", "n", "p"]).select("source_id", "source_hash", "ts")


@query("f3_fingerprint_by_hash", f"select source_id, ts, p from ({SNAP}) where source_hash = sha256('R')")
def fingerprint_by_hash(spark, sf):
    import hashlib

    return lineage.fingerprint_by_hash(snapshots(spark, sf), hashlib.sha256(b"R").hexdigest()).select("source_id", "ts", "p")


@query("f4_verification_page", f"select verification_id, created_at from {LOG_SQL} order by created_at desc, verification_id limit 100 offset 50")
def verification_page(spark, sf):
    """The page behind the fiftieth row, by that row and not by counting."""
    log = log_table(spark, sf).select("verification_id", "created_at")
    before = lineage.page_after(log, "created_at", "verification_id", None, 50).collect()
    if len(before) < 50:
        return log.limit(0)
    return lineage.page_after(log, "created_at", "verification_id", (before[-1]["created_at"], before[-1]["verification_id"]), 100)


@query(
    "d12_invalidate_by_source",
    f"""
    with hit as (select distinct verification_id from {LINKS} where source_hash in (select sha256(p_partkey::varchar) from part where p_size >= 48))
    select v.verification_id, v.is_valid and h.verification_id is null as is_valid,
           case when v.is_valid and h.verification_id is not null then timestamp '2024-02-01' end as invalidated_at
    from {LOG_SQL} v left join hit h on h.verification_id = v.verification_id
    """,
)
def invalidate_by_source(spark, sf):
    changed = table(spark, sf, "part").filter("p_size >= 48").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("source_hash"))
    log = log_table(spark, sf).withColumn("invalidated_at", F.lit(None).cast("timestamp_ntz"))
    at = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    return lineage.invalidate_by_source(log, links(spark, sf), changed, at).select("verification_id", "is_valid", "invalidated_at")


@query(
    "d13_audit_trail",
    f"""
    select distinct f.source_id, v.verification_id, v.created_at from (select p_brand as source_id, sha256(p_partkey::varchar) as source_hash from part) f
    join {LINKS} l on l.source_hash = f.source_hash join {LOG_SQL} v on v.verification_id = l.verification_id
    """,
)
def audit_trail(spark, sf):
    fp = table(spark, sf, "part").select(F.col("p_brand").alias("source_id"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("source_hash"))
    return lineage.audit_trail(fp, links(spark, sf), log_table(spark, sf)).select("source_id", "verification_id", "created_at")


@query(
    "d13_newest_audits",
    f"""
    select distinct v.verification_id, v.created_at from (select sha256(p_partkey::varchar) as source_hash from part) f
    join {LINKS} l on l.source_hash = f.source_hash join {LOG_SQL} v on v.verification_id = l.verification_id
    order by v.created_at desc, v.verification_id limit 100
    """,
)
def newest_audits(spark, sf):
    trail = audit_trail(spark, sf).select("verification_id", "created_at").distinct()
    return lineage.page_after(trail, "created_at", "verification_id", None)


@query(
    "d14_verification_status",
    f"""
    select v.verification_id, v.is_valid, v.trust_label, count(l.source_hash) as source_count from {LOG_SQL} v left join {LINKS} l on l.verification_id = v.verification_id
    where v.verification_id in (select user_id from events) group by all
    """,
)
def verification_status(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").alias("verification_id"))
    return lineage.verification_status(log_table(spark, sf), links(spark, sf), ids).select(
        "verification_id", "is_valid", "trust_label", "source_count"
    )


@query(
    "e11_log_statistics",
    f"""select count(*) as total_verifications, count(*) filter (is_valid) as valid_verifications, count(*) filter (not is_valid) as invalid_verifications,
          count(*) filter (trust_label = '{scoring.VERIFIED}') as verified, count(*) filter (trust_label = '{scoring.REVIEW}') as review,
          count(*) filter (trust_label = '{scoring.REJECTED}') as rejected, round(avg(confidence_score) filter (is_valid), 6) as average_confidence from {LOG_SQL}""",
)
def log_statistics(spark, sf):
    return lineage.log_statistics(log_table(spark, sf), scoring.VERIFIED, scoring.REVIEW, scoring.REJECTED).withColumn(
        "average_confidence", F.round("average_confidence", 6)
    )


@query(
    "e12_fingerprint_statistics",
    f"""select * from (select count(distinct source_hash) as total_fingerprints, count(distinct source_id) as unique_sources from ({SNAP})),
          (select count(*) as total_verifications, count(*) filter (is_valid) as valid_verifications, count(*) filter (not is_valid) as invalid_verifications from {LOG_SQL})""",
)
def fingerprint_statistics(spark, sf):
    return lineage.fingerprint_statistics(snapshots(spark, sf), log_table(spark, sf))


@query(
    "d10_drop_known_documents",
    """select min(doc_id) as doc_id from documents where sha256(text) not in
         (select sha256(text) from documents d join labels l on l.doc_id = d.doc_id where l.quality = 0) group by sha256(text)""",
)
def drop_known_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    known = d.join(table(spark, sf, "labels").filter("quality = 0"), "doc_id", "left_semi")
    return lineage.drop_known_documents(d, known).select("doc_id")
