"""Chunks, sections, sentences, citations in text, personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.domains import GERMAN, GERMAN_LEGAL, DomainPack
from ..functions.rows import exploded
from ..functions.text import strip
from ..operators import chunking, pii, sections, sentences
from ..streaming.runs import bad_record_report, guarded_chunks
from .catalog import WS, lit, query, sql_strip, sql_words, texts
from .corpus import sql_answer

EMAIL = pii.EMAIL.pattern
REFS = DomainPack("refs", (r"\([0-9]+\)", EMAIL), ("the ", "der "))


def long(df, *cols):
    """Counts as bigint, the type the SQL twins give."""
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# --- chunks ---------------------------------------------------------------------------------


def _rfind(region: str, mark: str) -> str:
    m = lit(mark)
    return (
        f"case when contains({region}, {m}) then length({region}) - strpos(reverse({region}), reverse({m})) - length({m}) + 1 else -1 end"
    )


def sql_windows(rows: str, key: str, size: int, overlap: int) -> str:
    """Boundary windows of ``rows(key, text)``: one recursion step per window."""
    zone = int(size * 0.2)
    soft = "case " + " ".join(
        f"when contains(region, {lit(m)}) then s + {size - zone} + ({_rfind('region', m)}) + {len(m)}" for m in chunking.SENTENCE_ENDS
    ) + f" else s + 2 + ({_rfind('body', ' ')}) end"
    step = f"""
        select {key}, text, s, case when s + {size} < length(text) and soft > s + {overlap} then soft else s + {size} end as e
        from (select *, {soft} as soft from (
          select {key}, text, s, substring(text, s + 1 + {size - zone}, {zone}) as region, substring(text, s + 2, {size - 1}) as body from (%s)))"""
    return f"""
        with recursive w as (
          {step % f"select {key}, text, 0::bigint as s from ({rows})"}
          union all {step % f"select {key}, text, e - {overlap} as s from w where e - {overlap} < length(text)"})
        select {key}, s, {sql_strip("substring(text, s + 1, e - s)")} as text from w where {sql_strip("substring(text, s + 1, e - s)")} <> ''"""


BIG = "length(p.part) > 4000"
OVER = "f.used + length(p.part) + 2 > 4000"


@query(
    "c1_chunk_paragraphs",
    f"""
    with recursive p as (
      select doc_id, row_number() over (partition by doc_id order by i) as i, part from (
        select doc_id, unnest(range(len(string_split(text, '.')))) as i, {sql_strip("unnest(string_split(text, '.'))")} as part
        from documents where length(text) > 4000) where part <> ''),
    f as (
      select doc_id, 0::bigint as i, []::varchar[] as held, 0::bigint as used, null::varchar as done from p where i = 1
      union all
      select p.doc_id, p.i,
             case when {BIG} then [] when not {OVER} then list_append(f.held, p.part) when len(f.held) > 0 then [f.held[-1], p.part] else [p.part] end,
             case when {BIG} then 0 when not {OVER} then f.used + length(p.part) + 2
                  when len(f.held) > 0 then length(f.held[-1]) + length(p.part) + 2 else length(p.part) end,
             case when len(f.held) > 0 and ({BIG} or {OVER}) then array_to_string(f.held, '.') end
      from f join p on p.doc_id = f.doc_id and p.i = f.i + 1),
    big as ({sql_windows("select doc_id::varchar || '/' || i as k, part as text from p where length(part) > 4000", "k", 4000, 100)}),
    out as (
      select doc_id, i, 0 as j, done as text from f where done is not null
      union all select doc_id, 1000000000, 0, array_to_string(held, '.') from (
        select * from f qualify row_number() over (partition by doc_id order by i desc) = 1) where len(held) > 0
      union all select split_part(k, '/', 1)::bigint, split_part(k, '/', 2)::bigint, s + 1, text from big
      union all select doc_id, 0, 0, text from documents where length(text) between 1 and 4000)
    select doc_id, row_number() over (partition by doc_id order by i, j) - 1 as chunk_index, text from out
    """,
)
def chunk_paragraphs(spark, sf):
    d = texts(spark, sf, "documents").select("doc_id", "text")
    out = chunking.chunk_corpus(d, chunking.chunk_paragraphs(F.col("text"), 4000, 100, "."))
    return long(out.select("doc_id", "chunk_index", "text"), "chunk_index")


FIXED = """
    select doc_id, row_number() over (partition by doc_id order by s) - 1 as chunk_index, piece as text
    from (select doc_id, s, {strip} as piece from (
            select doc_id, text, unnest(range(0, length(text), 700)) as s from documents))
    where piece <> ''
""".format(strip=sql_strip("substring(text, s + 1, 800)"))


def _fixed(spark, sf):
    d = texts(spark, sf, "documents").select("doc_id", "lang", "text")
    return chunking.chunk_corpus(d, chunking.chunk_windows(F.col("text"), 800, 100, boundary=False))


@query("c2_chunk_windows_fixed", FIXED)
def chunk_windows_fixed(spark, sf):
    return long(_fixed(spark, sf).select("doc_id", "chunk_index", "text"), "chunk_index")


@query(
    "c2_chunk_windows_boundary",
    f"""select doc_id, row_number() over (partition by doc_id order by s) - 1 as chunk_index, text
        from ({sql_windows("select doc_id, text from documents", "doc_id", 800, 100)})""",
)
def chunk_windows_boundary(spark, sf):
    d = texts(spark, sf, "documents").select("doc_id", "text")
    out = chunking.chunk_corpus(d, chunking.chunk_windows(F.col("text"), 800, 100))
    return long(out.select("doc_id", "chunk_index", "text"), "chunk_index")


@query(
    "c3_chunk_corpus",
    f"""select c.doc_id || '_chunk_' || chunk_index as chunk_id, c.doc_id, d.lang, chunk_index,
               count(*) over (partition by c.doc_id) as total_chunks, length(c.text)::bigint as chars
        from ({FIXED}) c join documents d on d.doc_id = c.doc_id""",
)
def chunk_corpus(spark, sf):
    out = _fixed(spark, sf).withColumn("chars", F.length("text"))
    return long(out.select("chunk_id", "doc_id", "lang", "chunk_index", "total_chunks", "chars"), "chunk_index", "total_chunks", "chars")


@query(
    "e33_chunk_stats",
    f"""select sum(n)::bigint as chunks, count(*) as documents, round(avg(n), 6) as chunks_per_document, max(n) as most_chunks
        from (select doc_id, count(*) as n from ({FIXED}) group by 1)""",
)
def chunk_stats(spark, sf):
    return chunking.chunk_stats(_fixed(spark, sf)).withColumn("chunks_per_document", F.round("chunks_per_document", 6))


@query(
    "j11_bad_record_report",
    f"""select doc_id, case when {sql_strip("coalesce(text, '')")} = '' then 'empty text' else 'fewer than 20 characters' end as error
        from documents where length({sql_strip("coalesce(text, '')")}) < 20""",
)
def bad_records(spark, sf):
    """Documents without a chunk, and those that are chunked but too short for the corpus, each with its reason."""
    d = guarded_chunks(texts(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit(""))))
    bare = F.length(strip(F.col("text")))
    checks = {"empty text": F.col("error") == "empty text", "not chunked": F.col("error").isNotNull(), "fewer than 20 characters": bare < 20}
    return bad_record_report(d, checks, "doc_id")[1].withColumnRenamed("reason", "error")


# --- sections of pages ----------------------------------------------------------------------

MARK = "<(?:[hH]1[^>]*|[pP][^>]*|[bB])>"
PAGE_PARTS = f"""
    select page_id, i, unnest_m as marker, piece,
           case when starts_with(lower(unnest_m), '<h1') then 0 when starts_with(lower(unnest_m), '<p') then 1 else 2 end as level,
           sum(length(before)) over w + coalesce(sum(length(unnest_m)) over (partition by page_id order by i rows between unbounded preceding and 1 preceding), 0) as start
    from (select page_id, unnest(range(len(m))) as i, unnest(m) as unnest_m, unnest(pieces[2:]) as piece, unnest(pieces[:len(m)]) as before
          from (select page_id, regexp_extract_all(html, '{MARK}') as m, regexp_split_to_array(html, '{MARK}') as pieces from pages))
    window w as (partition by page_id order by i)
"""
SECTIONS = f"""
    select page_id, row_number() over (partition by page_id order by i) - 1 as position, {sql_strip('marker')} as section_id,
           {sql_strip('piece')} as content, level,
           case level when 0 then 'section' when 1 then 'subsection' else 'clause' end as chunk_type
    from ({PAGE_PARTS}) where {sql_strip('piece')} <> ''
"""
PARENTS = f"""
    with s as ({SECTIONS})
    select s.*, (select max(p.position) from s p where p.page_id = s.page_id and p.position < s.position and p.level < s.level) as parent_position
    from s
"""


def page_sections(spark, sf):
    out = sections.parse_sections(texts(spark, sf, "pages"), "page_id", F.col("html"), sections.PAGE_MARKERS)
    return long(out, "position", "level", "parent_position")


@query(
    "c4_extract_markers",
    f"""select page_id, cast(start as bigint) as start, cast(start + length(marker) as bigint) as stop, marker as section_id, level::bigint as level
        from ({PAGE_PARTS})""",
)
def extract_markers(spark, sf):
    found = sections.extract_markers(F.col("html"), sections.PAGE_MARKERS)
    m = exploded(texts(spark, sf, "pages"), ["page_id"], found, "n", "m")
    return long(m.select("page_id", "m.start", "m.stop", "m.section_id", "m.level"), "start", "stop", "level")


@query("c5_section_spans", f"select page_id, position, section_id, content, level::bigint as level, chunk_type from ({SECTIONS})")
def section_spans(spark, sf):
    return page_sections(spark, sf).drop("parent_position")


@query("c6_section_hierarchy", f"select page_id, position, level::bigint as level, parent_position from ({PARENTS})")
def section_hierarchy(spark, sf):
    return page_sections(spark, sf).select("page_id", "position", "level", "parent_position")


def _pieces(rows: str) -> str:
    """One step of the section split: end at the last full stop of the window, else hard."""
    return f"""select page_id, position, section_id, chunk_type, content, s,
               case when s + 300 < length(content) and soft > s + 50 then soft else s + 300 end as e
        from (select *, s + ({_rfind("substring(content, s + 1, 300)", ". ")}) + 1 as soft from ({rows}))"""


@query(
    "c7_split_sections",
    f"""
    with recursive x as ({SECTIONS}),
    w as ({_pieces("select page_id, position, section_id, chunk_type, content, 0::bigint as s from x where length(content) > 300")}
          union all {_pieces("select page_id, position, section_id, chunk_type, content, e - 50 as s from w where e < length(content)")}),
    p as (select page_id, position, section_id, chunk_type, {sql_strip("substring(content, s + 1, e - s)")} as content, true as is_split,
                 row_number() over (partition by page_id, position order by s) - 1 as split_index from w
          union all select page_id, position, section_id, chunk_type, content, false, 0 from x where length(content) <= 300),
    n as (select *, row_number() over (partition by page_id order by position, split_index) - 1 as running from p)
    select page_id, running as position, case when is_split then section_id || '_' || split_index else section_id end as section_id, content, chunk_type, is_split,
           case when is_split then split_index end as split_index, case when is_split then section_id end as parent_section_id,
           length(content)::bigint as char_count, len({sql_words('content')})::bigint as word_count
    from n
    """,
)
def split_sections(spark, sf):
    out = sections.number_chunks(texts(spark, sf, "pages"), "page_id", F.col("html"), sections.PAGE_MARKERS, 300, 50)
    return long(out, "position", "split_index", "char_count", "word_count")


@query(
    "c8_number_chunks",
    f"""select page_id, position, section_id, length(content)::bigint as char_count, len({sql_words('content')})::bigint as word_count
        from ({SECTIONS})""",
)
def number_chunks(spark, sf):
    # No section of the test pages is longer than the limit, so positions are those of the sections.
    out = sections.number_chunks(texts(spark, sf, "pages"), "page_id", F.col("html"), sections.PAGE_MARKERS, 1_000_000)
    return long(out.select("page_id", "position", "section_id", "char_count", "word_count"), "position", "char_count", "word_count")


@query(
    "c12_extract_section_ids",
    "select doc_id, array_to_string(list_sort(list_distinct(list_transform({0}, lambda x: {1}))), '|') as section_ids from documents".format(
        " || ".join(f"regexp_extract_all(text, {lit('(?i)' + p.replace(chr(92) + 's', WS))})" for p, _, _ in sections.GERMAN_MARKERS),
        sql_strip("x"),
    ),
)
def extract_section_ids(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id", F.array_join(sections.extract_section_ids(F.col("text")), "|").alias("section_ids")
    )


@query("b13_search_in_sections", f"select page_id, position from ({SECTIONS}) where contains(lower(content), 'tion the') or contains(lower(section_id), 'tion the')")
def search_in_sections(spark, sf):
    return sections.search_in_sections(page_sections(spark, sf), "tion THE").select("page_id", "position")


# --- sentences ------------------------------------------------------------------------------

END = f"[.!?]+{WS}+"


def sql_sentences(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({x}, {lit(END)}), lambda s: {sql_strip('s')}), lambda s: length(s) >= 3)"
    )


@query(
    "c9_split_sentences",
    f"""select doc_id, unnest(range(len(s))) as sentence_index, unnest(s) as sentence from (select doc_id, {sql_sentences('text')} as s from documents)""",
)
def split_sentences(spark, sf):
    d = texts(spark, sf, "documents")
    out = exploded(d, ["doc_id"], sentences.split_sentences(F.col("text")), "sentence_index", "sentence")
    return long(out, "sentence_index")


@query(
    "c10_sentence_table",
    f"""
    with n as (select conv_id, turn, {sql_answer('text')} as x from conversations),
    p as (select conv_id, turn, unnest(range(len(pieces))) as i, unnest(pieces) as piece, unnest(list_prepend('', ends)) as gap
          from (select conv_id, turn, regexp_split_to_array(x, {lit(END)}) as pieces, regexp_extract_all(x, {lit(END)}) as ends from n)),
    o as (select *, sum(length(gap)) over w + coalesce(sum(length(piece)) over (partition by conv_id, turn order by i rows between unbounded preceding and 1 preceding), 0) as pos0
          from p window w as (partition by conv_id, turn order by i))
    select conv_id, turn, row_number() over (partition by conv_id, turn order by i) - 1 as sentence_index, {sql_strip('piece')} as sentence,
           cast(pos0 + length(piece) - length(ltrim(piece)) as bigint) as start,
           cast(pos0 + length(piece) - length(ltrim(piece)) + length({sql_strip('piece')}) as bigint) as stop,
           len({sql_words('piece')})::bigint as tokens, regexp_matches({sql_strip('piece')}, {lit('(?:' + REFS.citation_patterns[0] + ')|(?:' + EMAIL + ')')}) as has_citation
    from o where length({sql_strip('piece')}) >= 3
    """,
)
def sentence_table(spark, sf):
    out = sentences.sentence_table(texts(spark, sf, "conversations"), ["conv_id", "turn"], "text", GERMAN, REFS)
    return long(out, "sentence_index", "start", "stop", "tokens")


def sql_citations(x: str) -> str:
    return "list_sort(list_distinct({}))".format(" || ".join(f"regexp_extract_all({x}, {lit(p)})" for p in REFS.citation_patterns))


@query("c11_extract_citations", f"select doc_id, unnest({sql_citations('text')}) as citation from documents")
def extract_citations(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.explode_outer(REFS.citations(F.col("text"))).alias("citation")).filter("citation is not null")


@query("g2_distinct_citations", f"select distinct unnest({sql_citations('text')}) as citation from documents")
def distinct_citations(spark, sf):
    return extract_citations(spark, sf).select("citation").distinct()


STATEMENT = " or ".join(f"contains(text, {lit(k)})" for k in GERMAN_LEGAL.keywords)
CITED = "|".join(f"(?:{p.replace(chr(92) + 's', WS)})" for p in GERMAN_LEGAL.citation_patterns)


@query(
    "c13_is_domain_statement",
    f"select doc_id, regexp_matches(text, {lit(CITED)}) or {STATEMENT} as is_statement from documents",
)
def is_domain_statement(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", GERMAN_LEGAL.is_statement(F.col("text")).alias("is_statement"))


@query(
    "c14_analyze_answers",
    f"""
    with a as (select conv_id, turn, text, {sql_sentences(sql_answer('text'))} as s from conversations where role = 'assistant')
    select conv_id, turn, len(s)::bigint as total_sentences,
           coalesce(list_sum(list_transform(s, lambda y: len({sql_words('y')}))), 0)::bigint as total_tokens,
           len({sql_citations('text')})::bigint as citations from a
    """,
)
def analyze_answers(spark, sf):
    c = texts(spark, sf, "conversations").filter("role = 'assistant'")
    out = sentences.analyze_answers(c, ["conv_id", "turn"], "text", GERMAN, REFS)
    return long(
        out.select("conv_id", "turn", "total_sentences", "total_tokens", F.size("citations").alias("citations")),
        "total_sentences", "total_tokens", "citations",
    )


# --- personal data --------------------------------------------------------------------------

MAILS = f"""
    select doc_id, i, found, sum(length(before)) over w + coalesce(sum(length(found)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start
    from (select doc_id, unnest(range(1, len(m) + 1)) as i, unnest(m) as found, unnest(pieces[:len(m)]) as before
          from (select doc_id, regexp_extract_all(text, {lit(EMAIL)}) as m, regexp_split_to_array(text, {lit(EMAIL)}) as pieces from documents))
    window w as (partition by doc_id order by i)
"""
MASKED = f"""
    select d.doc_id, coalesce(m.head, '') || coalesce(regexp_split_to_array(text, {lit(EMAIL)})[coalesce(m.n, 0) + 1], '') as masked, coalesce(m.n, 0) as entities
    from documents d left join (
      select doc_id, string_agg(before || '<EMAIL_ADDRESS_' || i || '>', '' order by i) as head, count(*) as n
      from (select doc_id, unnest(range(1, len(x) + 1)) as i, unnest(pieces[:len(x)]) as before
            from (select doc_id, regexp_extract_all(text, {lit(EMAIL)}) as x, regexp_split_to_array(text, {lit(EMAIL)}) as pieces from documents))
      group by 1) m on m.doc_id = d.doc_id
"""


def _masked(spark, sf):
    d = texts(spark, sf, "documents").select("doc_id", "text")
    return pii.mask_pii(d, "doc_id", "text", (pii.EMAIL,))


@query(
    "c15_detect_pii",
    f"select doc_id, found as text, cast(start as bigint) as start, cast(start + length(found) as bigint) as stop, '<EMAIL_ADDRESS_' || i || '>' as placeholder from ({MAILS})",
)
def detect_pii(spark, sf):
    d = exploded(texts(spark, sf, "documents"), ["doc_id"], pii.detect_pii(F.col("text"), (pii.EMAIL,)), "n", "e")
    return long(d.select("doc_id", "e.text", "e.start", "e.stop", "e.placeholder"), "start", "stop")


# What is written behind every document: its number in the forms of German identifiers. The VAT number lies within a
# contract number and wins, the second contract number stands alone, a case number and an IBAN follow.
@query(
    "c15_detect_german_ids",
    f"""
    with d as (select doc_id, length(coalesce(text, '')) as behind, doc_id::varchar as n, (doc_id % 97)::varchar as m from documents),
    e as (
      select doc_id, unnest([
        {{'entity': 'VAT_ID', 'text': 'DE' || lpad(n, 9, '0'), 'start': behind + 9, 'score': 0.85, 'placeholder': '<VAT_ID_1>'}},
        {{'entity': 'CONTRACT_NUMBER', 'text': 'V-Nr. ' || n || '/A', 'start': behind + 25, 'score': 0.75, 'placeholder': '<CONTRACT_NUMBER_1>'}},
        {{'entity': 'CASE_NUMBER', 'text': 'Az. ' || m || ' O ' || n || '/23', 'start': behind + 35 + length(n), 'score': 0.85, 'placeholder': '<CASE_NUMBER_1>'}},
        {{'entity': 'IBAN', 'text': 'DE' || lpad(n, 20, '0'), 'start': behind + 49 + 2 * length(n) + length(m), 'score': 0.9, 'placeholder': '<IBAN_1>'}}]) as e from d)
    select doc_id, e.entity, e.text, e.start::bigint as start, (e.start + length(e.text))::bigint as stop, e.score::double as score, e.placeholder from e
    """,
)
def detect_german_ids(spark, sf):
    """All four kinds of identifiers behind every document, in its text as it is."""
    n = F.col("doc_id").cast("string")
    tail = F.concat(
        F.lit(" Vertrag DE"), F.lpad(n, 9, "0"), F.lit(" und V-Nr. "), n, F.lit("/A, Az. "), (F.col("doc_id") % 97).cast("string"), F.lit(" O "), n,
        F.lit("/23 zu DE"), F.lpad(n, 20, "0"), F.lit("."),
    )
    d = texts(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))
    found = exploded(d, ["doc_id"], pii.detect_pii(F.col("text")), "n", "e")
    return long(found.select("doc_id", "e.*"), "start", "stop")


@query("c16_mask_pii", MASKED)
def mask_pii(spark, sf):
    return long(_masked(spark, sf)[0].select("doc_id", "masked", "entities"), "entities")


@query("c17_pii_leak_check", f"select doc_id, not regexp_matches(text, {lit(EMAIL)}) as before, not regexp_matches(masked, {lit(EMAIL)}) as after from ({MASKED}) join documents using (doc_id)")
def pii_leak_check(spark, sf):
    masked, _ = _masked(spark, sf)
    free = lambda c: pii.pii_free(F.col(c), (pii.EMAIL,))
    return masked.select("doc_id", free("text").alias("before"), free("masked").alias("after"))


@query("d15_restore_pii", "select doc_id, text as restored from documents")
def restore_pii(spark, sf):
    masked, mapping = _masked(spark, sf)
    return pii.restore_pii(masked, mapping, "doc_id", "masked").select("doc_id", "restored")


