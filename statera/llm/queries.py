"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, chat, clusters, compression, decontaminate, lexical, licenses, line_dedup, mixing, ngram_join, sharding, token_counts, urls

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_compression_bands")
def op1(spark, sf):
    return compression.compression_bands(table(spark, sf, "documents"))


@query("op2_minimax_shards")
def op2(spark, sf):
    return sharding.minimax_shards(table(spark, sf, "documents"))


@query("op3_token_counts")
def op3(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"))


@query("op4_entropy_balancing")
def op4(spark, sf):
    return mixing.mix_sources(table(spark, sf, "documents"))


@query("op5_line_dedup")
def op5(spark, sf):
    return line_dedup.repeated_lines(table(spark, sf, "documents")).drop("row")


@query("op7_transcript_roles")
def op7(spark, sf):
    return chat.parsed_conversations(table(spark, sf, "conversations"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op6_decontaminate",
    f"""
    with iw as (
      select item_id, w, least(10, len(w)) as k from (select item_id, {WORDS} as w from benchmark) where len(w) > 0),
    windows as (
      select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as win
      from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as p from iw)),
    docs as (select doc_id, {WORDS} as w from documents),
    dw as (
      select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') as win
      from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from docs, (select distinct k from windows))),
    hits as (select doc_id, p, dw.k as k, item_id from dw join windows on dw.k = windows.k and dw.win = windows.win),
    spots as (select doc_id, count(distinct s) as n_hit from (select doc_id, unnest(range(p, p + k)) as s from hits) group by 1),
    items as (
      select doc_id, count(distinct item_id) as n_items,
             array_to_string(list_sort(list(distinct item_id::varchar)), ',') as names from hits group by 1)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
           sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from docs left join spots using (doc_id) left join items using (doc_id)
    """,
)
def op6(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op8_attention_quality")
def op8(spark, sf):
    docs = table(spark, sf, "documents")
    return attention.quality_scores(docs, attention.fit(docs, table(spark, sf, "labels")))


GRAMS = r"""
    words as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') as w from documents),
    grams as (
      select distinct doc_id, array_to_string(w[p:p + 3], ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as p from words where len(w) > 0)),
    sizes as (select doc_id, count(*) as n from grams group by 1)"""


@query(
    "op9_ngram_jaccard",
    f"""
    with recursive {GRAMS},
    common as (
      select x.doc_id as a, y.doc_id as b, count(*) as c from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
    links as (
      select a, b from common join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * c >= 85 * (s.n + t.n - c)),
    ways as (select a, b from links union select b, a from links),
    reach as (
      select doc_id as a, doc_id as b from documents
      union
      select reach.a, ways.b from reach join ways on reach.b = ways.a)
    select documents.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
    from documents join (select a as doc_id, min(b) as component_id from reach group by 1) using (doc_id)
    left join sizes using (doc_id)
    """,
)
def op9(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


def _sql_two(host: str) -> str:
    return f"array_to_string(string_split({host}, '.')[-2:], '.')"


def _sql_level(level: str, parent: str | None, above: str) -> str:
    """Counts, prior mean, weight and posterior of one level, as the method's formulas give them."""
    mean = "(select (sum(bad) + 1.0) / (sum(n) + 2.0) from counts)" if parent is None else f"any_value({above}.mean)"
    join = "" if parent is None else f" join {above} on {above}.name = named.{parent}"
    return f"""
    {level}_c as (
      select {level} as name, sum(named.n)::double as n, sum(named.bad)::double as bad, {mean} as prior
      from named{join} group by 1),
    {level}_w as (
      select case when coalesce(sum(prior * (1 - prior) * (n - 1)), 0) = 0 then 10000.0 else
        1 / least(0.5, greatest(1 / 10001.0, (sum(n * (bad / n - prior) ** 2) - sum(prior * (1 - prior)))
          / sum(prior * (1 - prior) * (n - 1)))) - 1 end as w from {level}_c),
    {level}_p as (
      select name, (w * prior + bad) / (w + n) as mean, w + n as total, w from {level}_c, {level}_w)"""


_BARE = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
_TWO_LABELS = "', '".join(urls.SUFFIXES)


@query(
    "op10_url_filters",
    rf"""
    with split as (
      select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
      from pages),
    counts as (
      select {_BARE} as host, count(*) as n, sum(1 - quality) as bad
      from split join labels on labels.doc_id = try_cast(regexp_extract(path, '/(\d+)(?:\.html)?/?$', 1) as bigint)
      where quality is not null group by 1),
    hosts as (select host, {_sql_two('host')} as two from (select host from counts union select {_BARE} from split)),
    names as (
      select host, case when two in ('{_TWO_LABELS}') then two else string_split(host, '.')[-1] end as suffix,
             case when two in ('{_TWO_LABELS}') then array_to_string(string_split(host, '.')[-3:], '.') else two end as domain
      from hosts),
    named as (select names.*, n, bad from counts join names using (host)),
    {_sql_level("suffix", None, "")},
    {_sql_level("domain", "suffix", "suffix_p")},
    {_sql_level("host", "domain", "domain_p")},
    judged as (
      select page_id, split.host, path, coalesce(host_p.mean, domain_p.mean, suffix_p.mean) as bad_rate,
             coalesce(host_p.mean - 1.645 * sqrt(host_p.mean * (1 - host_p.mean) / (host_p.total + 1)),
               domain_p.mean - 1.645 * sqrt(domain_p.mean * (1 - domain_p.mean) / ((select max(w) from host_p) + 1)),
               suffix_p.mean - 1.645 * sqrt(suffix_p.mean * (1 - suffix_p.mean) / ((select max(w) from host_p) + 1))) as bad_bound,
             case when (split.host = 'www.example.com' or ends_with(split.host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
                  when (split.host = 'example.com' or ends_with(split.host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
                  when (split.host = 'net' or ends_with(split.host, '.net')) and starts_with(path, '/es/') then 'net/es/'
                  when (split.host = 'net' or ends_with(split.host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
                  when (split.host = 'com' or ends_with(split.host, '.com')) and starts_with(path, '/') then 'com/' end as rule
      from split join names on names.host = {_BARE.replace("host", "split.host")} left join host_p on host_p.name = names.host
        left join domain_p on domain_p.name = names.domain left join suffix_p on suffix_p.name = names.suffix)
    select page_id, host, path, rule, bad_rate, bad_bound,
           case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block'
                when coalesce(bad_bound > 0.25, false) then 'block' else 'allow' end as verdict
    from judged
    """,
)
def op10(spark, sf):
    pages = table(spark, sf, "pages")
    return urls.judged_urls(pages, urls.page_outcomes(pages, table(spark, sf, "labels")))


@query("op11_license_scan")
def op11(spark, sf):
    return licenses.license_digest(licenses.license_scan(table(spark, sf, "documents")))


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


@query(
    "op12_lexical_search",
    f"""
    with items as (
      select item_id, term, count(*) as times
      from (select item_id, text, unnest({_TERMS}) as term from (select distinct item_id, text from benchmark where text is not null))
      group by 1, text, 2),
    docs as (select row_number() over () as row, doc_id, {_TERMS} as words from documents where text is not null),
    total as (select count(*) as n, sum(len(words))::bigint as l from docs where len(words) > 0),
    post as (
      select row, term, count(*) as tf from (select row, unnest(words) as term from docs)
      where term in (select term from items) group by 1, 2),
    weights as (
      select term, floor(1000 * ln((2 * any_value(n) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from post, total group by 1),
    norms as (select row, doc_id, 75 + (25 * len(words)::bigint * n) // l as m from docs, total where len(words) > 0),
    scored as (
      select item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
      from items join post using (term) join weights using (term) join norms using (row) group by 1, 2, 3),
    ranked as (
      select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
      from scored where score > 0)
    select item_id, rank, doc_id, score from ranked where rank <= 20
    """,
)
def op12(spark, sf):
    return lexical.ranked_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _sql_rounds(rounds: int = 10) -> str:
    """Assignments and new centroids of all rounds, one after the other."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""
    a{r} as materialized (
      select vec_id, q, c, d from (
        select vec_id, kept.q as q, c, row_number() over (partition by row order by d, c) as place, d
        from (
          select row, vec_id, kept.q as q, c{r}.c as c,
                 list_sum(list_transform(list_zip(kept.q, c{r}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d
          from kept, c{r}) kept) where place = 1)""")
        if r < rounds:
            out.append(f"""
    c{r + 1} as materialized (
      select c{r}.c as c, coalesce(m.q, c{r}.q) as q from c{r} left join (
        select c, list(((s - ((s % n) + n) % n) // n)::bigint order by p) as q from (
          select c, p, sum(q[p])::bigint as s, count(*)::bigint as n from (select c, q, unnest(range(1, 65)) as p from a{r}) group by 1, 2)
        group by 1) m on m.c = c{r}.c)""")
    return ",".join(out)


@query(
    "op13_centroid_clusters",
    f"""
    with kept as materialized (
      select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as q from embeddings
      where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
    c0 as materialized (
      select row_number() over (order by mark, q) - 1 as c, q
      from (select sha256('3:' || vec_id::varchar) as mark, q from kept) order by mark, q limit 8),
    {_sql_rounds().lstrip()}
    select vec_id, a10.c::int as cluster, d as distance, (sum(d) over (partition by a10.c))::bigint as cluster_inertia,
           (sum(d) over ())::bigint as inertia, sha256(array_to_string(c10.q, ',')) as centroid_sha256
    from a10 join c10 on c10.c = a10.c
    """,
)
def op13(spark, sf):
    return clusters.clustered(table(spark, sf, "embeddings"))
