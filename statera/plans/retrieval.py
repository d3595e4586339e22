"""Vector search, context, encoding and caches.

Queries are the mean vector of every label (computed from the whole table); the chunk table gives
each vector a document (its label), a position and a parent (the first of its block of eight).
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import context, ordered, similarity, vector_index
from ..operators.blocks import match_vectors
from ..session import shared_dir
from .catalog import query, sql_tokens, table
from .segments import long

QUERIES = """
    (select label as query_id, list(x order by pos) as vec from (
       select label, pos, avg(x) as x from (
         select label, unnest(range(len(embedding))) as pos, unnest(embedding::double[]) as x from embeddings) group by all)
     group by label)
"""
CHUNKS = """
    (select vec_id as chunk_id, label as document_id, vec_id as position,
            case when vec_id % 8 <> 0 then vec_id - vec_id % 8 end as parent_id, 's' || vec_id % 8 as section_id,
            'vec ' || vec_id as content, case when vec_id % 8 = 0 then 'section' else 'clause' end as chunk_type,
            embedding::double[] as vec from embeddings)
"""
SCORE = "round(list_cosine_similarity(q.vec, s.vec), 9)"


def label_means(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (
        mean.groupBy(F.col("label").alias("query_id"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p"))
        .select("query_id", F.col("p.x").alias("vec"))
    )


def chunk_table(spark, sf):
    e = table(spark, sf, "embeddings")
    block = F.col("vec_id") - F.col("vec_id") % 8
    inner = F.col("vec_id") % 8 != 0
    return e.select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), F.col("vec_id").alias("position"),
        F.when(inner, block).alias("parent_id"), F.concat(F.lit("s"), F.col("vec_id") % 8).alias("section_id"),
        F.concat(F.lit("vec "), "vec_id").alias("content"),
        F.when(inner, "clause").otherwise("section").alias("chunk_type"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def _store(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


def rounded(df):
    # Scaled before it is rounded: a score of nine digits may end in a tie, and the scaled number says which side the double is on.
    return long(df.withColumn("score", F.round(F.col("score") * 1e6, 0) / 1e6), "rank")


@query(
    "d1_knn",
    f"""select query_id, vec_id, round(score, 6) as score, rank from (
          select q.query_id, s.vec_id, {SCORE} as score, row_number() over (partition by q.query_id order by {SCORE} desc, s.vec_id) as rank
          from {QUERIES} q, (select vec_id, embedding::double[] as vec from embeddings) s) where rank <= 5""",
)
def knn(spark, sf):
    return rounded(similarity.knn(label_means(spark, sf), _store(spark, sf), 5))


@query(
    "d1_knn_filtered",
    f"""select query_id, vec_id, round(score, 6) as score, rank from (
          select q.query_id, s.vec_id, {SCORE} as score, row_number() over (partition by q.query_id order by {SCORE} desc, s.vec_id) as rank
          from {QUERIES} q join (select vec_id, label, embedding::double[] as vec from embeddings) s on s.label = q.query_id) where rank <= 10""",
)
def knn_filtered(spark, sf):
    q = label_means(spark, sf).withColumn("label", F.col("query_id"))
    return rounded(similarity.knn(q, _store(spark, sf), 10, match_on="label"))


@query(
    "d1_knn_blocks",
    """select query_id, vec_id, round(score, 6) as score, rank from (
          select q.vec_id as query_id, s.vec_id, round(list_cosine_similarity(q.embedding::double[], s.embedding::double[]), 9) as score,
                 row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], s.embedding::double[]), 9) desc, s.vec_id) as rank
          from embeddings q join embeddings s on s.label = q.label) where rank <= 3""",
)
def knn_blocks(spark, sf):
    # Every vector is a query: both sides grow, so they meet in bounded blocks per label.
    s = _store(spark, sf)
    return rounded(match_vectors(s.withColumnRenamed("vec_id", "query_id"), s, "label", ["query_id"], "vec_id", 3))


MATCHED = f"""
    select query_id, chunk_id, score, rank from (
      select q.query_id, s.chunk_id, {SCORE} as score,
             row_number() over (partition by q.query_id order by {SCORE} desc, s.chunk_id) as rank
      from {QUERIES} q join {CHUNKS} s on s.document_id = q.query_id where {SCORE} > 0.15) where rank <= 5
"""


def _doc_queries(spark, sf):
    return label_means(spark, sf).withColumn("document_id", F.col("query_id"))


@query("d2_match_chunks", f"select query_id, chunk_id, round(score, 6) as score, rank from ({MATCHED})")
def match_chunks(spark, sf):
    return rounded(similarity.match_chunks(_doc_queries(spark, sf), chunk_table(spark, sf), 0.15, 5))


@query("d3_with_parent", f"select c.chunk_id, c.content, p.content as parent_content from {CHUNKS} c left join {CHUNKS} p on p.chunk_id = c.parent_id")
def with_parent(spark, sf):
    return context.with_parent(chunk_table(spark, sf).drop("vec")).select("chunk_id", "content", "parent_content")


SIBLINGS = f"""
    select c.chunk_id, count(s.chunk_id) as sibling_count,
           coalesce(array_to_string(list(s.content order by s.position) filter (s.chunk_id is not null), '|'), '') as siblings
    from {CHUNKS} c left join {CHUNKS} s on s.parent_id = c.parent_id and s.chunk_id <> c.chunk_id group by 1
"""


@query("d4_with_siblings", SIBLINGS)
def with_siblings(spark, sf):
    out = context.with_siblings(chunk_table(spark, sf).drop("vec"), shown=None)  # families of eight
    return long(out.select("chunk_id", "sibling_count", F.array_join("siblings", "|").alias("siblings")), "sibling_count")


FAMILY = f"""(select parent_id, row_number() over (partition by parent_id order by position, chunk_id) as rank, chunk_id, position, content
    from {CHUNKS} where parent_id is not null)"""


@query(
    "d4_families",
    f"""select c.chunk_id, c.parent_id, f.rank, coalesce(n - 1, 0) as sibling_count from {CHUNKS} c left join {FAMILY} f on f.chunk_id = c.chunk_id
        left join (select parent_id, count(*) as n from {CHUNKS} where parent_id is not null group by 1) s on s.parent_id = c.parent_id""",
)
def families(spark, sf):
    chunks = chunk_table(spark, sf).drop("vec")
    out = context.with_family(chunks, context.families(chunks)).select("chunk_id", "parent_id", "rank", "sibling_count")
    return long(out, "rank", "sibling_count")


@query(
    "d4_one_family",
    """select vec_id as chunk_id, row_number() over (order by vec_id) as rank, (select count(*) - 1 from embeddings) as sibling_count from embeddings""",
)
def one_family(spark, sf):
    """All chunks under one parent: the result is still one row a chunk."""
    chunks = chunk_table(spark, sf).drop("vec").withColumn("parent_id", F.lit(-1).cast("long"))
    return long(context.with_family(chunks, context.families(chunks)).select("chunk_id", "rank", "sibling_count"), "rank", "sibling_count")


@query(
    "d4_shown_siblings",
    f"""select a.chunk_id, a.place, f.chunk_id as sibling_id, f.content
        from (select chunk_id, parent_id, rank, unnest([2, 3, 4]) as place from {FAMILY}) a
        join {FAMILY} f on f.parent_id = a.parent_id and f.rank = case when a.place < a.rank then a.place else a.place + 1 end""",
)
def shown_siblings(spark, sf):
    """The second to the fourth sibling of every chunk."""
    chunks = chunk_table(spark, sf).drop("vec")
    family = context.families(chunks)
    return long(context.shown_siblings(family, family, 2, 3), "place")


@query(
    "d4_sibling_rows",
    f"""select c.chunk_id, s.chunk_id as sibling_id, s.position, s.content from {CHUNKS} c join {CHUNKS} s on s.parent_id = c.parent_id and s.chunk_id <> c.chunk_id
        where c.chunk_id % 50 = 0 or c.chunk_id % 50 = 1""",
)
def sibling_rows(spark, sf):
    """All siblings of a stated set of targets, as rows."""
    chunks = chunk_table(spark, sf).drop("vec")
    return context.sibling_rows(chunks.filter("chunk_id % 50 in (0, 1)"), chunks)


@query(
    "d5_context_chunks",
    f"""
    with t as (select distinct chunk_id as id from ({MATCHED})), c as (select * from {CHUNKS}),
    x as (select t.id, c.parent_id from t join c on c.chunk_id = t.id)
    select x.id as target_id, c.chunk_id, c.section_id, c.content, c.chunk_type, 'target' as relation from x join c on c.chunk_id = x.id
    union all select x.id, c.chunk_id, c.section_id, c.content, c.chunk_type, 'parent' from x join c on c.chunk_id = x.parent_id
    union all select x.id, c.chunk_id, c.section_id, c.content, c.chunk_type, 'sibling' from x join c on c.parent_id = x.parent_id and c.chunk_id <> x.id
    """,
)
def context_chunks(spark, sf):
    chunks = chunk_table(spark, sf)
    hits = similarity.match_chunks(_doc_queries(spark, sf), chunks, 0.15, 5)
    return context.context_chunks(hits.select(F.col("chunk_id").alias("target_id")), chunks.drop("vec")).drop("position")


@query(
    "g3_relation_union",
    f"""
    with t as (select distinct chunk_id as id from ({MATCHED})), c as (select * from {CHUNKS}),
    x as (select t.id, c.parent_id from t join c on c.chunk_id = t.id)
    select relation, count(*) as n from (
      select 'target' as relation from x union all select 'parent' from x join c on c.chunk_id = x.parent_id
      union all select 'sibling' from x join c on c.parent_id = x.parent_id and c.chunk_id <> x.id) group by 1
    """,
)
def relation_union(spark, sf):
    return context_chunks(spark, sf).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


WITH_CONTEXT = f"""
    select m.query_id, m.rank, m.chunk_id, c.section_id, c.content, m.score, p.content as parent_content, s.siblings
    from ({MATCHED}) m join {CHUNKS} c on c.chunk_id = m.chunk_id left join {CHUNKS} p on p.chunk_id = c.parent_id
    join ({SIBLINGS}) s on s.chunk_id = m.chunk_id
"""


def _retrieved(spark, sf):
    return context.retrieve_with_context(_doc_queries(spark, sf), chunk_table(spark, sf), 0.15, 5)


@query("d6_retrieve_with_context", f"select query_id, rank, chunk_id, section_id, content, round(score, 6) as score, parent_content, siblings from ({WITH_CONTEXT})")
def retrieve_with_context(spark, sf):
    return rounded(
        _retrieved(spark, sf).withColumn("siblings", F.array_join("siblings", "|")).select(
            "query_id", "rank", "chunk_id", "section_id", "content", "score", "parent_content", "siblings"
        )
    )


@query(
    "e38_format_context",
    f"""
    select query_id, string_agg(
      '### Retrieved Section ' || rank || ': ' || section_id || chr(10) || chr(10)
      || case when parent_content is not null then '**Parent Context:**' || chr(10) || parent_content || chr(10) || chr(10) else '' end
      || '**Target Content:**' || chr(10) || content || chr(10) || chr(10)
      || case when siblings <> '' then '**Related Sections:**' || chr(10) || array_to_string(list_transform(string_split(siblings, '|')[1:3], lambda s, i: i || '. ' || left(s, 200) || '...' || chr(10)), '') else '' end
      || chr(10) || '*(Relevance: ' || printf('%.2f', score * 100) || '%)*' || chr(10) || repeat('-', 80) || chr(10) || chr(10), chr(10) order by rank) as context
    from ({WITH_CONTEXT}) group by 1
    """,
)
def format_context(spark, sf):
    return context.format_context(_retrieved(spark, sf))


@query(
    "d18_chunk_by_section_id",
    f"""
    with r as (select distinct document_id, section_id from (select label as document_id, 's' || (vec_id % 10) as section_id from embeddings))
    select r.document_id, r.section_id, c.chunk_id from r left join (
      select document_id, section_id, chunk_id from {CHUNKS} qualify row_number() over (partition by document_id, section_id order by position) = 1) c
      on c.document_id = r.document_id and c.section_id = r.section_id
    """,
)
def chunk_by_section_id(spark, sf):
    refs = table(spark, sf, "embeddings").select(
        F.col("label").alias("document_id"), F.concat(F.lit("s"), F.col("vec_id") % 10).alias("section_id")
    ).distinct()
    return context.chunk_by_section_id(chunk_table(spark, sf), refs).drop("content")


@query(
    "f1_top_k_per_key",
    "select event_type, event_id, value, rank from (select *, row_number() over (partition by event_type order by value desc, event_id) as rank from events) where rank <= 10",
)
def top_k_per_key(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value")
    return long(ordered.top_k_per_key(e, ["event_type"], [F.desc("value"), F.asc("event_id")], 10), "rank")


@query("f5_chunks_in_order", f"select chunk_id, position from {CHUNKS} where document_id = 3")
def chunks_in_order(spark, sf):
    return context.chunks_in_order(chunk_table(spark, sf), 3).select("chunk_id", "position")


@query("k1_encode", "select doc_id, 256::bigint as dim, 1.0::double as norm from documents where regexp_matches(text, '[a-zA-Z0-9À-ÿ]')")
def encode(spark, sf):
    from ..functions.vectors import norm

    d = table(spark, sf, "documents").select("doc_id", "text")
    out = similarity.encode(d, "text", similarity.hashed_terms(256))
    return out.select("doc_id", F.size("vec").cast("long").alias("dim"), F.round(norm(F.col("vec")), 5).alias("norm")).filter("norm > 0")


@query(
    "d16_encode_with_cache",
    """select h as text_hash, h in (select sha256(text) from documents where lang = 'en') as hit
       from (select distinct sha256(text) as h, text from documents) where trim(text) <> ''""",
)
def encode_with_cache(spark, sf):
    from ..functions.ids import content_hash

    d = table(spark, sf, "documents").select("lang", "text")
    english = d.filter("lang = 'en'").select(content_hash(F.col("text")).alias("text_hash"), "text").dropDuplicates(["text_hash"])
    cache = similarity.encode(english, "text", similarity.hashed_terms(64)).select("text_hash", "vec")
    return similarity.encode_with_cache(d, "text", cache, similarity.hashed_terms(64)).select("text_hash", "hit")


@query(
    "k2_term_cosine",
    f"""
    with t as (select conv_id, turn, unnest({sql_tokens('text')}) as t from conversations),
    c as (select conv_id, turn, t, count(*)::double as n from t group by all),
    z as (select conv_id, turn, sqrt(sum(n * n)) as z from c group by all),
    p as (select a.conv_id, a.turn from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
    select p.conv_id, p.turn, round(coalesce(d.d / (za.z * zb.z), 0), 6) as score from p
    join z za on za.conv_id = p.conv_id and za.turn = p.turn join z zb on zb.conv_id = p.conv_id and zb.turn = p.turn + 1
    left join (select a.conv_id, a.turn, sum(a.n * b.n) as d from c a join c b on a.conv_id = b.conv_id and b.turn = a.turn + 1 and a.t = b.t group by all) d
      on d.conv_id = p.conv_id and d.turn = p.turn
    """,
)
def term_cosine(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    pairs = c.join(following, ["conv_id", "turn"])
    return similarity.term_cosine(pairs, ["conv_id", "turn"], "text", "other").withColumn("score", F.round("score", 6))


EXACT = """
    select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
      select q.vec_id as query_id, s.vec_id, round(list_cosine_similarity(q.embedding::double[], s.embedding::double[]), 9) as score
      from (select * from embeddings where vec_id % 50 = 0) q, embeddings s)
    qualify rank <= 5
"""


def _every_fiftieth(spark, sf):
    return _store(spark, sf).filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "vec")


_INDEXES: dict[tuple[str, str], vector_index.Index] = {}


def stored_index(spark, sf):
    """The index of the table, built and written the first time it is asked for in an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        vector_index.build_index(_store(spark, sf), path)
        _INDEXES[key] = vector_index.open_index(spark, path)
    return _INDEXES[key]


@query("k4_approx_knn", f"select query_id, vec_id, round(score, 6) as score, rank from ({EXACT})")
def approx_knn(spark, sf):
    """All lists opened and the result checked against the vectors, as codes alone miss neighbours in a large store."""
    index = stored_index(spark, sf)
    return rounded(vector_index.search_index(_every_fiftieth(spark, sf), index, 5, probes=index.lists, candidates=400, exact=True))


@query("k4_recall", "select count(*) * 5 as wanted, true as enough, true as few_lists from embeddings where vec_id % 50 = 0")
def recall(spark, sf):
    """Whether a quarter of the lists holds nine tenths of the exact top five of the queries."""
    index = stored_index(spark, sf)
    q, s = _every_fiftieth(spark, sf), _store(spark, sf)
    exact = similarity.knn(q, s, 5).select("query_id", "vec_id")
    approx = vector_index.search_index(q, index, 5).select("query_id", "vec_id", F.lit(1).alias("found"))
    opened = vector_index.probes_of(index, np.zeros((1, index.centers.shape[1])), max(1, index.lists // 4)).size
    return exact.join(approx, ["query_id", "vec_id"], "left").agg(
        F.count(F.lit(1)).alias("wanted"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("enough"),
        F.lit(4 * opened <= index.lists).alias("few_lists"),
    )
