"""Block matching and vector search against brute force, with hot keys and tiny blocks."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statera.operators import blocks, similarity
from statera.operators.blocks import match_terms, match_vectors


def vectors(n, dim, seed, key=lambda i: i % 3):
    rng = random.Random(seed)
    rows = [(i, key(i), [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows[1] = (rows[1][0], rows[1][1], rows[4][2] if n > 4 else rows[1][2])  # an exact copy
    return rows


def cos(a, b):
    d = sum(x * y for x, y in zip(a, b))
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return round(d / n, 9) if n else 0.0


def brute(left, right, k, floor=None):
    out = {}
    for i, key, v in left:
        scored = sorted(((-cos(v, w), j) for j, other, w in right if other == key))
        if floor is not None:
            scored = [s for s in scored if -s[0] > floor]
        out[i] = [(j, round(-s, 6)) for s, j in scored[:k]]
    return {i: v for i, v in out.items() if v}


def result(df, left="q", right="s"):
    out = {}
    for r in df.orderBy(left, "rank").collect():
        out.setdefault(r[left], []).append((r[right], round(r["score"], 6)))
    return out


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_vectors_with_a_hot_key(spark, block):
    # Key 0 holds most rows on both sides, so it is cut into many cells when blocks are small.
    hot = lambda i: 0 if i % 4 else i % 5
    left, right = vectors(30, 6, 1, hot), vectors(50, 6, 2, hot)
    a = spark.createDataFrame(left, "q int, key int, vec array<double>")
    b = spark.createDataFrame(right, "s int, key int, vec array<double>")
    assert result(match_vectors(a, b, "key", ["q"], "s", 3, block=block)) == brute(left, right, 3)
    assert result(match_vectors(a, b, "key", ["q"], "s", 3, floor=0.2, block=block)) == brute(left, right, 3, 0.2)


def test_hot_key_is_cut(spark):
    rows = spark.range(100).select(F.col("id").alias("i"), F.lit(1).alias("key"), F.array(F.lit(1.0)).alias("vec"))
    cells = blocks.cells(rows, rows, "key", ["i"], "i", ["i", "vec"], ["i", "vec"], block=10)
    sizes = cells.select(F.size("lefts").alias("l"), F.size("rights").alias("r")).collect()
    assert len(sizes) == 100 and max(max(s["l"], s["r"]) for s in sizes) <= 25
    # Every pair meets exactly once.
    assert sum(s["l"] * s["r"] for s in sizes) == 100 * 100


def test_terms(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 9)))
    left = [(i, i % 2, text()) for i in range(20)]
    right = [(i, i % 2, text()) for i in range(15)]

    def term_cos(a, b):
        ca, cb = Counter(a.split()), Counter(b.split())
        n = math.sqrt(sum(v * v for v in ca.values())) * math.sqrt(sum(v * v for v in cb.values()))
        return sum(ca[t] * cb[t] for t in ca) / n if n else 0.0

    want = {}
    for i, key, t in left:
        want[i] = [(j, round(s, 6)) for s, j in sorted(((term_cos(t, u), j) for j, o, u in right if o == key), key=lambda x: (-x[0], x[1]))[:2]]
    a = spark.createDataFrame(left, "q int, key int, terms string")
    b = spark.createDataFrame(right, "s int, key int, terms string")
    for block in (3, 100):
        assert result(match_terms(a, b, "key", ["q"], "s", 2, block)) == want


@pytest.mark.parametrize("limit", [4096, 3])
def test_knn_small_and_large_query_sides(spark, monkeypatch, limit):
    monkeypatch.setattr(similarity, "QUERY_ROWS", limit)
    left, right = vectors(10, 5, 3), vectors(40, 5, 4)
    q = spark.createDataFrame(left, "query_id int, key int, vec array<double>")
    s = spark.createDataFrame(right, "vec_id int, key int, vec array<double>").repartition(5)
    by_key = similarity.knn(q, s, 4, match_on="key")
    assert result(by_key, "query_id", "vec_id") == brute(left, right, 4)
    everything = similarity.knn(q, s, 4)
    assert result(everything, "query_id", "vec_id") == brute([(i, 0, v) for i, _, v in left], [(i, 0, v) for i, _, v in right], 4)
    filtered = similarity.knn(q, s, 4, filters={"key": 1})
    assert result(filtered, "query_id", "vec_id") == brute([(i, 1, v) for i, _, v in left], right, 4)


def test_ragged_vectors_are_refused(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vec array<double>")
    for rows in ([(1, [1.0, 0.0, 0.0]), (2, [1.0])], [(1, [1.0, 0.0, 0.0])]):
        s = spark.createDataFrame(rows, "vec_id int, vec array<double>").coalesce(1)
        with pytest.raises(Exception, match="share one length"):
            similarity.knn(q, s, 2).collect()


@pytest.mark.parametrize("limit", [4096, 1])
def test_null_keys_match_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(similarity, "QUERY_ROWS", limit)
    q = spark.createDataFrame([(1, None, [1.0]), (2, 7, [1.0]), (3, 8, [1.0])], "query_id int, key int, vec array<double>")
    s = spark.createDataFrame([(1, None, [1.0]), (2, 7, [1.0])], "vec_id int, key int, vec array<double>")
    got = similarity.knn(q, s, 2, match_on="key").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(2, 2)]


def test_large_query_sides_are_taken_in_passes(spark, monkeypatch):
    left, right = vectors(23, 6, 1), vectors(80, 6, 2)
    exact = brute([(i, 0, v) for i, _, v in left], [(i, 0, v) for i, _, v in right], 3)
    q = spark.createDataFrame(left, "query_id int, key int, vec array<double>")
    s = spark.createDataFrame(right, "vec_id int, key int, vec array<double>")
    monkeypatch.setattr(similarity, "QUERY_ROWS", 6)
    found = similarity.knn(q, s, 3)
    assert result(found, "query_id", "vec_id") == exact
    assert "_all" not in found._jdf.queryExecution().toString()


def test_encoder_drops_empty_texts_with_their_row(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "   "), (3, "")], "id int, text string")
    out = similarity.encode(d, "text", similarity.hashed_terms(16), prefix="passage").collect()
    assert [r["id"] for r in out] == [1] and len(out[0]["vec"]) == 16


def test_cache_encodes_misses_only(spark):
    calls = spark.sparkContext.accumulator(0)

    def build():
        base = similarity.hashed_terms(8)()

        def run(texts):
            calls.add(len(texts))
            return base(texts)

        return run

    texts = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "text string")
    cache = similarity.encode(
        spark.createDataFrame([("a",)], "text string").withColumn("text_hash", F.sha2("text", 256)), "text", similarity.hashed_terms(8)
    ).select("text_hash", "vec")
    rows = {r["text"]: r["hit"] for r in similarity.encode_with_cache(texts, "text", cache, build).collect()}
    assert rows == {"a": True, "b": False, "c": False} and calls.value == 2


def test_python_is_handed_few_bytes_at_once(spark):
    import pandas as pd
    from pyspark.sql import types as T

    from statera.functions.rows import BATCH_BYTES, bounded_batches
    from statera.operators.blocks import run_kernel

    rows = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 5000).alias("text"))

    def most(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    seen = [r.n for r in bounded_batches(rows).mapInPandas(most, "n long").collect()]
    assert sum(seen) == 4000 and max(seen) <= 2 * BATCH_BYTES // 5000
    one = F.array(F.struct("id", "text"))
    cells = rows.select(one.alias("lefts"), one.alias("rights"))
    sizes = run_kernel(cells, lambda a, b: iter([(a[0]["id"],)]), T.StructType([T.StructField("id", T.LongType())]))
    assert sizes.distinct().count() == 4000


def test_sections_that_need_no_cut_stay_out_of_python(spark):
    from statera.operators import sections

    df = spark.createDataFrame([(1, "<h1>short<p>" + "word. " * 200 + "<b>x"), (2, "<h1>a<p>b"), (3, None)], "id long, html string")
    out = sections.number_chunks(df, "id", F.col("html"), sections.PAGE_MARKERS, 300, 50)
    got = [(r.id, r.position, r.section_id, r.is_split) for r in out.orderBy("id", "position").collect()]
    assert got[0] == (1, 0, "<h1>", False) and got[-1] == (2, 1, "<p>", False) and [g[1] for g in got[:-2]] == list(range(len(got) - 2))
    assert sum(g[3] for g in got) > 3
    sent = df.select(sections.split_sections(F.array("html"), 2000).alias("p")).collect()
    assert [r.p for r in sent] == [None] * 3
