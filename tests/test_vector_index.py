import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from statera.operators import similarity, vector_index
from statera.operators.vector_index import Layout
from statera.session import shared_dir


def rows(n, dim, seed):
    return [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, dim)))]


def folder(spark):
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def built(spark):
    store = spark.createDataFrame([*rows(900, 16, 1), (9000, None)], "vec_id long, vec array<double>").withColumn("code", F.lit("x"))
    path = folder(spark)
    made = vector_index.build_index(store, path)
    return store, made, vector_index.open_index(spark, path)


def found(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in df.collect()}


def test_index_is_read_back_as_built(built):
    store, made, index = built
    assert index.lists == math.isqrt(900) == 30 and index.rows == 900
    assert np.allclose(index.centers, made.centers) and np.allclose(index.books, made.books)
    codes, vectors = index.codes(store.sparkSession), index.vectors(store.sparkSession)
    assert codes.count() == 4 * 900 and codes.groupBy("vec_id").agg(F.count_distinct("list").alias("n")).filter("n <> 4").count() == 0
    assert vectors.count() == vectors.select("vec_id").distinct().count() == 900
    assert {len(r.code) for r in codes.select("code").distinct().collect()} == {4}


def test_all_lists_and_candidates_are_exact(spark, built):
    store, _, index = built
    q = spark.createDataFrame([*rows(12, 16, 2), (77, None)], "query_id long, vec array<double>")
    exact = found(similarity.knn(q, store, 5))
    assert found(vector_index.search_index(q, index, 5, probes=index.lists, candidates=900)) == exact


def test_a_quarter_of_the_lists_finds_nine_tenths(spark, built, monkeypatch):
    store, _, index = built
    q = spark.createDataFrame(rows(40, 16, 3), "query_id long, vec array<double>")
    exact = {(k[0], v) for k, v in found(similarity.knn(q, store, 5)).items()}
    got = {(k[0], v) for k, v in found(vector_index.search_index(q, index, 5)).items()}
    assert len(exact & got) >= 0.9 * len(exact)
    monkeypatch.setattr(vector_index, "PASS_QUERIES", 9)
    assert {(k[0], v) for k, v in found(vector_index.search_index(q, index, 5)).items()} == got


def test_scan_reads_a_quarter_of_the_lists(spark, built, monkeypatch):
    """The opened lists are a partition filter of the scan of the codes."""
    _, _, index = built
    seen = []
    real = vector_index.stored
    monkeypatch.setattr(vector_index, "stored", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    vector_index.search_index(spark.createDataFrame(rows(1, 16, 4), "query_id long, vec array<double>"), index, 5).collect()
    filters = seen[0].split("PartitionFilters: [")[1].split("]")[0]
    assert "list#" in filters and filters.split(" IN (")[1].count(",") + 1 <= index.lists // 4
    assert "vec#" not in seen[0].split("FileScan")[1].split("Batched")[0]


def test_odd_stores(spark):
    none = spark.createDataFrame([], "vec_id string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vec array<double>")
    index = vector_index.build_index(none, folder(spark))
    assert vector_index.search_index(q, index, 3).collect() == []
    few = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 0.0])], "vec_id string, vec array<double>")
    index = vector_index.build_index(few, folder(spark), layout=Layout(lists=9, parts=5))
    assert [(r.vec_id, r.score) for r in vector_index.search_index(q, index, 3, probes=9).orderBy("rank").collect()] == [("a", 1.0), ("c", 1.0), ("b", 0.0)]
    with pytest.raises(ValueError, match="2 components"):
        vector_index.search_index(spark.createDataFrame([(1, [1.0])], "query_id int, vec array<double>"), index, 3)
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "vec_id int, vec array<double>")
    with pytest.raises(Exception):
        vector_index.build_index(ragged, folder(spark))


def test_checked_search_is_exact_with_few_candidates(spark, built, monkeypatch):
    store, _, index = built
    q = spark.createDataFrame(rows(30, 16, 5), "query_id long, vec array<double>")
    exact = found(similarity.knn(q, store, 5))
    assert found(vector_index.search_index(q, index, 5, probes=index.lists, candidates=6)) != exact
    assert found(vector_index.search_index(q, index, 5, probes=1, candidates=6, exact=True)) == exact
    monkeypatch.setattr(vector_index, "PASS_QUERIES", 7)
    assert found(vector_index.search_index(q, index, 5, probes=index.lists, candidates=6, exact=True)) == exact


def test_best_of_a_task_counts_an_id_once():
    held = [(np.array([0, 0, 1], np.int32), np.array(["a", "b", "a"], object), np.array([3, 3, 4]), np.array([0.1, 0.5, 0.2], np.float32)),
            (np.array([0, 0], np.int32), np.array(["a", "c"], object), np.array([3, 3]), np.array([0.4, 0.3], np.float32))]
    floor = np.full(2, -np.inf, np.float32)
    query, ids, home, near = vector_index._best_of(held, 2, floor)
    assert list(zip(query, ids)) == [(0, "b"), (0, "a"), (1, "a")] and floor[0] == np.float32(0.4) and floor[1] == -np.inf
    assert list(home) == [3, 3, 4] and near[1] == np.float32(0.4)


def test_scores_that_end_in_a_tie_are_rounded_as_the_sql_does(spark):
    import duckdb

    from statera.plans.retrieval import rounded

    ties = [i / 1e7 for i in range(-9999995, 9999995, 70010)]
    got = [r.score for r in rounded(spark.createDataFrame([(t, 1) for t in ties], "score double, rank int").coalesce(1)).collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [t]).fetchone()[0] for t in ties]
    assert 0.504787 in [r.score for r in rounded(spark.createDataFrame([(0.5047875, 1)], "score double, rank int")).collect()]


def test_open_lists_rank_a_vector_once_and_start_from_a_floor(spark, built, monkeypatch):
    """A scan of all lists goes over every vector once, and a task begins with what a sample says that a candidate must reach."""
    _, _, index = built
    monkeypatch.setattr(vector_index, "FLOOR_ROWS", 300)
    floors, plans = [], []
    least, stored = vector_index._least, vector_index.stored
    monkeypatch.setattr(vector_index, "_least", lambda *a: (floors.append(least(*a)), floors[-1])[1])
    monkeypatch.setattr(vector_index, "stored", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), stored(df))[1])
    q = spark.createDataFrame(rows(9, 16, 6), "query_id long, vec array<double>")
    vector_index.search_index(q, index, 2, probes=index.lists, candidates=20)
    assert "(list" in plans[0].split("Filter")[-1] and "= home" in plans[0] and "Aggregate" not in plans[0]
    codes = index.codes(spark).filter("list = home").collect()
    x = vector_index._decoded(np.array([list(r.code) for r in codes]), np.array([r.home for r in codes]), index.centers, index.books)
    part = q.collect()
    s = np.sort(vector_index.unit_rows([r.vec for r in part]) @ x.T, axis=1)[:, ::-1]
    assert (floors[0] <= s[:, 19]).all() and (np.sum(s >= floors[0][:, None], axis=1) < 250).all()
    vector_index.search_index(q, index, 2, candidates=20)
    assert (floors[1] <= floors[0]).all() and "Aggregate" in plans[1]  # a vector of several opened lists


def test_check_hands_on_few_of_many_copies(spark, monkeypatch):
    store = spark.createDataFrame([(i, [1.0, 0.0] if i else [0.0, 1.0]) for i in range(2000)], "vec_id long, vec array<double>")
    index = vector_index.build_index(store, folder(spark), layout=Layout(lists=2))
    seen = []
    real = vector_index.best_k
    monkeypatch.setattr(vector_index, "best_k", lambda df, *a: (seen.append(df), real(df, *a))[1])
    q = spark.createDataFrame([(i, [1.0, 0.1]) for i in range(20)], "query_id long, vec array<double>")
    got = vector_index.search_index(q, index, 3, candidates=4, exact=True).collect()
    assert sorted({(r["rank"], r["vec_id"]) for r in got}) == [(1, 1), (2, 2), (3, 3)] and len(got) == 60
    assert seen[-1].count() <= 20 * 3 * seen[-1].rdd.getNumPartitions()
