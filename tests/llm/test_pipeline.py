"""The whole pipeline, from documents to shards, against plain Python; and on odd and empty tables."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from statera.llm import attention, mixing

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_good(rows, model):
    return [r for r in rows if model.score([r.text or ""])[0] >= 0.5]


def plain_one_of_each(rows):
    """All pairs of shingle sets; of each component the row with the least id stays."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(ASCII_LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i) if sets[i] else ("empty", i)].append(r)
    return [min(g, key=lambda r: r.doc_id) for g in groups.values()]


def plain_clean(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in items:
        w = word.findall((t or "").translate(ASCII_LOWER))
        k = min(10, len(w))
        windows.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k)
    sizes = {len(w) for w in windows}

    def hit(r):
        w = word.findall((r.text or "").translate(ASCII_LOWER))
        return any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))

    return [r for r in rows if not hit(r)]


def test_pipeline_against_plain_stages(spark, sf):
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    docs = read("documents")
    model = attention.fit(docs, read("labels"))
    good = plain_good(docs.collect(), model)
    single = plain_one_of_each(good)
    clean = plain_clean(single, [r.text for r in read("benchmark").collect()])
    assert len(docs.collect()) > len(good) > len(single) > len(clean) > 0
    got = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id: r for r in clean}
    times = Counter(r.doc_id for r in got)
    want = mixing.mix_sources(spark.createDataFrame(clean, docs.schema)).collect()
    assert times == Counter({r.doc_id: r.copies for r in want if r.copies}) and set(times) <= set(kept) and max(times.values()) <= 2
    taken = defaultdict(int)
    for id, n in times.items():
        taken[kept[id].source] += n * len(re.findall(r"[^\x20\x09-\x0D]+", kept[id].text or ""))
    targets = {kept[r.doc_id].source: r.target for r in want}
    # A source's words miss its target by no more than its longest document.
    longest = {s: max(len((r.text or "").split()) for r in clean if r.source == s) for s in targets}
    assert all(abs(taken[s] - target) <= longest[s] + 1 for s, target in targets.items())
    assert all(r.size == len((kept[r.doc_id].text or "").encode()) + 1 for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(min(s), min(s) + len(s))) for s in slots.values()) and set(slots) == set(range(8))


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_on_odd_and_empty_tables(spark, request, rows, monkeypatch):
    table = request.getfixturevalue(rows)
    labels = spark.createDataFrame([(5, 1, "x"), (10, 0, "y"), (None, 1, "z"), (4, None, "x")], "doc_id long, quality int, text string")
    items = spark.createDataFrame([("b1", "jumps over the lazy dog while seven other animals look on"), ("b2", None), (None, "")], "item_id string, text string")
    tables = {"documents": table, "labels": labels, "benchmark": items}
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: tables[name])
    got = corpus_pipeline.run(spark, "").collect()
    allowed = {r.doc_id for r in table.collect() if "seven other animals" not in (r.text or "")}
    assert {r.doc_id for r in got} <= allowed and (rows == "odd" or not got)


def test_texts_come_to_python_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from statera.functions.rows import BATCH_BYTES, BATCH_SETTING
    from statera.llm import ngram_join

    rows = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    model = attention.train([], [])

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows])})

    for stage in (lambda: attention.good_documents(rows, model), lambda: attention.quality_scores(rows, model), lambda: ngram_join.near_duplicates(rows.limit(1))):
        spark.conf.unset(BATCH_SETTING)
        stage()
        seen = [r.n for r in rows.mapInArrow(count, "n long").collect()]
        assert sum(seen) == 4000 and max(seen) <= 2 * BATCH_BYTES // 5000


def test_the_driver_plans_few_and_short_queries(spark, sf):
    from pyspark.sql import functions as F

    from statera.llm import ngram_join

    store = spark._jsparkSession.sharedState().statusStore()

    def plans(run):
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
        before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
        run()
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
        every = store.executionsList()
        new = (every.apply(i) for i in range(every.size()))
        return [len(x.physicalPlanDescription()) for x in new if x.executionId() not in before]

    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), "id").alias("text"))
    labels = many.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert max(plans(lambda: attention.fit(many, labels, options=attention.Training(steps=1)))) < 20_000
    assert len(plans(lambda: ngram_join.one_of_each(spark.read.parquet(f"{sf}/documents.parquet")).collect())) < 70
