"""Registered queries against their SQL, whole pipelines, and the odd table."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import check_oracles
import corpus_pipeline
from statera.llm import attention, chat, compression, decontaminate, licenses, line_dedup, mixing, ngram_join, sharding, token_counts, urls
from statera.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return check_oracles.connect(sf)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, sf, con, name):
    assert check_oracles.compare(QUERIES[name](spark, sf), con, ORACLES[name])[0] == "ok"


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] not in ("op7", "op10", "op12", "op13")])
def test_one_row_per_document(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES[name](spark, sf).select("doc_id")
    assert Counter(r[0] for r in got.collect()) == Counter(r[0] for r in docs.select("doc_id").collect())


def _bench(spark):
    return spark.createDataFrame([("b1", "jumps over the lazy dog while seven other animals look on"), ("b2", None), (None, "one")], "item_id string, text string")


RUNS = {
    "bands": lambda d, s: compression.compression_bands(d),
    "shards": lambda d, s: sharding.minimax_shards(d, 3),
    "tokens": lambda d, s: token_counts.token_counts(d),
    "mix": lambda d, s: mixing.mix_sources(d),
    "lines": lambda d, s: line_dedup.repeated_lines(d),
    "bench": lambda d, s: decontaminate.contamination(d, _bench(s)),
    "licenses": lambda d, s: licenses.license_digest(licenses.license_scan(d)),
    "near": lambda d, s: ngram_join.near_duplicates(d),
    "score": lambda d, s: attention.quality_scores(d, attention.fit(d, s.createDataFrame([(5, 1), (10, 0), (None, 1), (4, None)], "doc_id long, quality int"))),
}


@pytest.mark.parametrize("name", list(RUNS))
def test_odd_rows_keep_their_ids(spark, odd, none, name):
    got = RUNS[name](odd, spark)
    assert Counter(r[0] for r in got.select("doc_id").collect()) == Counter(r[0] for r in odd.select("doc_id").collect())
    assert RUNS[name](none, spark).collect() == []


def test_filters_keep_columns(spark, odd, none):
    model = attention.train([], [])
    for run in (
        lambda d: attention.good_documents(d, model), lambda d: ngram_join.one_of_each(d), mixing.mixed_documents,
        lambda d: decontaminate.without_contaminated(d, _bench(spark)), lambda d: decontaminate.without_contaminated(d, _bench(spark), spans=True),
        line_dedup.without_repeated_lines,
    ):
        assert run(odd).columns == odd.columns and run(odd).count() > 0
        assert run(none).count() == 0


def test_one_of_each_goes_by_links_not_by_ids(spark, odd):
    got = Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(odd).collect())
    assert got[(9, "one")] == got[(9, "two")] == 1
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words), " ".join([*words, "more"]), " ".join(["less", *words])]
    rows = [*((None, t) for t in near), (7, "a b c d e f"), (7, "a b c d e f"), (7, "u v w x y z"), (None, "u v w x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text in near or r.text) for r in ngram_join.one_of_each(docs).collect())
    assert got == {(None, True): 1, (7, "a b c d e f"): 1, (7, "u v w x y z"): 1}


def test_odd_urls(spark):
    rows = [(1, None), (None, "http://A.Example.com"), (2, "no host"), (3, "http:///x"), (4, "s://u@H.net:80/fr/?q#f"), (4, "s://u@H.net:80/fr/?q#f"), (5, "http://www.example.com/en/1")]
    pages = spark.createDataFrame([(i, u, "c") for i, u in rows], "page_id long, url string, host string")
    bad = spark.createDataFrame([("http://x.h.net/a", 1), (None, 1), ("http://x.h.net/b", None)], "url string, bad int")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judged_urls(pages, bad).collect()}
    assert got == {
        (1, "", "", None, "allow"), (None, "a.example.com", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "/x", None, "allow"),
        (4, "u@h.net:80", "/fr/", None, "block"), (5, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    }
    assert urls.judged_urls(pages, bad).count() == 7 and urls.judged_urls(pages.limit(0), bad.limit(0)).count() == 0


def test_bad_hosts_domains_and_suffixes_are_blocked(spark):
    bad = [(f"http://{h}.site.org/{i}", 1) for h in ("bad", "worse", "worst") for i in range(40)]
    bad += [(f"http://h{i % 9}.x{i % 7}.vile/{i}", 1) for i in range(200)]
    good = [(f"http://h{i % 30}.g{i % 11}.org/{i}", int(i % 20 == 0)) for i in range(900)] + [(f"http://w{i % 5}.fine.net/{i}", 0) for i in range(300)]
    pages = {
        "http://bad.site.org/new": "block", "http://h3.g3.org/new": "allow", "http://fresh.site.org/": "block", "http://u:p@fresh.site.org:8080/a": "block",
        "http://fresh.g3.org/": "allow", "http://fresh.new.vile/": "block", "http://fresh.new.org/": "allow", "http://fresh.new.zz/": "allow", "http://w9.fine.net:80/": "allow",
    }
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = urls.judged_urls(frame, spark.createDataFrame(bad + good, "url string, bad int")).collect()
    assert {list(pages)[r.page_id]: r.verdict for r in got} == pages
    assert all((r.verdict == "block") == bool(r.bad_bound is not None and r.bad_bound > urls.MAX_BAD) for r in got)


def test_suffixes_from_a_table(spark):
    rows = spark.createDataFrame([("co.uk",), (" Co.UK ",), ("uk",), ("a.b.c",), (None,)], "suffix string")
    assert urls.suffixes_of(rows) == ("co.uk",)
    names = urls.with_names(spark.createDataFrame([("u@a.b.co.uk:80",), ("co.uk",), ("x.y.uk",)], "host string"), ("co.uk",)).collect()
    assert [(r.bare, r.domain, r.suffix) for r in names] == [("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("x.y.uk", "y.uk", "uk")]


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "hi\nthere"), (1, 0, "user", "hi\nthere"), (1, 1, "assistant", None), (1, 2, None, " "), (None, 0, "user", "x"), (2, None, "odd", "y?"), (3, 0, "system", "")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = chat.parsed_conversations(turns).collect()
    assert sorted((r.conv_id or 0, r.n_lines) for r in got) == [(0, 1), (1, 2), (2, 1)]
    assert chat.parsed_conversations(turns.limit(0)).count() == 0


def test_long_conversations_are_decoded_as_one(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 4)
    monkeypatch.setattr(chat, "FAN", 2)
    said = ("hello", "why is that?", "one line\n\nafter a blank one", "a long answer " * 6, "so\nit goes")
    rows = [(c, t, chat.ROLES[(t * t + c) % 5 % 2], said[(t * 7 + c) % 5] + f" {t}") for c in range(1, 9) for t in range(5 * c)]
    rows += [(20, 3, "user", f"same turn {i}") for i in range(41)] + [(None, t, "user", "x") for t in (1, 2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    raw = chat.raw_transcripts(turns).collect()
    assert max(len(r.known) for r in raw) == 4 and sum(len(r.known) for r in raw) == len(rows)
    whole, states = {}, {}
    for r in sorted((r for r in raw if not r.alone), key=lambda r: (r.conv_id, r.part)):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.transcript
        states[r.conv_id] = states.get(r.conv_id, []) + r.states
    counted = [(t, states[c]) for c, t in whole.items() if zlib.crc32(str(c).encode()) % 3 != 1]
    counted += [(r.transcript, r.states) for r in raw if r.alone]
    model = chat.fit_roles(spark.createDataFrame(counted, "transcript string, states array<int>"))
    got = chat.parsed_conversations(turns).collect()
    assert sum(r.conv_id is None for r in got) == 2 and any("one line\n\nafter" in r.transcript for r in raw)
    for c, text in whole.items():
        want = chat.turns_of(text, model)
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(len(mine)))
        assert "".join(r.rendered for r in mine) == chat.rendered(want)
        assert sum(r.n_turns for r in mine) == len(want) and not mine[0].continued


def test_blank_lines_stay_within_a_turn():
    model = chat.model_of(Counter({0: 9}), Counter({(0, 1): 90, (1, 1): 90}), Counter())
    assert chat.turns_of("User: one\n\n \ntwo\n", model) == [("user", "one\n\n \ntwo")]


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        after = stage(spark, before, sf).persist()
        assert after.columns == docs.columns and after.exceptAll(before).count() == 0, name
        assert 0 < after.count() <= before.count()
        before = after
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert not decontaminate.contamination(before, benchmark).filter("contaminated").count()
    assert not ngram_join.near_duplicates(before).filter("n_shingles > 0 and component_id <> doc_id").count()
    mixed = corpus_pipeline.STAGES[3][1](spark, before, sf).persist()
    want = mixing.mix_sources(before)
    assert mixed.count() == want.agg(F.sum("copies")).first()[0] and mixed.columns == docs.columns
    shards = corpus_pipeline.STAGES[4][1](spark, mixed, sf)
    assert shards.count() == mixed.count()
