"""Audit, citations, context, pages, personal data, lineage, usage on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statera.functions import domains, scoring
from statera.operators import audit, citations, context, lineage, pages, pii, quality, tenancy, usage

ANSWERS = "answer_id int, text string"
SOURCES = "answer_id int, source_id int, text string, score double"


def run_audit(spark, answers, sources, **kwargs):
    a, s = spark.createDataFrame(answers, ANSWERS), spark.createDataFrame(sources, SOURCES)
    out = audit.audit_batch(a, s, "answer_id", ["answer_id"], "text", domains.GERMAN, domains.GERMAN_LEGAL, **kwargs)
    return {r["answer_id"]: r for r in out.collect()}


def test_audit_of_copied_unknown_and_empty_answers(spark):
    text = "Wer einen anderen verletzt, haftet nach § 823 BGB."
    got = run_audit(
        spark,
        [(1, text), (2, "Ganz fremde Worte stehen hier."), (3, ""), (4, "Ohne Quellen bleibt das.")],
        [(1, 1, text, 0.9), (1, 2, "anderes", None), (2, 1, text, 0.9), (3, 1, text, 0.9)],
    )
    best = got[1]
    assert best["verified_sentences"] == 1 and best["semantic_similarity"] == pytest.approx(1.0)
    assert best["retrieval_quality"] == pytest.approx((0.9 + 0.5) / 2)
    # § 823, BGB, § 823 BGB: three citations by the overlapping patterns.
    assert best["citation_presence"] == pytest.approx(0.9)
    assert best["confidence_score"] == pytest.approx(0.6 + 0.25 * 0.7 + 0.09 + 0.05)
    assert best["trust_label"] == scoring.VERIFIED and best["verified"]
    assert got[2]["trust_label"] == scoring.REJECTED and got[2]["error"] is None
    assert (got[3]["error"], got[4]["error"]) == ("no_sentences", "no_sources")
    assert got[3]["confidence_score"] == 0.0 and got[4]["trust_label"] == scoring.REJECTED


def test_retry_takes_the_wider_sources_for_weak_answers_only(spark):
    a = spark.createDataFrame([(1, "eins zwei drei"), (2, "vier fünf sechs"), (3, "sieben acht neun")], ANSWERS)
    narrow = spark.createDataFrame([(1, 1, "eins zwei drei", 0.9), (2, 1, "nichts", 0.1), (3, 1, "nichts", 0.1)], SOURCES)
    wider = spark.createDataFrame([(1, 1, "falsch", 0.0), (2, 1, "vier fünf sechs", 0.9), (3, 1, "nichts", 0.1)], SOURCES)
    out = audit.audit_with_retry(a, [narrow, wider, wider], "answer_id", ["answer_id"], "text", domains.GERMAN, domains.GENERIC)
    got = {r["answer_id"]: (r["retry_attempts"], r["confidence_score"] >= 0.6) for r in out.collect()}
    assert got == {1: (0, True), 2: (1, True), 3: (2, False)}


def test_audit_does_not_depend_on_block_size(spark, sf, monkeypatch):
    from statera.operators import blocks
    from statera.plans import load

    run = load()["d7_match_sentences"].run
    want = sorted(map(tuple, run(spark, sf).collect()))
    real = blocks.match_terms
    monkeypatch.setattr(audit, "match_terms", lambda *a, **k: real(*a, block=3, **k))
    assert sorted(map(tuple, run(spark, sf).collect())) == want


def test_citations(spark):
    a = spark.createDataFrame(
        [(1, "Nach § 5 muss der Mieter die Miete zahlen. Er hat auch sonst viele weitere Pflichten.", ["§ 5", "§ 9"])],
        "answer_id int, text string, citations array<string>",
    )
    h = spark.createDataFrame(
        [(1, 1, 10, "§ 4", "anders", 0.9), (1, 2, 11, "§ 5", "der Mieter muss die Miete zahlen nach", 0.6), (1, 3, 12, "§ 5", "x", 0.99)],
        "answer_id int, rank int, chunk_id int, section_id string, content string, similarity double",
    )
    conf = {r["citation"]: (r["chunk_id"], r["confidence"]) for r in citations.citation_confidence(a, h).collect()}
    assert conf["§ 5"] == (11, pytest.approx(0.75)) and conf["§ 9"] == (None, 0.0)
    bad = [r["sentence"] for r in citations.unsupported_claims(a, citations.citation_confidence(a, h)).collect()]
    assert bad == ["Er hat auch sonst viele weitere Pflichten."]
    v = citations.verify_citations(a, h).first()
    assert not v["is_supported"] and v["confidence"] == pytest.approx(0.375 * 0.6) and v["strong_citations"] == 1
    none = spark.createDataFrame([(2, "Kurz.", [])], a.schema)
    v = citations.verify_citations(none, h).first()
    assert v["is_supported"] and v["confidence"] == 0.5
    no = spark.createDataFrame([(2, False)], "answer_id int, is_supported boolean")
    assert not citations.verify_citations(none, h, verdicts=no).first()["is_supported"]


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(1, None, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 1, 4), (6, 1, 5), (7, None, 6)]
    return spark.createDataFrame(rows, "chunk_id int, parent_id int, position int").select(
        "*", F.concat(F.lit("§"), "chunk_id").alias("section_id"), F.concat(F.lit("c"), "chunk_id").alias("content"),
        F.lit("section").alias("chunk_type"), F.lit(1).alias("document_id"),
    )


def test_pages_follow_each_other(spark):
    log = spark.createDataFrame([(i, i % 3) for i in range(10)], "id int, ts int")
    want = [(r["ts"], r["id"]) for r in lineage.newest_page(log, "ts", "id", 10).collect()]
    got, last = [], None
    while page := [(r["ts"], r["id"]) for r in lineage.page_after(log, "ts", "id", last, 3).collect()]:
        got, last = got + page, page[-1]
    assert got == want


def test_siblings_and_context(spark, tree):
    got = {r["chunk_id"]: (r["sibling_count"], r["siblings"]) for r in context.with_siblings(tree, shown=3).collect()}
    assert got[2] == (4, ["c3", "c4", "c5"]) and got[4] == (4, ["c2", "c3", "c5"]) and got[6] == (4, ["c2", "c3", "c4"])
    assert got[1] == (0, []) and got[7] == (0, [])
    whole = {r["chunk_id"]: (r["sibling_count"], r["siblings"]) for r in context.with_siblings(tree, shown=None).collect()}
    assert whole[2] == (4, ["c3", "c4", "c5", "c6"]) and whole[6] == (4, ["c2", "c3", "c4", "c5"]) and whole[7] == (0, [])
    assert context.sibling_rows(tree, tree).count() == 20
    rows = context.context_chunks(spark.createDataFrame([(3,), (7,)], "target_id int"), tree).collect()
    assert sorted((r["target_id"], r["relation"], r["chunk_id"]) for r in rows) == [
        (3, "parent", 1), (3, "sibling", 2), (3, "sibling", 4), (3, "sibling", 5), (3, "sibling", 6), (3, "target", 3), (7, "target", 7)
    ]


@pytest.mark.parametrize(
    "quality_,conf,error,source,confidence,reason",
    [
        ("excellent", 0.9, None, "embedded", 0.95, "Embedded quality: excellent"),
        ("GOOD", 0.9, None, "embedded", 0.85, "Embedded quality: good"),
        ("poor", 0.75, None, "ocr", 0.75, "OCR conf (0.75) > threshold"),
        ("poor", 0.7, None, "fallback", 0.6, "Low OCR conf (0.70)"),
        ("none", 0.2, None, "ocr", 0.2, "No embedded text"),
        ("none", 0.2, "timeout", "embedded", 0.9, "No OCR result available"),
        ("strange", 0.9, None, "embedded", 0.8, "Unknown quality 'strange' - using embedded"),
        ("unknown", 0.9, None, "embedded", 0.7, "Unknown quality"),
        (None, 0.9, None, "embedded", 0.7, "Unknown quality"),
    ],
)
def test_page_rules(spark, quality_, conf, error, source, confidence, reason):
    emb = spark.createDataFrame([(1, 1, "E", quality_)], "doc_id int, page_num int, text string, q string")
    ocr = spark.createDataFrame([(1, 1, "O", conf, error)], "doc_id int, page_num int, full_text string, avg_confidence double, error string")
    r = pages.merge_pages(emb, ocr, F.col("q"), order=F.lit(1)).first()
    assert (r["source"], r["confidence"], r["reason"], r["text"]) == (source, confidence, reason, "O" if source == "ocr" else "E")


def test_masking_round_trip(spark):
    x = "Az. 1 C 234/23, IBAN DE12 3456 7890 1234 5678 90 und DE123456789, Vertrag AB-1/2. IBAN DE12345678901234567890."
    d = spark.createDataFrame([(1, x), (2, "nichts")], "id int, t string")
    masked, mapping = pii.mask_pii(d, "id", "t")
    got = {r["id"]: r["masked"] for r in masked.collect()}
    assert got[1] == "<CASE_NUMBER_1>, IBAN <IBAN_1> und <VAT_ID_1>, <CONTRACT_NUMBER_1>. IBAN <IBAN_2>." and got[2] == "nichts"
    back = pii.restore_pii(masked, mapping, "id", "masked")
    assert {r["id"]: r["restored"] for r in back.collect()} == {1: x, 2: "nichts"}
    assert {r["id"]: r["ok"] for r in masked.select("id", pii.pii_free(F.col("masked")).alias("ok")).collect()} == {1: True, 2: True}
    strict = pii.mask_pii(d, "id", "t", threshold=0.88)[0].first()["masked"]
    assert "Vertrag AB-1/2" in strict and "<IBAN_1>" in strict


def test_eleven_placeholders_restore_in_order(spark):
    x = " ".join(f"u{i}@x.de" for i in range(11))
    masked, mapping = pii.mask_pii(spark.createDataFrame([(1, x)], "id int, t string"), "id", "t", (pii.EMAIL,))
    assert pii.restore_pii(masked, mapping, "id", "masked").first()["restored"] == x


def test_versions_compare_with_the_latest(spark):
    rows = [("s", 1, "a"), ("s", 2, "b"), ("s", 3, "a"), ("s", 4, "a"), ("t", 1, "x")]
    df = spark.createDataFrame(rows, "source_id string, ts int, source_hash string")
    got = {(r["source_id"], r["ts"]): (r["previous_hash"], r["changed"], r["version"]) for r in lineage.source_versions(df).collect()}
    assert got[("s", 3)] == ("b", True, 3) and got[("s", 4)] == ("a", False, 3) and got[("t", 1)] == (None, False, 1)


def test_invalidation_keeps_the_first_time(spark):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    log = spark.createDataFrame([(1, True, None), (2, False, old), (3, True, None)], "verification_id int, is_valid boolean, invalidated_at timestamp")
    links = spark.createDataFrame([(1, "h"), (2, "h"), (3, "g")], "verification_id int, source_hash string")
    changed = spark.createDataFrame([("h",), ("h",)], "source_hash string")
    out = lineage.invalidate_by_source(log, links, changed, F.lit(new))
    assert {r[0]: (r["is_valid"], r["invalidated_at"]) for r in out.collect()} == {1: (False, new), 2: (False, old), 3: (True, None)}


def test_quota_and_unknown_types(spark):
    req = spark.createDataFrame([(1, "2024-01", "tokens", 1), (1, "2024-01", "tokens", 2), (1, "2024-01", "odd", 1), (9, "2024-01", "queries", 1000)], "user_id int, month string, quota_type string, amount int")
    used = spark.createDataFrame([(1, "2024-01", 99_999, 0, 0, 100_000, 1000, 100)], "user_id int, month string, tokens_used int, queries_count int, documents_indexed int, token_quota int, query_quota int, document_quota int")
    assert [r["allowed"] for r in usage.quota_check(req, used).orderBy("user_id", "quota_type", "amount").collect()] == [False, True, False, True]


def test_tenant_sees_only_own_rows(spark):
    docs = spark.createDataFrame([(1, 7), (2, 8)], "document_id int, user_id int")
    rows = spark.createDataFrame([(1,), (2,), (None,)], "document_id int")
    me = spark.createDataFrame([(7,), (7,)], "user_id int")
    assert [r[0] for r in tenancy.tenant_scope(rows, docs, me).collect()] == [1]
    assert tenancy.tenant_scope(rows, docs, me, null_passes=True).count() == 2


def test_coverage_levels(spark):
    want = spark.range(100).withColumnRenamed("id", "law")
    for n, status in ((95, "pass"), (85, "warn"), (84, "fail")):
        assert quality.coverage_report(want.filter(F.col("law") < n), want, "law").first()["status"] == status


def test_query_without_hits_fails(spark):
    exp = spark.createDataFrame([(1, ["a"])], "query_id int, keywords array<string>")
    hits = spark.createDataFrame([], "query_id int, rank int, score double, text string")
    v = quality.retrieval_verdict(quality.retrieval_metrics(hits, exp, 0.5), 0.5).first()
    assert not v["passed"] and v["failure_reason"] == "No results returned"


def test_expired_mappings_and_used_ones_are_gone(spark):
    now = dt.datetime(2024, 1, 1, 1, 0)
    m = spark.createDataFrame([(1, now - dt.timedelta(seconds=299)), (2, now - dt.timedelta(seconds=300)), (3, now)], "request_id int, created_at timestamp")
    used = spark.createDataFrame([(3,)], "request_id int")
    assert [r[0] for r in usage.live_mappings(m, used, F.lit(now)).select("request_id").collect()] == [1]


def test_links_are_told_apart_before_they_are_hashed(spark, sf):
    from statera.plans import audits, load

    keys = audits.links(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[1].split("]")[0]
    assert "l_partkey" in keys and "source_hash" not in keys
    status = load()["d14_verification_status"].run(spark, sf)
    assert "sha2" not in status._jdf.queryExecution().optimizedPlan().toString()
