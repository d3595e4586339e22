"""Readers on small files written here."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from statera import schemas
from statera.sources import files, mail, records, store


def folder(contents: dict) -> str:
    base = tempfile.mkdtemp(prefix="spark-")
    for name, data in contents.items():
        os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
        with open(f"{base}/{name}", "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())
    return base


def test_jsonl_blank_lines_and_missing_file(spark):
    base = folder({"a.jsonl": '{"doc_id": "1", "text": "x"}\n\n  \n{"doc_id": "2", "law": "BGB"}\n'})
    rows = files.read_jsonl(spark, f"{base}/a.jsonl", schemas.CORPUS).filter("doc_id is not null").collect()
    assert sorted(r["doc_id"] for r in rows) == ["1", "2"]
    assert files.read_jsonl(spark, f"{base}/none.jsonl", schemas.CORPUS).count() == 0


def test_markdown_laws(spark):
    base = folder(
        {
            "bgb.md": "# [BGB] Bürgerliches Gesetzbuch  (BGB)\n\n\n\n## § 1\nText\n",
            "Front.md": "---\nTitle: Mein: Gesetz\nSlug: mg\nkein Paar\n---\n\nInhalt\n",
            "NurSlug.md": "---\nx: y\n---\nInhalt",
            "plain.md": "Nur Text",
            "skip.txt": "x",
        }
    )
    rows = {r["slug"]: (r["title"], r["content"]) for r in files.read_statute_markdown(spark, base).collect()}
    assert rows == {
        "BGB": ("Bürgerliches Gesetzbuch  (BGB)", "# [BGB] Bürgerliches Gesetzbuch  (BGB)\n\n## § 1\nText"),
        "mg": ("Mein: Gesetz", "Inhalt"),
        "nurslug": ("NurSlug", "Inhalt"),
        "plain": ("plain", "Nur Text"),
    }


def test_eu_json(spark):
    doc = {"header": "H" * 40, "recitals": "", "main_body": ["A" * 40, None, "B" * 40], "attachments": "X", "concepts": ["Decision on fish"] + [str(i) for i in range(20)]}
    base = folder({"train/32001D1.json": json.dumps(doc, indent=1), "dev/short.json": '{"header": "x"}'})
    rows = files.read_eu_json(spark, base).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["doc_id"] == "eurlex-32001D1" and r["type"] == "eu_decision" and len(r["concepts"]) == 21
    assert r["text"] == "\n\n".join(["H" * 40, "A" * 40, "B" * 40, "X"])


def test_statute_xml_keeps_mixed_content(spark):
    xml = (
        "<dokumente><norm><metadaten><jurabk>BGB</jurabk><enbez>§ 1</enbez><titel>Beginn</titel></metadaten>"
        "<textdaten><text><Content><P>Die <B>Rechts</B>fähigkeit &amp; mehr.</P></Content></text></textdaten></norm>"
        "<norm><metadaten><jurabk>BGB</jurabk></metadaten></norm></dokumente>"
    )
    rows = files.read_statute_xml(spark, folder({"a.xml": xml}) + "/a.xml").collect()
    assert [(r["abbreviation"], r["section"], r["title"], r["content"].strip()) for r in rows] == [
        ("BGB", "§ 1", "Beginn", "Die Rechtsfähigkeit & mehr.")
    ]


MAIL = (
    "From: a@x.de\nTo: b@x.de\nCc: c@x.de\nSubject: Fwd: Test\nDate: Mon, 01 Jan 2024 10:00:00 +0100\nMessage-ID: <1@x>\n"
    "In-Reply-To: <0@x>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nHallo\n"
    "--B\nContent-Type: text/html\n\n<p>Hallo</p>\n--B\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=x.pdf\n\nPDF\n--B--\n"
)


def test_mail(spark):
    m = mail.read_mail(spark, folder({"a.eml": MAIL}))
    r = m.first()
    assert (r["subject"], r["sender"], r["recipients"], r["body_text"]) == ("Fwd: Test", "a@x.de", ["b@x.de", "c@x.de"], "Hallo")
    assert r["body_html"].strip() == "<p>Hallo</p>" and r["error"] is None
    assert mail.mail_attachments(m).first()["filename"] == "x.pdf"
    t = mail.mail_thread_flags(m).first()
    assert t["is_reply"] and t["is_forward"]
    assert mail.mail_to_document(m).first()["text"].endswith("Date: 2024-01-01 10:00:00\n\nHallo")


def test_inventory(spark):
    base = folder({"a.bin": b"%PDF-1.4 x", "b.docx": b"PK\x03\x04zz", "c.zip": b"PK\x03\x04zz", "d.MSG": b"hi", "e.xyz": b"?"})
    rows = {r["name"]: r["file_type"] for r in files.file_inventory(spark, base).collect()}
    assert rows == {"a.bin": "pdf", "b.docx": "docx", "c.zip": "zip", "d.MSG": "eml", "e.xyz": "unknown"}


def test_case_and_law_records(spark):
    html = "<p>" + "Wort " * 20 + "</p>"
    cases = spark.createDataFrame(
        [("1", "s1", ("BVerwG", "bverwg"), "7 C 2", "2013", "Urteil", html), ("2", "s2", None, None, None, None, "<p>kurz</p>")], schemas.CASE_RECORD
    )
    r = records.normalize_case_records(cases).collect()
    assert len(r) == 1 and r[0]["title"] == "BVerwG - 7 C 2 - 2013" and r[0]["court"] == "BVERWG"
    laws = spark.createDataFrame([("1", "bgb", "Bürgerliches Gesetzbuch", None, html, None, "2023")], schemas.LAW_RECORD)
    assert records.normalize_law_records(laws).first()["title"] == "BGB - Bürgerliches Gesetzbuch"


def test_upsert_is_idempotent_and_counted(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "point_id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "point_id int, v string")
    once = store.upsert_points(new, base)
    twice = store.upsert_points(new, once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert store.upsert_counts(new, base, once, "point_id").first()["matches"]
    assert not store.upsert_counts(new, base, base, "point_id").first()["matches"]


def test_incremental_scan_is_by_day_and_inclusive(spark):
    src = spark.sql("select timestamp'2024-01-01 23:00:00' ts union all select timestamp'2024-01-02 00:00:00' union all select timestamp'2024-01-02 12:00:00'")
    last = F.lit("2024-01-02 11:00:00").cast("timestamp")
    assert store.incremental_scan(src, "ts", last).count() == 2
    assert store.incremental_scan(src, "ts", last, force_full=True).count() == 3
    assert store.incremental_scan(src, "ts", None).count() == 3
    assert store.dry_run(src).first()[0] == 3


def test_logs_hold_hashes_only(spark):
    q = spark.createDataFrame([(1, " frage ", "antwort", "2024-01-01 00:00:00")], "id int, q string, r string, t string").withColumn("ts", F.to_timestamp("t"))
    rows = store.query_log_rows(q, "ts", "q", "r", ["id"])
    path = tempfile.mkdtemp(prefix="spark-") + "/log"
    store.append_query_log(rows, path)
    store.append_query_log(rows, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 and not {"q", "r"} & set(back.columns)
    import hashlib

    assert back.first()["query_hash"] == hashlib.sha256(b"frage").hexdigest()


def test_payload_scan_reads_no_vectors(spark, sf):
    plan = store.scan_payload(spark.read.parquet(f"{sf}/embeddings.parquet"), "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("include,n", [(False, 1), (True, 2)])
def test_export(spark, include, n):
    log = spark.createDataFrame([(1, True), (2, False)], "id int, is_valid boolean")
    path = tempfile.mkdtemp(prefix="spark-") + "/out"
    store.export_verifications(log, path, include)
    assert spark.read.schema("id int").json(path).count() == n


def test_messages_are_dealt_to_tasks_and_headers_are_kept(spark, monkeypatch):
    from statera.sources import mail

    raw = "Message-ID: <m%d@x>\nFrom: a@b.c\nTo: x@y.z\nSubject: t%d\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\nbody %d\n"
    rows = [(str(i), (raw % (i, i % 3, i)).encode()) for i in range(60)] + [("bad", b"Date: never\n\n\xff"), ("empty", b"")]
    monkeypatch.setattr(mail, "TASK_MESSAGES", 3)
    parsed = mail.parse_mail(spark.createDataFrame(rows, "path string, content binary").coalesce(1))
    assert parsed.rdd.getNumPartitions() == 21
    got = {r.path: r.asDict() for r in parsed.collect()}
    assert len(got) == 62 and all({"path": p, **mail.parse_message(c)} == got[p] for p, c in rows)
    made, policy = [], mail.header_cache()
    kept = policy.header_factory.__wrapped__
    for _ in range(2):
        made.append(mail.parse_message(rows[0][1], policy))
    info = policy.header_factory.cache_info()
    assert made[0] == made[1] and callable(kept) and info.misses <= 8 and info.hits >= info.misses


def test_laws_of_odd_documents_give_the_rows_of_the_sql(spark):
    """Nulls, blank texts, white space at both ends and texts that begin like a law, in every kind of file."""
    import check_oracles
    import duckdb
    from statera.plans import load

    texts = [None, "", " \n", "a", "\n  a\n\n\n\nb ", "---\nSlug: x\n---\nb", "# [X] Y\nb", "a\n---\nb\n---\nc"]
    names = [("en", "src1"), (None, "src2"), ("de", None), ("", ""), ("a \nSlug: b\n", "a\r\n\n\n\n]b \n")]
    rows = [(t, lang, source) for t in texts for lang, source in names for _ in range(3)]
    sf = tempfile.mkdtemp(prefix="spark-")
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    q = load()["a4_read_statute_markdown"]
    assert check_oracles.compare(q.run(spark, sf), con, q.sql) == ("ok", len(rows))
