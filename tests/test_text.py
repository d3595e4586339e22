import pytest
from pyspark.sql import functions as F

from statera.functions import domains, ids, scoring, text, vectors
from statera.operators import chunking, sections, sentences, validation


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("§  823  Abs.  1  BGB", "§823 Abs. 1 BGB"),
        ("§ 823 Nr.  2", "§823 Nr. 2"),
        ("&nbsp;&nbsp;Wer&nbsp;oder &amp; &lt;b&gt;", "Wer oder &"),
        ("<p>Test   text\twith</p>", "Test text with"),
        ("a\r\nb\rc\n\n\n\nd", "a\nb\nc\n\nd"),
        ("Müller ", "Müller"),
        ("Ångström", "Ångström"),
        (None, ""),
    ],
)
def test_normalize_text(spark, raw, want):
    assert one(spark, raw, text.normalize_text) == want


def test_normalize_answer(spark):
    raw = "„Gilt“  §§ 1,  z.B.\nAbs. 2 – i.V.m. ‚x‘"
    assert one(spark, raw, domains.GERMAN.normalize) == '"Gilt" §  1, zum Beispiel Absatz 2 - in Verbindung mit \'x\''
    assert one(spark, "§§ 1 Abs. 2", domains.MULTILINGUAL.normalize) == "§§ 1 Abs. 2"


def test_html_to_text(spark):
    page = "<html><style>p{}</style><p>A &amp; B<br>c</p><script>x('</p>')</script><!-- n --><p> &nbsp; </p><b>&Uuml;</b></html>"
    assert one(spark, page, text.html_to_text) == "A & B\nc\nÜ"


def test_mail_body(spark):
    raw = "Hallo\n > alt\nText\n-- \nName\nSent from x"
    assert one(spark, raw, text.clean_mail_body) == "Hallo\nText"


def test_german_detection(spark):
    de = "Das Gesetz gilt und die Frist wird nach dem Antrag mit der Post für alle gewahrt."
    assert one(spark, de, text.detect_german) == "de"
    assert one(spark, "The law applies to everyone who lives here, and to those who do not.", text.detect_german) == "other"
    assert one(spark, "der und die mit", text.detect_german) == "other"


def test_citations(spark):
    x = "Nach § 823 Abs. 1 BGB und Art. 1 GG (BGH VI ZR 396/18) haftet er."
    found = one(spark, x, domains.GERMAN_LEGAL.citations)
    assert found == sorted(
        ["§ 823", "Art. 1", "Abs. 1", "BGB", "GG", "BGH", "BGH VI ZR 396/18", "§ 823 Abs. 1 BGB", "Art. 1 GG"]
    )
    assert one(spark, "GGä und xBGB", domains.GERMAN_LEGAL.citations) == []
    assert one(spark, "Er haftet.", domains.GERMAN_LEGAL.is_statement) is True
    assert one(spark, "Es regnet.", domains.GERMAN_LEGAL.is_statement) is False
    assert one(spark, x, domains.GENERIC.citations) == []


def test_presets():
    assert domains.preset("default")[1] is domains.GERMAN_LEGAL
    domains.register_domain("medical", domains.MULTILINGUAL, [r"ICD-\d+"], ["Diagnose"])
    assert domains.preset("medical")[1].keywords == ("Diagnose",) and "medical" in domains.list_presets()
    with pytest.raises(KeyError):
        domains.preset("none")


def test_sentences(spark):
    x = "Ja. Der Mieter haftet!  Ist das so?? Ende"
    assert one(spark, x, sentences.split_sentences) == ["Der Mieter haftet", "Ist das so", "Ende"]
    rows = sentences.sentence_table(
        spark.createDataFrame([(1, "Ja. ab ab. ab ab cd.")], "id int, t string"), ["id"], "t", domains.MULTILINGUAL, domains.GENERIC
    ).orderBy("sentence_index").collect()
    assert [(r["sentence"], r["start"], r["stop"], r["tokens"]) for r in rows] == [("ab ab", 4, 9, 2), ("ab ab cd.", 11, 20, 3)]


def test_section_tree(spark):
    x = "Vorwort §5 Vertrag Abs. 1 Kündigung (a) schriftlich Abs. 2 Frist §6 Ende"
    rows = sections.parse_sections(spark.createDataFrame([(1, x)], "id int, t string"), "id", text.strip_page_furniture(F.col("t"))).orderBy("position").collect()
    assert [(r["section_id"], r["content"], r["level"], r["parent_position"], r["chunk_type"]) for r in rows] == [
        ("§5", "Vertrag", 0, None, "section"),
        ("Abs. 1", "Kündigung", 1, 0, "subsection"),
        ("(a)", "schriftlich", 3, 1, "paragraph"),
        ("Abs. 2", "Frist", 1, 0, "subsection"),
        ("§6", "Ende", 0, None, "section"),
    ]
    assert one(spark, x, sections.extract_section_ids) == ["(a)", "Abs. 1", "Abs. 2", "§5", "§6"]


def test_empty_sections_are_skipped_and_splits_numbered(spark):
    long = "Satz eins ist lang. " * 10
    x = f"§1 §2 kurz §3 {long}§4 ende"
    d = spark.createDataFrame([(1, x)], "id int, t string")
    rows = sections.number_chunks(d, "id", F.col("t"), size=80, overlap=10).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    ids_ = [r["section_id"] for r in rows]
    assert ids_[0] == "§2" and ids_[1] == "§3_0" and ids_[-1] == "§4" and "§1" not in ids_
    assert all(r["parent_section_id"] == "§3" for r in rows if r["is_split"])
    assert rows[0]["word_count"] == 1 and rows[0]["char_count"] == 4


@pytest.mark.parametrize("x", ["ab " + "x" * 1000, "", "a", "w " * 500, "One. Two! " * 80, "x" * 799 + ".\n" + "y" * 30])
@pytest.mark.parametrize("size,overlap", [(100, 30), (50, 0), (10, 9)])
def test_windows_move_forward_and_cover(x, size, overlap):
    for pieces in (chunking.boundary_windows(x, size, overlap), chunking.section_pieces(x, size, overlap)):
        assert all(len(p) <= size for p in pieces)
        # Every word piece of the text is in some window.
        assert set("".join(pieces)) >= set(x.replace(" ", "").replace("\n", "")[:1])
    assert "".join(chunking.boundary_windows(x, size, 0)).replace(" ", "").replace("\n", "") == x.replace(" ", "").replace("\n", "")


def test_window_boundaries():
    # The full stop lies in the last fifth of the window.
    x = "a" * 90 + ". " + "b" * 50
    assert chunking.boundary_windows(x, 100, 10)[0] == "a" * 90 + "."
    # Nothing there: the last space counts.
    y = "a" * 40 + " " + "b" * 100
    assert chunking.boundary_windows(y, 100, 10)[0] == "a" * 40


def test_paragraph_overlap():
    paras = ["p" * 300, "q" * 300, "r" * 300, "s" * 50]
    got = chunking.paragraph_chunks("\n\n".join(paras), 700, 100, "\n\n")
    assert got == ["\n\n".join(paras[:2]), "\n\n".join(paras[1:3]) + "\n\n" + paras[3]]
    assert chunking.paragraph_chunks("\n\n".join(paras), 700, 0, "\n\n") == ["\n\n".join(paras[:2]), "\n\n".join(paras[2:])]


def test_chunk_sizes_are_checked():
    with pytest.raises(ValueError):
        chunking.chunk_windows(None, 10, 10)


def test_ids(spark):
    import hashlib

    assert one(spark, "x_chunk_0", ids.point_id) == int(hashlib.md5(b"x_chunk_0").hexdigest()[:16], 16)
    assert one(spark, "ä", ids.short_hash) == hashlib.sha256("ä".encode()).hexdigest()[:16]


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vectors.l2_normalize, "array<float>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], vectors.l2_normalize, "array<float>") == [0.0, 0.0]
    assert one(spark, [0.0, 0.0], lambda v: vectors.cosine(v, v), "array<float>") == 0.0


def test_scores(spark):
    scores = [0.92, 0.88, 0.85]
    mean, var = sum(scores) / 3, sum((s - sum(scores) / 3) ** 2 for s in scores) / 2
    row = spark.range(1).select(
        scoring.semantic_score(F.lit(mean), F.lit(var), F.lit(3), F.lit(0.0)).alias("s"),
        scoring.retrieval_score(F.array(*[F.lit(x) for x in (0.82, 0.95, 0.1, 0.89)])).alias("r"),
        scoring.retrieval_score(F.array().cast("array<double>")).alias("r0"),
        *[scoring.citation_score(F.lit(n)).alias(f"c{n}") for n in (0, 1, 2, 3, 9)],
        scoring.coverage_score(F.lit(0), F.lit(0)).alias("v0"),
        *[scoring.trust_label(F.lit(x)).alias(f"t{i}") for i, x in enumerate((0.8, 0.6, 0.599))],
    ).first()
    assert row["s"] == pytest.approx(mean - 0.5 * var) and row["r"] == pytest.approx((0.95 + 0.89 + 0.82) / 3)
    assert row["r0"] == 0.5 and row["v0"] == 0.0
    assert [row[f"c{n}"] for n in (0, 1, 2, 3, 9)] == pytest.approx([0.3, 0.7, 0.85, 0.9, 1.0])
    assert [row[f"t{i}"] for i in range(3)] == [scoring.VERIFIED, scoring.REVIEW, scoring.REJECTED]
    with pytest.raises(ValueError):
        scoring.check_weights({"a": 0.5})
    assert scoring.strict_threshold(0.98, True) == 1.0


def test_low_and_uneven_scores_are_punished(spark):
    row = spark.range(1).select(
        scoring.semantic_score(F.lit(0.5), F.lit(9.0), F.lit(2), F.lit(1.0)).alias("cap"),
        scoring.semantic_score(F.lit(0.1), F.lit(0.0), F.lit(2), F.lit(1.0)).alias("floor"),
        scoring.semantic_score(F.lit(0.9), F.lit(None).cast("double"), F.lit(1), F.lit(0.0)).alias("single"),
    ).first()
    assert row["cap"] == pytest.approx(0.15) and row["floor"] == 0.0 and row["single"] == 0.9


@pytest.mark.parametrize(
    "name,size,safe,reason",
    [
        ("a b.PDF", 10, "a b.PDF", None),
        ("../a.pdf", 10, "", "Invalid filename"),
        ("a/b.pdf", 10, "", "Invalid filename"),
        ("", 10, "unnamed_file", "Filename is required"),
        ("x?.eml", 0, "x_.eml", "File is empty"),
        ("x.exe", 5, "x.exe", "File type not supported"),
        (".pdf", 5, "pdf", "File type not supported"),
        ("ü.txt", 51 * 1024 * 1024, "ü.txt", "File too large"),
        ("n" * 300 + ".docx", 5, "n" * 190 + ".docx", None),
        ("???", 5, "unnamed_file", "File type not supported"),
    ],
)
def test_files(spark, name, size, safe, reason):
    r = validation.check_files(spark.createDataFrame([(name, size)], "name string, size long")).first()
    assert (r["safe_name"], r["reason"]) == (safe, reason)


def test_queries(spark):
    rows = [("  hi ", None), (" ", 1), ("x" * 1001, 1), ("q", 0), ("q", 21), ("' OR '1'='1", 3)]
    got = validation.check_queries(spark.createDataFrame(rows, "query string, top_k int")).collect()
    assert [(r["k"], r["reason"]) for r in got[:1]] == [(5, None)] and got[0]["clean"] == "hi"
    assert [r["reason"] for r in got[1:5]] == ["Query cannot be empty", "Query too long", "top_k must be at least 1", "top_k too large"]
    assert got[5]["suspicious"] and got[5]["reason"] is None


def test_metadata(spark):
    m = one(spark, {"a b": "x" * 600, "a-b": "last", "ok": "1"}, validation.sanitize_metadata, "map<string,string>")
    assert m == {"a_b": "last", "ok": "1"} or m == {"a_b": "x" * 600, "ok": "1"}
    many = {str(i): "v" for i in range(51)}
    assert one(spark, many, validation.sanitize_metadata, "map<string,string>") == many
    for bad, reason in ((many, "too many keys"), ({"k" * 101: "v"}, "key too long"), ({"k": "x" * 501}, "value too long"), ({"k": "v"}, None)):
        assert one(spark, bad, validation.metadata_violation, "map<string,string>") == reason
