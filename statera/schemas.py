"""Declared schemas; nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("jurisdiction", T.StringType()),
        T.StructField("law", T.StringType()),
        T.StructField("court", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("created_date", T.StringType()),
        T.StructField("concepts", T.ArrayType(T.StringType())),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
    ]
    + [f for f in CORPUS.fields if f.name not in ("text", "concepts", "source", "created_date")]
)

CASE_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("slug", T.StringType()),
        T.StructField(
            "court",
            T.StructType([T.StructField("name", T.StringType()), T.StructField("slug", T.StringType())]),
        ),
        T.StructField("file_number", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

LAW_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("slug", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abbreviation", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("latest_date", T.StringType()),
    ]
)

COURT_RECORD = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "court", "aktenzeichen", "id", "title", "leitsatz", "text", "volltext",
            "datum", "date", "url",
        )
    ]
)

EU_RECORD = T.StructType(
    [
        T.StructField("header", T.StringType()),
        T.StructField("recitals", T.StringType()),
        T.StructField("main_body", T.ArrayType(T.StringType())),
        T.StructField("attachments", T.StringType()),
        T.StructField("concepts", T.ArrayType(T.StringType())),
    ]
)

STATUTE_NORM = T.StructType(
    [
        T.StructField(
            "metadaten",
            T.StructType(
                [
                    T.StructField("jurabk", T.StringType()),
                    T.StructField("enbez", T.StringType()),
                    T.StructField("titel", T.StringType()),
                ]
            ),
        ),
        T.StructField("textdaten", T.StructType([T.StructField("text", T.StringType())])),
    ]
)

MAIL = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("recipients", T.ArrayType(T.StringType())),
        T.StructField("date", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("body_html", T.StringType()),
        T.StructField(
            "attachments",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("filename", T.StringType()),
                        T.StructField("content_type", T.StringType()),
                        T.StructField("size_bytes", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("message_id", T.StringType()),
        T.StructField("in_reply_to", T.StringType()),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)

VERIFICATION_LOG = T.StructType(
    [
        T.StructField("verification_id", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("answer_text", T.StringType()),
        T.StructField("answer_hash", T.StringType()),
        T.StructField("answer_sentences", T.LongType()),
        T.StructField("has_citations", T.BooleanType()),
        T.StructField("citations", T.ArrayType(T.StringType())),
        T.StructField("source_count", T.LongType()),
        T.StructField("source_fingerprints", T.ArrayType(T.StringType())),
        T.StructField("verified_sentences", T.LongType()),
        T.StructField("verification_rate", T.DoubleType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("trust_label", T.StringType()),
        T.StructField("semantic_similarity", T.DoubleType()),
        T.StructField("retrieval_quality", T.DoubleType()),
        T.StructField("citation_presence", T.DoubleType()),
        T.StructField("coverage", T.DoubleType()),
        T.StructField("retry_attempts", T.IntegerType()),
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("invalidated_at", T.TimestampType()),
        T.StructField("error", T.StringType()),
    ]
)

RUN_STATE = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("stage", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("last_updated", T.TimestampType()),
    ]
)

SECTION = T.StructType(
    [
        T.StructField("section_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("chunk_type", T.StringType()),
    ]
)
