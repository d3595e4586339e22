"""Readers for landed files, and stage files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.rows import computed
from ..functions.text import WS, classify_doc_type, strip


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line; blank lines are skipped; a missing path is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    # Spark's reader already skips blank lines.
    return spark.read.schema(schema).json(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite a stage; readers see it once ``_SUCCESS`` is there."""
    df.write.mode("overwrite").format(fmt).save(path)


def append_stage(df: DataFrame, path: str, batch_id: int | None = None, fmt: str = "parquet", run: str = "main") -> None:
    """Append rows. With a batch id the write is idempotent: a repeated batch of a run replaces its own folder.

    Runs number their batches from 0, so every run has a folder of its own.
    """
    if batch_id is None:
        df.write.mode("append").format(fmt).save(path)
    else:
        df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/run={run}/batch_id={batch_id}")


def _file_name() -> Column:
    return F.col("_metadata.file_name")


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "")


def read_statute_markdown(spark: SparkSession, folder: str, base_url: str = "file:///") -> DataFrame:
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(
        F.col("value"), _file_name().alias("file_name")
    )
    return parse_statute_markdown(raw, base_url)


def parse_statute_markdown(raw: DataFrame, base_url: str = "file:///", keep: Sequence[str] = ()) -> DataFrame:
    """One row (``value, file_name``) is one law: front matter ``key: value``, else ``# [SLUG] Title``,
    else the file name. ``keep`` names columns that go along."""
    front_rx = r"(?s)^---\n(.*?)\n---\n(.*)"
    front = F.regexp_extract("value", front_rx, 1)
    has_front = F.col("value").rlike(front_rx)
    pairs = F.transform(
        F.filter(F.split(front, "\n"), lambda line: line.contains(":")),
        lambda line: F.struct(
            strip(F.substring_index(line, ":", 1)).alias("key"),
            strip(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value"),
        ),
    )

    def field(name: str) -> Column:
        # The last line with the key counts.
        return F.try_element_at(F.filter(F.col("_front"), lambda p: p["key"] == name), F.lit(-1))["value"]

    head_rx = f"^#{WS}*\\[([^\\]]+)\\]{WS}*(.+)"
    line = F.substring_index("value", "\n", 1)
    has_head = line.rlike(head_rx)
    stem = _stem(F.col("file_name"))
    body = F.when(has_front, F.regexp_extract("value", front_rx, 2)).otherwise(F.col("value"))
    staged = raw.withColumn("_front", pairs)
    title = (
        F.when(has_front, F.coalesce(field("Title"), stem))
        .when(has_head, strip(F.regexp_extract(line, head_rx, 2)))
        .otherwise(stem)
    )
    slug = (
        F.when(has_front, F.coalesce(field("Slug"), F.lower(stem)))
        .when(has_head, strip(F.regexp_extract(line, head_rx, 1)))
        .otherwise(stem)
    )
    return staged.select(
        F.lit("gesetze_github").alias("source"),
        F.lit("law").alias("type"),
        slug.alias("slug"),
        title.alias("title"),
        F.regexp_replace(strip(body), "\n{3,}", "\n\n").alias("content"),
        F.concat(F.lit(base_url), F.col("file_name")).alias("url"),
        *keep,
    )


def read_eu_json(spark: SparkSession, folder: str, min_chars: int = 100, base_url: str = "file:///") -> DataFrame:
    raw = spark.read.schema(schemas.EU_RECORD).json(
        folder, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json"
    ).select("*", _stem(_file_name()).alias("stem"))
    return parse_eu_records(raw, min_chars, base_url)


def parse_eu_records(raw: DataFrame, min_chars: int = 100, base_url: str = "file:///") -> DataFrame:
    """One record is one document; header, recitals, body parts and attachments joined by blank lines.

    ``raw`` has the record columns and ``stem``, the file name without its suffix.
    """
    parts = F.concat(
        F.array("header", "recitals"), F.coalesce("main_body", F.array().cast("array<string>")), F.array("attachments")
    )
    kept = F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != "")
    return (
        computed(raw, "text", F.array_join(kept, "\n\n"), lambda t: F.length(t) >= min_chars)
        .select(
            F.concat(F.lit("eurlex-"), "stem").alias("doc_id"),
            F.concat(F.lit("EUR-Lex "), "stem").alias("title"),
            "text",
            F.concat(F.lit(base_url), "stem").alias("url"),
            classify_doc_type(F.col("concepts")).alias("type"),
            F.lit("EU").alias("jurisdiction"),
            F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"),
        )
    )


def read_statute_xml(spark: SparkSession, path: str) -> DataFrame:
    """One ``<norm>`` per section; ``text`` is declared as a string so mixed content stays whole."""
    norms = spark.read.format("xml").option("rowTag", "norm").schema(schemas.STATUTE_NORM).load(path)
    text = F.col("textdaten.text")
    plain = F.regexp_replace(text, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return norms.select(
        F.col("metadaten.jurabk").alias("abbreviation"),
        F.coalesce("metadaten.enbez", F.lit("")).alias("section"),
        F.coalesce("metadaten.titel", F.lit("")).alias("title"),
        plain.alias("content"),
    ).filter((F.col("section") != "") | (F.col("title") != ""))


# Leading bytes and extensions of the known file types.
MAGIC = {"25504446": "pdf", "504B0304": "zip"}
EXTENSION_TYPES = {
    "pdf": "pdf", "docx": "docx", "odt": "odt", "eml": "eml", "msg": "eml", "zip": "zip",
}


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return inventory_rows(files)


def inventory_rows(files: DataFrame) -> DataFrame:
    """Path, size, sha256 and type of ``path, length, content`` rows: leading bytes, then the extension.

    A zip container whose extension names an office format is that format.
    """
    ext = F.lower(F.regexp_extract("path", r"[^./]\.([^./]+)$", 1))
    by_ext = F.lit(None).cast("string")
    for e, t in EXTENSION_TYPES.items():
        by_ext = F.when(ext == e, t).otherwise(by_ext)
    magic = F.hex(F.substring("content", 1, 4))
    by_magic = F.lit(None).cast("string")
    for m, t in MAGIC.items():
        by_magic = F.when(magic == m, t).otherwise(by_magic)
    kind = F.when((by_magic == "zip") & ext.isin("docx", "odt"), ext).otherwise(
        F.coalesce(by_magic, by_ext, F.lit("unknown"))
    )
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("file_hash"),
        kind.alias("file_type"),
    )
