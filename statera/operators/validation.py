"""Input checks as columns; rejected rows keep a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, unicode_ws

# Upload and query rules.
MAX_FILE_BYTES = 50 * 1024 * 1024
EXTENSIONS = ("pdf", "docx", "odt", "txt", "eml")
MAX_NAME = 200
MAX_QUERY = 1000
SQL_PATTERNS = (
    r"('\s*OR\s+'1'\s*=\s*'1)",
    r"('\s*;)",
    r"(--)",
    r"(UNION\s+SELECT)",
    r"(DROP\s+TABLE)",
)


def file_extension(name: Column) -> Column:
    """Lower-cased last suffix without the dot, empty for none (a leading dot starts no suffix)."""
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))


def sanitize_filename(name: Column) -> Column:
    """Safe name, or an empty string when the name is dangerous."""
    safe = F.regexp_replace(name, "[^a-zA-Z0-9_. äöüÄÖÜß-]", "_")
    suffix = F.regexp_extract(safe, r"[^.](\.[^.]+)$", 1)
    stem = F.substring(safe, F.lit(1), F.length(safe) - F.length(suffix))
    short = F.when(
        F.length(safe) > MAX_NAME, F.concat(F.substring(stem, F.lit(1), F.lit(MAX_NAME - 10)), suffix)
    ).otherwise(safe)
    bare = F.btrim(short, F.lit(". "))
    named = F.when((bare == "") | bare.rlike(r"^[_.]+$"), "unnamed_file").otherwise(bare)
    return F.when(name.rlike(r"\.\.|/|\\|\x00"), "").otherwise(named)


def check_files(files: DataFrame, name: str = "name", size: str = "size") -> DataFrame:
    """Adds ``safe_name`` and ``reason`` (null for a valid file)."""
    out = files.withColumn("safe_name", sanitize_filename(F.col(name)))
    reason = (
        F.when(F.coalesce(F.col(name), F.lit("")) == "", "Filename is required")
        .when(F.col("safe_name") == "", "Invalid filename")
        .when(~file_extension(F.col("safe_name")).isin(*EXTENSIONS), "File type not supported")
        .when(F.col(size) == 0, "File is empty")
        .when(F.col(size) > MAX_FILE_BYTES, "File too large")
    )
    return out.withColumn("reason", reason)


def filter_valid_files(files: DataFrame, name: str = "name", size: str = "size") -> tuple[DataFrame, DataFrame]:
    checked = check_files(files, name, size)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def check_queries(queries: DataFrame, text: str = "query", top_k: str = "top_k", max_length: int = MAX_QUERY,
                  default_k: int = 5, max_k: int = 20) -> DataFrame:
    """Adds ``clean``, ``k``, ``suspicious`` and ``reason``; SQL-like text is only flagged."""
    trimmed = strip(F.coalesce(F.col(text), F.lit("")))
    k = F.coalesce(F.col(top_k).cast("int"), F.lit(default_k))
    flag = trimmed.rlike("(?i)" + "|".join(unicode_ws(p) for p in SQL_PATTERNS))
    reason = (
        F.when(trimmed == "", "Query cannot be empty")
        .when(F.length(trimmed) > max_length, "Query too long")
        .when(k < 1, "top_k must be at least 1")
        .when(k > max_k, "top_k too large")
    )
    return (
        queries.withColumn("clean", F.replace(trimmed, F.lit("\x00"), F.lit("")))
        .withColumn("k", k)
        .withColumn("suspicious", flag)
        .withColumn("reason", reason)
    )


def filter_valid_queries(queries: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame]:
    checked = check_queries(queries, **kwargs)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def metadata_violation(m: Column, max_keys: int = 50, max_key: int = 100, max_value: int = 500) -> Column:
    """Why a map breaks the limits, else null; the map itself stays whole."""
    return (
        F.when(F.size(m) > max_keys, "too many keys")
        .when(F.exists(F.map_keys(m), lambda k: F.length(k) > max_key), "key too long")
        .when(F.exists(F.map_values(m), lambda v: F.length(v) > max_value), "value too long")
    )


def sanitize_metadata(m: Column) -> Column:
    """Keys with safe characters only; entries and values stay whole. Of keys that collide the last stays."""
    entries = F.transform(
        F.map_entries(m),
        lambda e: F.struct(
            F.regexp_replace(e["key"], "[^a-zA-Z0-9_]", "_").alias("key"), e["value"].alias("value")
        ),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(last)
