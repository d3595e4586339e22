"""Row visibility per tenant, deletion with its consequences, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import union_rows


def tenant_scope(rows: DataFrame, documents: DataFrame, users: DataFrame, document: str = "document_id",
                 null_passes: bool = False) -> DataFrame:
    """Rows whose document belongs to one of the users; log rows without a document may pass."""
    mine = documents.join(users.select("user_id").distinct(), "user_id", "left_semi").select(
        F.col("document_id").alias("_doc")
    )
    visible = rows.filter(F.col(document).isNotNull()).join(mine, F.col(document) == F.col("_doc"), "left_semi")
    return union_rows(visible, rows.filter(F.col(document).isNull())) if null_passes else visible


def cascade_delete(children: DataFrame, deleted: DataFrame, document: str = "document_id") -> DataFrame:
    """Child rows that survive the deletion of documents."""
    gone = deleted.select(F.col("document_id").alias("_doc"))
    return children.join(gone, F.col(document) == F.col("_doc"), "left_anti")


def soft_delete(documents: DataFrame, deleted: DataFrame) -> DataFrame:
    gone = deleted.select("document_id").distinct().withColumn("_gone", F.lit(True))
    return documents.join(gone, "document_id", "left").withColumn(
        "status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))
    ).drop("_gone")


def clear_lost_parents(chunks: DataFrame, parent: str = "parent_id", row_id: str = "chunk_id") -> DataFrame:
    """Parent pointers to rows that no longer exist become null."""
    alive = chunks.select(F.col(row_id).alias("_p")).distinct()
    j = chunks.join(alive, F.col(parent) == F.col("_p"), "left")
    return j.withColumn(parent, F.when(F.col("_p").isNotNull(), F.col(parent))).drop("_p")


def document_list(documents: DataFrame, user_id) -> DataFrame:
    return documents.filter(F.col("user_id") == F.lit(user_id))


def document_by_id(documents: DataFrame, document_id) -> DataFrame:
    return documents.filter(F.col("document_id") == F.lit(document_id))
