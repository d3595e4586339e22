"""Hashes and ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(c: Column, n: int = 16) -> Column:
    return F.substring(content_hash(c), 1, n)


def point_id(chunk_id: Column) -> Column:
    """First 64 bits of md5 as an unsigned number; needs 20 digits, so a decimal."""
    return F.conv(F.substring(F.md5(chunk_id), 1, 16), 16, 10).cast("decimal(20,0)")
