"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
#: Bytes A-Z to a-z, all others kept; ``bytes.split()`` cuts at exactly GAP.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def words(text: Column) -> Column:
    """Array of the words of a non-null text; empty for a blank text."""
    bare = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def text_bytes(value) -> bytes:
    """UTF-8 bytes of an Arrow/Python text; null is empty."""
    if value is None:
        return b""
    return value.encode("utf-8", "surrogatepass") if isinstance(value, str) else bytes(value)
