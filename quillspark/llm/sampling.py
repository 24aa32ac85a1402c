"""Bounded samples of labelled rows to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for documents that are never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About `most` of the rows, never more: those whose hashed key is under a threshold.

    The rows are counted first; the choice depends on keys alone, so it is the same in every run.
    """
    n = rows.count()
    share = 1.0 if n <= most else 0.97 * most / n
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(most)
