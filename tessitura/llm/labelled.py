"""Bounded samples of labelled rows for fitting, and the share that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def sampled_ids(ids: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` rows of ``ids(doc_id, ...)`` that come first by their id's hash: the same on every run."""
    return ids.filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` with ``text``; broadcast, as a sample has a fixed bound."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
