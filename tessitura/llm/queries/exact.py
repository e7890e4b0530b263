"""Exact duplicates of whole documents."""

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import exact


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document."""
    return exact.exact_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {
    "op5_exact_dedup": r"""
WITH normal AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, text_sha256
FROM normal WINDOW same AS (PARTITION BY text_sha256)
"""
}
