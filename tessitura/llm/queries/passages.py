"""Passages of whole documents that an earlier document holds."""

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import passages


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document."""
    return passages.repeated_passages(spark.read.parquet(f"{folder}/documents.parquet")).drop("text_key", "spans")


QUERIES = {"op11_substring_dedup": op11_substring_dedup}
ORACLES = {
    "op11_substring_dedup": r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS passage FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)),
firsts AS (SELECT passage, min(doc_id) AS first FROM windows GROUP BY passage HAVING count(DISTINCT doc_id) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT place) AS places
  FROM (SELECT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN firsts USING (passage) WHERE first < doc_id) GROUP BY doc_id),
marked AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS body
  FROM marked m ANTI JOIN (SELECT doc_id, unnest(places) AS place FROM gone) g USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
