"""Shards of whole documents."""

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import sharding


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document; law ``bytes``."""
    return sharding.shard(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op3_sharding": op3_sharding}
ORACLES = {
    "op3_sharding": r"""
WITH RECURSIVE turned AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sized AS (
  SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, '')) + 16 AS size, substr(md5(coalesce(text, '')), 1, 15) AS hash FROM documents),
checked AS (
  SELECT doc_id, size, hash, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM sized, turned),
groups AS (SELECT hash, sum(size) AS size FROM sized GROUP BY hash),
line AS (SELECT hash, size, sum(size) OVER (ORDER BY hash) AS upto FROM groups),
walk AS (
  SELECT CAST(max(size) AS BIGINT) AS low, CAST(sum(size) AS BIGINT) AS high, CAST(0 AS BIGINT) AS start, 0 AS used, false AS done FROM groups
  UNION ALL
  SELECT CASE WHEN over AND NOT fits THEN middle + 1 ELSE low END, CASE WHEN over AND fits THEN middle ELSE high END,
         CASE WHEN over THEN 0 ELSE next END, CASE WHEN over THEN 0 ELSE used + 1 END, false
  FROM (
    SELECT low, high, middle, used, next, next = total OR used + 1 >= 40 AS over, next = total AS fits FROM (
      SELECT low, high, used, (low + high) // 2 AS middle, (SELECT CAST(max(upto) AS BIGINT) FROM line) AS total,
             (SELECT CAST(coalesce(max(upto), 0) AS BIGINT) FROM line WHERE upto <= start + (low + high) // 2) AS next FROM walk WHERE low < high))),
best AS (SELECT min(high) AS capacity FROM walk),
cut AS (
  SELECT 0 AS shard, CAST(0 AS BIGINT) AS start, (SELECT CAST(max(upto) AS BIGINT) FROM line WHERE upto <= capacity) AS stop, capacity FROM best
  UNION ALL
  SELECT shard + 1, stop, (SELECT CAST(max(upto) AS BIGINT) FROM line WHERE upto <= stop + capacity), capacity FROM cut WHERE stop < (SELECT max(upto) FROM line)),
placed AS (SELECT c.doc_id, c.size, c.crc, cut.shard, md5(CAST(c.doc_id AS VARCHAR)) AS place, c.hash FROM checked c JOIN line USING (hash) JOIN cut ON upto > start AND upto <= stop)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, hash) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
}
