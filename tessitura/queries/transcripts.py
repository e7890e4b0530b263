"""Transcript files written from the word fixture, one in twelve bent in each of ten ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.spans import as_ms, ordered_text
from tessitura.queries.common_sql import with_words
from tessitura.sources.tables import table, words
from tessitura.sources.words import judged_words


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``stream_id, content``: every document as the transcript of its words."""
    stream, i, m = words(spark, folder), F.col("token_id"), F.col("stream_id") % 12
    quoted = F.regexp_extract(F.to_json(F.struct("text")), r"^\{(.*)\}$", 1)
    start = F.when((m == 5) & (i == 1), F.lit("true")).when(m == 8, F.concat(F.lit('"'), F.col("start_s").cast("string"), F.lit('"'))).otherwise(F.col("start_s").cast("string"))
    sure = F.when((m == 4) & (i == 2), F.lit("")).when((m == 10) & (i == 0), F.lit(',"confidence":null')).otherwise(F.concat(F.lit(',"confidence":'), F.col("confidence").cast("string")))
    item = F.when(m == 2, F.regexp_extract(quoted, r"^\"text\":(.*)$", 1)).otherwise(
        F.concat(F.lit('{"start_s":'), start, F.lit(',"end_s":'), F.col("end_s").cast("string"), F.lit(","), quoted, sure, F.lit("}"))
    )
    rolled = stream.withColumn("item", item).groupBy("stream_id").agg(ordered_text(["token_id"], F.col("item"), ",").alias("items"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("stream_id"), F.col("lang"))
    listed = F.concat(F.lit("["), F.coalesce("items", F.lit("")), F.lit("]"))
    body = F.concat(
        F.lit('{"language":"'), F.col("lang"), F.lit('","duration_s":'), F.when(m == 3, F.lit('"abc"')).otherwise(F.lit('"12.5"')),
        F.when(m == 7, F.lit("")).otherwise(F.concat(F.lit(',"words":'), F.when(m == 1, F.lit('{"0":1}')).otherwise(listed))), F.lit("}"),
    )
    content = F.when(m == 6, F.substring(body, 1, 20)).when(m == 9, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return docs.join(rolled, "stream_id", "left").select("stream_id", content.alias("content"))


def transcript_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Words and their times of every sound transcript, the first fault of every other."""
    judged = judged_words(files(spark, folder)).filter(F.col("w").isNotNull() | F.col("reason").isNotNull())
    times = as_ms(F.col("w.start_s")) + as_ms(F.col("w.end_s"))
    return judged.groupBy("stream_id").agg(
        F.count("w").alias("n"), F.coalesce(F.sum(times), F.lit(0)).alias("sum_ms"), F.coalesce(F.sum(F.length("w.text")), F.lit(0)).alias("n_chars"),
        F.max(F.coalesce("reason", F.concat_ws(":", "language", F.col("duration_s").cast("string")))).alias("reason"),
    )


QUERIES = {"transcript_scan": transcript_scan}
ORACLES = {
    "transcript_scan": with_words()
    + """, g AS (SELECT stream_id, count(*) AS n, sum(CAST(round_even(start_s * 1000, 0) AS BIGINT) + CAST(round_even(end_s * 1000, 0) AS BIGINT))::BIGINT AS sum_ms,
            sum(length(text))::BIGINT AS n_chars FROM words GROUP BY stream_id),
        j AS (SELECT doc_id AS stream_id, doc_id % 12 AS m, lang, coalesce(n, 0) AS k, sum_ms, g.n_chars FROM documents LEFT JOIN g ON g.stream_id = doc_id),
        r AS (SELECT *, CASE WHEN m = 6 THEN 'not JSON' WHEN m = 9 THEN 'transcript is not an object' WHEN m = 7 THEN 'transcript has no words' WHEN m = 1 THEN 'words is not a list'
            WHEN m = 2 AND k > 0 THEN 'word 0 is not an object' WHEN m = 4 AND k > 2 THEN 'word 2 has no confidence' WHEN m = 5 AND k > 1 THEN 'word 1: start_s is not numeric'
            WHEN m = 10 AND k > 0 THEN 'word 0: confidence is not numeric' WHEN m = 3 THEN 'duration_s is not numeric' END AS fault FROM j)
        SELECT stream_id, CASE WHEN fault IS NULL THEN k ELSE 0 END AS n, CASE WHEN fault IS NULL THEN sum_ms ELSE 0 END AS sum_ms,
            CASE WHEN fault IS NULL THEN n_chars ELSE 0 END AS n_chars, coalesce(fault, lang || ':12.5') AS reason FROM r WHERE fault IS NOT NULL OR k > 0"""
}
