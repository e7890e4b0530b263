"""Streaming forms, run over the tables as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.plans.scan import shared_folder
from tessitura.queries.common_sql import ISLANDS, with_words
from tessitura.queries.segments import ms
from tessitura.sources.tables import table, words
from tessitura.streaming import live


def live_chat_density(spark: SparkSession, folder: str) -> DataFrame:
    """Closed five-minute windows; the watermark trails the newest message by half an hour."""
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    # The table's clock has no zone; reading it as UTC keeps windows the same in every session.
    zone = spark.conf.get("spark.sql.session.timeZone")
    messages = events.select((F.col("user_id") % 4).alias("stream_id"), F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone).alias("ts"))
    rows = live.run_to_table(live.chat_density(messages, 300.0, "30 minutes"), spark)
    return rows.select("stream_id", F.unix_seconds("window_start").alias("window_start"), F.round("level", 6).alias("level"))


def live_gap_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of the word streams that had closed when the watermark stopped, five seconds behind the newest word.

    The word fixture is written to the shared folder first, for its clock needs whole documents; its times as whole milliseconds,
    each as its distance from the one before, which takes a few bytes a word.
    """
    place = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    timed = words(spark, folder).select("stream_id", "token_id", ms("start_s"), ms("end_s"))
    timed.write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").parquet(place)
    seconds = [(F.col(f"{c}_ms") / F.lit(1000.0)).alias(f"{c}_s") for c in ("start", "end")]
    stream = spark.readStream.schema(timed.schema).parquet(place).select("stream_id", "token_id", *seconds, F.timestamp_millis("start_ms").alias("ts"))
    found = live.run_to_table(live.live_spans(stream), spark)
    return found.select("stream_id", "kind", ms("start_s"), ms("end_s"), "n_words")


QUERIES = {"live_chat_density": live_chat_density, "live_gap_spans": live_gap_spans}
ORACLES = {
    "live_gap_spans": with_words(ISLANDS)
    + """, m AS (SELECT max(CAST(round_even(start_s * 1000, 0) AS BIGINT)) AS top FROM words),
        s AS (SELECT *, CAST(round_even(end_s * 1000, 0) AS BIGINT) AS e, span_no = max(span_no) OVER (PARTITION BY stream_id) AS is_last FROM spans)
        SELECT CAST(stream_id AS VARCHAR) AS stream_id, 'span' AS kind, CAST(round_even(start_s * 1000, 0) AS BIGINT) AS start_ms, e AS end_ms, n_words
        FROM s, m WHERE NOT is_last OR e + 7000 <= top - 5000""",
    "live_chat_density": """WITH e AS (SELECT user_id % 4 AS stream_id, floor(epoch(ts) / 300)::BIGINT * 300 AS w FROM events), m AS (SELECT max(epoch_ms(ts)) AS top FROM events)
        SELECT stream_id, w AS window_start, round(count(*) / 300.0::DOUBLE, 6) AS level FROM e, m WHERE (w + 300) * 1000 <= top - 1800000 GROUP BY 1, 2""",
}
