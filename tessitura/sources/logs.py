"""Frame-metric logs and chat files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.signals import linear_level
from tessitura.plans.scan import prefix_scan, row_block
from tessitura.sources.timed_text import file_lines

# Fixed values.
TIME_LINE = r"pts_time:\s*([0-9]+(?:\.[0-9]+)?)"
SCENE_LINE = r"lavfi\.scd\.score=(-?[0-9]+(?:\.[0-9]+)?)"
LEVEL_LINE = r"lavfi\.astats\.Overall\.RMS_level=(-?[0-9]+(?:\.[0-9]+)?|-inf)"


def paired_metrics(lines: DataFrame, metric: str) -> DataFrame:
    """Pairs every time line with the next metric line. ``lines``: ``file_id, line_no, line``.

    A metric counts only when the nearest earlier relevant line is a time line, which also uses that
    time up; dangling lines on either side fall away.
    """
    time = F.regexp_extract("line", TIME_LINE, 1)
    value = F.regexp_extract("line", metric, 1)
    marked = lines.select(
        "file_id",
        "line_no",
        F.when(time != "", time.try_cast("double")).alias("at"),
        F.when((time == "") & (value != ""), value).alias("raw"),
    ).filter(F.col("at").isNotNull() | F.col("raw").isNotNull())
    linked = prefix_scan(marked, ["file_id"], ["line_no"], row_block(F.col("line_no")), lasts={"prev": F.struct("at")})
    return linked.filter(F.col("raw").isNotNull() & F.col("prev.at").isNotNull()).select("file_id", "line_no", F.col("prev.at").alias("time_s"), "raw")


def scene_scores(lines: DataFrame) -> DataFrame:
    """Scene-change scores per time."""
    return paired_metrics(lines, SCENE_LINE).select("file_id", "time_s", F.col("raw").try_cast("double").alias("value"))


def loudness(lines: DataFrame) -> DataFrame:
    """Linear loudness per time."""
    return paired_metrics(lines, LEVEL_LINE).select("file_id", "time_s", linear_level(F.col("raw")).alias("value"))


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of log files; files are read whole so that line order is certain."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_id"), F.col("value").alias("content"))
    return file_lines(files)


CHAT_SCHEMA = "stream_id string, timestamp_s double, text string"


def valid_chat(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects): a time below zero or an empty text is rejected."""
    ok = F.coalesce((F.col("timestamp_s") >= 0) & (F.col("text") != ""), F.lit(False))
    return messages.filter(ok), messages.filter(~ok)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Chat messages from JSON lines."""
    return spark.read.schema(CHAT_SCHEMA).json(path)
