"""Timed-text files: synced lyrics and caption scripts, scanned as whole-file rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions.clock import lenient_caption_clock, lyric_clock, strict_caption_clock
from tessitura.operators.spans import ordered_text, trimmed

# Line ends as Python reads them, the offset tag, the time tag, style overrides.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
OFFSET_TAG = r"(?i)^\[offset:\s*([+-]?[0-9]+)\s*\]$"
TIME_TAG = r"\[([0-9:.]+)\]"
STYLE_TAG = r"\{[^}]*\}"
DIALOGUE = "Dialogue:"


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``file_id, content``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_id"), F.col("value").alias("content"))


def file_lines(files: DataFrame, outer: bool = False) -> DataFrame:
    """``file_id, line_no, line`` in file order; with ``outer`` one row without a line for a file without content."""
    explode = F.posexplode_outer if outer else F.posexplode
    return files.select("file_id", explode(F.split("content", LINE_END)).alias("line_no", "line"))


def parse_synced_lyrics(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, rejects). A line with k tags gives k rows; an offset holds for the lines after it.

    One malformed tag fails its file, as does a file without any timed text. Both are read off the file's own rows, so
    neither result scans the files twice.
    """
    line = trimmed(F.col("line"))
    tags = F.regexp_extract_all(line, F.lit(TIME_TAG), 1)
    # Text after the last tag: greedy prefix up to it.
    text = trimmed(F.regexp_extract(line, r"(?s)^.*\[[0-9:.]+\](.*)$", 1))
    offset = F.regexp_extract(line, OFFSET_TAG, 1)
    ordered = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    scanned = file_lines(files, outer=True).select(
        "file_id",
        "line_no",
        F.last(F.when(offset != "", offset.try_cast("double") / 1000.0), ignorenulls=True).over(ordered).alias("offset_s"),
        F.when(offset == "", tags).alias("tags"),
        text.alias("text"),
    )
    # Files without a tag keep a row, so that they are told.
    held = F.when((F.size("tags") > 0) & (F.col("text") != ""), F.col("tags"))
    timed = scanned.select(
        "file_id", "line_no", "text", F.coalesce("offset_s", F.lit(0.0)).alias("offset_s"), F.posexplode_outer(held).alias("tag_no", "tag")
    ).withColumn("raw_s", lyric_clock(F.col("tag")))
    tagged = F.col("tag").isNotNull()
    wrong = tagged & F.col("raw_s").isNull()
    rejects = (
        timed.groupBy("file_id")
        .agg(F.min_by("tag", F.when(wrong, F.struct("line_no", "tag_no"))).alias("tag"), F.max(tagged).alias("_timed"))
        .select("file_id", F.when(tagged, F.concat(F.lit("bad_time_tag:"), F.col("tag"))).when(~F.col("_timed"), "no_timed_lines").alias("reason"))
        .filter(F.col("reason").isNotNull())
    )
    rank = Window.partitionBy("file_id").orderBy("start_s", "line_no", "tag_no")
    lines = (
        timed.withColumn("_bad", F.max(wrong).over(Window.partitionBy("file_id")))
        .filter(tagged & ~F.col("_bad"))
        .withColumn("start_s", F.greatest(F.lit(0.0), F.col("raw_s") + F.col("offset_s")))
        .select("file_id", (F.row_number().over(rank) - 1).cast("long").alias("line_no"), "start_s", F.lit(None).cast("double").alias("end_s"), "text")
    )
    return lines, rejects


def _dialogue(files: DataFrame, strip_line: bool) -> DataFrame:
    line = trimmed(F.col("line")) if strip_line else F.col("line")
    return (
        file_lines(files)
        .withColumn("line", line)
        .filter(F.col("line").startswith(DIALOGUE))
        .withColumn("fields", F.split(F.col("line"), ",", 10))
    )


def clean_dialogue(text: Column) -> Column:
    """Dialogue text without style overrides, hard breaks as spaces."""
    return trimmed(F.replace(F.regexp_replace(text, STYLE_TAG, ""), F.lit("\\N"), F.lit(" ")))


def caption_segments(files: DataFrame) -> DataFrame:
    """Lenient scan: malformed, empty or reversed lines are skipped."""
    return (
        _dialogue(files, False)
        .filter(F.size("fields") == 10)
        .select(
            "file_id",
            "line_no",
            lenient_caption_clock(F.col("fields")[1]).alias("start_s"),
            lenient_caption_clock(F.col("fields")[2]).alias("end_s"),
            clean_dialogue(F.col("fields")[9]).alias("text"),
        )
        .filter((F.col("end_s") > F.col("start_s")) & (F.col("text") != ""))
    )


def judged_scripts(files: DataFrame) -> DataFrame:
    """``file_id, events, line, reason``: the dialogue of each file, or its first fault and null ``events``; each file in its own row."""
    lines = F.transform(F.split("content", LINE_END), lambda x, i: F.struct(i.alias("line_no"), trimmed(x).alias("line")))
    spoken = F.filter(lines, lambda x: x["line"].startswith(DIALOGUE))
    split = F.transform(spoken, lambda x: F.struct(x["line_no"].alias("line_no"), F.split(x["line"], ",", 10).alias("f")))
    read = F.transform(
        split,
        lambda x: F.struct(
            x["line_no"].alias("line_no"),
            strict_caption_clock(F.get(x["f"], F.lit(1))).alias("start_s"),
            strict_caption_clock(F.get(x["f"], F.lit(2))).alias("end_s"),
            trimmed(F.get(x["f"], F.lit(9))).alias("text"),
            (F.size(x["f"]) < 10).alias("short"),
        ),
    )

    def faulty(x: Column) -> Column:
        return x["short"] | x["start_s"].isNull() | x["end_s"].isNull() | (x["end_s"] <= x["start_s"])

    found = files.select("file_id", read.alias("events")).withColumn("_bad", F.get(F.filter("events", faulty), F.lit(0)))
    return found.select(
        "file_id",
        F.when(F.col("_bad").isNull(), F.col("events")).alias("events"),
        (F.col("_bad.line_no") + 1).alias("line"),
        F.when(F.col("_bad.short"), "malformed_dialogue").when(F.col("_bad").isNotNull(), "bad_time").alias("reason"),
    )


def caption_events_strict(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): any malformed line fails its whole file; overrides stay in the text."""
    judged = judged_scripts(files)
    return script_events(judged), judged.filter(F.col("reason").isNotNull()).select("file_id", "line", "reason")


def script_events(judged: DataFrame) -> DataFrame:
    """Events of ``judged_scripts``, one row each."""
    return judged.select("file_id", F.explode("events").alias("e")).select("file_id", *[F.col("e")[c].alias(c) for c in ("line_no", "start_s", "end_s", "text")])


def caption_text(files: DataFrame) -> DataFrame:
    """All dialogue text of each file joined by spaces; null when there is none."""
    fields = F.split("line", ",", 10)
    spoken = F.when(F.col("line").startswith(DIALOGUE) & (F.size("fields") == 10), clean_dialogue(F.col("fields")[9]))
    # Other lines keep a row without text, so that every file keeps one without another scan.
    texts = file_lines(files, outer=True).withColumn("fields", fields).select("file_id", "line_no", spoken.alias("text"))
    return texts.groupBy("file_id").agg(ordered_text(["line_no"], F.when(F.col("text") != "", F.col("text"))).alias("text"))
