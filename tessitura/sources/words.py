"""Word-stream sources: transcript files, raw recogniser output and text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.plans.scan import dealt_once

# Bytes of text whose words one task sorts in memory; a word takes about ten times its text.
PART_BYTES = 8_000_000
WORD_COLUMNS = ["stream_id", "token_id", "start_s", "end_s", "text", "confidence"]
REQUIRED_WORD_FIELDS = ("start_s", "end_s", "text", "confidence")


def words_from_documents(documents: DataFrame) -> DataFrame:
    """Timed words laid over plain documents; every time is integer milliseconds first.

    The compact text is shuffled and sorted by stream, not the exploded words: the running clock reuses that
    partitioning, and the words come in its order already. It is shuffled once for all jobs over the words. The partition count
    follows the bytes of text, so that the words of a partition are sorted in memory however large the table; a job sums them up.
    """
    texts = documents.select(F.col("doc_id").alias("stream_id"), F.col("lang").alias("language"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    tokens = (
        dealt_once(texts, spread, "stream_id")
        .select(
            "stream_id",
            "language",
            F.posexplode(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("token_id", "text"),
        )
        .withColumn("token_id", F.col("token_id").cast("long"))
    )
    last = F.substring("text", -1, 1)
    timed = tokens.select(
        "*",
        (F.lit(60) + 40 * F.least(F.length("text"), F.lit(12))).cast("long").alias("dur_ms"),
        (
            F.when(last.isin(".", "?", "!"), 700).when(last.isin(",", ";", ":"), 250).otherwise(30)
            + F.when((F.col("stream_id") * 7 + F.col("token_id") * 13) % 97 == 0, 2600).otherwise(0)
        )
        .cast("long")
        .alias("pause_ms"),
    )
    before = Window.partitionBy("stream_id").orderBy("token_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur_ms") + F.col("pause_ms")).over(before), F.lit(0))
    return timed.withColumn("start_ms", start).select(
        "stream_id",
        "token_id",
        (F.col("start_ms") / F.lit(1000.0)).alias("start_s"),
        ((F.col("start_ms") + F.col("dur_ms")) / F.lit(1000.0)).alias("end_s"),
        "text",
        (((F.col("stream_id") * 31 + F.col("token_id") * 17) % 100) / F.lit(100.0)).alias("confidence"),
        "language",
    )


def _is_object(value: Column) -> Column:
    """Whether a variant is a JSON object; reads all of it."""
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _number(value: Column) -> Column:
    """A number or numeric string as a double; null for every other type, for no other JSON text reads as a number."""
    return F.trim(F.try_variant_get(value, "$", "string")).try_cast("double")


def judged_words(files: DataFrame) -> DataFrame:
    """Words of sound transcripts as ``stream_id, language, duration_s, reason, w``, with null ``reason``; one row with null ``w`` for each other.

    ``files``: ``stream_id, content``, one JSON object each. Each file is parsed and judged in its own row, and the
    verdict decides what is exploded; a filter on it would be pushed below the parsing and repeat it.
    """
    part = lambda name: F.try_variant_get("root", f"$.{name}", "variant")
    parsed = files.select("stream_id", F.try_parse_json("content").alias("root")).select(
        "stream_id", "root", part("words").alias("words"), part("language").alias("language"), part("duration_s").alias("duration")
    )

    # One step after the other, so that each value is taken out of its word once.
    named = f"struct<{','.join(f'{f}:variant' for f in REQUIRED_WORD_FIELDS)}>"
    numeric = [f for f in REQUIRED_WORD_FIELDS if f != "text"]
    fields = F.transform("items", lambda x: F.try_variant_get(x, "$", named))
    values = F.transform(
        fields, lambda x, i: F.struct(i.alias("at"), x.alias("f"), *[_number(x[f]).alias(f) for f in numeric], F.try_variant_get(x["text"], "$", "string").alias("text"))
    )

    def judge(word: Column) -> Column:
        place = F.concat(F.lit("word "), word["at"].cast("string"))
        bad = F.when(word["f"].isNull(), F.concat(place, F.lit(" is not an object")))
        for name in REQUIRED_WORD_FIELDS:
            bad = bad.when(word["f"][name].isNull(), F.concat(place, F.lit(f" has no {name}")))
        for name in numeric:
            bad = bad.when(word[name].isNull(), F.concat(place, F.lit(f": {name} is not numeric")))
        return F.struct(word["at"].cast("long").alias("token_id"), *[word[c].alias(c) for c in WORD_COLUMNS[2:]], bad.alias("reason"))

    fault = (
        F.when(F.col("root").isNull(), "not JSON")
        .when(F.col("words").isNull() & ~_is_object(F.col("root")), "transcript is not an object")
        .when(F.col("words").isNull(), "transcript has no words")
        .when(F.col("items").isNull(), "words is not a list")
    )
    length = F.when(F.col("duration").isNull(), F.lit(0.0)).otherwise(_number(F.col("duration")))
    rows = parsed.withColumn("items", F.try_variant_get("words", "$", "array<variant>")).select(
        "stream_id",
        F.when(F.col("language").isNull(), "?").otherwise(F.try_variant_get("language", "$", "string")).alias("language"),
        length.alias("duration_s"),
        fault.alias("file_fault"),
        F.transform(values, judge).alias("rows"),
    )
    in_words = F.get(F.filter("rows", lambda r: r["reason"].isNotNull()), F.lit(0))["reason"]
    judged = rows.withColumn("reason", F.coalesce("file_fault", in_words, F.when(F.col("duration_s").isNull(), "duration_s is not numeric")))
    return judged.select("stream_id", "language", "duration_s", "reason", F.explode_outer(F.when(F.col("reason").isNull(), F.col("rows"))).alias("w"))


def parse_transcripts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, rejects) from transcripts, one JSON object each. ``files``: ``stream_id, content``.

    Types are checked, not only keys: numbers may be numeric strings but neither booleans nor null. A file with a
    fault contributes no words and one reject row: the first fault of the file itself, else of its words in order,
    else of its duration. Any text that is no JSON string counts as its JSON text.
    """
    judged = judged_words(files)
    rejects = judged.filter(F.col("w").isNull() & F.col("reason").isNotNull()).select("stream_id", "reason")
    words = judged.filter(F.col("w").isNotNull()).select("stream_id", *[F.col("w")[c].alias(c) for c in WORD_COLUMNS[1:]], "language", "duration_s")
    return words, rejects


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``parse_transcripts`` over files that hold one transcript each; the file's name is the stream."""
    raw = spark.read.text(path, wholetext=True)
    return parse_transcripts(raw.select(F.input_file_name().alias("stream_id"), F.col("value").alias("content")))


def words_from_segments(segments: DataFrame) -> DataFrame:
    """Recogniser segments (``stream_id, seg_no, words``) to words; ids run after empties are dropped.

    A segment's running index starts at the number of words kept in earlier segments, so ids need one
    small prefix over segments rather than one over all words.
    """
    from tessitura.plans.scan import prefix_scan, row_block

    kept = segments.filter(F.col("words").isNotNull()).select(
        "stream_id",
        "seg_no",
        F.filter(
            F.transform(
                "words",
                lambda w: F.struct(
                    w["start_s"].alias("start_s"),
                    w["end_s"].alias("end_s"),
                    F.trim(w["text"]).alias("text"),
                    w["confidence"].alias("confidence"),
                ),
            ),
            lambda w: w["text"] != "",
        ).alias("kept"),
    )
    based = prefix_scan(
        kept, ["stream_id"], ["seg_no"], row_block(F.col("seg_no")), sums={"base": F.size("kept").cast("long")}
    )
    return based.select("stream_id", "base", F.posexplode("kept").alias("pos", "w")).select(
        "stream_id",
        (F.col("base") + F.col("pos")).alias("token_id"),
        F.col("w.start_s").alias("start_s"),
        F.col("w.end_s").alias("end_s"),
        F.col("w.text").alias("text"),
        F.col("w.confidence").alias("confidence"),
    )
