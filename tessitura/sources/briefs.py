"""Brief documents and recorded model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.digest import line_feeds
from tessitura.operators.resolve import expected_names

DRAFT_SUFFIX, CAPTION_SUFFIX = ".draft.json", ".caption.json"


def read_briefs(spark: SparkSession, path: str, max_bytes: int = 5_000_000) -> tuple[DataFrame, DataFrame]:
    """(briefs, rejects): UTF-8 text within the size limit, hashed after its line ends are normalised."""
    raw = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    sized = raw.filter(F.col("length") <= max_bytes).select("path", F.col("content"), F.expr("try_validate_utf8(cast(content as string))").alias("text"))
    good = sized.filter(F.col("text").isNotNull()).select(F.col("path").alias("source"), line_feeds(F.col("text")).alias("text"))
    bad = sized.filter(F.col("text").isNull()).select(F.col("path").alias("source"), F.lit("not_utf8").alias("reason"))
    big = raw.filter(F.col("length") > max_bytes).select(F.col("path").alias("source"), F.lit("too_large").alias("reason"))
    return good.withColumn("sha256", F.sha2("text", 256)), bad.unionByName(big)


def ingest_texts(texts: DataFrame) -> DataFrame:
    """The same normal form and hash for texts already in a table (``source, text``)."""
    return texts.withColumn("text", line_feeds(F.col("text"))).withColumn("sha256", F.sha2("text", 256))


def read_recorded(spark: SparkSession, folder: str, prompt_version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drafts, captions, faults) of recorded answers; any fault means the folder must not be used."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.input_file_name().alias("file_id"), "value")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    kind = F.when(F.col("file_id").endswith(DRAFT_SUFFIX), "draft").when(F.col("file_id").endswith(CAPTION_SUFFIX), "caption")
    marked = files.withColumn("kind", kind)
    stale = marked.filter(F.col("kind").isNotNull() & ~field("prompt_version").eqNullSafe(F.lit(prompt_version)))
    faults = (
        expected_names(files, (DRAFT_SUFFIX, CAPTION_SUFFIX)).select("file_id", F.lit("unexpected_name").alias("reason"))
        .unionByName(stale.select("file_id", F.lit("other_prompt_version").alias("reason")))
    )
    drafts = marked.filter(F.col("kind") == "draft").select(field("brief_sha256").alias("brief_sha256"), field("draft").alias("draft"))
    captions = marked.filter(F.col("kind") == "caption").select(
        field("prompt_sha256").alias("prompt_sha256"), field("platform").alias("platform"), field("piece_id").alias("piece_id"),
        field("caption.caption").alias("caption"), F.from_json(field("caption.hashtags"), "array<string>").alias("hashtags"),
    )
    return drafts, captions, faults
