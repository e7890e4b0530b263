"""Periodic runs of whole documents, a tenth of which get a repeating tail; tests compare with all periods tried."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import periodic


def with_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where the id's checksum is a multiple of ten, words from a place on repeat a stretch."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    placed = chosen.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    left = F.size("w") - F.col("a").cast("int")
    stretch = F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(stretch, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document."""
    found = periodic.periodic_runs(with_tails(spark.read.parquet(f"{folder}/documents.parquet")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.q").alias("period"),
        F.expr("(-1000 * best.l) div best.q").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
