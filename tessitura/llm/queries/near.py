"""Near-duplicate documents; tests compare with all pairs of a small fixture."""

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import near


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document with its component."""
    return near.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLES: dict[str, str] = {}
