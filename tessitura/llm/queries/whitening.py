"""Whitened embeddings; tests compare with a dense decomposition."""

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import whitening


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """One row per vector and component."""
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
