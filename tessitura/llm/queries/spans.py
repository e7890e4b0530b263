"""Secrets and personal data in whole documents; tests compare with plain loops."""

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import pii, secrets


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document."""
    return pii.personal_data(spark.read.parquet(f"{folder}/documents.parquet"))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document."""
    return secrets.secrets(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op6_personal_data": op6_personal_data, "op8_secrets": op8_secrets}
ORACLES: dict[str, str] = {}
