"""Token records and packed sequences of whole documents; SQL has no tokenizer, so tests compare with plain loops."""

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import packing, records


def op9_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, as read back from the record files."""
    return records.token_records(spark.read.parquet(f"{folder}/documents.parquet"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """One row per piece."""
    return packing.pack(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op9_token_records": op9_token_records, "op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
