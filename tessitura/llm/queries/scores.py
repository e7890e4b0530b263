"""Learned scores of whole documents; tests measure held-out accuracy."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import quality, toxicity
from tessitura.llm.labelled import remainder

LEAST = 0.3


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def _digest(scored: DataFrame, modulus: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted")
    )


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document."""
    docs, labels = _tables(spark, folder)
    return _digest(quality.score(docs, quality.fit(docs, labels)), 5, 0)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document."""
    docs, labels = _tables(spark, folder)
    return _digest(toxicity.score(docs, toxicity.fit(docs, labels)), 4, 2)


QUERIES = {"op1_quality": op1_quality, "op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
