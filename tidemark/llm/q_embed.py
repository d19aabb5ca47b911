"""Query over the embedding operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup
from tidemark.runtime import read_table


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector."""
    out = embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


QUERIES = {"op2_embedding": op2_embedding}
ORACLE_SQL: dict[str, str] = {}
