"""Query over the suffix operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import suffix_dedup
from tidemark.runtime import read_table


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every document, and a digest of what stays."""
    out = suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
