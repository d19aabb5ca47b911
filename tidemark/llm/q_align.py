"""Query over the alignment of two tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import token_alignment
from tidemark.llm.q_bpe import vocabulary
from tidemark.runtime import read_table, table


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and their counts of every document."""
    d = read_table(spark, sf_dir, "documents")
    found = token_alignment.align(d, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    slim = found.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times")
    kept = table(slim, "aligned")
    out = token_alignment.score_links(kept, table(token_alignment.pair_counts(kept), "pairs"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op13_alignment": op13_alignment}
ORACLE_SQL: dict[str, str] = {}
