"""Query over the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.common import n_words, text_of
from tidemark.runtime import read_table, table


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    d = read_table(spark, sf_dir, "documents")
    t = text_of(d)
    slim = table(d.select("doc_id", "source", n_words(t).alias("size"), F.xxhash64("doc_id", t).alias("h")), "sizes")
    p = mixing.plan(slim).withColumnsRenamed({"source": "_s", "size": "_z"})
    out = slim.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    copies = F.col("base") + mixing.extra(F.col("h"), F.col("part"), F.col("last"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


QUERIES = {"op7_mixing": op7_mixing}
ORACLE_SQL: dict[str, str] = {}
