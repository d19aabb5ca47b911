"""A corpus pipeline over `documents`: quality rules, line dedup, SimHash
near-dedup, mixing to target weights, byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, line_dedup, mixing, quality_rules, simhash
from tidemark.llm.q_bpe import vocabulary
from tidemark.runtime import read_table, table


def _carried(docs: DataFrame) -> DataFrame:
    """What operators read, and the rest of each row as a struct, so that no
    column of any name clashes with those that operators make."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    return docs.select("doc_id", "text", "lang", "source", rest.alias("_row"))


def _restored(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `docs` from what `_carried` made of them."""
    of = lambda c: F.col("text") if c == "text" else changed.get(c, F.col(f"_row.`{c}`"))
    return rows.select(*(of(c).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the outlier rule reject.

    A null or empty text fails the base rules; null languages and sources are
    groups of their own; repeated rows are judged each; an empty table gives none."""
    vec = table(quality_rules.vectors(quality_rules.base_stats(_carried(docs))), "statistics")
    return _restored(quality_rules.judge(vec, quality_rules.estimates(vec)).where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; none is lost.

    Null texts stay null (of no characters); rows equal in id and text count as
    one document and lose the same lines; an empty table gives none."""
    out = line_dedup.drop_recurring_lines(_carried(docs).drop("lang", "source"))
    return _restored(out, docs, n_chars=F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of smallest id (no id last),
    then of smallest hash of its columns.

    Unlike texts that share an id stay. Equal rows are one; null and empty texts
    are near-duplicates of one another; an empty table gives none."""
    whole = F.xxhash64(*(F.col("text" if c == "text" else f"_row.`{c}`") for c in docs.columns))
    keyed = _carried(docs).withColumn("_key", whole)
    fps = table(simhash.fingerprints(keyed, "_key").distinct(), "fingerprints")
    ids = keyed.select(F.col("_key").alias("id"), "doc_id").distinct()
    groups = ids.join(fps, "id").join(simhash.components(fps), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("id").alias("id"))
    first = groups.groupBy("component").agg(F.min(order)["id"].alias("_key")).select("_key")
    return _restored(keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words are taken once; a null source is one of its own; repeated
    rows are taken each; an empty table gives none."""
    out = mixing.mix(_carried(docs).drop("lang")).where("copies > 0")
    return _restored(out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text.

    A null text counts as empty; repeated rows are encoded each; other columns
    than doc_id, lang and source aren't returned."""
    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids_le", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("encoding", encode),
]

#: Robust estimates, fingerprints, Newton steps and merges aren't SQL. The tests
#: hold line dedup, near dedup and encoding against brute-force versions, quality
#: rules to the labels and mixing to its targets; the operators behind these two
#: have numerical versions in tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written before the next one reads them."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
