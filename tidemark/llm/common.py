"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order, as an array."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD + "+")).cast("long")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once: a filter on it isn't pushed
    below it, where the optimiser would write its definition into every use."""
    return df.select("*", F.explode(F.array(value)).alias(name))
