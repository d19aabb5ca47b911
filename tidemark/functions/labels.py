"""Labels: folding, placeholders, near spellings, word sets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Words of which a label that names nothing consists (fixed values).
PLACEHOLDERS = ["id", "ids", "tbc", "tba", "unknown", "unreleased", "ur", "forthcoming", "dubplate"]
#: Limits of a label that a comment may give (fixed values).
MOST_WORDS, MOST_CHARS = 12, 120


@pandas_udf(StringType())
def display_fold(s: pd.Series) -> pd.Series:
    """Compatibility form, case folded, trimmed, inner white space as one space.
    Python because the engine has no Unicode normalisation; null stays null."""
    return s.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip())


@pandas_udf(StringType())
def score_fold(s: pd.Series) -> pd.Series:
    """Decomposed, marks dropped, lower case, runs of other than word characters as a space."""

    def one(t):
        if t is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return re.sub(r"[^\w]+", " ", t.casefold()).strip()

    return s.map(one)


def ascii_fold(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


#: What a bracket says that is only a note (fixed values).
NOTES = [r"unreleased\*?", "ur", r"forthcoming[^()\[\]]*", "dubplate", "free", r"free\s+dl", r"free\s+download"]
NOTE_BRACKET = rf"[(\[]\s*({'|'.join(NOTES)})\s*[)\]]"


def is_placeholder(c: Column) -> Column:
    """Whether a field names nothing: null, empty, or no other words than
    placeholders. Brackets that hold a mere note don't count, others do."""
    rest = F.regexp_replace(F.lower(c), NOTE_BRACKET, " ")
    words = F.regexp_extract_all(rest, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.coalesce(F.size(F.array_except(words, F.array(*map(F.lit, PLACEHOLDERS)))) == 0, F.lit(True))


def near_spelling(a: Column, b: Column) -> Column:
    """Unlike words that are one word spelled two ways: both of four letters or
    more and one edit apart, or one is the other (of two or more letters, no
    digits) with a letter more at its end."""
    edit = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.levenshtein(a, b) <= 1)
    letters = a.rlike(r"^\p{L}+$") & b.rlike(r"^\p{L}+$")
    longer = lambda x, y: (F.length(x) >= 2) & (F.length(y) == F.length(x) + 1) & y.startswith(x)
    return (a != b) & (edit | (letters & (longer(a, b) | longer(b, a))))


def words_corroborate(a: Column, b: Column) -> Column:
    """Whether two word sets (arrays of distinct words) name one work: one holds
    the other, or they share a word and differ in one word each, spelled nearly
    alike; sets of fewer than two words never do."""
    only_a, only_b = F.array_except(a, b), F.array_except(b, a)
    one = (F.size(only_a) == 1) & (F.size(only_b) == 1) & F.arrays_overlap(a, b)
    near = near_spelling(F.get(only_a, F.lit(0)), F.get(only_b, F.lit(0)))
    return (F.least(F.size(a), F.size(b)) >= 2) & ((F.size(only_a) == 0) | (F.size(only_b) == 0) | (one & F.coalesce(near, F.lit(False))))


def plausible_label(artist: Column, title: Column) -> Column:
    """Whether both parts are filled, neither ends in a colon, and the two
    together are short and hold no question mark, line break, link or handle."""
    both = F.concat(artist, F.lit(" "), title)
    filled = (F.trim(artist) != "") & (F.trim(title) != "") & ~F.trim(artist).endswith(":") & ~F.trim(title).endswith(":")
    clean = ~both.rlike(r"(?i)[?\n]|https?://|www\.|(^|[^\p{L}\p{N}_])@[\p{L}\p{N}_]")
    brief = (F.length(both) <= MOST_CHARS) & (F.regexp_count(both, F.lit(r"[\p{L}\p{N}_]+")) <= MOST_WORDS)
    return F.coalesce(filled & clean & brief, F.lit(False))


def jaccard_e4(a: Column, b: Column) -> Column:
    """Shared share of two word arrays in ten-thousandths."""
    from tidemark.functions.exact import ratio_e4

    return ratio_e4(F.size(F.array_intersect(a, b)).cast("long"), F.size(F.array_union(a, b)).cast("long"))
