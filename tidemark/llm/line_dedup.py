"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its number of tokens and its leading tokens, those
with digits being variable fields. In a leaf, a token that few lines have at its
position is a variable field, and so is one beside which the rest of the line
stands with enough other tokens, or with a field, in its place; lines that agree
on all that is left are lines of one template. A template with few enough
variable fields that recurs in enough documents is dropped. Only DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, once, text_of
from tidemark.runtime import table

#: Leading tokens on a path, or a third of the tokens where that is fewer.
LEADING = 2
#: Documents that a template must be in to be dropped, lines of a leaf that a
#: constant token must be in, and tokens in one place that make it a field.
MIN_DOCS = 5
#: Times that templates are made more general; the second one takes in what the
#: first one left beside a template with more fields.
ROUNDS = 2
#: Most of a line's tokens, in tenths, that may be variable fields: of those
#: without digits, and in all.
WORDS_VARY, ALL_VARY = 3, 5
#: What stands for a field: of a token without and with digits.
_ANY, _DIGITS = "<*>", "<#>"


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), _DIGITS).otherwise(t))


def _leading(n: Column) -> Column:
    """Tokens of a line on its path."""
    return F.least(F.lit(LEADING), F.floor(n / 3)).cast("int")


def _lines(d: DataFrame, id_col: str, text: str) -> DataFrame:
    """`(_dk, _id, pos, line, n, leaf)` for every line with a token."""
    lines = d.select("_dk", F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = once(lines, "_tok", F.filter(F.split("line", SPACE + "+"), lambda w: w != "")).where(F.size("_tok") > 0)
    n = F.size("_tok")
    return lines.select("_dk", "_id", "pos", "line", n.alias("n"), F.xxhash64(n, _masked(F.slice("_tok", F.lit(1), _leading(n)))).alias("leaf"))


def _fits(n: Column, template: Column) -> Column:
    """Whether few enough of a line's tokens are fields."""
    count = lambda *kinds: F.size(F.filter(template, lambda t: t.isin(*kinds)))
    return (10 * count(_ANY) <= WORDS_VARY * n) & (10 * count(_ANY, _DIGITS) <= ALL_VARY * n)


def _constants(some: DataFrame, least: int) -> DataFrame:
    """`some` with `template`: its tokens, fields where fewer than `least` lines
    of the leaf have the token; of lines that fit."""
    at = some.select("no", "leaf", F.posexplode("tok").alias("at", "t")).where(F.col("t") != _DIGITS).select("no", "at", F.xxhash64("leaf", "at", "t").alias("h"))
    constant = at.groupBy("h").count().where(F.col("count") >= least).select("h")
    known = at.join(constant, "h", "left_semi").groupBy("no").agg(F.collect_set("at").alias("_at"))
    template = F.transform("tok", lambda t, i: F.when((t == _DIGITS) | F.array_contains("_at", i), t).otherwise(_ANY))
    return once(some.join(known, "no"), "template", template).where(_fits(F.col("n"), F.col("template")))


def _generalised(patterns: DataFrame, least: int) -> DataFrame:
    """Templates `(first, n, leaf, template)` with more fields.

    A place is a field if the rest of the template stands with `least` tokens
    there, or with a field; templates that would have too many fields stay."""
    masked = F.transform("template", lambda t, i: F.when(i == F.col("at"), _ANY).otherwise(t))
    keyed = patterns.withColumn("key", F.xxhash64("leaf", "template"))
    kinds = keyed.dropDuplicates(["key"]).select("key", "leaf", "template", F.posexplode("template").alias("at", "t"))
    each = table(kinds.select("key", "at", "t", F.xxhash64("leaf", "at", masked).alias("h")), "places")
    groups = each.groupBy("h").agg(F.count("*").alias("kinds"), F.max(F.col("t") == _ANY).alias("open"))
    fields = groups.where((F.col("kinds") >= least) | F.col("open") & (F.col("kinds") > 1)).select("h")
    more = each.where(F.col("t") != _ANY).join(fields, "h", "left_semi").groupBy("key").agg(F.collect_set("at").alias("_more"))
    wider = F.transform("template", lambda t, i: F.when(F.array_contains("_more", i), _ANY).otherwise(t))
    found = once(keyed.join(more, "key", "left"), "_wider", F.when(F.col("_more").isNotNull(), wider))
    fit = F.coalesce(_fits(F.col("n"), F.col("_wider")), F.lit(False))
    return found.select("first", "n", "leaf", F.when(fit, F.col("_wider")).otherwise(F.col("template")).alias("template"))


def _templates(lines: DataFrame, least: int) -> DataFrame:
    """`(_dk, _id, pos, key)` for the lines whose leaf has at least `least`
    lines, with a key for each template."""
    full = lines.groupBy("leaf").count().where(F.col("count") >= least).select("leaf")
    tok = _masked(F.filter(F.split("line", SPACE + "+"), lambda w: w != ""))
    some = table(lines.join(full, "leaf").select("_dk", "_id", "pos", "n", "leaf", tok.alias("tok"), F.monotonically_increasing_id().alias("no")), "candidates")
    found = table(_constants(some, least).select("_dk", "_id", "pos", "n", "leaf", "template", F.xxhash64("leaf", "template").alias("first")), "templates")
    patterns = found.select("first", "n", "leaf", "template").dropDuplicates(["first"])
    for _ in range(ROUNDS):
        patterns = table(_generalised(patterns, least), "patterns")
    return found.select("_dk", "_id", "pos", "first").join(patterns.select("first", F.xxhash64("leaf", "template").alias("key")), "first").drop("first")


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, keep_first: bool = True) -> DataFrame:
    """`df` with recurring lines taken out of `text`, and `n_lines`, `n_dropped`.

    A line is a template's if its leaf and its constant tokens are. With
    `keep_first` the document of smallest id (then smallest hash; no id last)
    keeps a template's lines, so that what many copies share stays once; without,
    they go from all. A document is a row's id and text: rows that are equal in
    both count as one. Null texts stay null with no lines; an empty text is one
    empty line; lines without a token, and those of digits only, stay; a text
    that loses all its lines becomes empty; no row is lost. Columns of the new
    names are replaced, others may have any name.

    Leaves, tokens of a leaf, places of a template and templates are counted
    with partial aggregation and joined back by joins that adaptive execution
    can split, so a template in a third of all rows loads no single task. Tokens
    are only spread out for lines whose leaf is full enough, and templates are
    made more general as distinct ones.
    """
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    d = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in names if c != text)).alias("row"))
    d = d.withColumn("_dk", F.xxhash64("id", text_of(d)))
    keyed = table(_templates(table(_lines(d, "id", "text"), "lines"), min_docs), "templates")
    docs = keyed.groupBy("key", "_dk").agg(F.min("_id").alias("_id"))
    common = docs.groupBy("key").agg(F.count("*").alias("docs"), F.min(F.struct("_id", "_dk"))["_dk"].alias("first")).where(F.col("docs") >= min_docs)
    goes = keyed.join(common, "key")
    if keep_first:
        goes = goes.where("_dk <> first")
    flagged = goes.groupBy("_dk").agg(F.collect_set("pos").alias("_drop"))
    out = d.join(flagged, "_dk", "left").withColumn("_all", F.split("text", "\n"))
    n, gone = F.coalesce(F.size("_all"), F.lit(0)), F.coalesce(F.size("_drop"), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), "_drop"), lambda i: F.get("_all", i))
    new = {text: F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))}
    lines = F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")
    dropped = F.when(F.col("_drop").isNull(), 0).otherwise(gone).cast("long")
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names), lines.alias("n_lines"), dropped.alias("n_dropped"))
