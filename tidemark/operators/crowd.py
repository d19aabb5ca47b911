"""Labels that name one work although they differ: by which tolerance, found by
equal keys, and labels of a crowd joined with each other.

Each tolerance turns a label into keys so that labels it joins share one; pairs
are met by equal keys and decided by their words, so nothing compares all labels
with each other, and equal labels are one before anything is joined. A tolerance
is loose on the title or on the artist, never on both.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import words_corroborate
from tidemark.functions.titles import BRACKETED
from tidemark.operators.graph import connected_components
from tidemark.runtime import table

#: Words that may lead in to a title, and markers of guests.
LEADS = ["i think", "think", "it is", "its", "this is", "sounds like", "maybe"]
MARKERS = ["feat", "featuring", "ft"]
#: Endings that a stem drops, and letters that sound alike, in order.
ENDINGS = ["ing", "in", "ed", "es", "s"]
SOUNDS = [("ph", "f"), ("ck", "k"), ("qu", "k"), ("x", "ks"), ("c", "k"), ("z", "s"), ("v", "f"), ("y", "i")]
#: Order of precedence.
TOLERANCES = ["", "swapped", "alt_title", "lead_in", "spaced", "joined", "descriptor", "stem", "phonetic", "artist_slip", "initials"]


def _plain_letters() -> tuple[str, str]:
    """Letters of the Latin blocks and what they are without their marks."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x250)]
    bare = [(a, "".join(x for x in d if not unicodedata.combining(x)).lower()) for a, d in pairs]
    some = [(a.lower(), b) for a, b in bare if len(b) == 1 and b.isascii() and len(a.lower()) == 1]
    return "".join(a for a, _ in some), "".join(b for _, b in some)


_MARKED, _BARE = _plain_letters()


def label_words(text: Column) -> Column:
    """Words of a label in lower case: marks dropped from letters, dotted initials
    joined, markers of guests dropped."""
    t = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKED, _BARE), r"\p{M}", "")
    t = F.regexp_replace(t, r"(?<![a-z0-9])([a-z0-9])\.(?=[a-z0-9]\.|[^a-z0-9]|$)", "$1")
    return F.filter(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~w.isin(MARKERS))


def stem(w: Column) -> Column:
    return F.when(F.length(w) > 4, F.regexp_replace(w, f"({'|'.join(ENDINGS)})$", "")).otherwise(w)


def sound(w: Column) -> Column:
    """A word by its sound, roughly: letters that sound alike as one, no vowels but
    the first letter, no doubles."""
    for a, b in SOUNDS:
        w = F.replace(w, F.lit(a), F.lit(b))
    w = F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, F.lit(2), F.length(w)), "[aeiouhw]", ""))
    return F.regexp_replace(w, r"(.)\1+", "$1")


def near(a: Column, b: Column) -> Column:
    """Equal, or of four letters or more and one edit apart."""
    return (a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (F.levenshtein(a, b) <= 1))


def _shortened(w: Column) -> Column:
    """A word and all that it is with a letter less; two words one edit apart
    share one of these."""
    less = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.when(F.length(w) >= 4, F.array_distinct(F.concat(F.array(w), less))).otherwise(F.array(w))


def labels_of(df: DataFrame, id_col: str, artist: str, title: str) -> DataFrame:
    """`(label, a, t, parts, ids)`: distinct labels by their words outside brackets
    and the parts of their titles, numbered by a hash, with the ids of rows that
    bear them; labels without a word in the artist or the title are left out."""
    bare = lambda c: F.regexp_replace(F.col(c), BRACKETED, " ")
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.col(title), r"\s+/\s+|[()\[\]]"), lambda p: F.array_join(label_words(p), " ")), lambda p: p != "")))
    d = df.select(F.col(id_col).alias("id"), label_words(bare(artist)).alias("a"), label_words(bare(title)).alias("t"), F.coalesce(parts, F.array().cast("array<string>")).alias("parts"))
    d = d.where((F.size("a") > 0) & (F.size("t") > 0))
    return d.groupBy(F.xxhash64("a", "t", "parts").alias("label"), "a", "t", "parts").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _keys(labels: DataFrame) -> DataFrame:
    """`(kind, key, role, label)`: the keys of each label; where a kind has roles
    0 and 1, pairs are of one each, where it has only role 2, of any two."""
    a, t = F.array_join("a", " "), F.array_join("t", " ")
    one = F.array_join("t", "")
    rest = [F.when(F.startswith(t, F.lit(lead + " ")), F.substring(t, F.lit(len(lead) + 2), F.length(t))) for lead in LEADS]
    prefixes = F.when(F.size("t") > 2, F.transform(F.sequence(F.lit(2), F.size("t") - 1), lambda n: F.array_join(F.slice("t", F.lit(1), n), " ")))
    each = lambda words, f: F.array_join(F.transform(words, f), " ")
    single = F.size("a") == 1
    first = F.element_at("a", 1)
    kinds = [
        ("swapped", 0, a, F.array(t)),
        ("swapped", 1, t, F.array(a)),
        ("alt_title", 2, a, F.col("parts")),
        ("lead_in", 0, a, F.array(t)),
        ("lead_in", 1, a, F.array_compact(F.array(*rest))),
        ("spaced", 2, a, F.array(one)),
        ("joined", 0, a, F.when(F.size("t") == 1, _shortened(one))),
        ("joined", 1, a, F.when(F.size("t") > 1, _shortened(one))),
        ("descriptor", 0, a, F.when(F.size("t") >= 2, F.array(t))),
        ("descriptor", 1, a, prefixes),
        ("stem", 2, a, F.array(each("t", stem))),
        ("phonetic", 2, a, F.array(each("t", sound))),
        ("artist_slip", 2, F.concat_ws("|", t, F.size("a").cast("string")), _shortened(first)),
        ("initials", 0, t, F.when(single, F.array(first))),
        ("initials", 1, t, F.when(~single, F.array(F.array_join(F.transform("a", lambda w: F.substring(w, 1, 1)), "")))),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(r).alias("role"), side.alias("side"), F.coalesce(keys, F.array().cast("array<string>")).alias("keys")) for k, r, side, keys in kinds))
    d = labels.select("label", F.explode(rows).alias("k")).select("label", "k.kind", "k.role", "k.side", F.explode("k.keys").alias("key"))
    return d.select("kind", F.xxhash64("kind", "side", "key").alias("key"), "role", "label").distinct()


def _holds(kind: str, x: str, y: str) -> Column:
    """Whether a tolerance joins two labels that share one of its keys (x has role 0)."""
    c = lambda side, name: F.col(f"{side}.{name}")
    same_a, same_t = c(x, "a") == c(y, "a"), c(x, "t") == c(y, "t")
    n = lambda s: F.size(c(s, "t"))
    sizes = n(x) == n(y)
    zip_all = lambda p, q, f: F.forall(F.zip_with(p, q, f), lambda v: v)
    each = lambda side, f: F.transform(c(side, "t"), f)
    return {
        "swapped": (c(x, "a") == c(y, "t")) & (c(x, "t") == c(y, "a")),
        "alt_title": same_a & F.arrays_overlap(c(x, "parts"), c(y, "parts")),
        "lead_in": same_a,
        "spaced": same_a & ~sizes & (F.array_join(c(x, "t"), "") == F.array_join(c(y, "t"), "")),
        "joined": same_a & (n(x) == 1) & (n(y) > 1) & near(F.array_join(c(x, "t"), ""), F.array_join(c(y, "t"), "")),
        "descriptor": same_a & (n(x) >= 2) & (n(y) > n(x)) & (F.slice(c(y, "t"), F.lit(1), n(x)) == c(x, "t")),
        "stem": same_a & sizes & (each(x, stem) == each(y, stem)),
        "phonetic": same_a & sizes & zip_all(c(x, "t"), c(y, "t"), lambda p, q: ((F.length(p) > 3) & (F.length(q) > 3)) | (p == q)) & (each(x, sound) == each(y, sound)),
        "artist_slip": same_t & (F.size(c(x, "a")) == F.size(c(y, "a"))) & zip_all(c(x, "a"), c(y, "a"), near),
        "initials": same_t & (F.size(c(x, "a")) == 1) & (F.size(c(y, "a")) > 1) & (c(x, "a")[0] == F.array_join(F.transform(c(y, "a"), lambda w: F.substring(w, 1, 1)), "")),
    }[kind]


def tolerant_pairs(labels: DataFrame) -> DataFrame:
    """`(a, b, tolerance)` for labels of labels_of(), a < b: the first tolerance
    that joins them; labels of the same words are joined by none needed ("")."""
    keys = table(_keys(labels), "keys")
    slim = labels.select("label", "a", "t", "parts")
    x = keys.select("kind", "key", "role", F.col("label").alias("xl"))
    y = keys.select("kind", "key", F.col("role").alias("role_y"), F.col("label").alias("yl"))
    met = x.join(y, ["kind", "key"]).where("(role = 0 and role_y = 1 or role = 2 and xl < yl) and xl <> yl").select("kind", "xl", "yl").distinct()
    side = lambda name, key: slim.select(F.col("label").alias(key), F.struct("a", "t", "parts").alias(name))
    full = met.join(side("x", "xl"), "xl").join(side("y", "yl"), "yl")
    holds = reduce(lambda w, k: w.when(F.col("kind") == k, _holds(k, "x", "y")), TOLERANCES[1:], F.when(F.lit(False), False))
    order = F.array_position(F.array(*map(F.lit, TOLERANCES)), F.col("kind"))
    # labels that differ in nothing but the parts of their titles are the same
    rank = F.when((F.col("x.a") == F.col("y.a")) & (F.col("x.t") == F.col("y.t")), 1).otherwise(order)
    found = full.where(holds).select(F.least("xl", "yl").alias("a"), F.greatest("xl", "yl").alias("b"), rank.alias("n"))
    best = found.groupBy("a", "b").agg(F.min("n").alias("n"))
    return best.select("a", "b", F.element_at(F.array(*map(F.lit, TOLERANCES)), F.col("n").cast("int")).alias("tolerance"))


def corroborating_pairs(labels: DataFrame) -> DataFrame:
    """`(a, b)`, a < b: labels whose words name one work: one holds the other's, or
    they share a word and differ in one each, spelled nearly alike.

    Of such a pair the one of fewer words (or either) has one of its two rarest
    words in the other, so each label looks for its two rarest only; words that
    everybody uses meet nothing but labels that have none rarer."""
    words = F.array_distinct(F.concat("a", "t"))
    each = table(labels.select("label", words.alias("words")), "words")
    at = each.select("label", F.explode("words").alias("w"))
    often = at.groupBy("w").agg(F.count("*").alias("n"))
    ranked = at.join(often, "w").groupBy("label").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "w"))), 1, 2).alias("rare"))
    probe = ranked.select(F.col("label").alias("p"), F.explode("rare.w").alias("w"))
    met = probe.join(at, "w").where("p <> label").select(F.least("p", "label").alias("a"), F.greatest("p", "label").alias("b")).distinct()
    of = lambda key, name: each.select(F.col("label").alias(key), F.col("words").alias(name))
    return met.join(of("a", "_x"), "a").join(of("b", "_y"), "b").where(words_corroborate(F.col("_x"), F.col("_y"))).select("a", "b")


def crowd_links(labels: DataFrame) -> DataFrame:
    """`(a, b, confidence, tolerance)`: which labels of a crowd name one work.

    Labels that corroborate each other, are the same, or the same the other way
    round are joined with confidence 6000. A tolerance joins two of the groups
    that this makes, with 5500, only if all tolerant pairs of either lead to the
    other: what fits two works joins neither, and tolerances never chain."""
    tolerant = table(tolerant_pairs(labels), "tolerant")
    sure = tolerant.where("tolerance in ('', 'swapped')").select("a", "b").unionByName(corroborating_pairs(labels)).distinct()
    sure = table(sure, "sure")
    groups = table(labels.select("label").join(connected_components(sure).withColumnRenamed("node", "label"), "label", "left").select("label", F.coalesce("component", "label").alias("group")), "groups")
    of = lambda side: groups.select(F.col("label").alias(side), F.col("group").alias(f"g{side}"))
    loose = tolerant.where("tolerance not in ('', 'swapped')").join(of("a"), "a").join(of("b"), "b").where("ga <> gb")
    way = lambda g, o: loose.select(F.col(g).alias("g"), F.col(o).alias("o"))
    both = way("ga", "gb").unionByName(way("gb", "ga")).distinct()
    only = both.groupBy("g").agg(F.min("o").alias("o"), F.count("*").alias("n")).where("n = 1").select("g", "o")
    mutual = only.alias("l").join(only.alias("r"), (F.col("l.o") == F.col("r.g")) & (F.col("r.o") == F.col("l.g"))).select(F.col("l.g").alias("ga"), F.col("l.o").alias("gb"))
    kept = loose.join(mutual, ["ga", "gb"])
    link = lambda d, c, t: d.select("a", "b", F.lit(c).alias("confidence"), t.alias("tolerance"))
    return link(sure, 6000, F.lit("")).unionByName(link(kept, 5500, F.col("tolerance")))
