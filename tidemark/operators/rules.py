"""Row rules: badges, run status, retention, hidden reasons, redaction, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def badge(work: Column, version: Column) -> Column:
    """A row's tier: that of its work, but no better than likely while the
    version isn't verified too."""
    return F.when((work == "verified") & (version != "verified"), "likely").otherwise(work)


def tier_score(tier: Column) -> Column:
    """The score of a tier (fixed values); null for one that has none."""
    return F.when(tier == "likely", 8000).when(tier == "possible", 6000).when(tier == "unclear", 2500)


def achieved(resolved: Column, planned: Column, percent: int) -> Column:
    """Whether at least `percent` of what was planned is resolved."""
    return resolved * 100 >= F.lit(percent) * planned


def run_status(provider_failed: Column, reserved_out: Column, primary_ok: Column, secondary_ok: Column) -> Column:
    """The first that holds: partial for its reason, degraded, complete."""
    return (
        F.when(provider_failed, "partial (provider)")
        .when(reserved_out, "partial (reservation)")
        .when(~primary_ok, "partial (primary)")
        .when(~secondary_ok, "degraded")
        .otherwise("complete")
    )


def retention(df: DataFrame, keys: list[str], due: str) -> DataFrame:
    """Latest due date of each group; null (never) if any of its rows has none."""
    return df.groupBy(*keys).agg(F.when(~F.bool_or(F.col(due).isNull()), F.max(due)).alias("due"), F.count("*").alias("runs"))


def parent_share(df: DataFrame, keys: list[str], parent: str, child_weight: str) -> DataFrame:
    """The parent whose children weigh most in each group, ties to the smallest."""
    s = df.groupBy(*keys, parent).agg(F.sum(child_weight).alias("_w"))
    b = s.groupBy(*keys).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col(parent).alias("p"))).alias("b"), F.sum("_w").alias("total"))
    return b.select(*keys, F.col("b.p").alias(parent), (-F.col("b.w")).alias("weight"), "total")


def separate_playing(spans: DataFrame, separators: DataFrame, keys: list[str], work: str, id_col: str, start: str, end: str) -> DataFrame:
    """Spans that are playings of their own: a separator (a span of another
    work) lies wholly between each and every earlier and later span of its work;
    overlapping spans of one work are one playing.

    Whether one lies between a span and the nearest earlier end of its work
    decides for all earlier ones, so a span looks both ways once: at the latest
    start of a separator that ends before it, and the other way round. Those
    of its own work don't count, so they are looked up work by work (a recording
    names few) and the best of the others' is taken."""
    w = Window.partitionBy(*keys, work).orderBy(start, end, id_col)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    mine = spans.select(*keys, work, id_col, start, end, F.max(end).over(before).alias("_prior"), F.min(start).over(after).alias("_next"))
    sep = separators.select(*keys, F.col(work).alias("_w"), F.col(start).alias("_s"), F.col(end).alias("_e"))

    def found(order: str, value: str, latest: bool) -> DataFrame:
        """The best value of each work up to each of its boundaries."""
        pick, o = (F.max, F.col("_o")) if latest else (F.min, F.col("_o").desc())
        run = Window.partitionBy(*keys, "_w").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
        each = sep.groupBy(*keys, "_w", F.col(order).alias("_o")).agg(pick(value).alias("_v"))
        return each.withColumn("_v", pick("_v").over(run))

    from tidemark.operators.intervals import asof

    works = sep.select(*keys, "_w").distinct()
    pairs = mine.join(works, keys).where(F.col(work) != F.col("_w"))
    p = asof(pairs, found("_e", "_s", True), [*keys, "_w"], start, "_o", "_v", out="_b")
    p = asof(p, found("_s", "_e", False), [*keys, "_w"], end, "_o", "_v", forward=True, out="_a")
    own = [*keys, work, id_col, start, end, "_prior", "_next"]
    g = p.groupBy(*own).agg(F.max("_b").alias("_b"), F.min("_a").alias("_a"))
    left = F.col("_prior").isNull() | ((F.col("_prior") <= F.col(start)) & (F.col("_b") >= F.col("_prior")))
    right = F.col("_next").isNull() | ((F.col("_next") >= F.col(end)) & (F.col("_a") <= F.col("_next")))
    lone = mine.where("_prior is null and _next is null").select(*keys, work, id_col)
    return g.where(F.coalesce(left & right, F.lit(False))).select(*keys, work, id_col).unionByName(lone).distinct()


def region_key(*parts: Column) -> Column:
    """A stable key of a request: the first 16 digits of a SHA-256 of its parts."""
    return F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 16)


#: Names of fields whose values are secret, names of secret
#: parameters in the query of an address, and endings of such names.
SECRETS = ["client_id", "oauth_token", "api_key", "api_token", "access_key", "access_secret", "client_secret", "authorization", "cookie", "access_token", "password", "secret", "token"]
QUERY_SECRETS = [
    *"access_token api_key apikey auth authorization client_id client_secret cookie credential key oauth_token policy sig signature token".split(),
    *"x_amz_credential x_amz_security_token x_amz_signature x_goog_credential x_goog_signature password secret".split(),
]
QUERY_ENDINGS = ["_access_token", "_api_key", "_credential", "_secret", "_signature"]
HIDDEN = "[REDACTED]"
#: Stands for HIDDEN (a code point that is no character) until all is read.
_MARK = "\ufdd0"

ADDRESS = r"(?i)https?://[^\s<>\"']+"
_PARTS = r"(?i)^(https?://)([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_NAMES = "|".join(SECRETS)
QUOTED = rf"(?i)([\"']?\b(?:{_NAMES})[\"']?\s*[:=]\s*)(?:\"[^\"\n]*\"|'[^'\n]*')"
PLAIN = rf"(?i)\b({_NAMES})(\s*[:=]\s*)(?:Bearer\s+)?[^\s,;}}\"'{_MARK}]+"


def secret_name(key: Column) -> Column:
    """Whether a parameter's name, decoded, in lower case and with anything but
    letters and digits as one underscore, tells of a secret."""
    plain = F.lower(F.coalesce(F.try_url_decode(key), key))
    name = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_|_$", "")
    found = name.isin(QUERY_SECRETS)
    for e in QUERY_ENDINGS:
        found = found | F.endswith(name, F.lit(e))
    return found


def _query(url: Column) -> Column:
    """The parameters of an address's query."""
    return F.split(F.substring(F.regexp_extract(url, _PARTS, 4), F.lit(2), F.length(url)), "&")


def _name(parameter: Column) -> Column:
    return F.get(F.split(parameter, "=", 2), F.lit(0))


def has_credentials(url: Column) -> Column:
    """Whether an address holds a user or a secret parameter."""
    user = F.contains(F.regexp_extract(url, _PARTS, 2), F.lit("@"))
    return user | F.exists(_query(url), lambda p: F.contains(p, F.lit("=")) & secret_name(_name(p)))


def _address_hidden(url: Column) -> Column:
    """An address without its user and with marks for the values of secret
    parameters, each looked at by itself, however many there are."""
    part = lambda k: F.regexp_extract(url, _PARTS, k)
    one = lambda p: F.when(F.contains(p, F.lit("=")) & secret_name(_name(p)), F.concat(_name(p), F.lit("=" + _MARK))).otherwise(p)
    query = F.when(part(4) == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.transform(_query(url), one), "&")))
    return F.when(part(2) == "", url).otherwise(F.concat(part(1), F.regexp_replace(part(2), "^.*@", ""), part(3), query, part(5)))


def redact(text: Column) -> Column:
    """A text without credentials in addresses and without the values of secret
    parameters and assignments; null stays null."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), _address_hidden)
    pieces = F.zip_with(F.split(text, ADDRESS, -1), urls, lambda gap, u: F.concat(gap, F.coalesce(u, F.lit(""))))
    marked = F.regexp_replace(F.array_join(pieces, ""), QUOTED, '$1"' + _MARK + '"')
    return F.replace(F.regexp_replace(marked, PLAIN, "$1$2" + _MARK), F.lit(_MARK), F.lit(HIDDEN))


def redact_map(fields: Column) -> Column:
    """A map of strings with the values of secret names hidden and the others redacted."""
    hidden = lambda k: F.lower(k).isin(SECRETS)
    return F.transform_values(fields, lambda k, v: F.when(hidden(k), HIDDEN).otherwise(redact(v)))


def host(url: Column) -> Column:
    """The host of an address in lower case, without `www.` and port."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")
