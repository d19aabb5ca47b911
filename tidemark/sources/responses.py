"""Saved answers of recognisers and comment services as rows.

Answers arrive as JSON or CSV text, one a row; what is parsed is their shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How long an answer counts, in days, by its state; others are never kept.
TTL_DAYS = {"match": 180, "no_match": 30}

SHAZAM = "struct<matches:array<struct<id:string,offset:decimal(20,9),timeskew:decimal(20,12),frequencyskew:decimal(20,12)>>,track:struct<key:string,title:string,subtitle:string>>"
AUDD = "struct<status:string,result:array<struct<offset:string,songs:array<struct<artist:string,title:string,album:string,score:bigint,isrc:string>>>>>"
ACR = "struct<data:array<struct<id:string,name:string,duration:bigint,state:int,results:struct<music:array<struct<offset:bigint,played_duration:bigint,result:struct<title:string,artists:array<struct<name:string>>,score:bigint,acrid:string>>>>>>>"
COMMENTS = "struct<collection:array<struct<id:bigint,body:string,timestamp:bigint,user:struct<permalink:string,followers_count:bigint,verified:boolean>>>,next_href:string>"
VIDEO_COMMENTS = "struct<comments:array<struct<id:string,text:string,author:string,author_is_uploader:boolean,author_is_verified:boolean,is_pinned:boolean,like_count:bigint,parent:string>>>"
SECTIONS = "struct<data:struct<cloudcastLookup:struct<name:string,sections:array<struct<artistName:string,songName:string,startSeconds:bigint>>>>>"


def cache_valid(state: Column, age_s: Column) -> Column:
    """Whether a stored answer still counts: by its state's time to live; errors never."""
    c = F.lit(False)
    for name, days in TTL_DAYS.items():
        c = F.when(state == name, age_s <= days * 86_400).otherwise(c)
    return F.coalesce(c, F.lit(False))


def work_left(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries without a valid answer: `cache` is `(cache_key, state, age_s)`."""
    good = cache.where(cache_valid(F.col("state"), F.col("age_s"))).select("cache_key").distinct()
    return queries.join(good, "cache_key", "left_anti")


def shared_queries(windows: DataFrame, key: str, order: str) -> DataFrame:
    """Windows with `asked`: the first window of their content key, which alone is
    sent; its answer is every window's of that key. A key of very many windows is
    met as one minimum."""
    first = windows.groupBy(key).agg(F.min(order).alias("asked"))
    return windows.join(first, key)


def shazam(df: DataFrame, body: str) -> DataFrame:
    """`(…, status, key, title, artist, offsets_ms, skews_e6)`: offsets half up;
    an answer that isn't JSON is an error."""
    d = df.withColumn("_r", F.from_json(body, SHAZAM))
    status = F.when(F.col("_r").isNull() | F.col("_r.matches").isNull(), "error").when(F.size("_r.matches") > 0, "match").otherwise("no_match")
    ms = F.transform("_r.matches", lambda m: F.round(m["offset"] * 1000, 0).cast("long"))
    skew = F.transform("_r.matches", lambda m: F.round(m["timeskew"] * 1_000_000, 0).cast("long"))
    return d.select(*df.columns, status.alias("status"), F.col("_r.track.key").alias("key"), F.col("_r.track.title").alias("title"), F.col("_r.track.subtitle").alias("artist"), F.array_compact(ms).alias("offsets_ms"), F.array_compact(skew).alias("skews_e6")).drop(body)


def audd(df: DataFrame, body: str) -> DataFrame:
    """A row for each song of each part, its offset "mm:ss" in milliseconds."""
    kept = [c for c in df.columns if c != body]
    d = df.select(*kept, F.explode(F.from_json(body, AUDD)["result"]).alias("p")).select(*kept, F.col("p.offset").alias("offset"), F.explode("p.songs").alias("s"))
    part = F.split("offset", ":")
    ms = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a * 60 + F.try_to_number(x, F.lit("99999")).cast("long")) * 1000
    return d.select(*kept, ms.alias("offset_ms"), "s.artist", "s.title", "s.album", "s.score", "s.isrc")


def acrcloud(df: DataFrame, body: str) -> DataFrame:
    """A row for each piece of music of each finished file (state 1)."""
    kept = [c for c in df.columns if c != body]
    d = df.select(*kept, F.explode(F.from_json(body, ACR)["data"]).alias("f")).where("f.state = 1")
    d = d.select(*kept, F.col("f.id").alias("file"), F.explode("f.results.music").alias("m"))
    artist = F.array_join(F.transform("m.result.artists", lambda a: a["name"]), ", ")
    return d.select(*kept, "file", (F.col("m.offset") * 1000).alias("offset_ms"), artist.alias("artist"), F.col("m.result.title").alias("title"), F.col("m.result.score").alias("score"), F.col("m.result.acrid").alias("acrid"))


def panako(df: DataFrame, line: str) -> DataFrame:
    """Matches of a result file's lines of 13 fields parted by semicolons: times
    in milliseconds, factors in ten-thousandths; headings and lines without a
    match id are left out."""
    p = F.split(line, ";")
    get = lambda i: F.trim(F.get(p, F.lit(i)))
    num = lambda i, by: F.round(F.expr(f"try_cast(trim(get(split({line}, ';'), {i})) AS decimal(20,6))") * by, 0).cast("long")
    d = df.where((F.size(p) == 13) & get(0).rlike(r"^\d+$") & ~get(6).isin("", "null", "-1"))
    kept = [c for c in df.columns if c != line]
    return d.select(*kept, get(2).alias("query"), num(3, 1000).alias("query_s"), num(4, 1000).alias("query_e"), get(6).alias("match"), num(7, 1000).alias("match_s"), num(8, 1000).alias("match_e"), num(9, 1).alias("score"), num(10, 100).alias("time_e4"), num(11, 100).alias("frequency_e4"))


def soundcloud_comments(df: DataFrame, body: str) -> DataFrame:
    """A row for each comment of each saved page, once for an id."""
    kept = [c for c in df.columns if c != body]
    d = df.select(*kept, F.explode(F.from_json(body, COMMENTS)["collection"]).alias("c"))
    return d.select(*kept, "c.id", F.col("c.body").alias("text"), F.col("c.timestamp").alias("at_ms"), F.col("c.user.permalink").alias("author"), F.col("c.user.verified").alias("verified")).dropDuplicates([*kept, "id"])


def video_comments(df: DataFrame, body: str) -> DataFrame:
    kept = [c for c in df.columns if c != body]
    d = df.select(*kept, F.explode(F.from_json(body, VIDEO_COMMENTS)["comments"]).alias("c"))
    return d.select(*kept, "c.id", "c.text", "c.author", F.coalesce("c.author_is_uploader", F.lit(False)).alias("uploader"), F.coalesce("c.is_pinned", F.lit(False)).alias("pinned"), F.when(F.col("c.parent") != "root", F.col("c.parent")).alias("parent"))


def sections(df: DataFrame, body: str) -> DataFrame:
    """A row for each section with a start, as a tracklist's line, from 0."""
    kept = [c for c in df.columns if c != body]
    d = df.select(*kept, F.posexplode(F.from_json(body, SECTIONS)["data"]["cloudcastLookup"]["sections"]).alias("number", "s"))
    return d.where("s.startSeconds is not null").select(*kept, "number", F.col("s.artistName").alias("artist"), F.col("s.songName").alias("title"), (F.col("s.startSeconds") * 1000).alias("at_ms"))


def wikitext_tracklist(df: DataFrame, text: str) -> DataFrame:
    """The numbered lines under a page's heading Tracklist, up to the next
    heading, without emphasis and comments, from 0."""
    kept = [c for c in df.columns if c != text]
    body = F.regexp_extract(F.regexp_replace(text, "\r\n?", "\n"), r"(?is)(?:^|\n)\s*={2,}\s*Tracklist\s*={2,}\s*\n(.*?)(?=\n\s*={2,}[^\n]*={2,}\s*(?:\n|$)|$)", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("#"))
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^#+", ""), "<!--.*?-->", ""), "'{2,}", "")))
    return df.select(*kept, F.posexplode(F.filter(clean, lambda x: x != "")).alias("number", "line"))


def manual_tracklist(spark, path: str) -> DataFrame:
    """Non-blank lines of tracklist files with their file and number."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("number", "line"))
    return t.where(F.trim("line") != "")


def pointer_page(html: Column) -> Column:
    """(title, text_chars, links) of a page: its title, the length of its text
    without scripts, styles and tags, and its number of links."""
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " "), r"<[^>]*>", " ")
    text = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.struct(title.alias("title"), F.length(text).cast("long").alias("text_chars"), F.regexp_count(html, F.lit(r"(?i)<a\s")).cast("long").alias("links"))


def media_index(spark, path: str) -> DataFrame:
    """Files under a folder with size and time, by path; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", "length", "modificationTime")


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """`(rule, violations)`: how many rows break each rule of a contract; a rule
    that is null for a row is broken."""
    n = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    names = ", ".join(f"'{k}', `{k}`" for k in rules)
    return n.selectExpr(f"stack({len(rules)}, {names}) AS (rule, violations)")
