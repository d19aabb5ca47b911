"""What is shown: paid rows added to free ones, covered time, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import whole

TIERS = ["unclear", "possible", "likely", "verified"]


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier) - 1


def additive_merge(free: DataFrame, paid: DataFrame) -> DataFrame:
    """Free rows, plus what paid rows add or confirm; `(media, id, origin, why)`.

    A paid row that overlaps (touching counts) no free row of its work is added.
    One that does takes the place of all of them if it preserves each: a listed
    one stays listed under the same label, its tier doesn't fall, and its hints
    remain; else it is dropped. Rows are `(media, id, work, label, s, e, tier,
    listed, hints)`, hints an array."""
    f = free.select("media", "work", *(F.col(c).alias(f"f_{c}") for c in ("id", "label", "s", "e", "tier", "listed", "hints")))
    j = paid.join(f, ["media", "work"]).where((F.col("s") <= F.col("f_e")) & (F.col("f_s") <= F.col("e")))
    shown = ~F.col("f_listed") | (F.col("listed") & F.col("label").eqNullSafe(F.col("f_label")))
    keeps = shown & (tier_rank(F.col("tier")) >= tier_rank(F.col("f_tier"))) & (F.size(F.array_except("f_hints", "hints")) == 0)
    met = j.groupBy("media", "id").agg(F.min(keeps).alias("_ok"), F.collect_set("f_id").alias("_same"))
    d = paid.join(met, ["media", "id"], "left")
    why = F.when(F.col("_ok").isNull(), "added").when(F.col("_ok"), "confirmed")
    kept = d.select("media", "id", F.lit("paid").alias("origin"), why.alias("why"), "_same").where("why is not null")
    gone = kept.where("why = 'confirmed'").select("media", F.explode("_same").alias("id")).distinct()
    return free.select("media", "id", F.lit("free").alias("origin"), F.lit("kept").alias("why")).join(gone, ["media", "id"], "left_anti").unionByName(kept.drop("_same"))


def cue_index(ms: Column) -> Column:
    """MM:SS:FF at 75 frames a second, to the nearest frame (halves to even);
    minutes may have more digits."""
    frames = F.bround(ms * F.lit(75).cast("decimal(12,0)") / 1000, 0).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    m = whole(frames, F.lit(4500))
    minutes = F.when(m < 100, two(m)).otherwise(m.cast("string"))
    return F.concat(minutes, F.lit(":"), two(whole(frames % 4500, F.lit(75))), F.lit(":"), two(frames % 75))


def clock(ms: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = whole(ms, F.lit(1000))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = whole(s, F.lit(3600)), whole(s % 3600, F.lit(60))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s % 60))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s % 60)))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.translate(text, '"\n\r', "'  "), F.lit('"'))


def _sheet(rows: DataFrame, body: Column, head: list[Column]) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("number", body.alias("text")))), lambda x: x["text"])
    return rows.groupBy("media").agg(F.concat(F.array_join(F.concat(F.array(*head), lines), "\n"), F.lit("\n")).alias("sheet"))


def cue_sheet(entries: DataFrame, title: str | None = None) -> DataFrame:
    """`(media, sheet)`: a CUE sheet of each recording's entries `(media, kind,
    artist, title, s)` in order; entries without a track are called ID."""
    w = Window.partitionBy("media").orderBy("s", "title", "artist")
    d = entries.withColumn("number", F.row_number().over(w))
    name = lambda c: F.when(F.col("kind") == "id", "ID").otherwise(F.col(c))
    number = F.when(F.col("number") < 100, F.lpad(F.col("number").cast("string"), 2, "0")).otherwise(F.col("number").cast("string"))
    body = F.concat(F.lit("  TRACK "), number, F.lit(" AUDIO\n    TITLE "), _quoted(name("title")), F.lit("\n    PERFORMER "), _quoted(name("artist")), F.lit("\n    INDEX 01 "), cue_index(F.col("s")))
    return _sheet(d, body, [F.concat(F.lit("TITLE "), _quoted(F.lit(title or "DJ set"))), F.lit('FILE "audio" WAVE')])


def m3u_list(entries: DataFrame, target: Column) -> DataFrame:
    """`(media, sheet)`: an extended M3U whose entries start at their second of
    one target; entries without a track say how long nothing is known."""
    w = Window.partitionBy("media").orderBy("s", "title", "artist")
    d = entries.withColumn("number", F.row_number().over(w)).withColumn("_t", target)
    label = F.when(F.col("kind") == "id", F.concat(F.lit("ID - no evidence through "), clock(F.col("e")))).otherwise(F.translate(F.concat_ws(" - ", "artist", "title"), "\n\r", "  "))
    seconds = F.greatest(whole(F.col("s"), F.lit(1000)), F.lit(0)).cast("string")
    return _sheet(d, F.concat(F.lit("#EXTINF:-1,"), label, F.lit("\n#EXTVLCOPT:start-time="), seconds, F.lit("\n"), F.col("_t")), [F.lit("#EXTM3U")])
