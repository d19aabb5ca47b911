import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity as idn
from tidemark.operators import projection as pj
from tidemark.operators import scoring as sco
from tidemark.operators import targeting as tg
from tidemark.operators import timeline as tl
from tidemark.sources import records, responses


def test_allocation(spark):
    rows = [("m", c, cs, ce, cl, w, r) for c, cs, ce, cl, n in ((1, 0, 60, "unclear", 5), (2, 60, 90, "disputed", 3), (3, 90, 100, "blank", 1)) for r, w in enumerate(range(c * 10, c * 10 + n), 1)]
    d = spark.createDataFrame(rows, "media string, cand long, cs long, ce long, class string, id long, rank int")
    pick = lambda q: [(r.cand, r.id, r.round) for r in tg.allocate(d.withColumn("q", F.lit(q)), "q").collect()]
    assert pick(2) == [(2, 20, "first"), (1, 10, "first")]
    # the three first ones, then 4 by 60:30 (the blank has no window left): 3 and 1
    assert sorted(pick(7)) == [(1, 10, "first"), (1, 11, "proportional"), (1, 12, "proportional"), (1, 13, "proportional"), (2, 20, "first"), (2, 21, "proportional"), (3, 30, "first")]
    assert len(pick(99)) == 9 and pick(0) == []


def test_confirmations(spark):
    w = spark.createDataFrame([("m", i, i * 10, i * 10 + 12) for i in range(20)], "media string, id long, s long, e long")
    x = spark.createDataFrame([("m", 1, 50, 62, 0, 200, 5, 3), ("m", 2, 120, 132, 0, 200, 12, 3)], "media string, disc long, ds long, de long, bs long, be long, probe long, reserve long")
    got = sorted((r.disc, r.id) for r in tg.confirmations(x, w, "reserve", 30, 40, 6).collect())
    # two farthest apart for the first, the earliest of the rest for the second as one is left
    assert got == [(1, 2), (1, 9), (2, 10)]
    assert tg.confirmations(x.where("false"), w, "reserve", 30, 40, 6).count() == 0


def test_association(spark):
    t = spark.createDataFrame([("w", 1, 0, 10), ("w", 2, 100, 110), ("w", 3, 100, 120)], "k string, id long, s long, e long")
    p = spark.createDataFrame([("w", 7, 5, 8), ("w", 8, 12, 14), ("w", 9, 105, 130), ("v", 5, 0, 9)], "k string, id long, s long, e long")
    assert sorted((r.pred, r.truth) for r in sco.associate(p, t, ["k"], 3).collect()) == [(7, 1), (9, 2)]


def test_prior_components_and_contest(spark):
    links = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 2, 3)], "id long, a long, b long")
    bad = spark.createDataFrame([(1, 4), (5, 6)], "a long, b long")
    prior = spark.createDataFrame([(5, 6)], "a long, b long")
    got = tl.merge_with_veto(links, bad, prior)
    assert {r.node: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    assert [r.component for r in idn.contested(got, bad).collect()] == [5]
    a = spark.createDataFrame([(1, 9, 1, "same_recording", 1, False), (2, 1, 9, "same_recording", 2, False), (3, 2, 3, "same_recording", 1, True), (4, 2, 4, "same_recording", 1, False), (5, 1, 9, "same_work", 3, False)], "id long, a long, b long, relation string, independent_of int, p boolean")
    assert sorted((r.id, r.a, r.b) for r in idn.eligible_links(a, F.col("a") == 9, F.col("p")).collect()) == [(1, 1, 9), (3, 2, 3)]


def refit(points):
    """The decisions by fitting every segment anew, from the written rules."""
    rnd = lambda v: int(np.sign(v) * np.floor(abs(v) + 0.5))

    def fit(seg):
        x, y, r = (np.array(v) for v in zip(*seg, strict=True))
        i, j = np.triu_indices(len(seg), 1)
        ok = x[i] != x[j]
        own = int(np.rint(np.median(r)))
        rate = int(r[0]) if len(seg) < 3 else rnd(np.median((y[j] - y[i])[ok] * 10_000 / (x[j] - x[i])[ok])) if ok.any() else own
        off = rnd(np.median(y - rate * x / 10_000))
        at = lambda m: rnd(rate * m / 10_000) + off
        miss = max(abs(b - at(a)) for a, b, _ in seg)
        return rate, at, 8400 <= rate <= 12_000 and abs(rate - own) <= 200 and miss <= 1500

    def on(seg, p):
        return abs(p[1] - fit(seg)[1](p[0])) <= 1500 and (len(seg) < 2 or fit([*seg, p])[2])

    out, seg = ["start"], [points[0]]
    for i in range(1, len(points)):
        p, gap = points[i], points[i][0] - points[i - 1][0]
        low, high = min(q[1] for q in seg), max(q[1] for q in seg)
        again, fits, rate = low - 1500 <= p[1] <= high + 1500, on(seg, p), fit(seg)[0]
        two, three = (fit(points[i : i + n]) if i + n <= len(points) else None for n in (2, 3))
        if fits and gap <= 120_000 and (gap <= 30_000 or not again):
            out.append("continuation")
            seg.append(p)
            continue
        if again and gap <= 30_000 and p[1] < high - 2000:
            out.append("loop")
        elif abs(p[1]) <= 5000 and high > 7000:
            out.append("reset")
        elif gap > 30_000 and (again or not fits):
            out.append("replay")
        elif not fits and two and two[2] and abs(two[0] - rate) <= 200 and abs(p[2] - rate) <= 200:
            out.append("jump")
        elif three and three[2] and abs(three[0] - rate) > 300:
            out.append("drift")
        elif i + 1 < len(points) and on(seg, points[i + 1]):
            out.append("outlier")
            continue
        else:
            out.append("pending")
        seg = [p]
    return out


def test_alignment_against_refits():
    rng, seen = random.Random(8), set()
    for _ in range(300):
        mix, ref, points = 0, 20_000, []
        rate = 10_000
        for _ in range(rng.randint(1, 25)):
            step = rng.choice([9000, 9000, 9000, 18_000, 40_000, 130_000])
            mix += step
            ref += step * rate // 10_000
            if (u := rng.random()) < 0.05:
                ref = rng.choice([500, 20_000, ref + 60_000, ref - 40_000])
            elif u < 0.08:
                rate = rng.choice([9500, 10_000, 10_500])
            points.append((mix, ref + rng.choice([0, 0, 0, 100, -700, 4000]), rng.choice([10_000, 10_000, 9500, 10_500])))
        got = [w for w, _, _ in tl._decided(*(np.array(v) for v in zip(*points, strict=True)))]
        assert got == refit(points), points
        seen |= set(got)
    assert seen == {n for n, _ in tl.DECISIONS} | {"start"}


def test_sheets(spark):
    d = spark.createDataFrame([("m", "track", 'A "x"', "T\nu", 6_000_040, 1), ("m", "id", None, None, 61_000, 4_000_000)], "media string, kind string, artist string, title string, s long, e long")
    assert pj.cue_sheet(d).first().sheet == 'TITLE "DJ set"\nFILE "audio" WAVE\n  TRACK 01 AUDIO\n    TITLE "ID"\n    PERFORMER "ID"\n    INDEX 01 01:01:00\n  TRACK 02 AUDIO\n    TITLE "T u"\n    PERFORMER "A \'x\'"\n    INDEX 01 100:00:03\n'
    assert pj.m3u_list(d, F.lit("f.mp3")).first().sheet == '#EXTM3U\n#EXTINF:-1,ID - no evidence through 1:06:40\n#EXTVLCOPT:start-time=61\nf.mp3\n#EXTINF:-1,A "x" - T u\n#EXTVLCOPT:start-time=6000\nf.mp3\n'


def test_answers(spark):
    body = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i long, b string")
    got = responses.audd(body('{"status":"success","result":[{"offset":"01:02","songs":[{"artist":"A","title":"T","score":90}]},{"offset":"00:30","songs":[]}]}', "torn", None), "b").collect()
    assert [(r.i, r.offset_ms, r.artist, r.title, r.score) for r in got] == [(0, 62_000, "A", "T", 90)]
    got = responses.acrcloud(body('{"data":[{"id":"f","state":1,"results":{"music":[{"offset":3,"result":{"title":"T","artists":[{"name":"A"},{"name":"B"}],"score":80,"acrid":"z"}}]}},{"id":"g","state":0}]}'), "b").collect()
    assert [(r.file, r.offset_ms, r.artist, r.title) for r in got] == [("f", 3000, "A, B", "T")]
    got = responses.panako(body("Index; Total;a;b;c;d;e;f;g;h;i;j;k", "1; 2;q.wav;1.5;3.25;m.wav;77;10.0;11.75;42;100.5;99.9;1.00", "2;2;q.wav;0;0;null;null;0;0;0;0;0;0"), "b").collect()
    assert [(r.query_s, r.query_e, r.match, r.match_s, r.score, r.time_e4) for r in got] == [(1500, 3250, "77", 10_000, 42, 10_050)]
    got = responses.soundcloud_comments(body('{"collection":[{"id":5,"body":"hi","timestamp":900,"user":{"permalink":"p","verified":true}},{"id":5,"body":"hi","timestamp":900,"user":{"permalink":"p","verified":true}}]}'), "b").collect()
    assert [(r.id, r.text, r.at_ms, r.author) for r in got] == [(5, "hi", 900, "p")]
    got = responses.video_comments(body('{"comments":[{"id":"c","text":"x","author":"a","parent":"root"},{"id":"d","text":"y","author":"a","parent":"c","is_pinned":true}]}'), "b").collect()
    assert [(r.id, r.parent, r.pinned, r.uploader) for r in got] == [("c", None, False, False), ("d", "c", True, False)]
    got = responses.sections(body('{"data":{"cloudcastLookup":{"name":"n","sections":[{"artistName":"A","songName":"S","startSeconds":61},{"songName":"x"}]}}}'), "b").collect()
    assert [(r.number, r.artist, r.title, r.at_ms) for r in got] == [(0, "A", "S", 61_000)]
    got = responses.wikitext_tracklist(body("== Intro ==\n# no\n== Tracklist ==\n# '''A''' - B\n#<!-- x -->\n# C - D <!-- y -->\ntext\n== End ==\n# no", "none"), "b").collect()
    assert [(r.number, r.line) for r in got] == [(0, "A - B"), (1, "C - D")]
    html = '<html><head><title> T </title><script>var a="<a href>"</script></head><body><a href=x>hi</a> <b>there</b></body></html>'
    p = body(html).select(responses.pointer_page(F.col("b")).alias("p")).first().p
    assert (p.title, p.text_chars) == ("T", len("T hi there"))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One\r\n\r\nTwo\n")
    got = sorted((r.number, r.line) for r in responses.manual_tracklist(spark, str(tmp_path)).collect())
    assert got == [(0, "One"), (2, "Two")]
    i = responses.media_index(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in i] == [("a.txt", 11)]
    d = spark.createDataFrame([(1, {"z": 1, "a": 2}, None)], "b long, a map<string,int>, c string")
    assert records.canonical(d).first().value == '{"a":{"a":2,"z":1},"b":1,"c":null}'
    with pytest.raises(ValueError, match="a.x"):
        records.canonical(spark.createDataFrame([((1.0,),)], "a struct<x:double>"))
