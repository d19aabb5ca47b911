"""Queries over comments, labels, saved answers and nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import comments as cm
from tidemark.functions import labels as lb
from tidemark.functions import signal as sg
from tidemark.functions import titles as tt
from tidemark.operators import crowd as cr
from tidemark.plans import episodes as pe
from tidemark.runtime import read_table, table
from tidemark.sources import records, responses


def _comments(spark, d):
    """Whole turns of conversations, and parts' labels as listeners write them."""
    turns = read_table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("id"), "text")
    p = read_table(spark, d, "part")
    k, label = F.col("p_partkey"), F.concat("p_brand", F.lit(" - "), "p_name")
    cue = F.concat((k % 3).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":09 "))
    shapes = [
        F.concat(F.lit("@some_one: "), label, F.lit(" ["), F.col("p_type"), F.lit("]")),
        F.concat(F.lit("what's this track, "), F.col("p_name"), F.lit("?")),
        F.concat(F.lit("Track ID: "), F.col("p_name"), F.lit(" (Club Mix) by "), F.col("p_brand")),
        F.concat(F.lit("actually "), F.col("p_brand"), F.lit(" | "), F.col("p_name")),
        F.concat(cue, F.lit("[x] "), label, F.lit(" (unreleased)")),
        F.concat(F.lit("see https://www.mixesdb.com/w/"), k.cast("string"), F.lit(".")),
        F.concat(F.lit("https://example.org/"), k.cast("string"), F.lit("?token=1")),
        F.concat(F.col("p_brand"), F.lit(" - ID ("), F.col("p_name"), F.lit(" Remix)")),
        F.concat(F.lit('"'), F.col("p_brand"), F.lit('" –  '), F.col("p_name"), F.lit(" w/ Friends bootleg")),
        F.concat(F.lit("this is so good, "), F.col("p_name")),
        F.concat(F.col("p_brand"), F.lit(" -"), F.col("p_name")),
    ]
    text = F.element_at(F.array(*shapes), (k % len(shapes) + 1).cast("int"))
    both = turns.unionByName(p.select(F.concat(F.lit("p"), k.cast("string")).alias("id"), text.alias("text")))
    # a small file is one task's scan, but reading comments is work for all cores
    return both.repartition(4 * spark.sparkContext.defaultParallelism, "id")


def _parsed(spark, d):
    c = _comments(spark, d)
    return c.select("id", "text", cm.parsed(F.col("text"), cm.cue_ms(F.col("text")).isNotNull()).alias("p"))


def q_kind(spark, d):
    """What each comment is, with its label."""
    return _parsed(spark, d).select("id", *(F.coalesce(f"p.{c}", F.lit("")).alias(c) for c in ("kind", "artist", "title")), F.coalesce("p.confidence", F.lit(0)).alias("confidence"))


def q_split(spark, d):
    """Artist and title as in an answer to a question."""
    a = _comments(spark, d).select("id", cm.artist_title(F.col("text"), F.lit(True)).alias("a"))
    return a.select("id", *(F.coalesce(f"a.{c}", F.lit("")).alias(c) for c in ("artist", "title")), "a.confidence")


def q_flags(spark, d):
    f = _comments(spark, d).select("id", cm.flags(F.col("text")).alias("f"))
    return f.select("id", *(f"f.{c}" for c in ("unreleased", "edit", "bootleg", "mashup", "unknown", "qualifier", "label")))


def q_mentions(spark, d):
    return _comments(spark, d).select("id", cm.mentions_dropped(cm.furniture_dropped(F.col("text"))).alias("text"))


def q_positions(spark, d):
    x = pe.windows(spark, d).select("id", F.expr("s % 4000000").alias("at"), F.element_at(F.array(*map(F.lit, ("cue", "minute", "question"))), (F.col("id") % 3 + 1).cast("int")).alias("of"))
    p = cm.position(F.col("at"), F.col("of"), F.lit(3_900_000).cast("long"))
    return x.select("id", p["s"].alias("s"), p["e"].alias("e"), cm.stamp(F.col("at")).alias("stamp"))


def q_units(spark, d):
    c = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda t: F.concat_ws(" ", F.concat(t["turn"].cast("string"), F.lit(":30")), t["text"])), "\n")
    return cm.units(c.select("conv_id", text.alias("text"), F.lit(7_200_000).alias("duration")), "text", "duration")


def q_keys(spark, d):
    p = read_table(spark, d, "part")
    title = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " (Extended Mix)").when(F.col("p_partkey") % 3 == 1, " VIP feat. X & Y").otherwise(" & Co - Live"))
    t = tt.parsed_title(title)
    return p.select("p_partkey", tt.work_key(F.col("p_brand"), title).alias("work_key"), tt.hint_key(title).alias("hint_key"), F.concat_ws(" ", t["base"]).alias("base"), F.concat_ws(" ", t["version"]).alias("version"))


def q_confidence(spark, d):
    """How well each part's label agrees with the next part's."""
    p = read_table(spark, d, "part")
    k = F.col("p_partkey")
    title = F.concat_ws(" ", "p_name", F.when(k % 4 == 0, "- remix").when(k % 4 == 1, "(club mix)"))
    a = p.select(k.alias("k"), "p_brand", title.alias("t"), (F.col("p_size").cast("long") * 1000).alias("ms"))
    b = a.select((F.col("k") - 1).alias("k"), F.col("p_brand").alias("b2"), F.col("t").alias("t2"), F.col("ms").alias("ms2"))
    j = a.join(b, "k")
    return j.select("k", tt.match_confidence_e4(F.col("p_brand"), F.col("t"), F.col("b2"), F.col("t2")).alias("plain_e4"), tt.match_confidence_e4(F.col("p_brand"), F.col("t"), F.col("b2"), F.col("t2"), F.col("ms"), F.col("ms2")).alias("timed_e4"), tt.song_score_e4(F.col("t"), F.col("t2"), F.abs(F.col("ms") - F.col("ms2"))).alias("song_e4"))


def q_styles(spark, d):
    v = spark.createDataFrame([("red", "Warm"), ("blue", "Cold"), ("green", "Cold"), ("widget", "Device"), ("gadget", "Device")], "key string, style string")
    tags = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split(F.upper("p_name"), " ")).alias("tag"))
    return tt.styles_of(tags, F.broadcast(v)).groupBy("style").agg(F.count("*").alias("parts"))


def q_plausible(spark, d):
    """Whether each comment's label is plausible, and its title a placeholder."""
    c = _parsed(spark, d).select("id", F.col("p.artist").alias("artist"), F.col("p.title").alias("title"))
    return c.select("id", lb.plausible_label(F.col("artist"), F.col("title")).alias("plausible"), lb.is_placeholder(F.col("title")).alias("placeholder"))


def q_corroborate(spark, d):
    p = read_table(spark, d, "part")
    a = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", F.lit("one"))), " "))
    b = F.array_distinct(F.split(F.lower(F.concat_ws(" ", F.regexp_replace("p_name", "[aeiou]([a-z]) ", "$1 "), F.when(F.col("p_partkey") % 2 == 0, "one").otherwise("ones"))), " "))
    return p.select("p_partkey", lb.words_corroborate(a, b).alias("same"))


def _crowd(spark, d):
    """Labels of parts as a crowd writes them."""
    p = read_table(spark, d, "part")
    k, t = F.col("p_partkey"), F.col("p_name")
    other = F.when(k % 7 == 0, F.concat(F.lit("i think "), t)).when(k % 7 == 1, F.replace(t, F.lit(" "), F.lit(""))).when(k % 7 == 2, F.concat(t, F.lit(" live"))).when(k % 7 == 3, F.replace(t, F.lit("e"), F.lit("ee"))).when(k % 7 == 4, F.concat(t, F.lit(" / x"))).when(k % 7 == 5, F.concat(t, F.lit("s")))
    title = F.coalesce(other, t)
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    brand = F.when(k % 10 == 5, F.concat(brand, F.lit("x"))).when(k % 10 == 6, F.concat(F.lit("b"), F.substring("p_brand", 7, 2))).when(k % 10 == 7, F.concat(F.lit("brand house "), F.substring("p_brand", 7, 2))).otherwise(brand)
    return p.select("p_partkey", brand.alias("artist"), title.alias("title"))


def _first_ids(links, labels):
    of = lambda side: labels.select(F.col("label").alias(side), F.element_at("ids", 1).alias(f"id_{side}"))
    d = links.join(of("a"), "a").join(of("b"), "b")
    return d.withColumns({"a": F.least("id_a", "id_b"), "b": F.greatest("id_a", "id_b")}).drop("id_a", "id_b")


def q_tolerances(spark, d):
    """Labels of a crowd that a tolerance joins, by their smallest parts."""
    labels = table(cr.labels_of(_crowd(spark, d), "p_partkey", "artist", "title"), "labels")
    return _first_ids(cr.tolerant_pairs(labels), labels)


def q_crowd(spark, d):
    """Labels of a crowd that name one work."""
    labels = table(cr.labels_of(_crowd(spark, d), "p_partkey", "artist", "title"), "labels")
    return _first_ids(cr.crowd_links(labels), labels)


def q_read(spark, d):
    p = read_table(spark, d, "part")
    r = tt.read_label(F.concat("p_brand", F.lit(" & Friends feat. N.E.R.D.")), F.concat("p_name", F.lit(" (Some One Remix)")))
    x = p.select("p_partkey", r.alias("r"), F.array_join(tt.label_tokens("p_type"), " ").alias("tokens"))
    return x.select("p_partkey", *(F.concat_ws(",", f"r.{c}").alias(c) for c in ("names", "guests", "title", "remixers")), "tokens")


def q_cache(spark, d):
    """Orders as queries; lines as stored answers with an age in days."""
    li = read_table(spark, d, "lineitem")
    state = F.when(F.col("l_returnflag") == "A", "match").when(F.col("l_returnflag") == "N", "no_match").otherwise("error")
    cache = li.select(F.col("l_orderkey").alias("cache_key"), state.alias("state"), (F.col("l_partkey") % 200 * 86_400).alias("age_s"))
    return responses.work_left(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("cache_key"), "o_orderstatus"), cache)


def q_shared(spark, d):
    li = read_table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("window"), F.concat_ws("/", F.col("l_partkey").cast("string"), "l_returnflag").alias("content"))
    return responses.shared_queries(li, "content", "window").groupBy("asked").agg(F.count("*").alias("windows"))


def _answers(spark, d):
    """Events as saved recogniser answers."""
    i, v = F.col("event_id"), F.round("value", 3).cast("decimal(12,3)").cast("string")
    found = F.concat(F.lit('{"matches":[{"id":"a","offset":'), v, F.lit(',"timeskew":0.000'), (i % 10).cast("string"), F.lit('}],"track":{"key":"'), F.col("user_id").cast("string"), F.lit('","title":"'), F.col("event_type"), F.lit('","subtitle":"X"}}'))
    return read_table(spark, d, "events").select("event_id", F.when(i % 4 == 0, '{"matches":[]}').when(i % 9 == 0, "torn {").otherwise(found).alias("body"))


def q_shazam(spark, d):
    r = responses.shazam(_answers(spark, d), "body")
    at = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(-1).cast("long"))
    return r.select("event_id", "status", F.coalesce("title", F.lit("")).alias("title"), at("offsets_ms").alias("offset_ms"), at("skews_e6").alias("skew_e6"))


def q_pages(spark, d):
    p = responses.pointer_page(F.col("html"))
    return read_table(spark, d, "pages").select("page_id", p["title"].alias("title"), p["links"].alias("links"))


def q_contract(spark, d):
    """How many rows break each rule of lines and orders."""
    li = read_table(spark, d, "lineitem")
    rules = {"quantity": F.col("l_quantity").between(1, 49), "discount": F.col("l_discount") * 100 <= 9, "flags": F.col("l_returnflag").isin("A", "N"), "ordered": F.col("l_extendedprice") > F.col("l_tax")}
    return responses.validated(li, rules)


def q_canonical(spark, d):
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_returnflag").alias("z"), F.col("l_partkey").alias("a")).alias("b"), F.when(F.col("l_linenumber") > 3, F.col("l_linestatus")).alias("n"))
    return records.canonical(li).select(F.sha2("value", 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))


def q_rms(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", F.round(sg.rms(F.col("embedding")), 6).alias("rms"))


def q_json(spark, d):
    """A key of JSON properties read, set and written back, by its value."""
    e = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    p = F.from_json("props", "k long").withField("k", k + 1).withField("seen", F.lit(True))
    return e.groupBy(k.alias("k"), F.to_json(p).alias("props")).agg(F.count("*").alias("n"))


def q_maps(spark, d):
    """Counters of each user's kinds, two halves merged by the larger value."""
    e = read_table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 2).alias("half"), "event_type").agg(F.count("*").alias("n"))
    m = e.groupBy("user_id", "half").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    a, b = (m.where(f"half = {i}").select("user_id", F.col("m").alias(c)) for i, c in ((0, "x"), (1, "y")))
    both = F.map_zip_with("x", "y", lambda k, p, q: F.greatest(F.coalesce(p, F.lit(0)), F.coalesce(q, F.lit(0))))
    z = F.explode(F.map_entries(both)).alias("e")
    return a.join(b, "user_id").select("user_id", z).select("user_id", F.col("e.key").alias("kind"), F.col("e.value").alias("most"))


def q_arrays(spark, d):
    o = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"), F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x)
    return o.select("l_orderkey", F.size("p").cast("long").alias("parts"), total.alias("total"), F.size(F.array_except("p", "s")).cast("long").alias("only"), F.element_at("p", -1).alias("last"), F.exists("p", lambda x: x % 7 == 0).alias("seventh"))


def q_recent(spark, d):
    """The ten latest orders of customers that have an order still open and none
    of the lowest priority, with the customer's market."""
    for t in ("orders", "customer"):
        read_table(spark, d, t).createOrReplaceTempView(f"recent_{t}")
    # what a customer paid before is looked up for the ten orders alone
    return spark.sql(
        """WITH latest AS (SELECT o.o_orderkey, c.c_custkey, o.o_orderdate FROM recent_orders o JOIN recent_customer c ON o.o_custkey = c.c_custkey WHERE EXISTS (SELECT 1 FROM recent_orders x WHERE x.o_custkey = c.c_custkey AND x.o_orderstatus = 'O')
 AND NOT EXISTS (SELECT 1 FROM recent_orders x WHERE x.o_custkey = c.c_custkey AND x.o_orderpriority LIKE '5%') ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 10),
 ten AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS no FROM latest)
 SELECT t.o_orderkey, t.c_custkey, coalesce(max(p.o_totalprice), 0D) AS before_most FROM ten t LEFT JOIN recent_orders p ON p.o_custkey = t.c_custkey AND p.o_orderkey < t.o_orderkey
 GROUP BY t.no, t.o_orderkey, t.c_custkey ORDER BY t.no"""
    )


QUERIES = {
    "comment_kind": q_kind,
    "label_split": q_split,
    "label_flags": q_flags,
    "mentions_dropped": q_mentions,
    "cue_positions": q_positions,
    "comment_units": q_units,
    "title_keys": q_keys,
    "match_confidence": q_confidence,
    "tag_styles": q_styles,
    "plausible_labels": q_plausible,
    "words_corroborate": q_corroborate,
    "label_tolerances": q_tolerances,
    "crowd_links": q_crowd,
    "label_readings": q_read,
    "work_left": q_cache,
    "shared_queries": q_shared,
    "recogniser_answers": q_shazam,
    "pointer_pages": q_pages,
    "contract_violations": q_contract,
    "canonical_records": q_canonical,
    "rms_energy": q_rms,
    "json_fields": q_json,
    "map_counters": q_maps,
    "array_values": q_arrays,
    "recent_orders": q_recent,
}

_s = lambda x: x.replace("'", "''")
_list = lambda x: "[" + ", ".join(f"'{_s(w)}'" for w in x) + "]"
_has = lambda x, p: f"regexp_matches({x}, '{_s(p)}')"
_sub = lambda x, p, to="": f"regexp_replace({x}, '{_s(p)}', '{to}', 'g')"
_LBL = "p_brand || ' - ' || p_name"
_C = f"""c AS (SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS id, text FROM conversations UNION ALL SELECT 'p' || p_partkey, CASE p_partkey % 11 WHEN 0 THEN '@some_one: ' || {_LBL} || ' [' || p_type || ']' WHEN 1 THEN 'what''s this track, ' || p_name || '?' WHEN 2 THEN 'Track ID: ' || p_name || ' (Club Mix) by ' || p_brand
 WHEN 3 THEN 'actually ' || p_brand || ' | ' || p_name WHEN 4 THEN p_partkey % 3 || ':' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') || ':09 [x] ' || {_LBL} || ' (unreleased)' WHEN 5 THEN 'see https://www.mixesdb.com/w/' || p_partkey || '.' WHEN 6 THEN 'https://example.org/' || p_partkey || '?token=1'
 WHEN 7 THEN p_brand || ' - ID (' || p_name || ' Remix)' WHEN 8 THEN '"' || p_brand || '" –  ' || p_name || ' w/ Friends bootleg' WHEN 9 THEN 'this is so good, ' || p_name ELSE p_brand || ' -' || p_name END FROM part)"""
_tokens = lambda x: f"(' ' || array_to_string(regexp_extract_all(lower({x}), '{_s(cm.TOKEN)}'), ' ') || ' ')"
_says = lambda t, of: "(" + " OR ".join(f"contains({t}, ' {_s(p)} ')" for p in of) + ")"
_one = lambda x: f"trim({_sub(x, r'\s+', ' ')})"
_drop = lambda x: _one(_sub(_sub(_sub(x, r"(^|[^\p{L}\p{N}_])@[\p{L}\p{N}_.-]+:?", r"\1 "), r"([(\[])\s+", r"\1"), r"\s+([)\]])", r"\1"))
_ITEMS = "|".join([r"[0-9]{1,3}[.)]\s+", r"\[\s*[xX✓•·*-]?\s*\]\s*", r"\(\s*\)\s*", r"[•·*–—-]\s+"])
_lead = lambda x: f"trim({_sub(_sub(x, r'^(\s*[0-9]{1,3}[.)])\[', r'\1 ['), rf'^\s*({_ITEMS})+')})"
_unq = lambda x: f"(CASE WHEN length({x}) > 2 AND left({x}, 1) || right({x}, 1) IN ({', '.join(chr(39) + _s(q) + chr(39) for q in cm.QUOTES)}) THEN trim(substr({x}, 2, length({x}) - 2)) ELSE {x} END)"
_only = lambda x, *more: f"(lower(trim({_sub(x, r'\s*([(\[][^()\[\]]*[)\]]\s*)+$')})) IN ({', '.join(chr(39) + w + chr(39) for w in ('id', *more))}) OR {_has(f'lower(trim({x}))', r'^\?+$')})"
_edges = lambda x: f"list_transform(string_split(lower({_one(x)}), ' '), lambda w: {_sub('w', r'^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_/]+$')})"


def _flags_sql(x: str) -> dict[str, str]:
    """Flags of a text `x`, whose tokens are in the column `k`."""
    words = f"string_split(lower({_one(x)}), ' ')"
    label = f"trim(regexp_extract({x}, '\\[([^\\[\\]]+)\\]\\s*$', 1))"
    bracket = f"list_filter(regexp_extract_all({x}, '\\([^()]*\\)|\\[[^\\[\\]]*\\]'), lambda b: regexp_matches(lower(b), '{'|'.join(cm.VERSIONS)}'))[1]"
    return {
        **{n: _says("k", w) for n, w in cm.SAYS.items()},
        "mashup": f"(list_contains({_edges(x)}, 'w/') OR {_says('k', ['vs'])} OR list_contains({words}[2:len({words}) - 1], 'x'))",
        "unknown": _only(_unq(f"trim({x})"), "id - id", "id-id"),
        "qualifier": f"coalesce(trim(substr({bracket}, 2, length({bracket}) - 2)), '')",
        "label": f"CASE WHEN {_says(_tokens(label), cm.VERSIONS)} THEN '' ELSE {label} END",
    }


def _split_sql(t: str, reply: bool) -> str:
    """(artist, title, confidence) of `t` as a struct."""
    pair = lambda a, b, n: f"struct_pack(artist := {_unq(a)}, title := {_unq(b)}, confidence := {n})"
    by = f"list_transform([1, 2], lambda n: CASE n WHEN 1 THEN regexp_extract({t}, '(?is)^(.+?)\\s+by\\s+(.+)$', 1) ELSE regexp_extract({t}, '(?is)^(.+?)\\s+by\\s+(.+)$', 2) END)"
    cases = f"WHEN {_has(t, r'(?is)^(.+?)\s+by\s+(.+)$')} THEN {pair(by + '[2]', by + '[1]', 8500)}"
    for s in cm.SEPARATORS:
        left, right = f"trim(split_part({t}, '{s}', 1))", f"trim(substr({t}, strpos({t}, '{s}') + {len(s)}))"
        cases += f" WHEN strpos({t}, '{s}') > 0 AND {left} <> '' AND {right} <> '' THEN {pair(left, right, 9000)}"
    if reply:  # the only such comments have one word before the dash's word
        d = r"^(.*?[^\s])\s+[-–—]([^-–—\s].*)$"
        cases += f" WHEN {_has(t, d)} THEN {pair(f'''regexp_extract({t}, '{d}', 1)''', f'''regexp_extract({t}, '{d}', 2)''', 9000)}"
    return f"CASE {cases} ELSE struct_pack(artist := NULL::VARCHAR, title := nullif({t}, ''), confidence := 3000) END"


def _kind_sql() -> str:
    begins = lambda t, of: "(" + " OR ".join(f"starts_with({t}, ' {_s(p)} ')" for p in of) + ")"
    n = "CASE " + " ".join(f"WHEN starts_with(k, ' {_s(p)} ') THEN {len(p.split(' '))}" for p in reversed(cm.TELLS + cm.NAMES_ID)) + " ELSE 0 END"
    stamp, last = r"^[\s\[(#]*[0-9]+:[0-9]{1,2}(:[0-9]{1,2})?[\s:.)\]–—-]*", r"[\s:.)\[–—-]*[0-9]+:[0-9]{1,2}(:[0-9]{1,2})?[\s\]).]*$"
    rest = lambda x, m: f"trim({x[: 0]}regexp_replace({x}, '^(\\s*({_s(cm.TOKEN)})){{' || ({m}) || '}}', ''))"
    f = _flags_sql("body")
    words = "array_to_string(list_filter(string_split(trim(k), ' '), lambda w: regexp_matches(w, '^[\\p{L}\\p{N}_]')), ' ')"
    host = "lower(regexp_extract(u, '(?i)^https://(?:[^/?#]*@)?([^/?#:@]*)', 1))"
    clean = lambda x: f"CASE WHEN kind IN ('correction', 'tracklist_line', 'answer', 'keyword') THEN {_one(_no(_no(x, 'qualifier'), 'label'))} END"
    return f"""WITH {_C}, m AS (SELECT id, text, {_drop('text')} AS t, regexp_matches(text, '^[0-9]:[0-9]{{2}}:09 ') AS cued FROM c), k AS (SELECT *, {_tokens('t')} AS k,
 regexp_replace(list_filter(regexp_extract_all(text, '(?i)https://[^\\s<>()\\[\\]]+'), lambda u: list_contains({_list(cm.POINTER_HOSTS)}, {host}) AND NOT contains(u, 'token='))[1], '[.,;:]+$', '') AS pointer FROM m),
 q AS (SELECT *, NOT ({begins('k', cm.NAMES_ID)}) AND (({_says(_sub('k', 'u+', 'u'), cm._NAMES)} AND (contains(k, '?') OR contains(k, ' id '))) OR (list_contains({_list(cm.BARE)}, {words}) AND starts_with(k, ' ' || {words} || ' ? ')) OR {_says('k', cm.ASKS_ID + cm.ASKS_TRACK)}) AS asks, {n} AS opens,
  CASE WHEN cued THEN {_lead(f"trim({_sub(_lead(_sub(_lead('t'), stamp)), last)})")} ELSE {_lead('t')} END AS cut FROM k),
 b AS (SELECT id, text, cued, k AS toks, pointer, asks, opens, CASE WHEN starts_with(k, ' actually ') THEN {rest('cut', '1')} WHEN asks OR cued OR opens = 0 THEN cut ELSE {rest('cut', 'opens')} END AS body FROM q),
 a AS (SELECT *, {_tokens('body')} AS k, {_split_sql('body', False)} AS s FROM b),
 g AS (SELECT *, {f['unreleased']} AS unreleased, {f['unknown']} OR coalesce(lower(s.artist) = 'id' AND starts_with(lower(s.title), 'id'), false) OR coalesce({_only('s.title')}, false) AS unknown, {f['qualifier']} AS qualifier, {f['label']} AS label, opens > 0 OR s.artist IS NOT NULL OR coalesce(regexp_matches(s.title, '\\S-\\S'), false) AS answers FROM a),
 z AS (SELECT *, CASE WHEN pointer IS NOT NULL THEN 'pointer' WHEN asks THEN 'question' WHEN starts_with(toks, ' actually ') THEN 'correction' WHEN cued THEN 'tracklist_line' WHEN answers AND NOT {begins('k', cm.REACTIONS)} THEN 'answer' WHEN NOT answers AND (unreleased OR unknown) THEN 'keyword' END AS kind FROM g)
 SELECT id, coalesce(kind, '') AS kind, coalesce({clean('s.artist')}, '') AS artist, coalesce(CASE WHEN kind = 'pointer' THEN pointer ELSE {clean('s.title')} END, '') AS title, CASE WHEN kind IS NULL THEN 0 WHEN kind = 'pointer' THEN 10000 WHEN kind = 'question' THEN 8000 WHEN kind = 'tracklist_line' THEN least(s.confidence, 7500) ELSE s.confidence END AS confidence FROM z"""


def _no(x: str, extra: str) -> str:
    return f"CASE WHEN {extra} = '' THEN {x} ELSE replace(replace({x}, '(' || {extra} || ')', ' '), '[' || {extra} || ']', ' ') END"


_WORDS = lambda x: f"list_filter(string_split(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_GROUP = lambda x: f"list_filter(regexp_split_to_array(regexp_replace(replace({_sub(_sub(f'lower({x})', tt.BRACKETED, ' '), tt.GUESTS)}, '&', ' and '), '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+'), lambda w: w <> '')"
_JOINED = lambda x: f"array_to_string({x}, ' ')"
_PARTS = lambda x: f"regexp_split_to_array({_sub(f'lower({x})', tt.BRACKETED, ' ')}, '{tt.SPACED_DASH}')"
_ISVER = lambda x: f"(len({_PARTS(x)}) > 1 AND list_has_any({_WORDS(f'{_PARTS(x)}[-1]')}, {_list(tt.VERSION_WORDS)}))"
_BASE = lambda x: f"CASE WHEN {_ISVER(x)} THEN {_WORDS(f'''array_to_string({_PARTS(x)}[1:len({_PARTS(x)}) - 1], ' ')''')} ELSE {_WORDS(f'''array_to_string({_PARTS(x)}, ' - ')''')} END"
_VER = lambda x: f"list_sort(list_distinct(list_concat({_WORDS(f'''array_to_string(regexp_extract_all(lower({x}), '{tt.BRACKETED}', 1), ' ')''')}, CASE WHEN {_ISVER(x)} THEN {_WORDS(f'{_PARTS(x)}[-1]')} ELSE [] END)))"
_JAC = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"
_CV = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' - remix' WHEN 1 THEN p_name || ' (club mix)' ELSE p_name END"

_LW = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ('feat', 'featuring', 'ft'))"
_CROWD = f"""cw AS (SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 5 THEN replace(p_brand, '#', '') || 'x' WHEN 6 THEN 'b' || substr(p_brand, 7, 2) WHEN 7 THEN 'brand house ' || substr(p_brand, 7, 2) ELSE replace(p_brand, '#', '') END AS artist,
 CASE p_partkey % 7 WHEN 0 THEN 'i think ' || p_name WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN p_name || ' live' WHEN 3 THEN replace(p_name, 'e', 'ee') WHEN 4 THEN p_name || ' / x' WHEN 5 THEN p_name || 's' ELSE p_name END AS title FROM part),
 lb AS (SELECT a, t, parts, min(id) AS id FROM (SELECT id, {_LW('artist')} AS a, {_LW('title')} AS t, list_sort(list_distinct(list_transform(string_split(title, ' / '), lambda p: array_to_string({_LW('p')}, ' ')))) AS parts FROM cw) GROUP BY ALL)"""
_STEM = lambda w: f"CASE WHEN length({w}) > 4 THEN regexp_replace({w}, '({'|'.join(cr.ENDINGS)})$', '') ELSE {w} END"
_ALL = lambda x, f: f"list_transform({x}, lambda w: {f('w')})"


def _sound_sql(w: str) -> str:
    for a, b in cr.SOUNDS:
        w = f"replace({w}, '{a}', '{b}')"
    letters = f"string_split(substr({w}, 1, 1) || regexp_replace(substr({w}, 2), '[aeiouhw]', '', 'g'), '')"
    return f"array_to_string(list_filter({letters}, lambda c, i: i = 1 OR c <> {letters}[i - 1]), '')"


_NEARQ = lambda x, y: f"({x} = {y} OR (length({x}) >= 4 AND length({y}) >= 4 AND levenshtein({x}, {y}) <= 1))"
_ZIP = lambda x, y, f: f"len(list_filter(range(1, len({x}) + 1), lambda i: NOT {f(f'{x}[i]', f'{y}[i]')})) = 0"
_J = lambda x, s="": f"array_to_string({x}, '{s}')"


def _tolerance_sql() -> str:
    """The first tolerance that joins x and y, either way round."""
    both = lambda f: f"({f('x', 'y')} OR {f('y', 'x')})"
    lead = lambda x, y: "(" + " OR ".join(f"{_J(f'{x}.t', ' ')} = '{k} ' || {_J(f'{y}.t', ' ')}" for k in cr.LEADS) + ")"
    sound = _ALL("{0}.t", _sound_sql)
    stem = _ALL("{0}.t", _STEM)
    cases = [
        ("", "x.a = y.a AND x.t = y.t"),
        ("swapped", "x.a = y.t AND x.t = y.a"),
        ("alt_title", "x.a = y.a AND list_has_any(x.parts, y.parts)"),
        ("lead_in", f"x.a = y.a AND {both(lead)}"),
        ("spaced", f"x.a = y.a AND len(x.t) <> len(y.t) AND {_J('x.t')} = {_J('y.t')}"),
        ("joined", f"x.a = y.a AND (len(x.t) = 1) <> (len(y.t) = 1) AND {_NEARQ(_J('x.t'), _J('y.t'))}"),
        ("descriptor", "x.a = y.a AND " + both(lambda x, y: f"(len({x}.t) >= 2 AND len({y}.t) > len({x}.t) AND {y}.t[1:len({x}.t)] = {x}.t)")),
        ("stem", f"x.a = y.a AND len(x.t) = len(y.t) AND {stem.format('x')} = {stem.format('y')}"),
        ("phonetic", f"x.a = y.a AND len(x.t) = len(y.t) AND {_ZIP('x.t', 'y.t', lambda p, q: f'(least(length({p}), length({q})) > 3 OR {p} = {q})')} AND {sound.format('x')} = {sound.format('y')}"),
        ("artist_slip", f"x.t = y.t AND len(x.a) = len(y.a) AND {_ZIP('x.a', 'y.a', _NEARQ)}"),
        ("initials", "x.t = y.t AND " + both(lambda x, y: f"(len({x}.a) = 1 AND len({y}.a) > 1 AND {x}.a[1] = {_J(_ALL(f'{y}.a', lambda w: f'substr({w}, 1, 1)'))})")),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in cases) + " END"


_TOL = f"""tp AS (SELECT * FROM (SELECT x.id AS a, y.id AS b, {_tolerance_sql()} AS tolerance FROM lb x JOIN lb y ON x.id < y.id AND (x.a = y.a OR x.t = y.t OR x.a = y.t)) WHERE tolerance IS NOT NULL)"""
_SPELL = "(p <> q AND ((length(p) >= 4 AND length(q) >= 4 AND levenshtein(p, q) <= 1) OR (regexp_full_match(p, '\\p{L}+') AND regexp_full_match(q, '\\p{L}+') AND ((length(p) >= 2 AND length(q) = length(p) + 1 AND starts_with(q, p)) OR (length(q) >= 2 AND length(p) = length(q) + 1 AND starts_with(p, q))))))"
_SURE = f"""ws AS (SELECT id, list_distinct(list_concat(a, t)) AS w FROM lb), wp AS (SELECT x.id AS a, y.id AS b, len(x.w) AS nx, len(y.w) AS ny, list_filter(x.w, lambda v: NOT list_contains(y.w, v)) AS ox, list_filter(y.w, lambda v: NOT list_contains(x.w, v)) AS oy FROM ws x JOIN ws y ON x.id < y.id AND list_has_any(x.w, y.w)),
 su AS (SELECT a, b FROM (SELECT a, b, nx, ny, len(ox) AS lx, len(oy) AS ly, ox[1] AS p, oy[1] AS q FROM wp) WHERE least(nx, ny) >= 2 AND (lx = 0 OR ly = 0 OR (lx = 1 AND ly = 1 AND {_SPELL})) UNION SELECT a, b FROM tp WHERE tolerance IN ('', 'swapped')),
 ed AS (SELECT a, b FROM su UNION SELECT b, a FROM su), rc AS (SELECT id AS node, id AS r FROM lb UNION SELECT ed.b, rc.r FROM rc JOIN ed ON ed.a = rc.node), gr AS (SELECT node, min(r) AS g FROM rc GROUP BY node),
 lo AS (SELECT tp.*, x.g AS ga, y.g AS gb FROM tp JOIN gr x ON x.node = tp.a JOIN gr y ON y.node = tp.b WHERE tolerance NOT IN ('', 'swapped') AND x.g <> y.g), pr AS (SELECT ga AS g, gb AS o FROM lo UNION SELECT gb, ga FROM lo), on_ AS (SELECT g, min(o) AS o FROM pr GROUP BY g HAVING count(*) = 1),
 mu AS (SELECT l.g AS ga, l.o AS gb FROM on_ l JOIN on_ r ON l.o = r.g AND r.o = l.g)"""

ORACLE_SQL = {
    "comment_kind": _kind_sql(),
    "label_tolerances": f"WITH {_CROWD}, {_TOL} SELECT a, b, tolerance FROM tp",
    "crowd_links": f"""WITH RECURSIVE {_CROWD}, {_TOL}, {_SURE} SELECT a, b, 6000 AS confidence, '' AS tolerance FROM su UNION ALL SELECT a, b, 5500, tolerance FROM lo JOIN mu USING (ga, gb)""",
    "label_split": f"WITH {_C}, t AS (SELECT id, {_unq(_drop('text'))} AS t FROM c), s AS (SELECT id, {_split_sql('t', True)} AS s FROM t) SELECT id, coalesce(s.artist, '') AS artist, coalesce(s.title, '') AS title, s.confidence AS confidence FROM s",
    "label_flags": f"WITH {_C}, l AS (SELECT *, {_tokens('text')} AS k FROM c) SELECT id, {', '.join(f'{x} AS {n}' for n, x in _flags_sql('text').items())} FROM l",
    "mentions_dropped": f"WITH {_C} SELECT id, {_drop(_lead('text'))} AS text FROM c",
    "cue_positions": f"""WITH {pe._W}, x AS (SELECT id, s % 4000000 AS tp, ['cue', 'minute', 'question'][id % 3 + 1] AS k FROM w), r AS (SELECT *, greatest(least(CASE k WHEN 'question' THEN tp - 120000 WHEN 'minute' THEN tp ELSE tp - 5000 END, 3900000), 0) AS a, greatest(least(CASE k WHEN 'question' THEN tp + 15000 WHEN 'minute' THEN tp + 60000 ELSE tp + 5000 END, 3900000), 0) AS b FROM x)
 SELECT id, CASE WHEN b <= a THEN least(a, 3899999) ELSE a END AS s, CASE WHEN b <= a THEN least(a + 1, 3900000) ELSE b END AS e, tp // 3600000 || ':' || lpad(CAST(tp // 1000 % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(tp // 1000 % 60 AS VARCHAR), 2, '0') AS stamp FROM r""",
    "title_keys": f"""WITH t AS (SELECT p_partkey, p_brand, p_name || CASE p_partkey % 3 WHEN 0 THEN ' (Extended Mix)' WHEN 1 THEN ' VIP feat. X & Y' ELSE ' & Co - Live' END AS t FROM part), k AS (SELECT *, {_GROUP('t')} AS ws, list_filter({_GROUP('t')}, lambda w: NOT list_contains({_list(tt.GROUPING_WORDS)}, w)) AS rest FROM t)
 SELECT p_partkey, {_JOINED(_GROUP('p_brand'))} || '|' || {_JOINED('CASE WHEN len(rest) > 0 THEN rest ELSE ws END')} AS work_key, array_to_string({_WORDS("regexp_replace(lower(t), '\\([^()]*remix[^()]*\\)', ' ', 'g')")}, ' ') AS hint_key, {_JOINED(_BASE('t'))} AS base, {_JOINED(_VER('t'))} AS version FROM k""",
    "match_confidence": f"""WITH a AS (SELECT p_partkey AS k, {_WORDS('lower(p_brand)')} AS w, {_BASE(_CV)} AS b, {_VER(_CV)} AS v, list_distinct({_WORDS(f'lower({_CV})')}) AS q, CAST(p_size AS BIGINT) * 1000 AS ms FROM part),
 j AS (SELECT x.k, x.ms AS m1, y.ms AS m2, abs(x.ms - y.ms) AS off, x.q AS q1, y.q AS q2, CASE WHEN len(x.w) > 0 AND x.w = y.w THEN 1.0::DOUBLE ELSE {_JAC('x.w', 'y.w')} END AS ar, CASE WHEN len(x.b) > 0 AND x.b = y.b THEN 1.0::DOUBLE ELSE {_JAC('x.b', 'y.b')} END AS ba,
 CASE WHEN x.v = y.v THEN 1.0::DOUBLE WHEN len(x.v) = 0 OR len(y.v) = 0 THEN 0.4::DOUBLE ELSE {_JAC('x.v', 'y.v')} END AS ve FROM a x JOIN a y ON y.k = x.k + 1),
 p AS (SELECT *, ar * 0.39::DOUBLE + ba * 0.39::DOUBLE + ve * 0.22::DOUBLE AS pl, CASE WHEN off <= 3000 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (off - 3000) / 12000.0::DOUBLE) END AS du FROM j)
 SELECT k, CAST(round_even(round(pl * 10000, 6), 0) AS BIGINT) AS plain_e4, CAST(round_even(round(CASE WHEN m1 <> 0 AND m2 <> 0 THEN ar * 0.32::DOUBLE + ba * 0.32::DOUBLE + ve * 0.18::DOUBLE + du * 0.18::DOUBLE ELSE pl END * 10000, 6), 0) AS BIGINT) AS timed_e4,
 greatest(0, least(10000, (len(list_intersect(q1, q2)) * 20000 + len(q1)) // (2 * len(q1))) - off // 15000 * 1000) AS song_e4 FROM p""",
    "tag_styles": "SELECT style, count(*) AS parts FROM (SELECT DISTINCT p_partkey, style FROM (SELECT p_partkey, unnest(string_split(upper(p_name), ' ')) AS t FROM part) JOIN (VALUES ('red', 'Warm'), ('blue', 'Cold'), ('green', 'Cold'), ('widget', 'Device'), ('gadget', 'Device')) AS v(key, style) ON regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') = key) GROUP BY 1",
    "work_left": """SELECT o_orderkey AS cache_key, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE (l_returnflag = 'A' AND l_partkey % 200 <= 180) OR (l_returnflag = 'N' AND l_partkey % 200 <= 30))""",
    "shared_queries": "SELECT asked, count(*) AS windows FROM (SELECT min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey, l_returnflag) AS asked FROM lineitem) GROUP BY 1",
    "recogniser_answers": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'no_match' WHEN event_id % 9 = 0 THEN 'error' ELSE 'match' END AS status, CASE WHEN event_id % 4 = 0 OR event_id % 9 = 0 THEN '' ELSE event_type END AS title,
 CASE WHEN event_id % 4 = 0 OR event_id % 9 = 0 THEN -1 ELSE CAST(CAST(round(value, 3) AS DECIMAL(12,3)) * 1000 AS BIGINT) END AS offset_ms, CASE WHEN event_id % 4 = 0 OR event_id % 9 = 0 THEN -1 ELSE event_id % 10 * 100 END AS skew_e6 FROM events""",
    "pointer_pages": "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\s')) AS BIGINT) AS links FROM pages",
    "contract_violations": "SELECT unnest(['quantity', 'discount', 'flags', 'ordered']) AS rule, unnest([count(*) FILTER (NOT l_quantity BETWEEN 1 AND 49), count(*) FILTER (NOT l_discount * 100 <= 9), count(*) FILTER (l_returnflag NOT IN ('A', 'N')), count(*) FILTER (NOT l_extendedprice > l_tax)]) AS violations FROM lineitem",
    "canonical_records": """SELECT digest, count(*) AS n FROM (SELECT sha256('{"b":{"a":' || l_partkey || ',"z":"' || l_returnflag || '"},"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"n":' || CASE WHEN l_linenumber > 3 THEN '"' || l_linestatus || '"' ELSE 'null' END || '}') AS digest FROM lineitem) GROUP BY 1""",
    "rms_energy": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / len(embedding)), 6) AS rms FROM embeddings",
    "json_fields": """WITH k AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT k, '{"k":' || k + 1 || ',"seen":true}' AS props, count(*) AS n FROM k GROUP BY ALL""",
    "map_counters": """WITH n AS (SELECT user_id, event_id % 2 AS h, event_type AS kind, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id FROM n GROUP BY 1 HAVING count(DISTINCT h) = 2) SELECT user_id, kind, max(n) AS most FROM n SEMI JOIN b USING (user_id) GROUP BY ALL""",
    "array_values": """WITH o AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS p, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1)
 SELECT l_orderkey, CAST(len(p) AS BIGINT) AS parts, CAST(list_sum(p) AS BIGINT) AS total, CAST(len(list_filter(p, lambda x: NOT list_contains(s, x))) AS BIGINT) AS only, p[-1] AS last, len(list_filter(p, lambda x: x % 7 = 0)) > 0 AS seventh FROM o""",
    "recent_orders": """SELECT o.o_orderkey, c.c_custkey, coalesce((SELECT max(p.o_totalprice) FROM orders p WHERE p.o_custkey = c.c_custkey AND p.o_orderkey < o.o_orderkey), 0) AS before_most
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c.c_custkey AND x.o_orderstatus = 'O') AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c.c_custkey AND x.o_orderpriority LIKE '5%')
 ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 10""",
}
