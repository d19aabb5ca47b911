import html as html_lib
import random
import re
import time
from collections import defaultdict

import duckdb
import pytest

from tidemark.llm import html_text, license_scan, line_dedup
from tidemark.llm.q_text import ORACLE_SQL, op4_license, op6_html, op10_line_dedup

SF = "/root/testdata/sf0.01"


def licenses(text, dice=0.8):
    out = {}
    text = text or ""
    for unit in dict.fromkeys([*text.split("\n"), *re.split(r"\n\s*\n", text), text]):
        a, best = set(license_scan.bigrams(unit)), (0, "")
        for name, t in license_scan.TEMPLATES.items():
            b = set(license_scan.bigrams(t))
            if a:
                best = max(best, (2 * len(a & b) / (len(a) + len(b)), name))
        if best[0] >= dice - 1e-12:
            n, top = out.get(best[1], (0, 0))
            out[best[1]] = (n + 1, max(top, best[0]))
    return {k: (n, round(d, 6)) for k, (n, d) in out.items()}


def test_license_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, k): v for i, t in docs.items() for k, v in licenses(t).items()}
    got = {(r.doc_id, r.license): (r.n_units, r.dice) for r in op4_license(spark, SF).collect()}
    assert want and got == want


def test_license_odd_rows(spark):
    mit = license_scan.TEMPLATES["MIT"]
    cut = mit.replace("AS IS", "As-Is").replace("merge, ", "")
    rows = [(1, mit), (2, cut), (3, "intro words\n\n" + cut + "\n\nmore words"), (4, None), (5, ""), (6, "All"), (7, "ALL RIGHTS\tRESERVED!\nall rights reserved"), (7, "x"), (8, mit * 40), (None, "Released under the MIT License"), (9, "Permission is granted")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license", "2 as dice")
    got = defaultdict(dict)
    for r in license_scan.scan(d).collect():
        got[r.doc_id][r.license] = r.n_units
    want = {i: {k: n for k, (n, _) in licenses(t).items()} for i, t in rows if t != "x"}
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert "MIT" in got[2] and "MIT" in got[3] and got[7] == {"All rights reserved": 3}
    assert license_scan.scan(d.where("false")).count() == 0
    assert license_scan.scan(d, templates={}).count() == 0


def test_license_within_longer_text(spark):
    split = lambda name, *at: "\n\n".join(re.split("(?=" + "|".join(at) + ")", license_scan.TEMPLATES[name]))
    mit = split("MIT", "The above copyright", "THE SOFTWARE IS")
    gpl = re.sub("(.{50,70}) ", r"\1\n", split("GPL-3.0 header", "This program is distributed", "You should have"))
    prose = "\n".join(f"Line {i} of the prose around it has own words about nothing at all." for i in range(200))
    rows = [(1, f"{prose}\n\n{mit}\n\n{prose}"), (2, f"{prose}\n{gpl}\n{prose}"), (3, prose + " Released under the MIT License. More prose. " + prose)]
    rows += [(4, f"{mit}\n\n{prose}\n\n{gpl}\n{prose}\n{mit}"), (5, prose), (6, "of software released in the Apache project under a license " * 50)]
    assert not any(licenses(t) for _, t in rows)
    got = sorted((r.doc_id, r.license, r.dice, r.n_units) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "MIT", 1.0, 1), (2, "GPL-3.0 header", 1.0, 1), (3, "MIT notice", 1.0, 1), (4, "GPL-3.0 header", 1.0, 1), (4, "MIT", 1.0, 2)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="with-sidebar">
<header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=sidebar><p>Side</p></div>
<article><header><h1>Head &amp; line</h1></header><p>First  para\n with <b>bold</b><br>and &eacute;&#x41;.</p><div class="ad-slot"><p>Buy</p></div>
<p>Second.<p>Third, unclosed <form><input value="<p>x</p>"><label>Mail</label></form><ul><li>one</li><li>two</li></ul>
<section class="comments"><p>Nice post</p></section></article><aside>More</aside><footer>&copy; us</footer></body></html>"""

TEXT = "Head & line\nFirst para with bold and éA.\nSecond.\nThird, unclosed\none\ntwo"


def test_main_text():
    assert html_text.main_text(PAGE) == TEXT
    plain = PAGE.replace("<article>", "<div class=post>").replace("</article>", "</div>").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert html_text.main_text(plain) == TEXT
    assert html_text.main_text("") == "" and html_text.main_text("<p> </p><!-- x") == ""
    assert html_text.main_text("just text &lt;b&gt;") == "just text <b>"
    menu = "<div><a href=/a>A long menu entry that says a lot</a></div>" * 8
    body = "<p>" + "Words of the article itself. " * 9 + "</p><p>End.</p>"
    assert html_text.main_text(f"<body>{menu}{body}{menu}</body>") == ("Words of the article itself. " * 9).strip() + "\nEnd."
    assert html_text.main_text("<article><p>kept</p><div class=ad>never closed <p>kept too</p></article>".replace("</div>", "")).startswith("kept")


def test_main_text_searches_everywhere():
    long = "Words of the article itself. " * 9
    links = "<div><a href=/a>A link to something else</a></div>" * 4
    paras = [f"Short line {i}." for i in range(6)]
    body = "<h1>Head</h1>" + "".join(f"<p>{p}</p>" for p in paras) + f"<p>{long}</p><p>End.</p>"
    want = "\n".join(["Head", *paras, long.strip(), "End."])
    # without article or main: the surge goes up over plain lines
    assert html_text.main_text(f"<body>{links}{body}{links}</body>") == want
    # links before and after the text of an article or main aren't its text
    for tag in ("article", "main"):
        assert html_text.main_text(f"<{tag}>{links}{body}{links}</{tag}><p>Other</p>") == want
    # every part is kept, and none of what is only links
    parts = f"<article>{body}</article><p>Between</p><article>{links}</article><article><p>Second part.</p></article>"
    assert html_text.main_text(parts) == want + "\nSecond part."
    assert html_text.main_text(f"<article>{links}</article><main>{body}</main>") == want


def story_page(rng):
    """A page and the text that a reader would call its article."""
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    link = lambda: f'<a href="/{word()}">{text(4)}</a>'
    want, body = [], []

    def block(tag, n, wrap="{}"):
        t = text(n)
        want.append(t + rng.choice(["", " & é"]))
        body.append(f"<{tag}>" + wrap.format(t) + want[-1][len(t) :].replace("&", "&amp;").replace("é", "&eacute;") + f"</{tag}>")

    box = rng.choice(["article", "main", "div", 'div class="post"', "section"])
    block("h1", 5)
    noise = [lambda: f'<div class="ad-slot"><p>{text(30)}</p></div>', lambda: f"<aside><p>{text(40)}</p></aside>", lambda: f"<form><label>{text(3)}</label><button>{text(2)}</button></form>", lambda: f'<ul class="share">{"<li>" + link() + "</li>"}</ul>', lambda: f"<script>var a = '<p>{text(9)}</p>';</script>", lambda: f"<!-- <p>{text(9)}</p> -->"]
    for _ in range(rng.randint(3, 9)):
        block("p", rng.choice([3, 12, 30, 60, 90]), rng.choice(["{}", "{}", "<b>{}</b>", "{} ", "\n {}\n"]))
        if rng.random() < 0.4:
            body.append(rng.choice(noise)() * rng.randint(1, 3))
    block("p", 40)
    block("p", 50)
    if rng.random() < 0.3:
        body.append("".join(f"<div>{link()}</div>" for _ in range(4)))
        block("p", rng.choice([2, 60]))
    if box in ("article", "main") and rng.random() < 0.5:
        block("p", 4, "<a href=/report>{}</a>")
    if rng.random() < 0.5:
        body.append(f'<section class="comments"><h2>{text(2)}</h2>{"".join(f"<p>{text(25)}</p>" for _ in range(5))}</section>')
    nav = f"<nav><ul>{''.join(f'<li>{link()}</li>' for _ in range(6))}</ul></nav>"
    before = rng.choice(["", f'<div class="cookie-notice"><p>{text(40)}</p></div>', f"<header><h2>{text(3)}</h2></header>", f"<div>{text(4)}</div>" + f"<div>{link()}</div>" * 3])
    cards = "".join(f"<article><h3>{link()}</h3><p>{text(5)}</p></article>" for _ in range(4))
    after = rng.choice(["", cards if box != "article" else "", f"<div>{cards}</div>", f'<div id="related-stories">{"<p>" + text(30) + "</p>"}</div>', f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(7))}</ul>"])
    page = f"<!DOCTYPE html><html><head><title>{text(4)}</title><style>p{{}}</style></head><body>{nav}{before}<{box}>{''.join(body)}</{box.split()[0]}>{after}<footer><p>&copy; {text(30)}</p></footer></body></html>"
    return page, "\n".join(want)


def test_articles_of_made_pages():
    """Pages whose article is known, with what pages have around and in it."""
    rng = random.Random(5)
    for _ in range(600):
        page, want = story_page(rng)
        assert html_text.main_text(page) == want, page


def test_story_beside_teasers():
    story = "".join(f"<p>Sentence {i} of the story is told here in full.</p>" for i in range(8))
    want = "\n".join(f"Sentence {i} of the story is told here in full." for i in range(8))
    cards = "".join(f"<article><h3><a href=x>Other story {i}</a></h3><p>A teaser of story {i}.</p></article>" for i in range(4))
    for page in (f"<div>{story}</div>{cards}", f"{cards}<div>{story}</div>", f"<main><div>{story}</div><div>{cards}</div></main>"):
        assert html_text.main_text(f"<body>{page}</body>") == want
    links = "<div><a href=/a>A link to something else</a></div>" * 3
    assert html_text.main_text(f"<div>{story}{links}<p>The end.</p></div><div><p>Own.</p></div>") == want + "\nThe end."
    assert html_text.main_text(f"<article>{story}<p><a href=/r>See the full report</a></p></article>") == want + "\nSee the full report"
    assert html_text.main_text(f"<h1>Head</h1><article>{story}</article>") == "Head\n" + want


def test_html_query(spark):
    got = {r.page_id: r for r in op6_html(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = re.sub("<br>", " ", re.search("<article>(.*?)</article>", r.html, re.S)[1])
        blocks = [re.sub(r"\s+", " ", html_lib.unescape(re.sub("<[^>]+>", "", b))).strip() for b in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
        # the distribution finds the same text without the elements
        assert html_text.main_text(re.sub("<(/?)article>", r"<\1div>", r.html)) == got[r.page_id].text


def test_structure_only_weighs():
    long = "Words of the article itself. " * 9
    teaser = f'<article><p class="teaser">Lead.</p><p>{long}</p></article>'
    assert html_text.main_text(teaser) == "Lead.\n" + long.strip()
    assert html_text.main_text(f"<article><p>One.</p></article><div>{'<p><a>x</a></p>' * 5}</div><article><p>{long}</p></article>") == "One.\n" + long.strip()
    # articles that hold next to nothing don't decide
    assert html_text.main_text(f"<article><a>Other story</a> new</article><div><p>{long}</p><p>{long}</p></div>").count("Words") == 18
    assert html_text.main_text(f'<div class="widget"><h1>Head</h1><p>{long}</p></div>') == "Head\n" + long.strip()
    assert html_text.main_text(f"<article><p>{long} <span class=ad>Buy</span> end</p></article>") == long.strip() + " end"
    assert html_text.main_text(f"<article><p>{long}</p><p class=ad>Buy<p>End</article>") == long.strip() + "\nEnd"
    assert html_text.main_text("<p>a <b and c's > d</p> <p>it's</p>") == "a d\nit's"


@pytest.mark.parametrize("piece", ["<div class=ad>", "<p class='", '<a href="', "<", "<!--", "<textarea>", "<p>x</p>", "</div>", "<b x=y", "<![CDATA[", "&amp", "<div class=ad><p>", "id " * 9, "<a " + " " * 50])
def test_hostile_pages_take_linear_time(piece):
    def took(n):
        page = piece * (n // len(piece))
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            html_text.main_text(page)
            best = min(best, time.perf_counter() - start)
        return best

    assert took(1_000_000) < 12 * took(125_000) + 0.1


def test_html_odd_rows(spark):
    d = spark.createDataFrame([(1, None), (1, None), (None, "<p>x"), (2, "<p>" + "y " * 100_000)], "page_id long, html string").selectExpr("*", "0 as text")
    assert sorted(r.text for r in html_text.extract(d).collect())[:3] == ["", "", "x"]
    assert html_text.extract(d.where("false")).count() == 0


def deduped(rows, least=5, keep_first=True):
    """Every line's template by its leaf's tokens, made more general twice, and
    the texts without those in enough documents."""
    leaves, tokens = defaultdict(int), defaultdict(int)
    parsed = {}
    for k, (_, t) in enumerate(rows):
        for pos, x in enumerate((t or "").split("\n")):
            w = ["<#>" if re.search("[0-9]", x) else x for x in re.findall("[^\x20\x09-\x0d]+", x)]
            if w:
                leaf = len(w), tuple(w[: min(2, len(w) // 3)])
                parsed[k, pos] = leaf, w
                leaves[leaf] += 1
                for i, x in enumerate(w):
                    tokens[leaf, i, x] += 1
    fits = lambda w: 10 * w.count("<*>") <= 3 * len(w) and 10 * (w.count("<*>") + w.count("<#>")) <= 5 * len(w)
    first = {}
    for at, (leaf, w) in parsed.items():
        w = tuple(x if x == "<#>" or tokens[leaf, i, x] >= least else "<*>" for i, x in enumerate(w))
        if leaves[leaf] >= least and fits(w):
            first[at] = leaf, w
    now = {p: p for p in first.values()}
    for _ in range(2):
        rest = defaultdict(set)
        for leaf, w in set(now.values()):
            for i, x in enumerate(w):
                rest[leaf, i, w[:i] + w[i + 1 :]].add(x)
        field = lambda g: len(g) >= least or len(g) > 1 and "<*>" in g
        for p, (leaf, w) in now.items():
            wider = tuple("<*>" if field(rest[leaf, i, w[:i] + w[i + 1 :]]) else x for i, x in enumerate(w))
            now[p] = leaf, wider if fits(wider) else w
    keys, held = {at: now[p] for at, p in first.items()}, defaultdict(set)
    me = [(1 << 62 if i is None else i, t) for i, t in rows]
    for (k, _), key in keys.items():
        held[key].add(me[k])
    out = []
    for k, (i, t) in enumerate(rows):
        if t is None:
            out.append((i, None, 0, 0))
            continue
        ls = t.split("\n")
        goes = lambda p: (q := keys.get((k, p))) and len(held[q]) >= least and not (keep_first and min(held[q]) == me[k])  # noqa: E731, B023
        kept = [x for p, x in enumerate(ls) if not goes(p)]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return out


def test_line_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in op10_line_dedup(spark, SF).collect())
    assert got == sorted(deduped(docs)) and sum(r[3] for r in got) > 100


@pytest.mark.parametrize("name", ["op4_license", "op10_line_dedup"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    rows = {"op4_license": op4_license, "op10_line_dedup": op10_line_dedup}[name](spark, sf)
    want = c.sql(ORACLE_SQL[name]).project(", ".join(rows.columns)).fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want) and want


@pytest.mark.parametrize("names", [10, 50, 200])
def test_frequent_values_are_fields_too(spark, names):
    line = lambda i: f"Posted by {'abcdefghij'[i % names % 10]}name{'klmnopqrstuvwxyz'[i % names // 10 % 16]}{'xy'[i % names // 160]} in the {'abcdefghij'[i // 10 % 10]}section section today"
    rows = [(i, f"own {'pqrstuvw'[i % 8]}{'pqrstuvw'[i // 8 % 8]}{'pqrstuvw'[i // 64]} words\n{line(i)}") for i in range(200)]
    out = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == {i: t if i == 0 else t.split("\n")[0] for i, t in rows}


def test_line_odd_rows(spark):
    note = "This page was printed on day {} by the office for user {} only"
    rows = [(i, f"own words of {'abcdefghij'[i]} alone here now\n" + note.format(i, "pqrstuvwxy"[i])) for i in range(8)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "Of."), (54, note.format(9, "z")), (None, note.format(4, "k")), (55, "long line of many words " * 20_000)]
    rows += [(56, "same same same same\nsame same same same")] * 2
    rows += [(60 + i, "4 5 6 7\n8\n" + "Page 9\n" * (i % 2)) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as n_lines", "1 as line", "2 as key", "3 as _id", "4 as id", "5 as row", "6 as `_dk`", "7 as `a.b`")
    out = line_dedup.drop_recurring_lines(d).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out), key=key) == sorted(deduped(rows), key=key)
    assert all((r.line, r.key, r["_id"], r["id"], r["row"], r["_dk"], r["a.b"]) == (1, 2, 3, 4, 5, 6, 7) for r in out)
    assert {r.doc_id: r.text for r in out}[54] == "" and {r.doc_id: r.text for r in out}[63] == "4 5 6 7\n8\n"
    every = line_dedup.drop_recurring_lines(d, keep_first=False).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in every), key=key) == sorted(deduped(rows, keep_first=False), key=key)
    assert {r.doc_id: r.text for r in every}[0] == ""
    assert line_dedup.drop_recurring_lines(d.where("false")).count() == 0


def test_several_fields_of_a_template(spark):
    names = "Alice Bob Carol Dan Eve Frank".split()
    towns = "Rome Oslo Bern Kyiv Lima Baku".split()
    line = "Posted by {} in the {} office on day {} of the year"
    rows = [(i, f"Les.\n\n{line.format(n, towns[i], i)}\nown {'pqrstu'[i]}\nAll rights reserved.") for i, n in enumerate(names)]
    # two thirds alike, but too many fields
    rows += [(10 + i, "It is said that " + " ".join(f"{w}{'abcdef'[i]}" for w in ("one", "two", "tri", "for", "fiv"))) for i in range(6)]
    out = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: t if i == 0 or i >= 10 else f"\nown {'pqrstu'[i]}" for i, t in rows}
