"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block. A line weighs its characters outside
links. Where the sum of weights over a sliding window of lines has fallen to
nothing a stretch of text ends (its dive point), and where it rises from nothing
the next one begins (its surge point); a stretch whose window sums reach a rise
is kept, from its first line that weighs something to its last.

Elements only add weight: a line of an article or main element weighs up to twice
as much, by the share of the page that the element holds, and a paragraph there
that is all link weighs as text. No window reaches over an article's edge. Lines
of menus, adverts, forms and the like, known by name, role or class, are no text
and weigh nothing; those in a row count as one. What a kept stretch stands in
comes along: the lines that weigh something of its articles and of those beside
them, and, outside of articles, the paragraphs of the element that holds its own.
A page is read in linear time, whatever it leaves unclosed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and the weight of a window that is a rise.
WINDOW, RISE = 3, 120
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""(>)|=\s*(["'])""")
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
_RAW = {*"script style noscript template textarea title iframe svg math object canvas audio video select xmp noembed noframes".split()}
_NEVER = {*"head nav footer aside form button menu dialog fieldset datalist".split()}
_BLOCKS = {
    *"address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
}
#: Elements that the end of what they stand in closes, and those that the next
#: one of a kind does (any block closes a p).
_OPTIONAL = {*"p li dt dd tr td th option optgroup".split()}
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option", "optgroup"}}
_ROLES = {*"navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()}
_WORDS = {
    *"ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations widget pagination pager search skip alert paywall".split()
}
#: Class words that tell of a layout, not of what an element holds.
_LAYOUT = {"has", "with", "no", "without", "is", "js", "hide", "show"}
#: What a part of a page doesn't hold: a class on an element around one of these
#: names a wrapper.
_CORE = {"article", "main", "h1"}


class _Tag(NamedTuple):
    start: int
    end: int
    name: str
    close: bool
    attrs: str


class _Line(NamedTuple):
    text: str
    #: characters outside links
    plain: int
    #: never text
    never: bool
    heading: bool
    paragraph: bool
    #: number of the outermost article or main element, or -1
    inside: int
    #: what stands or falls with it: articles by what they are in, paragraphs too
    group: tuple[str, int] | None


def _tags(page: str) -> Iterator[_Tag]:
    """The tags of a page in order; comments, declarations and elements whose
    text is no prose come as nameless tags. No part is searched twice: what was
    once not found further on isn't looked for again."""
    gone: set[str] = set()

    def find(what: str, at: int) -> int:
        if what in gone:
            return -1
        k = page.find(what, at)
        if k < 0:
            gone.add(what)
        return k

    def tag_end(at: int) -> int:
        """After the > that closes a tag, quoted ones apart; -1 if none does."""
        first = at
        while "tag" not in gone:
            m = _STOP.search(page, at)
            if not m:
                gone.add("tag")
            elif m[1]:
                return m.end()
            else:
                k = find(m[2], m.end())
                if k < 0:
                    gone.add("tag")  # an open quote: from here on any > closes
                at = k + 1
        return find(">", first) + 1 or -1

    at = 0
    while (at := page.find("<", at)) >= 0:
        nxt = page[at + 1 : at + 2]
        if nxt in ("!", "?"):
            if page.startswith("<!--", at):
                end = find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at) and (k := find("]]>", at)) >= 0:
                end = k + 3
            else:
                end = find(">", at) + 1 or at + 1
            yield _Tag(at, end, "", False, "")
            at = end
            continue
        close = nxt == "/"
        m = _NAME.match(page, at + 1 + close)
        end = tag_end(m.end()) if m else -1
        if end < 0:
            at += 1
            continue
        name = m[0].lower()
        if not close and name in _RAW and not (name in ("svg", "math") and page[end - 2] == "/"):
            mark = f"</{name}"
            back = _closing(name).search(page, end) if mark not in gone else None
            if back:
                yield _Tag(at, back.end(), "", False, "")
                at = back.end()
                continue
            gone.add(mark)
            if name in ("script", "style"):
                yield _Tag(at, len(page), "", False, "")
                return
        yield _Tag(at, end, name, close, page[m.end() : end - 1])
        at = end


_CLOSING: dict[str, re.Pattern] = {}


def _closing(name: str) -> re.Pattern:
    if name not in _CLOSING:
        _CLOSING[name] = re.compile(rf"</{name}\s*>", re.I)
    return _CLOSING[name]


def _named(tag: _Tag, inside: bool) -> str:
    """"name" or "class" if that tells that an element isn't text, else empty."""
    if tag.name in _NEVER or (tag.name == "header" and not inside):
        return "name"
    if not tag.attrs.strip() or tag.name in ("html", "body", "main", "a"):
        return ""
    for m in _ATTR.finditer(tag.attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" and not value.startswith("until") or key == "aria-hidden" and value == "true":
            return "name"
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return "name"
        if key == "role" and value in _ROLES:
            return "class"
        if key in ("class", "id"):
            for c in value.split():
                parts = re.split(r"[-_:]+", c)
                if not _LAYOUT.intersection(parts) and (parts[0] in _WORDS or parts[-1] in _WORDS):
                    return "class"
    return ""


class _Place(NamedTuple):
    """What the text after a tag stands in."""

    name: str
    inside: int
    group: tuple[str, int] | None


def _structure(tags: list[_Tag]) -> tuple[list[tuple[int, int]], list[_Place]]:
    """Numbers of the tags where an element without text begins and ends, and
    the place after each tag. Only closed elements are without text: the name of
    one that isn't closed before what it stands in says nothing of what follows."""
    out: list[tuple[int, int]] = []
    places: list[_Place] = []
    stack: list[tuple[str, int, str, int]] = []  # name, number, why not text, cores before
    depth: dict[str, int] = {}
    articles = cores = 0
    # the outermost article or main element, and what the outermost article is in
    inside = outer = -1

    def pop(at: int, closed: bool) -> None:
        nonlocal articles
        name, first, why, before = stack.pop()
        depth[name] -= 1
        articles -= name == "article"
        if closed and (why == "name" or why == "class" and cores == before):
            out.append((first, at))

    def take(i: int, t: _Tag) -> None:
        nonlocal articles, cores, inside, outer
        if not t.name or t.name in _VOID:
            return
        if t.close:
            if depth.get(t.name):
                while stack[-1][0] != t.name:
                    pop(i, stack[-1][0] in _OPTIONAL)
                pop(i, True)
            return
        if stack and (stack[-1][0] in _SELF.get(t.name, ()) or (stack[-1][0] == "p" and t.name in _BLOCKS)):
            pop(i, True)
        why = _named(t, articles > 0)
        if t.name in _BLOCKS or why:
            if t.name in ("article", "main") and not (articles or depth.get("main")):
                inside = i
            if t.name == "article" and not articles:
                outer = stack[-1][1] if stack else -1
            stack.append((t.name, i, why, cores + (t.name in _CORE)))
            depth[t.name] = depth.get(t.name, 0) + 1
            articles += t.name == "article"
        cores += t.name in _CORE

    for i, t in enumerate(tags):
        take(i, t)
        name = stack[-1][0] if stack else ""
        group = ("a", outer) if articles else ("p", stack[-2][1] if len(stack) > 1 else -1) if name == "p" else None
        places.append(_Place(name, inside if articles or depth.get("main") else -1, group))
    return out, places


def lines(page: str) -> list[_Line]:
    """A page's lines; those that are never text in a row as one empty line."""
    tags = list(_tags(page))
    opens, ends = [0] * (len(tags) + 1), [0] * (len(tags) + 1)
    excluded, places = _structure(tags)
    for a, b in excluded:
        opens[a] += 1
        ends[b] += 1
    out: list[_Line] = []
    parts: list[str] = []
    nowhere = _Place("", -1, None)
    place = nowhere
    plain = links = never = at = 0
    heading = False

    def flush() -> None:
        nonlocal parts, plain
        if parts:
            t = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if t:
                out.append(_Line(t, plain, False, heading, place.name == "p", place.inside, place.group))
        parts, plain = [], 0

    for i, t in enumerate([*tags, _Tag(len(page), len(page), "", False, "")]):
        text = page[at : t.start]
        if text and not never:
            if not parts:
                place = places[i - 1] if i else nowhere
            parts.append(text)
            if not links and not text.isspace():
                plain += len(text)
        at = t.end
        never += opens[i] - ends[i]
        if opens[i] and t.name in _BLOCKS:
            flush()
            if not (out and out[-1].never):
                out.append(_Line("", 0, True, False, False, -1, None))
        if t.name == "a":
            links = max(0, links + (-1 if t.close else 1))
        elif t.name in _BLOCKS:
            flush()
            links = 0
            heading = not t.close and t.name in ("h1", "h2", "h3")
        elif t.name in ("br", "td", "th"):
            parts.append(" ")
    flush()
    return out


def weights(page_lines: list[_Line]) -> list[float]:
    """What each line weighs."""
    own = [x.plain or (len(x.text) if x.paragraph and x.inside >= 0 else 0) for x in page_lines]
    held: dict[int, int] = {}
    for x, w in zip(page_lines, own, strict=True):
        held[x.inside] = held.get(x.inside, 0) + w
    held[-1], total = 0, max(1, sum(own))
    return [w * (1 + held[x.inside] / total) for x, w in zip(page_lines, own, strict=True)]


def _windowed(page_lines: list[_Line]) -> list[int]:
    """The lines' numbers in order, with a window of -1 wherever an article, or
    a row of articles, begins or ends."""
    out: list[int] = []
    last = None
    for k, x in enumerate(page_lines):
        if not x.never:
            article = x.group if x.group and x.group[0] == "a" else None
            if out and article != last:
                out += [-1] * WINDOW
            last = article
        out.append(k)
    return out


def main_text(page: str) -> str:
    """The main text of a page, its blocks joined by newlines; empty if none."""
    ls = lines(page)
    own = weights(ls)
    at = _windowed(ls)
    weigh = [own[k] if k >= 0 else 0 for k in at]
    n = len(at)
    # sums over the window that begins with a line
    upto = list(accumulate(weigh, initial=0))
    sums = [upto[min(i + WINDOW, n)] - upto[i] if any(weigh[i : i + WINDOW]) else 0 for i in range(n)]
    rise = min(RISE, max(sums, default=0))
    kept: set[int] = set()
    i = 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        surge = dive = i
        while dive < n and sums[dive]:
            dive += 1
        i = dive
        if max(sums[surge:dive]) < rise:
            continue
        while not weigh[surge]:
            surge += 1
        while not weigh[dive - 1]:
            dive -= 1
        kept.update(k for k in at[surge:dive] if k >= 0)
        # headings right before the text belong to it, also where they weigh nothing
        k = at[surge]
        while k and ls[k - 1].heading:
            k -= 1
            kept.add(k)
    groups = {ls[k].group for k in kept if ls[k].group and own[k]}
    kept.update(k for k, x in enumerate(ls) if own[k] and x.group in groups)
    return "\n".join(ls[k].text for k in sorted(kept) if not ls[k].never)


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """`df` with `out`, the main text of `page`, in its place. Null counts as
    the empty page and has the empty text; every row, repeats included, is kept;
    a column named `out` is replaced. Pages are handled one by one, whole."""
    names = [c for c in df.columns if c not in (page, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(v.as_py() or "") for v in b.column(page)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), text], names=[*names, out])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)
    return df.select(*names, F.col(page)).mapInArrow(run, f"{fields}`{out}` string")
