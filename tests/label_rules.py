"""Label tolerances pair by pair in plain Python, for tests of the joins."""

from __future__ import annotations

import re

from tidemark.functions.titles import _BRACKETS, label_words


def _sound(w: str) -> str:
    """A word by its sound, roughly: hard and soft letters as one, no vowels but
    the first letter, no doubles."""
    for a, b in (("ph", "f"), ("ck", "k"), ("qu", "k"), ("x", "ks"), ("c", "k"), ("z", "s"), ("v", "f"), ("y", "i")):
        w = w.replace(a, b)
    w = w[:1] + re.sub("[aeiouhw]", "", w[1:])
    return re.sub(r"(.)\1+", r"\1", w)


def _stem(w: str) -> str:
    return re.sub(r"(?:ing|in|ed|es|s)$", "", w) if len(w) > 4 else w


def _near(a: str, b: str) -> bool:
    """Equal, or of four letters or more and one edit apart."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


#: How two titles may be one (in this order): name, and a test of two word lists.
#: Tolerance of a title: after words that lead in; without spaces; as joined
#: words; before a descriptor; one of two titles; by stems; by sound.
_LEADS = ("i think", "think", "it is", "its", "this is", "sounds like", "maybe")
TITLE_TOLERANCES = (
    ("lead_in", lambda a, b: any(" ".join(x).startswith(lead + " ") and x[len(lead.split()) :] == y for lead in _LEADS for x, y in ((a, b), (b, a)))),
    ("spaced", lambda a, b: len(a) != len(b) and "".join(a) == "".join(b)),
    ("joined", lambda a, b: any(len(x) == 1 and len(y) > 1 and _near(x[0], "".join(y)) for x, y in ((a, b), (b, a)))),
    ("descriptor", lambda a, b: any(len(x) >= 2 and len(y) > len(x) and y[: len(x)] == x for x, y in ((a, b), (b, a)))),
    ("stem", lambda a, b: len(a) == len(b) and [_stem(x) for x in a] == [_stem(y) for y in b]),
    ("phonetic", lambda a, b: len(a) == len(b) and all(min(len(x), len(y)) > 3 or x == y for x, y in zip(a, b, strict=True)) and [_sound(x) for x in a] == [_sound(y) for y in b]),
)
#: And two artists: one letter off in a word of each; initials for words.
ARTIST_TOLERANCES = (
    ("artist_slip", lambda a, b: len(a) == len(b) and all(_near(x, y) for x, y in zip(a, b, strict=True))),
    ("initials", lambda a, b: any(len(x) == 1 and len(y) > 1 and x[0] == "".join(w[0] for w in y) for x, y in ((a, b), (b, a)))),
)


def label_tolerances(artist_a: str, title_a: str, artist_b: str, title_b: str) -> list[str] | None:
    """By which tolerances two labels name one work: none needed gives an empty
    list, and null means that they don't. Never loose on both parts; a title of
    two by " / " or brackets may match by either one (alt_title)."""
    strip = lambda t: label_words(_BRACKETS.sub(" ", t or ""))
    aa, ab, ta, tb = strip(artist_a), strip(artist_b), strip(title_a), strip(title_b)
    if not (aa and ab and ta and tb):
        return None
    if aa == ab and ta == tb:
        return []
    if aa == ab:
        alt = [[label_words(p) for p in re.split(r"\s+/\s+|[()\[\]]", t) if label_words(p)] for t in (title_a, title_b)]
        if any(x == y for x in alt[0] for y in alt[1] if len(x) > 0):
            return ["alt_title"]
        return next(([n] for n, ok in TITLE_TOLERANCES if ok(ta, tb)), None)
    if ta == tb:
        return next(([n] for n, ok in ARTIST_TOLERANCES if ok(aa, ab)), None)
    return None
