"""Accents, case and spaces, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "không rõ"


@cache
def _table(dstroke: bool) -> tuple[str, str]:
    """Characters of the Latin and compatibility blocks and the single one that remains of each without its accents."""
    pairs = {}
    for block in (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0xFF01, 0xFF5F)):
        for code in block:
            c = chr(code)
            plain = "".join(x for x in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c)) if unicodedata.category(x) != "Mn").lower()
            if len(plain) == 1 and plain != c:
                pairs[c] = plain
    if dstroke:
        pairs |= {"đ": "d", "Đ": "d"}
    return "".join(pairs), "".join(pairs.values())


def deaccent(c: Column, dstroke: bool = True) -> Column:
    """Lower case without accents; ``dstroke`` also turns đ into d. Null stays null."""
    old, new = _table(dstroke)
    return F.lower(F.regexp_replace(F.translate(c, old, new), r"\p{Mn}", ""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def flat(c: Column) -> Column:
    """Accent-free, lower-case, single-spaced; null counts as empty."""
    return squeeze(deaccent(F.coalesce(c, F.lit(""))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once per row, which branches of a condition otherwise do each for themselves."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slug(c: Column) -> Column:
    """Accent-free words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(deaccent(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def group(c: Column, pattern: str, i: int = 1) -> Column:
    """A group of the first match; null without match or if the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


#: Stands between the parts of a text that is cut at its matches; flat text has no control characters.
CUT = "\x01"


def contexts(t: Column, pattern: str | Column, reach: int) -> Column:
    """Array of (match, left, right): each match of a pattern and up to ``reach`` characters before and after it. The text is cut at its
    matches, so the k-th part, the k-th match and what follows stand at one place and no match is sought a second time."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts, found = F.split(F.regexp_replace(t, pattern, F.lit(CUT)), CUT), F.regexp_extract_all(t, pattern, F.lit(0))

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.length(F.element_at(parts, acc["k"]))
        left = F.substring(t, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)))
        right = F.substring(t, at + F.length(m) + 1, F.lit(reach))
        one = F.struct(m.alias("match"), left.alias("left"), right.alias("right"))
        return F.struct((acc["k"] + 1).alias("k"), (at + F.length(m)).alias("at"), F.array_append(acc["out"], one).alias("out"))

    none = F.array().cast("array<struct<match:string,left:string,right:string>>")
    return F.aggregate(found, F.struct(F.lit(1).alias("k"), F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])


def first_matching(c: Column, labelled: list[tuple[str, str]], default: str = UNKNOWN) -> Column:
    """The label of the first pattern that is found."""
    out = F.lit(default)
    for label, pattern in reversed(labelled):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out
