"""Text columns. Lengths and places are code points."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "(?U)\\s"


def _letters() -> tuple[str, str]:
    """(letters, bases): the small letters of all scripts below U+2000 that decompose into another letter and marks, and that letter."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000)}
    some = {c: d[0] for c, d in parts.items() if len(d) > 1 and c == c.lower() and all(unicodedata.category(m) == "Mn" for m in d[1:])}
    return "".join(some), "".join(some.values())


_ACCENTED, _PLAIN = _letters()


def trim(text: Column) -> Column:
    """Without white space (any of Unicode's) at either end."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def tokens(text: Column) -> Column:
    """The parts between white space; none for blank text."""
    return F.filter(F.split(text, SPACE + "+"), lambda x: x != "")


def normalise(text: Column) -> Column:
    """One blank for any white space, none at the ends, lower case."""
    return F.lower(F.array_join(tokens(text), " "))


def fold(text: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or marks of their own after it."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), "\\p{Mn}+", "")


def quote(text: Column) -> Column:
    """Text as a pattern that matches it alone."""
    return F.regexp_replace(text, "([\\\\.\\[\\]{}()*+?^$|#&~\\-])", "\\\\$1")


def needle_pattern(needle: Column) -> Column:
    """A pattern for all occurrences of a needle: any white space between its tokens, any case, word bounds where a token's ends are letters or digits."""
    edge = "(?U)[\\p{L}\\p{N}]"

    def token(t: Column) -> Column:
        opening = F.when(F.substring(t, 1, 1).rlike(edge), "\\b").otherwise("")
        closing = F.when(F.substring(t, -1, 1).rlike(edge), "\\b").otherwise("")
        return F.concat(opening, quote(t), closing)

    return F.concat(F.lit("(?iuU)"), F.array_join(F.transform(tokens(needle), token), "\\s+"))


def listed(token: Column, words) -> Column:
    """Whether a token is one of the words; the list is one literal array."""
    items = ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)
    return F.array_contains(F.expr(f"array({items})"), token)


def contains_any(text: Column, hints) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | text.contains(h)
    return out
