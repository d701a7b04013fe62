"""All occurrences of many needles in one scan of a text: an automaton of a document's needles in place of a pattern for each.

Needles match as :func:`velum.functions.text.needle_pattern` says: any case, any white space between tokens, word bounds where the needle's
ends are letters or digits; of one needle's overlapping occurrences the leftmost count.
"""

from __future__ import annotations

import bisect
import collections
import functools
from collections.abc import Callable, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space and word characters as Java's patterns have them under (?U).
_SPACE = regex.compile(r"\p{White_Space}")
_WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]")
_EDGE = regex.compile(r"[\p{L}\p{N}]")
#: White space that isn't one blank alone.
_UNEVEN = regex.compile(r"\p{White_Space}{2}|[^\P{White_Space} ]")
_RUN = regex.compile(r"\p{White_Space}+")
_SPACES = np.array([c for c in range(0x3001) if _SPACE.match(chr(c))], np.uint32)


class _Folded(dict):
    """Each character's fold, itself one character: upper case, then lower case."""

    def __missing__(self, code: int) -> int:
        upper = chr(code).upper()
        lower = (upper if len(upper) == 1 else chr(code)).lower()
        self[code] = out = ord(lower) if len(lower) == 1 else code
        return out


_FOLDED = _Folded()


@functools.lru_cache(65_536)
def _is_word(char: str) -> bool:
    return _WORD.match(char) is not None


def key_of(needle: str | None) -> str:
    """A needle without case, with single blanks and none at its ends."""
    return _RUN.sub(" ", (needle or "").translate(_FOLDED)).strip(" ")


def folded(text: str) -> tuple[str, Sequence[int]]:
    """(text without case, with one blank for each run of white space; the place in the text of each of its characters)."""
    body = text.translate(_FOLDED)
    if not _UNEVEN.search(body):
        return body, range(len(body))
    codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(codes, _SPACES)
    kept = np.flatnonzero(~(space & np.append(False, space[:-1])))
    return np.where(space[kept], np.uint32(32), codes[kept]).tobytes().decode("utf-32-le", "surrogatepass"), kept


def places(text: str, needles: list[str]) -> list[list[int]]:
    """For each needle the starts and ends of its occurrences, one after another; none of a blank needle."""
    automaton, own = ahocorasick.Automaton(), {}
    for i, needle in enumerate(needles):
        key = key_of(needle)
        if key:
            own.setdefault(key, []).append(i)
    out: list[list[int]] = [[] for _ in needles]
    if not own:
        return out
    for key in own:
        automaton.add_word(key, (key, _EDGE.match(key[0]) is not None, _EDGE.match(key[-1]) is not None))
    automaton.make_automaton()
    body, at = folded(text)
    hits: dict[str, list[int]] = {}
    until: dict[str, int] = {}
    for last, (key, opening, closing) in automaton.iter(body):
        first = last - len(key) + 1
        if first < until.get(key, 0) or opening and first and _is_word(body[first - 1]) or closing and last + 1 < len(body) and _is_word(body[last + 1]):
            continue
        until[key] = last + 1
        hits.setdefault(key, []).extend((int(at[first]), int(at[last]) + 1))
    for key, found in hits.items():
        for i in own[key]:
            out[i] = found
    return out


#: Rows of a batch that are Python's objects at once: a batch has thousands, whose texts and places would fill a worker.
ROWS = 64


def by_slices(columns: list[pa.Array], one: Callable, kind: pa.DataType) -> pa.Array:
    """``one`` of each row of a batch, made a few rows at a time; what is done is kept as Arrow has it."""
    done = [pa.array(map(one, *(c.slice(i, ROWS).to_pylist() for c in columns)), kind) for i in range(0, len(columns[0]), ROWS)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _places(texts: pa.Array, needles: pa.Array) -> pa.Array:
    return by_slices([texts, needles], lambda t, n: places(t, n) if t is not None and n else None, pa.list_(pa.list_(pa.int32())))


def _pairs(found: Column) -> Column:
    """array<array<struct<start,end>>> of starts and ends one after another."""
    pair = lambda flat: F.transform(F.sequence(F.lit(1), F.size(flat), F.lit(2)), lambda i: F.struct(F.element_at(flat, i).alias("start"), F.element_at(flat, i + 1).alias("end")))
    return F.transform(found, lambda flat: F.when(F.size(flat) > 0, pair(flat)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))


def locate_all(text: Column, needles: Column) -> Column:
    """array<array<struct<start,end>>>: the occurrences of each of array<string> in the text, in its order; null where either is null or there are no needles."""
    return _pairs(_places(text, needles))


# --- Texts that changed in parts: pieces that are still there keep their occurrences, the others are scanned.

#: Where a text may be cut into pieces: after a sign that ends a line or sentence. So an edit changes the pieces that it touches alone.
PIECE_END = r"(?<=[\n.;!?])"


def piece_index(text: Column) -> Column:
    """array<struct<hash,size>> of a text's pieces, which tells what of it changed later."""
    return F.transform(F.split(text, PIECE_END, -1), lambda p: F.struct(F.xxhash64(p).alias("hash"), F.length(p).alias("size")))


def same_pieces(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start in the old text, start in the new one, size) of what both have, in order: equal pieces at both ends, and between them the
    longest chain of pieces that either has once."""
    starts = lambda x: np.concatenate([[0], np.cumsum([size for _, size in x])]).astype(int).tolist()
    at_old, at_new = starts(old), starts(new)
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    mine, theirs = _once(old[head : len(old) - tail]), _once(new[head : len(new) - tail])
    pairs = [(mine[p] + head, i + head) for p, i in theirs.items() if p in mine]  # in order of the new text
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (i, _) in enumerate(pairs):
        at = bisect.bisect_left(ends, i)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [i], [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    # From each pair of the chain on, and before the next, pieces that are equal too.
    kept = [(i, i) for i in range(head)]
    for i, j in [*chain[::-1], (len(old) - tail, len(new) - tail)]:
        (a, b), back = kept[-1] if kept else (-1, -1), []
        while a + 1 < i and b + 1 < j and old[a + 1] == new[b + 1]:
            a, b = a + 1, b + 1
            kept.append((a, b))
        while i - 1 > a and j - 1 > b and old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
            back.append((i, j))
        kept += back[::-1]
        i, j = i + len(back), j + len(back)
        if i < len(old) - tail:
            kept.append((i, j))
    kept += [(len(old) - tail + i, len(new) - tail + i) for i in range(tail)]
    out: list[tuple[int, int, int]] = []
    for i, j in kept:
        a, b, n = at_old[i], at_new[j], new[j][1]
        if out and out[-1][0] + out[-1][2] == a and out[-1][1] + out[-1][2] == b:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((a, b, n))
    return out


def _once(x: list) -> dict:
    seen = collections.Counter(x)
    return {p: i for i, p in enumerate(x) if seen[p] == 1}


def may_meet_itself(key: str) -> bool:
    """Whether occurrences of a folded needle may overlap, so that those before decide which count."""
    border, fail = 0, [0] * len(key)
    for i in range(1, len(key)):
        while border and key[i] != key[border]:
            border = fail[border - 1]
        border += key[i] == key[border]
        fail[i] = border
    return bool(key) and fail[-1] > 0


def changed_places(text: str, new: list[tuple[int, int]], needles: list[str], old: list[tuple[int, int]], known: list[list[int]]) -> tuple[list[list[int]], int]:
    """:func:`places` of a text with the pieces ``new``, of which an earlier version had the pieces ``old`` and the occurrences ``known``;
    and how many characters were scanned.

    An occurrence that lies, with the characters beside it, in what both versions have, is moved along; the others overlap or touch what
    changed, and are looked for there, with as much beside it as the longest needle may take. Needles whose occurrences may overlap are looked
    for in the whole text.
    """
    blocks = same_pieces(old, new)
    keys = [key_of(n) for n in needles]
    whole = [may_meet_itself(k) for k in keys]
    out: list[list[int]] = [[] for _ in needles]
    scanned = 0
    if any(whole):
        for i, found in zip([i for i, w in enumerate(whole) if w], places(text, [n for n, w in zip(needles, whole, strict=True) if w]), strict=True):
            out[i] = found
        scanned = len(text)
    some = [i for i, w in enumerate(whole) if not w and keys[i]]
    if not some:
        return out, scanned
    old_size = sum(size for _, size in old)
    inner = lambda a, n, size: (a + (a > 0), a + n - (a + n < size))  # noqa: E731  without the characters beside what changed
    kept = [(*inner(a, n, old_size), b - a) for a, b, n in blocks]
    firm = [inner(b, n, len(text)) for _, b, n in blocks]
    begins = [a for a, *_ in kept]
    for i in some:
        for s, e in zip(known[i][::2], known[i][1::2], strict=True):
            k = bisect.bisect_right(begins, s) - 1
            if k >= 0 and e <= kept[k][1]:
                out[i] += [s + kept[k][2], e + kept[k][2]]
    # What isn't firm, with as much around it as a needle takes: its characters, and all of a run of white space.
    most = max(len(keys[i]) for i in some)
    gaps, at = [], 0
    for a, b in firm:
        if a > at:
            gaps.append((at, a))
        at = max(at, b)
    if at < len(text):
        gaps.append((at, len(text)))
    windows: list[list[int]] = []
    for a, b in gaps:
        a, b = _widened(text, a, b, most)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], b)
        else:
            windows.append([a, b])
    firm_begins = [a for a, _ in firm]
    for a, b in windows:
        scanned += b - a
        for i, found in zip(some, places(text[a:b], [needles[i] for i in some]), strict=True):
            for s, e in zip(found[::2], found[1::2], strict=True):
                s, e = s + a, e + a
                k = bisect.bisect_right(firm_begins, s) - 1
                outside = (a == 0 or s > a) and (b == len(text) or e < b)  # its neighbours are in the window
                if outside and not (k >= 0 and e <= firm[k][1]):
                    out[i] += [s, e]
    for i in some:
        pairs = sorted(set(zip(out[i][::2], out[i][1::2], strict=True)))
        out[i] = [x for p in pairs for x in p]
    return out, scanned


def _widened(text: str, start: int, end: int, most: int) -> tuple[int, int]:
    """A stretch with ``most`` folded characters and one more on either side."""

    def reach(step: int, at: int) -> int:
        left, before = most + 1, False
        while left and 0 <= at < len(text):
            space = _SPACE.match(text[at]) is not None
            left -= not (space and before)
            before = space
            at += step
        while 0 <= at < len(text) and before and _SPACE.match(text[at]):
            at += step
        return at

    return reach(-1, start - 1) + 1, reach(1, end)


_CHANGED = T.StructType([T.StructField("found", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("scanned", T.IntegerType())])


@F.pandas_udf(_CHANGED)
def _changed(texts: pd.Series, new: pd.Series, needles: pd.Series, old: pd.Series, known: pd.Series) -> pd.DataFrame:
    pairs = lambda index: [(p["hash"], p["size"]) for p in index]
    rows = [
        (None, 0) if t is None or n is None or not len(n) else (places(t, list(n)), len(t)) if o is None else changed_places(t, pairs(p), list(n), pairs(o), [list(x) for x in k])
        for t, p, n, o, k in zip(texts, new, needles, old, known, strict=True)
    ]
    return pd.DataFrame({"found": pd.Series([r[0] for r in rows], dtype=object), "scanned": [r[1] for r in rows]})


def locate_changed(text: Column, needles: Column, old: Column, known: Column) -> Column:
    """struct<found: array<array<struct<start,end>>>, scanned: int>: :func:`locate_all` of a text that changed in parts.

    old: the :func:`piece_index` of the text before, null if there was none; known: for each needle its starts and ends in it, one after another.
    """
    out = _changed(text, piece_index(text), needles, old, known)
    return F.struct(_pairs(out["found"]).alias("found"), out["scanned"].alias("scanned"))
