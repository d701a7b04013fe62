"""Spans of a document as arrays of struct(start, end, ...): finding, claiming, containment, merging.

Spans are found without a user function and by one scan of a pattern: its matches are marked by signs that no text holds, and the
running lengths of what stands between the marks are the places. Claims, merges and containment only concern spans that overlap, so spans
are cut into clusters first, each ending where no span reaches on; a cluster's fold is over its few spans. So the cost grows with the number of
findings, not with its square, and nothing is shuffled. No span is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Noncharacters, which have no place in interchanged text.
_OPEN, _SHUT, _END = "\ufdd0", "\ufdd1", "\ufdd2"
SPAN = "struct<type:string,start:int,end:int,value:string,rule_id:int,source:string>"
#: Elements of an array that are folded into a growing array at once.
_BLOCK = 64
#: Characters of a piece of text that is cut from.
_PIECE = 4096


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """The running combination (sums, say) of array<int>, by blocks: what a growing array would copy with each element is copied once a level."""
    last = lambda a: F.element_at(a, -1)
    fold = lambda block: F.aggregate(block, F.slice(block, 1, 0), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(combine(F.try_element_at(acc, F.lit(-1)), x)))))
    if not levels:
        return fold(values)

    def blocks(v: Column) -> Column:
        local = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: fold(F.slice(v, b * _BLOCK + 1, _BLOCK)))
        ahead = lambda part, end: F.transform(part, lambda x: combine(end, x))
        joined = lambda parts, ends: F.flatten(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(ahead(part, F.element_at(ends, F.greatest(i, F.lit(1)))))))
        return once(local, lambda parts: once(running(F.transform(parts, last), combine, levels - 1), lambda ends: joined(parts, ends)))

    return once(values, lambda v: F.when(F.size(v) <= _BLOCK, fold(v)).otherwise(blocks(v)))


def is_odd(text: Column) -> Column:
    """Whether a text holds one of the signs that mark matches; it has others in their places meanwhile (:func:`plain`)."""
    return text.contains(_OPEN) | text.contains(_SHUT) | text.contains(_END)


def plain(text: Column) -> Column:
    return F.when(is_odd(text), F.translate(text, _OPEN + _SHUT + _END, "\ufffd\ufffd\ufffd")).otherwise(text)


def marked(text: Column, pattern: Column | str, group: bool = False) -> Column:
    """A :func:`plain` text with signs around its matches: "OPEN match SHUT group END"."""
    return F.regexp_replace(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(_OPEN + "$0" + _SHUT + ("$1" if group else "") + _END))


def places(marks: Column, group: Column) -> Column:
    """array<struct<start,end,value>> of what a marked text marks: the matches, or with ``group`` the groups that end them."""

    def piece(x: Column, i: Column) -> Column:
        # "match SHUT group END gap", but the first piece is the gap before all matches.
        shut, last = F.instr(x, _SHUT), F.instr(x, _END)
        wide = F.when(group, last - shut - 1).otherwise(shut - 1)
        some = F.struct((shut - 1 + F.length(x) - last).alias("on"), (shut - 1).alias("size"), wide.alias("wide"), F.substring(x, F.when(group, shut + 1).otherwise(1), wide).alias("value"))
        none = F.struct(F.length(x).alias("on"), F.lit(0).alias("size"), F.lit(0).alias("wide"), F.lit("").alias("value"))
        return F.when(i == 0, none).otherwise(some)

    def spans(parts: Column, ends: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            end = F.element_at(ends, i + 1) + m["size"]
            return F.struct((end - m["wide"]).alias("start"), end.alias("end"), m["value"].alias("value"))

        return F.transform(F.slice(parts, 2, F.size(parts)), span)

    def all_of(pieces: Column) -> Column:
        ends = lambda q: running(F.transform(q, lambda m: m["on"]), lambda a, b: a + b)
        placed = once(F.transform(pieces, piece), lambda q: once(ends(q), lambda e: spans(q, e)))
        return F.when(F.size(pieces) > 1, placed).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))

    return once(F.split(marks, _OPEN), all_of)


def own_values(text: Column, spans: Column) -> Column:
    """Spans of a plain text with the values that the text itself has."""
    own = lambda m: m.withField("value", cut(text, m["start"], m["end"]))
    return once(spans, lambda x: F.when(is_odd(text), F.transform(x, own)).otherwise(x))


def found(text: Column, pattern: Column | str, group: bool = False, trigger: str = "") -> Column:
    """array<struct<start,end,value>> of the matches, or of the group that ends each match; empty if there are none or the text is null."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    out = own_values(text, places(marked(plain(text), pattern, group), F.lit(group)))
    return F.when(text.rlike(trigger), out).otherwise(empty) if trigger else F.when(text.isNull(), empty).otherwise(out)


def matches(text: Column, pattern: Column | str, group: bool = False, trigger: str = "") -> Column:
    """array<struct<start,end>> of :func:`found`."""
    return F.transform(found(text, pattern, group, trigger), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def cut(text: Column, start: Column, end: Column) -> Column:
    return text.substr(start + 1, end - start)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def by_start(spans: Column) -> Column:
    """In order of place; equal starts by their end, then as the remaining fields compare."""
    return F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] < b["start"], -1)
        .when(a["start"] > b["start"], 1)
        .when(a["end"] < b["end"], -1)
        .when(a["end"] > b["end"], 1)
        .when(a["rule_id"] < b["rule_id"], -1)
        .when(a["rule_id"] > b["rule_id"], 1)
        .otherwise(0),
    )


def clusters(spans: Column) -> Column:
    """array<array<struct<start,end,i,x>>>: the spans x, i their number, cut where no span reaches on; each cluster in order of i.

    Spans that overlap are in one cluster. Clusters are in order of place.
    """

    def split(k: Column, tops: Column) -> Column:
        n = F.size(k)
        begins = F.filter(F.sequence(F.lit(1), n), lambda j: F.when(j == 1, True).otherwise(F.element_at(k, j)["start"] >= F.element_at(tops, j - 1)))
        until = lambda b, c: F.when(c + 1 < F.size(b), F.try_element_at(b, c + 2)).otherwise(n + 1)
        return once(begins, lambda b: F.transform(b, lambda at, c: in_order(F.slice(k, at, until(b, c) - at))))

    in_order = lambda c: F.when(F.size(c) == 1, c).otherwise(F.array_sort(c, lambda a, b: a["i"] - b["i"]))
    keyed = F.array_sort(F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i"), x.alias("x"))), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["i"] - b["i"]))
    return once(keyed, lambda k: F.when(F.size(k) == 0, F.array(k)).otherwise(once(running(F.transform(k, lambda s: s["end"]), F.greatest), lambda tops: split(k, tops))))


def _each(spans: Column, fold: Callable[[Column], Column]) -> Column:
    """``fold`` of each cluster of several spans; what is left, one after another, as array<struct<start,end,i,x>>."""
    return F.flatten(F.transform(clusters(spans), lambda c: F.when(F.size(c) <= 1, c).otherwise(fold(c))))


def _items(spans: Column) -> Column:
    """The spans themselves, as they came."""
    return F.transform(F.array_sort(spans, lambda a, b: a["i"] - b["i"]), lambda s: s["x"])


def claim(spans: Column, seed: Column | None = None) -> Column:
    """Accept each span in array order unless it overlaps one accepted before (those of ``seed`` are accepted from the start); as they came, after the seed."""
    given = lambda flag: (lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(flag).alias("given"), x.alias("x")))
    every = F.transform(spans, given(False)) if seed is None else F.concat(F.transform(seed, given(True)), F.transform(spans, given(False)))
    meets = lambda acc, x: ~x["x"]["given"] & F.exists(acc, lambda y: overlap(x, y))
    accept = lambda c: F.aggregate(c, F.slice(c, 1, 0), lambda acc, x: F.when(meets(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(_items(_each(every, accept)), lambda s: s["x"])


def drop_contained(spans: Column) -> Column:
    """Without spans that lie within a longer span of the same type; as they came."""

    def inside(x: Column, y: Column) -> Column:
        return (y["x"]["type"] == x["x"]["type"]) & (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])

    return _items(_each(spans, lambda c: F.filter(c, lambda x: ~F.exists(c, lambda y: inside(x, y)))))


def replaces(old: Column, new: Column) -> Column:
    """A longer contextual span (person, company, address) takes the place of a shorter contextual one."""
    contextual = ["name", "organization", "address"]
    return old["type"].isin(contextual) & new["type"].isin(contextual) & (new["end"] - new["start"] > old["end"] - old["start"])


def merge(base: Column, more: Column) -> Column:
    """Each span of ``more`` in turn meets the first accepted span that it overlaps: it replaces it, in its place of the list, or goes.
    Without one it is added at the end."""

    def step(acc: Column, x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(acc)), lambda i: overlap(F.element_at(acc, i), x))
        at = F.when(F.size(acc) > 0, F.try_element_at(places, F.lit(1)))
        swapped = F.transform(acc, lambda y, i: F.when(i + 1 == at, x.withField("i", y["i"])).otherwise(y))
        return F.when(at.isNull(), F.concat(acc, F.array(x))).when(replaces(F.try_element_at(acc, at)["x"]["x"], x["x"]["x"]), swapped).otherwise(acc)

    fold = lambda c: F.aggregate(F.filter(c, lambda x: x["x"]["more"]), F.filter(c, lambda x: ~x["x"]["more"]), step)
    given = lambda more: (lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(more).alias("more"), x.alias("x")))
    merged = _each(F.concat(F.transform(base, given(False)), F.transform(more, given(True))), fold)
    return F.transform(_items(merged), lambda s: s["x"])


def resolve(puts: Column) -> Column:
    """Of array<struct<start,end,ordinal,...>>, those that are put in, in order of place: by start, the longest first, then by ordinal; what
    starts within an earlier one is left out."""

    def fold(c: Column) -> Column:
        order = F.array_sort(
            c, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["x"]["ordinal"] - b["x"]["ordinal"])
        )
        return F.aggregate(order, F.slice(c, 1, 0), lambda acc, x: F.when(F.try_element_at(acc, F.lit(-1))["end"] > x["start"], acc).otherwise(F.concat(acc, F.array(x))))

    return F.transform(_each(puts, fold), lambda s: s["x"])


def pieces(text: Column) -> Column:
    """A text as array<string> of a fixed size, from which :func:`cut_pieces` cuts without counting from the text's start."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _PIECE), F.lit(0))


def cut_pieces(parts: Column, start: Column, end: Column) -> Column:
    first, last = F.floor(start / _PIECE).cast("int"), F.floor((end - 1) / _PIECE).cast("int")
    head = lambda n: F.substring(F.element_at(parts, first + 1), start - first * _PIECE + 1, n)
    far = F.concat(head(F.lit(_PIECE)), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.substring(F.element_at(parts, last + 1), F.lit(1), end - last * _PIECE))
    return F.when(start >= end, "").when(first == last, head(end - start)).otherwise(far)
