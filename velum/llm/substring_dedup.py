"""Removal of repeated byte strings by longest-previous-factor arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere, in the same text or another, goes
(``keep="none"``), or every later copy goes and the first stays (``keep="first"``: the least (doc_id, place)).

A suffix array of the whole corpus is one task's work, so the suffixes are first dealt into groups that can hold equal
strings: of the GRAM-byte strings within a window of LENGTH bytes, the one with the least hash is its anchor. Equal windows
have equal anchors at equal places, so windows with different anchors are never compared. A run of windows with one anchor
is an extent (one per 77 bytes or so).

1. Equal texts are found by digest and stand for each other from then on.
2. Extents are written once. Those whose anchor may occur again (a bitmap of fixed size tells) are counted by anchor and bytes:
   extents of equal bytes are one kind, whose first occurrence stands for it. A later copy's factor is the whole copy.
3. The kinds of an anchor that has several meet in one task with their bytes. There a suffix array of all their suffixes is made
   by prefix doubling, its common prefixes are read off the ranks of the doubling's steps, and previous and next smaller
   positions in suffix order give each suffix its longest previous factor; with the text order reversed, its longest later one.
   A kind that recurs stands twice in these arrays. A factor of LENGTH bytes or more is a repeat.
4. A group of more than ``GROUP`` kinds is split by the bytes around the anchor: windows that have the anchor in one part of them
   and the bytes in common that every window of that part has. Halving the part again and again ends with groups of equal
   windows, so any group gets small, and each is treated as in 2 and 3.
5. A text's repeated stretches are gathered and cut out.

Memory: a worker holds a slice of texts (at least one whole text, about 60 bytes a byte) or ``SORT_BYTES`` of suffixes and one group.

Defined cases: a null text is empty; texts shorter than LENGTH keep all bytes; a null doc_id is replaced by a hash of the
text; repeated rows are copies of each other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import materialise, mix64, prefix_hash, range_hash, small_batches, string, table, text_bytes, text_slices, tidy, whole_groups

LENGTH = 200
GRAM = 48
GRAMS = LENGTH - GRAM + 1
#: Kinds of one anchor that are sorted in one task (280 bytes each), and bytes sorted at once.
GROUP = 2_000
SORT_BYTES = 1 << 19
#: Numbers (8 bytes each) up to which a counted list is broadcast.
BROADCAST_NUMBERS = 1_000_000
#: Most bits of a bitmap that is sent to all tasks (32 MB); it has 8 to 16 for each counted value. More values are joined instead.
FILTER_BITS = 1 << 28
_PLACES = 1 << 21


def extents(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, windows, at, anchor, whole): each run of windows with one anchor, its first window's place in the row, the
    number of windows, the anchor's place in the first, and the hashes of the anchor and of all the run's bytes."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < LENGTH:
        return none
    prefix = prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = range_hash(prefix, at, at + GRAM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(n - LENGTH + 1)
    whole = row[start] == row[start + LENGTH - 1]
    # The least hash, and of equals the last place: both in one number. Pieces of _PLACES, so that places fit.
    chosen = np.empty(len(start), np.int64)
    for a in range(0, len(start), _PLACES - GRAMS):
        part = gram[a : a + _PLACES - 1]
        low = (part >> np.uint64(21) << np.uint64(21)) | (np.uint64(_PLACES - 1) - np.arange(len(part), dtype=np.uint64))
        width = 1
        while 2 * width <= GRAMS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if GRAMS > width:
            low = np.minimum(low[: len(low) - (GRAMS - width)], low[GRAMS - width :])
        part = (_PLACES - 1 - (low & np.uint64(_PLACES - 1)).astype(np.int64) + a)[: _PLACES - GRAMS]
        chosen[a : a + len(part)] = part
    start, chosen = start[whole], chosen[whole]
    if not len(start):
        return none
    first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)))
    windows = np.diff(np.append(first, len(start)))
    begin, anchor = start[first], chosen[first]
    with np.errstate(over="ignore"):
        body = mix64(range_hash(prefix, begin, begin + windows - 1 + LENGTH) + ((anchor - begin) * 1000 + windows).astype(np.uint64))
    return row[begin], begin - offsets[row[begin]], windows, anchor - begin, gram[anchor], body


#: Symbols (bytes + 1, 0 for the end) in the first step of the doubling: nine bits each.
_FIRST = 7


def suffix_array(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes of strings data[offsets[i]:offsets[i+1]], each up to its string's end, in sorted order, and the
    length that each has in common with the one before (0 for the first). Equal suffixes are in order of place."""
    n = len(data)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    left = ends - np.arange(n)
    symbols = data.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for j in range(_FIRST):
        part = np.zeros(n, np.int64)
        part[: max(n - j, 0)] = symbols[j:]
        part[left <= j] = 0
        key = key << 9 | part
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # of equal ones the first's place
    steps, have = [rank.astype(np.int32)], _FIRST
    while have < left.max(initial=0):
        alone = fresh & np.append(fresh[1:], True)
        open_ = np.flatnonzero(~alone)  # places in order, whole classes
        if not len(open_):
            break
        own = order[open_]
        following = np.where(left[own] > have, rank[np.minimum(own + have, n - 1)] + 1, 0)
        by = np.argsort(rank[own] * (n + 2) + following, kind="stable")
        own, following = own[by], following[by]
        order[open_] = own
        differs = np.append(True, (rank[own[1:]] != rank[own[:-1]]) | (following[1:] != following[:-1]))
        fresh[open_] = differs
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(differs, open_, 0))
        steps.append(rank.astype(np.int32))
        have *= 2
    a, b = order[1:].copy(), order[:-1].copy()
    least = np.minimum(left[a], left[b])
    common = np.zeros(len(a), np.int64)
    for i in range(len(steps) - 1, -1, -1):
        same = steps[i][np.minimum(a, n - 1)] == steps[i][np.minimum(b, n - 1)]
        size = _FIRST << i
        common[same] += size
        a[same] += size
        b[same] += size
    apart = key[np.minimum(a, n - 1)] ^ key[np.minimum(b, n - 1)]
    for j in range(1, _FIRST):
        common += (apart >> (9 * (_FIRST - j))) == 0
    return order, np.append(0, np.minimum(common, least))[:n]


def previous_factor(order: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix.

    order: suffixes in sorted order; common[i]: the length that order[i] has in common with order[i - 1] (0 for the first);
    place[s]: suffix s's place in the text. The nearest suffixes on either side that start earlier are found by jumping over
    those that start later, all at once: what lies between them and the suffix starts later still.
    """
    n = len(order)
    at = place[order]
    out = np.zeros(n, np.int64)
    for side in (1, -1):
        where = at if side == 1 else at[::-1]
        shared = common if side == 1 else np.append(0, common[1:][::-1])
        to, least = np.arange(n) - 1, shared.copy()
        todo = np.flatnonzero((to >= 0) & (least > 0) & (where[to] > where))
        while len(todo):
            jump = to[todo]
            new_to, new_least = to[jump], np.minimum(least[todo], least[jump])
            to[todo], least[todo] = new_to, new_least
            todo = todo[(to[todo] >= 0) & (least[todo] > 0) & (where[to[todo]] > where[todo])]
        found = np.where(to >= 0, least, 0)
        out = np.maximum(out, found if side == 1 else found[::-1])
    factors = np.empty(n, np.int64)
    factors[order] = out
    return factors


def factors(data: np.ndarray, offsets: np.ndarray, turn: np.ndarray, again: np.ndarray, keep: str) -> np.ndarray:
    """The longest previous factor at each byte of strings, or (keep="none") the longest factor elsewhere.

    turn: the strings' order in the text; again: those of which a later copy is in the text, which stands for itself in the arrays.
    """
    order, common = suffix_array(data, offsets)
    owner = np.repeat(np.arange(len(turn)), np.diff(offsets))
    copies = 1 + again[owner[order]].astype(np.int64)
    first = np.cumsum(copies) - copies
    entries, shared = np.repeat(order, copies), np.repeat(common, copies)
    second = np.ones(len(entries), bool)
    second[first] = False
    shared[second] = (offsets[1:][owner] - np.arange(len(data)))[entries[second]]  # a copy has the whole rest in common
    place = turn[owner] * 1000 + np.arange(len(data)) - offsets[owner]
    places = place[entries] + second * (len(turn) + 1) * 1000
    every = np.arange(len(entries))
    best = previous_factor(every, shared, places)
    if keep == "none":
        best = np.maximum(best, previous_factor(every, shared, -places))
    out = np.empty(len(data), np.int64)
    out[order] = best[first]
    return out


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each run of true flags; a run ends where breaks is true, too."""
    before = np.append(False, flags[:-1]) & ~breaks
    first = np.flatnonzero(flags & ~before)
    after = np.append(flags[1:] & ~breaks[1:], False)
    return first, np.flatnonzero(flags & ~after)


def _small(df: DataFrame, numbers: Column | str = "1") -> DataFrame:
    """A written table, marked for broadcast if its counted numbers (an expression of those in a row) allow."""
    n = df.agg(F.sum(F.expr(numbers) if isinstance(numbers, str) else numbers).alias("n")).first()["n"] or 0
    return F.broadcast(df) if n <= BROADCAST_NUMBERS else df


def _bitmap(hashes: DataFrame) -> np.ndarray | None:
    """Which values the column h of a written table takes, modulo the number of bits: for leaving out most of what isn't in it. None if
    they are too many for a bitmap that leaves out enough."""
    n = hashes.count()
    if 8 * n > FILTER_BITS:
        return None
    bits = max(1 << 16, 1 << (8 * n).bit_length())
    at = F.pmod("h", F.lit(bits)) + 1
    rows = hashes.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():  # as many rows as the bitmap has parts, at most
        part = np.frombuffer(r["bits"], np.uint8)[: len(out) - (r["b"] - 1) * 4096]
        out[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(part)] = part
    return out


def _in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(np.int64) % (8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


_EXTENT = "h long, e long, node long, t int, start int, windows int, at int"
_BODY = _EXTENT + ", body binary"


def _batch_extents(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of _EXTENT for a batch of (node, t, text), and each extent's place in data."""
    row, start, windows, at, anchor, body = extents(data, offsets)
    node, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    small = [x.astype(np.int32) for x in (start, windows, at)]
    return [anchor.view(np.int64), body.view(np.int64), node[row], t[row], *small], offsets[row] + start


def _ident(h: np.ndarray, node: np.ndarray, t: np.ndarray, start: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mix64(h.astype(np.int64).view(np.uint64) + np.uint64(1)) + node.astype(np.int64).view(np.uint64)
        return mix64(mix64(x) + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.int64).view(np.uint64))


def _extents(texts: DataFrame) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in text_slices(whole):
                columns, _ = _batch_extents(batch, *text_bytes(batch.column(2)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "e", "node", "t", "start", "windows", "at"])

    return texts.select("node", "t", "text").mapInArrow(tidy(run), _EXTENT)


def _marked(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The extents whose anchor is among the written ``hashes`` (h), or has its bit in their bitmap."""
    bits = _bitmap(hashes)
    if bits is None:
        return rows.join(hashes.select("h"), "h", "left_semi")
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_in_bitmap(shared.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(tidy(run), _EXTENT)


def _bodies(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The extents (h, node, t, start) of ``wanted`` with its further columns and their bytes, found again in the texts.

    Texts don't move where a bitmap tells most of the wanted from the others; else those that have any meet the list of theirs.
    """
    keys = ["h", "node", "t", "start"]
    names = ["h", "e", "node", "t", "start", "windows", "at"]

    def idents(batches):
        for batch in batches:
            own = _ident(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["h"])

    bits = _bitmap(materialise(wanted.select(*keys).mapInArrow(idents, "h long"), "idents"))
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, column=2):
                data, offsets = text_bytes(batch.column(2))
                columns, places = _batch_extents(batch, data, offsets)
                if bits is not None:
                    here = np.flatnonzero(_in_bitmap(shared.value, _ident(columns[0], *columns[2:5])))
                else:
                    starts = batch.column(3)
                    owner = np.repeat(np.arange(batch.num_rows), starts.value_lengths().to_numpy(zero_copy_only=False))
                    row = np.searchsorted(offsets, places, "right") - 1
                    here = np.flatnonzero(np.isin(row << 32 | columns[4].astype(np.int64), owner << 32 | starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
                columns, places = [x[here] for x in columns], places[here]
                yield _with_bodies(columns, data, places, columns[5] + LENGTH - 1, names)

    asked = texts.select("node", "t", "text")
    if bits is None:
        asked = asked.join(wanted.groupBy("node", "t").agg(F.collect_set("start").alias("starts")), ["node", "t"])
    return asked.mapInArrow(tidy(run), _BODY).join(wanted, keys)


def _with_bodies(columns: list[np.ndarray], data: np.ndarray, places: np.ndarray, sizes: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A batch of the columns and the bytes from each place."""
    sizes = sizes.astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    picked = data[np.arange(ends[-1]) + np.repeat(places - ends[:-1], sizes)]
    body = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(picked.tobytes())])
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), body], names=[*names, "body"])


def _sort_batches(keep: str):
    """Rows (h, n, node, t, start, windows, body), those of one h together: the repeated stretches of each."""

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes_of(rows.column(6))
        n, node, t, start, windows = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
        by = np.lexsort((start, t, node))
        turn = np.empty(len(n), np.int64)
        turn[by] = np.arange(len(n))
        longest = factors(data, offsets, turn, n > 1, keep)
        owner = np.repeat(np.arange(len(n)), windows)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        first, last = _runs(longest[offsets[owner] + step] >= LENGTH, step == 0)
        own = owner[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(node[own], pa.int64()), pa.array(t[own], pa.int32()), pa.array((start[own] + step[first]).astype(np.int32)), pa.array((start[own] + step[last] + LENGTH).astype(np.int32))],
            names=["node", "t", "a", "b"],
        )

    def run(batches):
        for rows in whole_groups(batches, 1, 5, SORT_BYTES * 77 // 276):
            yield found(rows)

    return run


def text_bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _split(level: int):
    """Extents (_BODY and n) parted by where the anchor is in a window: within 256 >> level places. h is then a hash of the bytes around
    the anchor that all windows of the part have."""
    width = 256 >> level

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_bytes_of(batch.column(7))
            h, _, node, t, start, windows, at = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7))
            low = (at - windows + 1) // width  # the last window has the anchor nearest to its start
            parts = at // width - low + 1
            row = np.repeat(np.arange(len(at)), parts)
            cell = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            most, least = np.minimum(at[row], (cell + 1) * width - 1), np.maximum(at[row] - windows[row] + 1, cell * width)
            begin, size = at[row] - most, most - least + 1  # windows of the part
            place = offsets[row] + begin
            prefix = prefix_hash(data)
            anchor = offsets[row] + at[row]
            with np.errstate(over="ignore"):
                around = range_hash(prefix, anchor - cell * width, anchor + LENGTH - np.minimum((cell + 1) * width - 1, GRAMS - 1))
                group = mix64(around + mix64(h.view(np.uint64)[row] + (cell + 1000 * level).astype(np.uint64)))
                whole = mix64(range_hash(prefix, place, place + size + LENGTH - 1) + (most * 1000 + size).astype(np.uint64))
            columns = [group.view(np.int64), whole.view(np.int64), node[row], t[row].astype(np.int32), *(x.astype(np.int32) for x in (start[row] + begin, size, most))]
            out = _with_bodies(columns, data, place, size + LENGTH - 1, ["h", "e", "node", "t", "start", "windows", "at"])
            yield out.append_column("n", batch.column(8).take(pa.array(row)))

    return run


def stretches(texts: DataFrame, keep: str = "none") -> DataFrame:
    """(node, t, a, b): stretches of different texts (node, t, text) that are repeated, in bytes; they may overlap."""
    found = materialise(_extents(texts), "extents")
    often = materialise(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "often")
    rows = materialise(_marked(found, often), "recurring").withColumn("n", F.lit(1).cast("long"))
    out, level = None, 0
    while True:
        # Kinds: extents of equal bytes, of which the first stands for all; a later one's factor is its whole length.
        kinds = materialise(rows.groupBy("h", "e").agg(F.sum("n").alias("n"), F.min(F.struct("node", "t", "start", "windows")).alias("x")), "kinds")
        first = F.struct("node", "t", "start", "windows") == F.col("x")
        copies = rows.drop("n").join(kinds.filter("n > 1"), ["h", "e"])
        if keep == "first":
            copies = copies.filter(~first)
        done = copies.select("node", "t", F.col("start").alias("a"), (F.col("start") + F.col("windows") + LENGTH - 1).alias("b"))
        # Anchors with several kinds; if no occurrence stays, one of them at least must be there once.
        several = "kinds > 1" if keep == "first" else "kinds > 1 and least = 1"
        mixed = materialise(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter(several).select("h", "kinds"), "mixed")
        if level == 0:
            wanted = materialise(kinds.join(mixed, "h").select("h", "x.node", "x.t", "x.start", "n", "kinds"), "wanted")
            bodies = materialise(_bodies(texts, wanted), "bodies")
        else:
            bodies = rows.drop("n").join(kinds.join(mixed, "h"), ["h", "e"]).filter(first)
        columns = ["h", "n", "node", "t", "start", "windows", "body"]
        group = bodies.filter(F.col("kinds") <= GROUP).select(*columns)
        done = done.unionByName(group.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(_sort_batches(keep)), "node long, t int, a int, b int"))
        out = done if out is None else out.unionByName(done)
        large = mixed.filter(F.col("kinds") > GROUP)
        if large.isEmpty():
            return out
        level += 1
        big = bodies.filter(F.col("kinds") > GROUP).select("h", "e", "node", "t", "start", "windows", "at", "body", "n")
        rows = materialise(big.mapInArrow(tidy(_split(level)), _BODY + ", n long"), "split")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = string(text)
    return docs.select(F.coalesce(F.col(key).cast("long"), F.xxhash64(body)).alias("node"), F.hash(body).alias("t"), F.col(key).alias("key"), body.alias("text"), F.unhex(F.md5(body.cast("binary"))).alias("digest"))


def _merged(parts: Column) -> Column:
    """struct<a,b> of arrays: stretches in order of place, those that meet as one (neighbouring extents overlap by a window)."""
    none = F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc["b"], F.lit(-1))
        grown = F.struct(acc["a"].alias("a"), F.concat(F.slice(acc["b"], 1, F.size(acc["b"]) - 1), F.array(F.greatest(last, x["b"]))).alias("b"))
        return F.when(x["a"] <= last, grown).otherwise(F.struct(F.concat(acc["a"], F.array(x["a"])).alias("a"), F.concat(acc["b"], F.array(x["b"])).alias("b")))

    return F.aggregate(parts, F.struct(none.alias("a"), none.alias("b")), step)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "none") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row; kept is the bytes that stay, as binary."""
    small_batches(docs.sparkSession)
    rows = _keyed(docs, key, text)
    copies = materialise(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("node").alias("one")).filter("copies > 1").select("digest", "one"), "copies")
    marked = rows.join(_small(copies, "4"), "digest", "left")
    texts = marked.filter("one is null or one = node").select("node", "t", "text")
    parts = stretches(texts, keep).groupBy("node", "t").agg(_merged(F.sort_array(F.collect_list(F.struct("a", "b")))).alias("parts"))
    cut = materialise(parts, "stretches")
    gone = F.col("one").isNotNull() if keep == "none" else F.col("one").isNotNull() & (F.col("one") != F.col("node"))
    joined = marked.join(_small(cut, "3 + 2 * size(parts.a)"), ["node", "t"], "left").select(
        "key", (gone & (F.octet_length("text") >= LENGTH)).alias("gone"), F.coalesce("parts.a", F.array().cast("array<int>")).alias("a"), F.coalesce("parts.b", F.array().cast("array<int>")).alias("b"), "text"
    )

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, 4 << 20):
                data, offsets = text_bytes(batch.column(4))
                all_gone = batch.column(1).to_numpy(zero_copy_only=False)
                starts, ends = (batch.column(i) for i in (2, 3))
                owner = np.repeat(np.arange(batch.num_rows), starts.value_lengths().to_numpy(zero_copy_only=False))
                marks = np.zeros(len(data) + 1, np.int32)
                np.add.at(marks, offsets[owner] + starts.flatten().to_numpy(zero_copy_only=False), 1)
                np.add.at(marks, offsets[owner] + ends.flatten().to_numpy(zero_copy_only=False), -1)
                lost = np.cumsum(marks)[:-1] > 0
                lost |= np.repeat(all_gone, np.diff(offsets))
                head = np.zeros(len(data) + 1, bool)
                head[offsets] = True
                fresh = lost & (head[:-1] | ~np.append(False, lost[:-1])[: len(lost)])
                total, spans = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (lost, fresh))
                rest = data[~lost]
                at = offsets - total
                digests = [hashlib.sha256(rest[a:b].data).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(rest.tobytes())])
                counts = [pa.array(x, pa.int64()) for x in (np.diff(offsets), np.diff(total), np.diff(spans))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), kept], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(tidy(run), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
