"""Periodic runs of words: stretches that repeat a phrase back to back, found by power-of-two naming.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of ``MIN_LENGTH`` words and
``MIN_COPIES`` periods at least, that no neighbouring word extends keeping the period.

1. Karp-Miller-Rosenberg: equal words get equal names; the name of 2^(k+1) words at a place is the rank of the pair of names of the two
   halves, for all places of a slice of texts at once. Equal names are equal words: nothing is hashed to be compared, no suffix is sorted.
2. Words q apart agree along at least m = max(MIN_LENGTH - q, (MIN_COPIES - 1) q) places in a run of period q. So of every grid of
   m - 2^k + 1 steps one place has its 2^k names equal to those q further on. k = 3 is looked at for all texts, only those with
   such places are named on.
3. The longest common extensions of such a place to the right and to the left, by descending levels of names, are its run. Of the
   places of a grid within one run only the first is extended. A stretch found for several periods has the smallest.

Defined cases: a null, empty or blank text has no words, so no runs, and its collapsed text is empty; repeated rows have a row each; a
null key stays null; an empty table gives an empty result; other columns are not looked at. A worker holds a slice of texts (one
whole text at least) and a name of 4 bytes a word and level of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import rows_of, small_batches, string, table, text_bytes, text_slices, tidy, words

MIN_LENGTH = 24
MIN_COPIES = 3
#: Level of names that every grid place is looked at with: 2**FILTER words.
FILTER = 3
#: Grid places looked at together.
PLACES = 1 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words alone."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    listed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[at].tobytes())])
    return listed.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def next_level(names: np.ndarray, step: int) -> np.ndarray:
    """Names of twice as many words: ranks of the pairs (here, ``step`` places on)."""
    if len(names) <= step:
        return np.zeros(0, np.int64)
    wide = names.astype(np.int64)
    pairs = wide[:-step] * (int(wide.max()) + 1) + wide[step:]
    order = np.argsort(pairs)
    ranked = pairs[order]
    new = np.zeros(len(pairs), np.int64)
    new[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1]))
    return new


def _grids(first: np.ndarray):
    """(place, period, row) arrays of all grid places of all rows, about ``PLACES`` at a time."""
    sizes = np.diff(first)
    most = np.where(sizes >= MIN_LENGTH, sizes // MIN_COPIES, 0)
    wide = 1 << FILTER
    ends = np.cumsum(most)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, PLACES):
        number = np.arange(at, min(at + PLACES, total))
        row = np.searchsorted(ends, number, "right")
        period = number - (ends - most)[row] + 1
        step = np.maximum(MIN_LENGTH - period, (MIN_COPIES - 1) * period) - wide + 1
        count = np.maximum((sizes[row] - period - wide) // step + 1, 0)
        bounds = np.cumsum(count)
        done = 0
        while done < len(number):  # some periods at a time
            base = bounds[done - 1] if done else 0
            to = max(done + 1, int(np.searchsorted(bounds, base + PLACES, "right")))
            some = slice(done, to)
            which = np.repeat(np.arange(done, to), count[some])
            nth = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(count[some])[:-1]]), count[some])
            yield first[row[which]] + nth * step[which], period[which], row[which], step[which]
            done = to


def runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs, in this order; names are the words', first[i]:first[i+1] those of row i."""
    none = (np.zeros(0, np.int64),) * 4
    level = names
    for k in range(FILTER):
        level = next_level(level, 1 << k)
    hits = [x for x in (_equal(level, *some) for some in _grids(first)) if len(x[0])] if len(level) else []
    if not hits:
        return none
    place, period, row, step = (np.concatenate(x) for x in zip(*hits, strict=True))
    # The texts concerned alone are named on, end to end.
    concerned = np.unique(row)
    sizes = np.diff(first)[concerned]
    own = np.concatenate([[0], np.cumsum(sizes)])
    levels = [np.unique(names[np.arange(own[-1]) + np.repeat(first[concerned] - own[:-1], sizes)], return_inverse=True)[1].astype(np.int32)]
    while 1 << len(levels) <= sizes.max() and int(levels[-1].max()) + 1 < len(levels[-1]):  # until no two places are equal
        levels.append(next_level(levels[-1], 1 << (len(levels) - 1)).astype(np.int32))
    new = np.searchsorted(concerned, row)
    place = place - first[row] + own[new]
    begin, end = own[new], own[new + 1]
    # A place whose whole step to the left agrees belongs to the stretch of the place before.
    back = np.minimum(_left(levels, place, period, begin), step)
    lead = back < step
    place, period, begin, end, back, new = (x[lead] for x in (place, period, begin, end, back, new))
    start = place - back
    stop = place + _right(levels, place, period, end) + period
    length = stop - start
    good = (length >= MIN_LENGTH) & (length >= MIN_COPIES * period)
    new, start, length, period = (x[good] for x in (new, start - begin, length, period))
    order = np.lexsort((period, length, start, new))
    new, start, length, period = (x[order] for x in (new, start, length, period))
    once = np.append(True, (new[1:] != new[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(new)]
    new, start, length, period = (x[once] for x in (new, start, length, period))
    order = np.lexsort((length, period, start, new))
    return concerned[new[order]], start[order], length[order], period[order]


def _equal(level: np.ndarray, place: np.ndarray, period: np.ndarray, row: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
    same = level[place] == level[place + period]
    return place[same], period[same], row[same], step[same]


def _right(levels: list[np.ndarray], place: np.ndarray, period: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words from each place on equal those a period further, up to ``end``."""
    at = place.copy()
    for k, names in reversed(list(enumerate(levels))):
        other = at + period
        some = np.flatnonzero(other + (1 << k) <= end)
        some = some[names[at[some]] == names[other[some]]]
        at[some] += 1 << k
    return at - place


def _left(levels: list[np.ndarray], place: np.ndarray, period: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many words before each place equal those a period further, down to ``begin``."""
    at = place.copy()
    for k, names in reversed(list(enumerate(levels))):
        other = at - (1 << k)
        some = np.flatnonzero(other >= begin)
        some = some[names[other[some]] == names[other[some] + period[some]]]
        at[some] -= 1 << k
    return place - at


def _kept(first: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay: those in no run after its first period."""
    change = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(change, first[row] + start + period, 1)
    np.add.at(change, first[row] + start + length, -1)
    return np.cumsum(change[:-1]) == 0


def _slice_runs(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of each row."""
    data, offsets = text_bytes(column)
    starts, ends, first = words(data, offsets)
    n = len(first) - 1
    found = runs(word_names(data, starts, ends), first) if len(starts) >= MIN_LENGTH else (np.zeros(0, np.int64),) * 4
    row, start, length, period = found
    kept = _kept(first, row, start, length, period)
    # A kept word and the blank before it, unless it is its row's first.
    mine, begins, stops = rows_of(first)[kept], starts[kept], ends[kept]
    blank = np.append(False, mine[1:] == mine[:-1])[: len(mine)]
    sizes = stops - begins + blank
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(to[-1]), 32, np.uint8)
    lengths = stops - begins
    within = np.arange(int(lengths.sum())) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else np.zeros(0, np.int64)
    out[np.repeat(to[:-1] + blank, lengths) + within] = data[np.repeat(begins, lengths) + within]
    bounds = to[np.searchsorted(mine, np.arange(n + 1))]
    collapsed = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
    items = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), items), collapsed


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, collapsed) of each row: runs by start, then period, in word numbers; the text's words, joined by a blank, without those
    that a run has after its first period."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole):
                found, collapsed = _slice_runs(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), found, collapsed], names=["velum_key", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(key).alias("velum_key"), F.col(text).alias("velum_text"))
    kind = narrow.schema["velum_key"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"velum_key {kind}, runs {RUNS}, collapsed string").withColumnRenamed("velum_key", key)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a tail that repeats a phrase, for the documents that the query's contract names; the other texts as they are."""
    h = F.crc32(doc_id.cast("string"))
    listed = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def tail(x: Column) -> Column:
        n, g = F.size(x), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.concat(F.slice(x, 1, a), F.transform(F.sequence(a, n - 1), lambda i: F.element_at(x, a + (i - a) % p + 1))), " ")

    made = F.element_at(F.transform(F.array(listed), lambda x: F.when(F.size(x) > 0, tail(x)).otherwise("")), 1)
    return F.when(h % 10 == 0, made).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), string("text")).alias("text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    # Runs are in order of start and period, so only a greater exponent takes the place of an earlier run.
    greater = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.reduce("runs", F.try_element_at("runs", F.lit(1)), lambda acc, r: F.when(greater(r, acc), r).otherwise(acc))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
