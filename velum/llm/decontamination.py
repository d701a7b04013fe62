"""Benchmark decontamination by the CGK embedding.

Items and documents are sequences of words (letters and digits, case folded). A document is contaminated by an item of
n words if some stretch of it is within ``MAX_EDITS`` * n word edits of the item.

Windows of an item's size are mapped by random walks (Chakraborty, Goldenberg, Koucky): the walk writes the current word
at each of 3n steps and moves on or stays by a random bit of (step, word), so sequences at a small edit distance get
outputs at a small Hamming distance. Locality-sensitive hashing by bit sampling looks each window up: TABLES times per
walk, SAMPLES of the output positions make a key, and windows and items of one length that share a key are candidates.
WALKS * TABLES repetitions reach ``RECALL`` at the largest allowed distance (a test measures it at floor(MAX_EDITS * n) edits). Candidates are verified
by the exact edit distance of the item to the best stretch around the window.

A window is embedded only if it can match: k edits leave at least n - q + 1 - qk of an item's q-grams of words intact,
and q is the largest for which that is positive, so a window without one of them in place is no match. That test loses
nothing and spares all but a small part of the windows of clean text.

The benchmark is read in blocks of ``BLOCK_BYTES``, PASS_BLOCKS of them broadcast in their turn against all documents, so its size
has no bound (its passes grow with it). Memory: a worker holds those indexes, a slice of texts (one whole text at least), a list of
BLOCK_WINDOWS windows and arrays of BLOCK_NUMBERS, or of one window where an item is longer. Documents are never shuffled, and no pair of documents is ever made.

Defined cases: null or empty texts, and items without a word, match nothing; equal items are found each; repeated rows
are judged each; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import materialise, mix64, prefix_hash, range_hash, rows_of, small_batches, stream64, string, table, text_bytes, text_slices, tidy, words

MAX_EDITS = 0.25
WALKS, TABLES, SAMPLES = 8, 4, 3
RECALL = 0.99
MAX_GRAM = 3
BLOCK_BYTES = 4 << 20
#: Numbers (8 bytes each) of the widest array for the windows that are embedded, or compared, at once: fewer windows of longer items.
BLOCK_NUMBERS = 2_000_000
#: Windows, or pairs of windows and items, that are listed at once.
BLOCK_WINDOWS = 1_000_000
#: Blocks that are searched in one pass over the documents, each after the other.
PASS_BLOCKS = 4
#: Numbers (8 bytes each) up to which a list of contaminated rows is broadcast.
BROADCAST_IDS = 500_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[48:58] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the folded words of each row. Latin-1 capitals are folded as the ASCII ones."""
    data, offsets = text_bytes(column)
    data = _FOLD[data]
    if len(data) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[at] += 32
    starts, ends, first = words(data, offsets, _SEPARATOR)
    return (range_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def _q_hashes(h: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words from each place; the last q - 1 places are left out."""
    n = max(len(h) - q + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, r in enumerate(stream64(20 + q, q) | np.uint64(1)):
            out += h[j : j + n] * r
    return mix64(out)


def cgk(symbols: np.ndarray, sizes: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """(rows, steps): the walk's output. symbols: (rows, largest size), of which each row uses its size; 0 is written after the end."""
    rows, width = symbols.shape
    padded = np.zeros((rows, width + 1), np.uint64)
    padded[:, :width] = np.where(np.arange(width)[None, :] < sizes[:, None], symbols, np.uint64(0))
    keys = stream64(1000 + walk, steps)
    at, every = np.zeros(rows, np.int64), np.arange(rows)
    out = np.empty((rows, steps), np.uint64)
    for j in range(steps):
        now = padded[every, at]
        out[:, j] = now
        at += ((mix64(now ^ keys[j]) >> np.uint64(63)).astype(np.int64)) & (at < sizes)
    return out


def lsh_keys(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(rows, WALKS * TABLES): the keys of each row; equal keys need equal sizes."""
    rows = len(sizes)
    keys = np.empty((rows, WALKS * TABLES), np.uint64)
    every = np.arange(rows)
    for walk in range(WALKS):
        out = cgk(symbols, sizes, walk, 3 * symbols.shape[1])
        for t in range(TABLES):
            k = np.full(rows, walk * TABLES + t + 1, np.uint64) * np.uint64(0x9E3779B1) + sizes.astype(np.uint64)
            for u in stream64(5000 + walk * TABLES + t, SAMPLES):
                place = (float(u) / 2.0**64 * 3 * sizes).astype(np.int64)
                k = mix64(k) ^ out[every, np.minimum(place, 3 * sizes - 1)]
            keys[:, walk * TABLES + t] = mix64(k)
    return keys


def best_edits(item: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The edit distance of each row's item (its first ``size`` words) to the best stretch of its text (padded by 0)."""
    rows, width = text.shape
    places = np.arange(width + 1)[None, :]
    now = np.zeros((rows, width + 1), np.int64)  # a stretch may start anywhere
    best = now.min(1)
    for i in range(item.shape[1]):
        change = now[:, :-1] + (item[:, i : i + 1] != text)
        nxt = np.concatenate([now[:, :1] + 1, np.minimum(change, now[:, 1:] + 1)], 1)
        nxt = np.minimum.accumulate(nxt - places, 1) + places
        now = np.where((i < sizes)[:, None], nxt, now)
    best = now.min(1)
    return best


def _blocks(sizes: np.ndarray, times: int):
    """Row numbers in blocks of like size, ``times`` * the largest size * rows at most BLOCK_NUMBERS (one row at least)."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        to = at + max(1, BLOCK_NUMBERS // (times * int(sizes[order[at]])))
        to = at + max(1, BLOCK_NUMBERS // (times * int(sizes[order[min(to, len(order)) - 1]])))
        yield order[at:to]
        at = min(to, len(order))


def runs_of(n: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of neighbours whose numbers add up to ``limit`` at most, one element at least."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield slice(at, to)
        at = to


def spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... of n[i] numbers each, one after another."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Index:
    """A block of items: their q-grams and LSH tables."""

    def __init__(self, ids: list[int], texts: list[str]):
        hashes, first = word_hashes(pa.array(texts, pa.string()))
        sizes = np.diff(first)
        some = np.flatnonzero(sizes > 0)
        self.ids = np.array(ids, np.int64)[some]
        self.sizes = sizes[some]
        self.edits = np.floor(MAX_EDITS * self.sizes + 1e-9).astype(np.int64)
        self.flat = hashes
        self.starts = first[some]
        grams: dict[int, list] = {}
        for i, s in enumerate(some.tolist()):
            own = hashes[first[s] : first[s + 1]]
            n, k = len(own), int(self.edits[i])
            q = max([q for q in range(1, MAX_GRAM + 1) if n - q + 1 - q * k >= 1], default=1)
            grams.setdefault(q, []).append((_q_hashes(own, q), i))
        self.grams = {}
        for q, found in grams.items():
            h = np.concatenate([x for x, _ in found])
            size = np.concatenate([np.full(len(x), self.sizes[i]) for x, i in found])
            place = np.concatenate([np.arange(len(x)) for x, _ in found])
            # A gram says where windows of what size lie: items that share it at one place and size (templates do) add nothing.
            by = np.lexsort((size, place, h))
            h, place, size = h[by], place[by], size[by]
            once = np.append(True, (h[1:] != h[:-1]) | (place[1:] != place[:-1]) | (size[1:] != size[:-1]))
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.grams[q] = (h[once], place[once], size[once], bits)
        keys = np.zeros((len(some), WALKS * TABLES), np.uint64)
        for part in _blocks(self.sizes, 3):
            keys[part] = lsh_keys(self.words(part, int(self.sizes[part].max())), self.sizes[part])
        flat = keys.ravel()
        by = np.argsort(flat, kind="stable")
        self.keys, self.key_item = flat[by], by // keys.shape[1]

    def words(self, items: np.ndarray, width: int) -> np.ndarray:
        """(items, width): the items' words, 0 after their end."""
        at = np.arange(width)[None, :]
        return np.where(at < self.sizes[items][:, None], self.flat[np.minimum(self.starts[items][:, None] + at, len(self.flat) - 1)], np.uint64(0))

    def windows(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks (row, start, size) of the item-sized windows that can match, each once a block; a start may lie before its row's."""
        row = rows_of(first)
        for q, (grams, place, size, bits) in self.grams.items():
            own = _q_hashes(h, q)
            at = np.flatnonzero(bits[(own >> np.uint64(44)).astype(np.int64)])
            at = at[row[at] == row[at + q - 1]] if len(at) else at
            lo, hi = np.searchsorted(grams, own[at]), np.searchsorted(grams, own[at], "right")
            n = hi - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            for some in runs_of(n, BLOCK_WINDOWS):
                entry = spread(lo[some], n[some])
                here = np.repeat(at[some], n[some])
                yield tuple(np.unique(np.stack([row[here], here - place[entry], size[entry]]), axis=1))

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item number, edits) of each item found in a row, once."""
        hits: dict[tuple[int, int], int] = {}
        for row, start, size in self.windows(h, first):
            for part in _blocks(size, 3):
                self._search(h, first, row[part], start[part], size[part], hits)
        pairs = np.array(list(hits), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1], np.array(list(hits.values()), np.int64)

    @staticmethod
    def _cut(h, low, high, start, width):
        """(rows, width): the words from each start, 0 outside low..high."""
        at = start[:, None] + np.arange(width)[None, :]
        return np.where((at >= low[:, None]) & (at < high[:, None]), h[np.clip(at, 0, len(h) - 1)], np.uint64(0))

    def _search(self, h, first, row, start, size, hits) -> None:
        width = int(size.max())
        symbols = self._cut(h, first[row], first[row + 1], start, width)
        keys = lsh_keys(symbols, size)
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        window, _ = np.nonzero(hi > lo)
        lo, n = lo[hi > lo], (hi - lo)[hi > lo]
        for some in runs_of(n, BLOCK_WINDOWS):
            pairs = np.unique(np.stack([np.repeat(window[some], n[some]), self.key_item[spread(lo[some], n[some])]]), axis=1)
            self._verify(h, first, row, start, pairs[:, self.sizes[pairs[1]] == size[pairs[0]]], hits)

    def _verify(self, h, first, row, start, pairs, hits) -> None:
        for part in _blocks(self.sizes[pairs[1]], 2):
            window, item = pairs[:, part]
            width, slack = int(self.sizes[item].max()), int(self.edits[item].max())
            text = self._cut(h, first[row[window]], first[row[window] + 1], start[window] - slack, width + 2 * slack)
            edits = best_edits(self.words(item, width), self.sizes[item], text)
            good = edits <= self.edits[item]
            for r, i, e in zip(row[window[good]].tolist(), item[good].tolist(), edits[good].tolist(), strict=True):
                hits[r, i] = min(e, hits.get((r, i), e))


def contaminated(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keep columns, item_id, n_item_words, edits) of every row of ``docs`` and item (item_id, text) that it contains."""
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    schema = fields + ", item_id long, n_item_words long, edits long"
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), string("text").alias("text"))
    total = sized.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    narrow = docs.select(*keep, F.col(text).alias("velum_text"))
    found = []
    for p in range(0, blocks, PASS_BLOCKS):
        indexes = []
        for b in range(p, min(p + PASS_BLOCKS, blocks)):
            rows = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
            indexes.append(Index([r["item_id"] for r in rows], [r["text"] for r in rows]))
        shared = spark.sparkContext.broadcast(indexes)
        del indexes  # the driver keeps the broadcast's file alone

        def run(batches, shared=shared):
            for whole in batches:
                for batch in text_slices(whole):
                    h, first = word_hashes(batch.column(len(keep)))
                    for index in shared.value:
                        row, item, edits = index.search(h, first)
                        at = pa.array(row)
                        yield pa.RecordBatch.from_arrays(
                            [*(batch.column(i).take(at) for i in range(len(keep))), pa.array(index.ids[item]), pa.array(index.sizes[item]), pa.array(edits)],
                            names=[*keep, "item_id", "n_item_words", "edits"],
                        )

        found.append(narrow.mapInArrow(tidy(run), schema))
    return reduce(DataFrame.union, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", 1 - F.col("edits") / F.col("n_item_words"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    # Two hashes of different seeds stand for a row: one of 64 bits could drop a clean document in a large table.
    keys = ["velum_key1", "velum_key2"]
    marked = docs
    for i, k in enumerate(keys):
        marked = marked.withColumn(k, F.xxhash64(F.lit(i), F.coalesce(F.col("doc_id").cast("string"), F.lit("\x01null")), string("text")))
    bad = materialise(contaminated(marked, table(spark, sf_dir, "benchmark"), tuple(keys)).select(*keys).distinct(), "contaminated")
    return marked.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, keys, "left_anti").select(*docs.columns)
