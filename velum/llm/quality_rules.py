"""Quality rules: simple counts of each text, and N-gram perplexity within its language's band.

The language model of each ``lang`` is an interpolated modified Kneser-Ney model of order ``ORDER`` over
``SYMBOLS`` character classes (case, letters, digits, signs and the tail bytes of other characters). Spark
counts the n-grams of every distinct text of the table, copies within a language once, as a group of copies
would otherwise set the model and the band; a task combines its own counts, so what is shuffled is one row
per task, language and distinct n-gram. The alphabet bounds a language's model at SYMBOLS ** ORDER entries
whatever the corpus, which is the proven bound of what reaches the driver and is broadcast (about a hundred
thousand are met). The model lies in two sorted arrays of 64-bit hashes (a bijection of language, order and
n-gram, so there are no collisions): n-gram -> log probability, context -> log backoff weight.

A second pass scores every row. The bands come from all distinct scored texts of a language: the median and
the quartile spread of log2 perplexity, widened for short texts; rows outside are rejected.

Defined cases: a null or empty text has no words and fails; a null ``lang`` is a language of its own; a
language's band is open while fewer than ``MIN_BAND_ROWS`` of its distinct texts pass the simple counts; repeated
rows are scored each; an empty table gives an empty result; other columns pass through, and result columns replace
columns of the same name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import materialise, mix64, prefix_hash, range_hash, rows_of, small_batches, sums, table, text_bytes, text_slices, tidy, windows, words

ORDER, BITS = 4, 6
SYMBOLS = 1 << BITS
MIN_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
MIN_BAND_ROWS = 50
#: Perplexity is binned this finely (in log2) for the bands' quantiles.
BINS = 256
#: Half-widths of a band in log2 perplexity: quartile spreads, at least a floor, and more for short texts.
SPREADS, FLOOR, SHORT = 1.0, 0.02, 4.0
#: N-grams (12 bytes each) of the models that are broadcast at once; more languages are scored in further passes.
MODEL_ENTRIES = 4_000_000
#: Texts with copies up to which their 64-bit keys are broadcast.
BROADCAST_COPIES = 1_000_000
#: Languages up to which the bands are broadcast (a few dozen bytes each).
BROADCAST_BANDS = 100_000

_SYMBOL_SIGNS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])


def _classes() -> np.ndarray:
    """Byte -> class 1..SYMBOLS-1, or 0 for lead bytes, which are left out (0 itself marks a text's ends)."""
    out = np.zeros(256, np.uint8)
    out[97:123] = np.arange(1, 27)  # a-z
    out[65:91] = 27  # A-Z
    out[48:58] = 28
    out[32], out[[9, 10, 11, 12, 13]] = 29, 30
    for i, signs in enumerate((".", ",", "!?", ":;", "'\"", "()[]{}", "-_", "|/\\", "#*$%&<>@^~`+=")):
        out[[ord(c) for c in signs]] = 31 + i
    rest = np.flatnonzero(out[:128] == 0)
    out[rest] = 40
    out[0x80:0xC0] = 41 + np.arange(64) % 23  # tail bytes
    return out


_CLASS = _classes()


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): the n-gram of order ORDER that ends at each symbol of a text and at its end."""
    symbols = _CLASS[data]
    there = symbols > 0
    counts = np.concatenate([[0], np.cumsum(there)])[offsets]
    sizes = np.diff(counts)
    pads = ORDER  # ORDER - 1 before a text and one after
    padded = np.zeros(int(counts[-1]) + pads * len(sizes), np.uint32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    padded[np.arange(int(counts[-1])) + (ORDER - 1) + pads * row] = symbols[there]
    codes = padded.copy()
    for j in range(1, ORDER):
        codes[j:] |= padded[:-j] << np.uint32(BITS * j)
    starts = np.concatenate([[0], np.cumsum(sizes + pads)])[:-1]
    keep = np.ones(len(codes), bool)
    for j in range(ORDER - 1):
        keep[starts + j] = False
    return codes[keep], np.concatenate([[0], np.cumsum(sizes + 1)])


def count_grams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over every text of ``docs``."""

    def run(batches):
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for batch in text_slices(whole, column=1):
                langs = np.array(batch.column(0).to_pylist(), object)
                data, offsets = text_bytes(batch.column(1))
                codes, first = grams(data, offsets)
                row = rows_of(first)
                for name in dict.fromkeys(langs.tolist()):
                    own = codes if (mine := langs == name).all() else codes[mine[row]]
                    keys, n = np.unique(own, return_counts=True)
                    if name in held:
                        keys, back = np.unique(np.concatenate([held[name][0], keys]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([held[name][1], n])).astype(np.int64)
                    held[name] = (keys, n)
        for name, (keys, n) in held.items():
            for a in range(0, len(keys), 50_000):
                part = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part.astype(np.int32)), pa.array(n[a : a + 50_000], pa.int64())], names=["lang", "gram", "n"])

    small_batches(docs.sparkSession)
    counts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text")).mapInArrow(tidy(run), "lang string, gram int, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """D(0), D(1), D(2), D(3 and more) of modified Kneser-Ney; 0.5 where a count of counts is empty."""
    n = [int((counts == i).sum()) for i in range(1, 5)]
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0] + [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 for i in (1, 2, 3)]
    return np.clip(d, 0, [0, 0.95, 1.95, 2.95])


def kneser_ney(gram: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """order -> (n-grams, log2 probability, contexts, log2 backoff weight), from the counts of the highest order."""
    levels = {ORDER: (gram.astype(np.int64), n.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):  # lower orders count the distinct symbols before
        lower, counts = np.unique(levels[order + 1][0] & ((1 << (BITS * order)) - 1), return_counts=True)
        levels[order] = (lower, counts.astype(np.float64))
    out = {}
    below = np.full(SYMBOLS, 1.0 / SYMBOLS)  # order 0
    below_keys = np.arange(SYMBOLS)
    for order in range(1, ORDER + 1):
        keys, c = levels[order]
        by = np.argsort(keys, kind="stable")
        keys, c = keys[by], c[by]
        contexts, start = np.unique(keys >> BITS, return_index=True)
        group = np.repeat(np.arange(len(contexts)), np.diff(np.append(start, len(keys))))
        total = np.bincount(group, c)
        d = _discounts(c)[np.minimum(c, 3).astype(int)]
        gamma = np.maximum(np.bincount(group, d) / total, 1e-9)
        suffix = keys & ((1 << (BITS * max(order - 1, 1))) - 1)
        p = np.maximum(c - d, 0) / total[group] + gamma[group] * below[np.searchsorted(below_keys, suffix)]
        out[order] = (keys, np.log2(p), contexts, np.log2(gamma))
        below, below_keys = p, keys
    return out


def _key(lang: int, order: int, gram: np.ndarray) -> np.ndarray:
    return mix64(gram.astype(np.uint64) | np.uint64((order << 32) | (lang << 40)))


class Model:
    """Sorted hash arrays of all languages' models."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = {name: i for i, name in enumerate(sorted(counts))}
        probs, backs = [], []
        for name, i in self.langs.items():
            for order, (keys, p, contexts, gamma) in kneser_ney(*counts[name]).items():
                probs.append((_key(i, order, keys), p))
                backs.append((_key(i, order, contexts), gamma))
        self.prob_keys, self.prob = self._sorted(probs)
        self.back_keys, self.back = self._sorted(backs)

    @staticmethod
    def _sorted(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
        values = np.concatenate([v for _, v in parts]) if parts else np.zeros(0)
        by = np.argsort(keys)
        return keys[by], values[by].astype(np.float32)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The values, NaN where a key is absent."""
        if not len(keys):
            return np.full(len(wanted), np.nan, np.float32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], np.float32(np.nan))

    def log2(self, lang: str, gram: np.ndarray) -> np.ndarray:
        """log2 p(last symbol | those before), by the longest known n-gram and the backoff weights above it."""
        out = np.zeros(len(gram), np.float64)
        i = self.langs.get(lang, -1)
        open_ = np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            code = gram[open_] & ((1 << (BITS * order)) - 1)
            p = self._find(self.prob_keys, self.prob, _key(i, order, code)) if i >= 0 else np.full(len(code), np.nan)
            known = ~np.isnan(p)
            out[open_[known]] += p[known]
            open_, code = open_[~known], code[~known]
            if not len(open_):
                return out
            if i >= 0:
                out[open_] += np.nan_to_num(self._find(self.back_keys, self.back, _key(i, order, code >> BITS)))
        out[open_] -= BITS
        return out


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    marks = np.concatenate([[0], np.cumsum(_SYMBOL_SIGNS[data])])
    prefix = prefix_hash(data)
    hashes = range_hash(prefix, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    row = rows_of(first)
    # Windows of eight words, marked by their row, that are there twice or more cover their words.
    covered = np.zeros(len(starts) + 1, np.int64)
    h, of = windows(hashes, first, REPEAT_WINDOW, 8)
    if len(h):
        with np.errstate(over="ignore"):
            h = h + mix64(of.astype(np.uint64) + np.uint64(77))
        by = np.argsort(h)
        same = h[by][1:] == h[by][:-1]
        twice = np.zeros(len(h), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        at = np.flatnonzero(row[: len(starts) - REPEAT_WINDOW + 1] == row[REPEAT_WINDOW - 1 :])[twice]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + REPEAT_WINDOW, -1)
    repeat = (np.cumsum(covered)[:-1] > 0).astype(np.int64)
    # Lines with a word, equal to an earlier line of the row.
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offsets[1:]]))
    # a row's end is its last line's end; a break's line ends at the break
    line_row = np.searchsorted(offsets, begin, "right") - 1
    line_row = np.minimum(line_row, len(offsets) - 2)
    has = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, line_row = begin[has], end[has], line_row[has]
    dup = np.zeros(len(n_words), np.int64)
    if len(begin):
        with np.errstate(over="ignore"):
            lh = range_hash(prefix, begin, end) + mix64(line_row.astype(np.uint64) + np.uint64(78))
        by = np.argsort(lh, kind="stable")
        again = by[1:][lh[by][1:] == lh[by][:-1]]
        dup = np.bincount(line_row[again], minlength=len(n_words))
    return {
        "n_words": n_words,
        "word_chars": sums(head[ends] - head[starts], first),
        "n_symbols": marks[offsets[1:]] - marks[offsets[:-1]],
        "n_dup_lines": dup,
        "n_repeat_words": sums(repeat, first),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _text_key(lang: str, text: str) -> Column:
    """A 64-bit hash of language and text: copies within a language have the same."""
    return F.xxhash64(F.coalesce(F.col(lang).cast("string"), F.lit("")), F.col(text))


def distinct_texts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` (lang, text) with each text of a language once. Texts without copies aren't shuffled, and a task sends one row of a group at most."""
    keyed = docs.select(lang, text, _text_key(lang, text).alias("velum_key"))
    copied = materialise(keyed.groupBy("velum_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("velum_key"), "copies")
    if copied.count() > BROADCAST_COPIES:
        return keyed.dropDuplicates(["velum_key"]).select(lang, text)
    shared = F.broadcast(copied)
    one = keyed.join(shared, "velum_key", "left_semi").dropDuplicates(["velum_key"])
    return keyed.join(shared, "velum_key", "left_anti").unionByName(one).select(lang, text)


def train(counts: DataFrame, langs: list[str]) -> Model:
    """The model of the given languages, from written counts (lang, gram, n). The counts of one come to the driver at a time, as many as the
    alphabet has n-grams at most."""
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name in langs:
        t = counts.filter(F.col("lang") == name).select("gram", "n").toArrow()
        g, n = (t.column(i).to_numpy().astype(np.int64) for i in (0, 1))
        by = np.argsort(g)
        found[name] = (g[by], n[by])
    return Model(found)


def passes(counts: DataFrame) -> list[list[str]]:
    """Languages (one row each) in groups whose counted n-grams add up to MODEL_ENTRIES at most, one language at least: a group's
    model is broadcast at once."""
    sizes = sorted((r["n"], r["lang"]) for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    out: list[list[str]] = [[]]
    total = 0
    for n, lang in sizes:
        if out[-1] and total + n > MODEL_ENTRIES:
            out.append([])
            total = 0
        out[-1].append(lang)
        total += n
    return out


def score(docs: DataFrame, model: Model, lang: str = "lang", text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns in ``drop``, with the simple counts, base_failed, n_scored (symbols) and log2_perplexity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {**dict.fromkeys(COUNTS, "long"), "base_failed": "boolean", "n_scored": "long", "log2_perplexity": "double"}
    kept = [c for c in docs.columns if c.lower() not in added and c not in drop]
    fields = [f"`{c}` {t}" for c, t in docs.select(*kept).dtypes] + [f"{c} {t}" for c, t in added.items()]

    def run(batches):
        m = shared.value
        seen = np.zeros(SYMBOLS**ORDER, bool)
        for whole in batches:
            for batch in text_slices(whole, column=len(kept) + 1):
                langs = np.array([x or "" for x in batch.column(len(kept)).to_pylist()], object)
                data, offsets = text_bytes(batch.column(len(kept) + 1))
                base = base_counts(data, offsets)
                codes, first = grams(data, offsets)
                values = np.empty(len(codes), np.float32)
                row = rows_of(first)
                for name in dict.fromkeys(langs.tolist()):
                    at = slice(None) if (mine := langs == name).all() else np.flatnonzero(mine[row])
                    own = codes[at]
                    seen[own] = True
                    distinct = np.flatnonzero(seen)
                    seen[distinct] = False
                    values[at] = m.log2(name, distinct)[np.searchsorted(distinct, own)]
                n = np.diff(first)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
                arrays = [*batch.columns[: len(kept)], *(pa.array(base[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(n, pa.int64()), pa.array(-sums(values.astype(np.float64), first) / n)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added])

    small_batches(docs.sparkSession)
    scored = docs.select(*kept, F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("velum_lang"), F.col(text).alias("velum_text"))
    return scored.mapInArrow(tidy(run), ", ".join(fields))


def bands(scored: DataFrame, lang: str = "lang") -> DataFrame:
    """(velum_lang, velum_lower, velum_upper): each language's band of log2 perplexity for long texts, from all distinct texts (``velum_key``) that pass the counts."""
    binned = (
        scored.filter(~F.col("base_failed"))
        .groupBy(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("velum_lang"), "velum_key")
        .agg(F.min(F.floor(F.col("log2_perplexity") * BINS)).alias("bin"))
        .groupBy("velum_lang", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    quartiles = F.percentile("bin", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    half = F.greatest(F.lit(FLOOR), SPREADS * (F.col("q")[2] - F.col("q")[0]) / BINS / 1.349)
    return (
        binned.groupBy("velum_lang")
        .agg(quartiles.alias("q"), F.sum("n").alias("rows"))
        .filter(F.col("rows") >= MIN_BAND_ROWS)
        .select("velum_lang", (F.col("q")[1] / BINS - half).alias("velum_lower"), (F.col("q")[1] / BINS + half).alias("velum_upper"))
    )


def verdict(scored: DataFrame, lang: str = "lang") -> DataFrame:
    """``scored`` with kept: the simple counts passed and the perplexity is within the language's band."""
    limits = materialise(bands(scored, lang), "bands")
    small = limits.count() <= BROADCAST_BANDS
    slack = SHORT / F.sqrt("n_scored")
    inside = F.coalesce((F.col("log2_perplexity") >= F.col("velum_lower") - slack) & (F.col("log2_perplexity") <= F.col("velum_upper") + slack), F.lit(True))
    return (
        scored.withColumn("velum_lang", F.coalesce(F.col(lang).cast("string"), F.lit("")))
        .join(F.broadcast(limits) if small else limits, "velum_lang", "left")
        .withColumn("kept", ~F.col("base_failed") & inside)
        .select(*[c for c in scored.columns if c.lower() not in ("kept", "velum_key")], "kept")
    )


def judge(docs: DataFrame, lang: str = "lang", text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns in ``drop``, with the counts, base_failed, log2_perplexity and kept.

    The scores are written once in the shared folder, as the bands need all of them before any text is judged.
    """
    keyed = docs.withColumn("velum_key", _text_key(lang, text))
    counts = materialise(count_grams(distinct_texts(docs, lang, text), lang, text), "grams")
    groups = passes(counts)
    own = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    # The last group also takes what has no model: rows of languages without a text.
    mine = lambda i: own.isin(groups[i]) if i + 1 < len(groups) else ~own.isin([x for g in groups[:-1] for x in g])
    parts = [score(keyed.filter(mine(i)) if len(groups) > 1 else keyed, train(counts, g), lang, text, drop) for i, g in enumerate(groups)]
    return verdict(materialise(reduce(DataFrame.unionByName, parts), "quality"), lang)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge(docs, drop=("text",)).select("doc_id", *COUNTS, "base_failed", "kept", "log2_perplexity")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, with their own columns, also those named like a result."""
    results = {*COUNTS, "base_failed", "n_scored", "log2_perplexity", "kept"}
    own = {c: f"velum_own_{c}" for c in docs.columns if c.lower() in results}
    passed = judge(docs.withColumnsRenamed(own)).filter("kept")
    return passed.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
