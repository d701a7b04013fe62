"""Language identification by a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of distinct letter n-grams of
1 to ``N`` letters that both have, over the geometric mean of the numbers that each has. Training uses a
documented bound: ``TRAIN_PER_LANG`` labelled texts of each language, of which ``LANDMARKS_PER_LANG`` are the
Nyström landmarks; kernel ridge regression of each language against the rest is solved in the landmarks' space.
A text's score needs its presence vector over the landmarks' n-grams only: batches of such vectors times the
landmark matrix, times the regression weights, are two matrix products. Every n-gram of every whole text counts.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is every text if no row
can be learned from; equal scores take the alphabetically first language; rows with a null lang teach nothing;
repeated rows are scored each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.llm.common import small_batches, table, text_bytes, text_slices, tidy

N, BITS = 3, 7
TRAIN_PER_LANG = 300
LANDMARKS_PER_LANG = 32
#: Texts of these sizes (bytes) are learned from first; of others, which fill a language's sample, the first so many
#: characters. This bounds what the driver gets.
TRAIN_BYTES = (200, 8_000)
RIDGE = 1e-3
#: Presence vectors that are multiplied at once.
BLOCK = 256


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> 0 for no letter, 1..26 for a-z in either case, 27..127 for others by a hash of the lower-case letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % 101
    return out


def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sizes, letters): row << 32 | n << 24 | n-gram of each distinct n-gram of a row, each row's number of them, and whether it has a letter.

    White space and signs count as one blank between words; blanks stand at both ends. n-grams of blanks alone don't count.
    """
    data, offsets = text_bytes(column)
    n = len(column)
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    firsts = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    code = _letters()[chars]
    # A blank before each row and N - 1 after it.
    row = np.repeat(np.arange(n), np.diff(firsts))
    padded = np.zeros(len(code) + N * n, np.uint32)
    padded[np.arange(len(code)) + 1 + N * row] = code
    rows = np.repeat(np.arange(n), np.diff(firsts) + N)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] > 0) | (padded[:-1] > 0) | (rows[1:] != rows[:-1])
    padded, rows = padded[keep], rows[keep]
    gram = np.zeros(len(padded), np.int64)
    for j in range(N):
        part = np.zeros(len(padded), np.int64)
        part[: len(padded) - j] = padded[j:]
        part[: len(padded) - j][rows[j:] != rows[: len(padded) - j]] = 0
        gram = gram << BITS | part
    full = np.unique((rows.astype(np.int64) << 32) | gram)
    keys = []
    for k in range(1, N + 1):
        short = full >> (BITS * (N - k)) << (BITS * (N - k))
        own = (full & ((1 << 32) - 1)) >> (BITS * (N - k))
        some = np.append(True, short[1:] != short[:-1]) & (own > 0)
        keys.append((full[some] >> 32 << 32) | (k << 24) | own[some])
    out = np.concatenate(keys)
    letters = np.zeros(n, bool)
    letters[row[code > 0]] = True
    return out, np.bincount(out >> 32, minlength=n).astype(np.float64), letters


class Model:
    """Landmarks, their n-grams and the regression weights."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: list[int]):
        self.langs = sorted(set(langs))
        marks, sizes, _ = presence(pa.array([texts[i] for i in landmarks], pa.string()))
        self.grams = np.unique(marks & 0xFFFFFFFF)
        hits = np.zeros((len(self.grams), len(landmarks)), np.float32)
        hits[np.searchsorted(self.grams, marks & 0xFFFFFFFF), marks >> 32] = 1
        self.landmarks = hits / np.sqrt(np.maximum(sizes, 1)).astype(np.float32)
        gram = self.landmarks.T @ self.landmarks
        values, vectors = np.linalg.eigh(gram.astype(np.float64))
        good = values > 1e-6 * values.max(initial=0)
        self.whiten = vectors[:, good] / np.sqrt(values[good])
        features = np.concatenate([self.kernel(pa.array(texts[a : a + BLOCK], pa.string()))[0] for a in range(0, len(texts), BLOCK)]) @ self.whiten
        features = np.hstack([features, np.ones((len(features), 1))])
        sides = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        weights = np.linalg.solve(features.T @ features + RIDGE * len(features) * np.eye(features.shape[1]), features.T @ sides)
        self.weights, self.bias = (self.whiten @ weights[:-1]).astype(np.float32), weights[-1].astype(np.float32)

    def kernel(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(kernel values with each landmark, whether a letter is there) of at most BLOCK rows."""
        keys, sizes, letters = presence(column)
        code = keys & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        known = self.grams[at] == code
        vectors = np.zeros((len(column), len(self.grams)), np.float32)
        vectors[keys[known] >> 32, at[known]] = 1
        return (vectors @ self.landmarks) / np.sqrt(np.maximum(sizes, 1))[:, None].astype(np.float32), letters

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        kernel, letters = self.kernel(column)
        scores = kernel @ self.weights + self.bias
        best = scores.argmax(1)
        score = np.clip((scores[np.arange(len(best)), best].astype(np.float64) + 1) / 2, 0, 1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> Model | None:
    """A model of the labelled rows of ``docs``, from a bounded sample of each language's; None if there are none."""
    order = W.partitionBy("lang").orderBy("other", "h", "text")
    other = ~F.octet_length(text).between(*TRAIN_BYTES)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"), other.alias("other"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    # The least hashes of each language: all but a few times as many rows as are wanted go before the window, by the counted share.
    counts = F.broadcast(rows.groupBy("lang", "other").agg(F.count(F.lit(1)).alias("n")))
    share = (F.col("h").cast("double") / 2.0**63 + 1) / 2
    few = rows.join(counts, ["lang", "other"]).filter(share * F.col("n") <= 2 * TRAIN_PER_LANG + 400)
    sample = (
        few.select("lang", "other", "h", F.substring("text", 1, TRAIN_BYTES[1]).alias("text"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= TRAIN_PER_LANG)
        .select("lang", "text", "place")
        .orderBy("lang", "place")
        .collect()
    )
    if not sample:
        return None
    return Model([r["text"] for r in sample], [r["lang"] for r in sample], [i for i, r in enumerate(sample) if r["place"] <= LANDMARKS_PER_LANG])


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of every row with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    fields = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes] + ["lang_pred string", "score double"]

    def run(batches):
        m = shared.value
        for whole in batches:
            for part in text_slices(whole):
                for a in range(0, part.num_rows, BLOCK):
                    batch = part.slice(a, BLOCK)
                    names, scores = (["und"] * batch.num_rows, np.zeros(batch.num_rows)) if m is None else m.predict(batch.column(len(keep)))
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text).alias("velum_text")).mapInArrow(tidy(run), ", ".join(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    return identify(docs, train(docs.filter(~F.col("held_out"))), keep=("doc_id", "held_out"))
