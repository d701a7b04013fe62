"""Text quality by a linear-chain conditional random field over lines.

Each line with a word has features of its own (shape, signs, repetition) and its neighbours'. The chain has two labels, good and
bad. Forward-backward gives each line's probability of being good given all lines of its text, and the text's score is their mean
weighted by length.

Training takes the labelled texts' labels as the labels of their lines, from a documented bound of TRAIN_PER_LABEL texts of each label
(those with the least hashes of their doc_id) and TRAIN_LINES lines of each text; chains are cut into pieces of PIECE lines for training
only. So the driver gets 2 * TRAIN_PER_LABEL * TRAIN_LINES lines at most (37 MB), and the fit's cost is bounded. Scoring takes whole texts.

Memory: a worker holds a slice of texts, one whole text at least (about 150 bytes a byte of one-letter lines, less else).

Defined cases: of texts that share a doc_id the least is learned from; a text without a line with a word (also null and empty ones) gets the share of good pieces (of PIECE lines) among those learned from;
without any label to learn from every score is 0.5; null labels teach nothing; repeated rows are scored each; empty tables
give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.llm.common import mix64, prefix_hash, range_hash, small_batches, table, text_bytes, text_slices, tidy, words

TRAIN_PER_LABEL = 1_000
TRAIN_LINES = 256
PIECE = 64
STEPS = 200
RATE = 0.1
L2 = 1e-3

_SIGNS = (
    [c for c in range(65, 91)],  # capitals
    [c for c in range(97, 123)],
    [c for c in range(48, 58)],
    [ord(c) for c in "#*$%&<>"],
    [ord(c) for c in "!?"],
    [ord(c) for c in "|"],
    [ord(c) for c in ".,;:"],
    [ord(c) for c in "()[]{}=+/\\@^~`_\"'-"],
    [c for c in range(128, 256)],
)
OWN = len(_SIGNS) + 9


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, first): own features of each line with a word, its bytes, and the rows' bounds."""
    rows = len(offsets) - 1
    starts, ends, _ = words(data, offsets)
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offsets[1:]]))
    w0, w1 = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    some = w1 > w0
    begin, end, w0, w1 = begin[some], end[some], w0[some], w1[some]
    n = len(begin)
    if not n:
        return np.zeros((0, OWN), np.float32), np.zeros(0), np.zeros(rows + 1, np.int64)
    row = np.searchsorted(offsets, begin, "right") - 1
    size = (end - begin).astype(np.float64)
    columns = []
    for signs in _SIGNS:
        inside = np.zeros(256, bool)
        inside[signs] = True
        total = np.concatenate([[0], np.cumsum(inside[data])])
        columns.append((total[end] - total[begin]) / size)
    count = (w1 - w0).astype(np.float64)
    prefix = prefix_hash(data)
    hashes = range_hash(prefix, starts, ends)
    line = np.repeat(np.arange(n), w1 - w0)
    own = hashes[w0[0] : w1[-1]] if w1[-1] - w0[0] == len(line) else hashes[np.concatenate([np.arange(a, b) for a, b in zip(w0, w1, strict=True)])]
    with np.errstate(over="ignore"):
        _, once = np.unique(own + mix64(line.astype(np.uint64) + np.uint64(5)), return_index=True)
        _, copy, times = np.unique(range_hash(prefix, begin, end) + mix64(row.astype(np.uint64) + np.uint64(6)), return_inverse=True, return_counts=True)
    distinct = np.bincount(line[once], minlength=n)
    same_next = np.append(own[1:] == own[:-1], False) & (np.append(line[1:], -1) == line)
    capital = np.zeros(256, bool)
    capital[65:91] = capital[0xC3] = True
    stop = np.zeros(256, bool)
    stop[[ord(c) for c in ".!?"]] = True
    columns += [
        np.log1p(size) / 4,
        np.log1p(count) / 4,
        size / count / 10,
        1 - distinct / count,
        np.bincount(line[same_next], minlength=n) / count,
        np.log(times[copy]),
        capital[data[begin]].astype(np.float64),
        stop[data[end - 1]].astype(np.float64),
        (count < 4).astype(np.float64),
    ]
    return np.stack(columns, 1).astype(np.float32), size, np.searchsorted(row, np.arange(rows + 1))


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, the previous and the next line's (0 at the ends), and marks for the first and the last line."""
    n = len(own)
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    filled = np.diff(first) > 0
    head[first[:-1][filled]] = True
    tail[first[1:][filled] - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[head], after[tail] = 0, 0
    return np.concatenate([own, before, after, head[:, None], tail[:, None]], 1).astype(np.float32)


def _logaddexp2(a: np.ndarray) -> np.ndarray:
    return np.logaddexp(a[..., 0], a[..., 1])


def forward_backward(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, pairs, log partition) of chains in log space.

    scores: (chains, longest, 2), of which each chain uses its size; moves: (2, 2) from label to label. marginals has the probability
    of label 1 at each place, pairs the expected number of each move in a chain.
    """
    chains, longest, _ = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    for t in range(1, longest):
        step = _logaddexp2((alpha[:, t - 1][:, :, None] + moves[None]).transpose(0, 2, 1)) + scores[:, t]
        alpha[:, t] = np.where((t < sizes)[:, None], step, alpha[:, t - 1])
    total = _logaddexp2(alpha[:, -1])
    pairs = np.zeros((chains, 2, 2))
    for t in range(longest - 2, -1, -1):
        ahead = (scores[:, t + 1] + beta[:, t + 1])[:, None, :] + moves[None]
        inside = t + 1 < sizes
        beta[:, t] = np.where(inside[:, None], _logaddexp2(ahead), 0)
        pairs += np.where(inside[:, None, None], np.exp(np.minimum(alpha[:, t][:, :, None] + ahead - total[:, None, None], 0)), 0)
    return np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - total[:, None], 0)), pairs, total


def _padded(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(first)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=1)))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - first[:-1][row]] = values
    return out, sizes


def objective(x: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of a line with its penalty, and its slopes by weights and moves; all lines of a chain have its label."""
    sizes = np.diff(first)
    y = np.repeat(labels, sizes).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = np.maximum(sizes[labels == label] - 1, 0).sum()
    scores = x @ weights
    padded, _ = _padded(scores, first)
    marginals, pairs, total = forward_backward(np.stack([np.zeros_like(padded), padded], 2), sizes, moves)
    n = len(x)
    loss = (total[sizes > 0].sum() - (scores * y).sum() - (seen * moves).sum()) / n + L2 / 2 * ((weights**2).sum() + (moves**2).sum())
    slope = x.T @ (marginals[row, np.arange(n) - first[:-1][row]] - y) / n + L2 * weights
    return float(loss), slope, (pairs.sum(0) - seen) / n + L2 * moves


class Model:
    """Weights of label 1 against label 0, and the moves between labels."""

    def __init__(self, features: np.ndarray, first: np.ndarray, labels: np.ndarray):
        """features: with neighbours, of the lines of chains first[i]:first[i+1]; labels: of the chains."""
        self.prior = float(labels.mean())
        self.mean, self.scale = features.mean(0), np.maximum(features.std(0), 1e-3)
        x = self._scaled(features)
        self.weights, self.moves = np.zeros(x.shape[1]), np.zeros((2, 2))
        parameters = [self.weights, self.moves]
        slow = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
        for step in range(1, STEPS + 1):  # Adam
            _, *slopes = objective(x, first, labels, self.weights, self.moves)
            for p, g, m in zip(parameters, slopes, slow, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                p -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)

    def _scaled(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        return np.concatenate([x, np.ones((len(x), 1))], 1)

    def score(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        own, weights, first = line_features(data, offsets)
        out = np.full(len(column), self.prior)
        if not len(own):
            return out
        values = self._scaled(with_neighbours(own, first)) @ self.weights
        sizes = np.diff(first)
        # Chains of like size together: each group pads to at most twice its lines.
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        level = np.floor(np.log2(sizes[order])).astype(int)
        for lv in np.unique(level):
            mine = order[level == lv]
            n = sizes[mine]
            at = np.repeat(first[:-1][mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own_first = np.concatenate([[0], np.cumsum(n)])
            padded, _ = _padded(values[at], own_first)
            good, _, _ = forward_backward(np.stack([np.zeros_like(padded), padded], 2), n, self.moves)
            weight, _ = _padded(weights[at], own_first)
            out[mine] = (good * weight).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled texts: docs (doc_id, text), labels (doc_id, quality). None if no label or no line is there."""
    small_batches(docs.sparkSession)
    good = F.col("quality").cast("int")
    labelled = (
        labels.filter(good.isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", good.alias("y"))
        .distinct()
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .withColumn("h", F.xxhash64("doc_id"))
    )
    # The least hashes of each label: all but a few times as many rows as are wanted go before the window, by the counted share.
    counts = F.broadcast(labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")))
    share = (F.col("h").cast("double") / 2.0**63 + 1) / 2
    few = labelled.join(counts, "y").filter(share * F.col("n") <= 2 * TRAIN_PER_LABEL + 400)
    order = W.partitionBy("y").orderBy("h", "doc_id")
    chosen = few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TRAIN_PER_LABEL).select("doc_id", "y")

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole):
                own, _, first = line_features(*text_bytes(batch.column(1)))
                raw = [own[a : min(b, a + TRAIN_LINES)].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["y", "x"])

    # At most 2 * TRAIN_PER_LABEL rows, so their ids may be broadcast; each gives one row.
    joined = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    found = sorted((r["y"], bytes(r["x"])) for r in joined.mapInArrow(tidy(run), "y int, x binary").collect())
    parts, labels_, sizes_ = [], [], []
    for y, raw in found:
        own = np.frombuffer(raw, np.float32).reshape(-1, OWN)
        if len(own):
            parts.append(with_neighbours(own, np.array([0, len(own)])))
            pieces = [min(PIECE, len(own) - a) for a in range(0, len(own), PIECE)]
            sizes_ += pieces
            labels_ += [y] * len(pieces)
    if not parts:
        return None
    return Model(np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes_)]), np.array(labels_))


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns of every row and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in text_slices(whole):
                scores = np.full(batch.num_rows, 0.5) if m is None else m.score(batch.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], names=[*keep, "score"])

    return docs.select(*keep, F.col(text).alias("velum_text")).mapInArrow(tidy(run), fields + ", score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = train(docs.filter(~F.col("held_out")).select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
