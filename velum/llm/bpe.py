"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The ranks of a tiktoken vocabulary give the merges. One bucket per rank holds the positions of linked-list
nodes whose pair with the next node has that rank; a three-level bitmap of 64-bit words over the ranks
says which buckets are filled, and find-first-set on it gives the next rank in constant time. A merge
changes two pairs at most, so a bucket may hold positions whose pair has since changed; those stale
entries are recognised by their current rank and skipped. The lists of many pre-tokens share one queue:
they are independent, so a bucket's positions merge together, which is what makes numpy worth while, and a
single pre-token of megabytes costs time in proportion to its merges.

Within a pre-token the lowest rank merges first and the leftmost of equals first, as in tiktoken. All
positions of a bucket merge at once only where no merge makes a pair of lower rank; elsewhere the leftmost
of the pre-token goes alone and the rest are put back.

Defined cases: a null text is empty and has no ids; special tokens are ordinary text; repeated rows are
encoded each; an empty table gives an empty result. Each document is encoded whole in its own row, so there
is no shuffle. A worker holds one Arrow batch and about ``CACHE_WORDS`` distinct pre-tokens (40 bytes each).
A hash of a pre-token's bytes finds its ids again; each document's ids are decoded and compared with its text, and
on a difference (two pre-tokens of one hash) the document is encoded without it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from velum.llm.common import prefix_hash, range_hash, small_batches, table, text_bytes, text_slices, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pre-tokens that a worker keeps between batches.
CACHE_WORDS = 500_000
BATCH_BYTES = 8 << 20


class RankBitmap:
    """A set of ranks with constant-time insertion, removal and minimum: words of 64 bits in three levels."""

    def __init__(self, n: int):
        self.low = [0] * (n // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0

    def add(self, r: int) -> None:
        a, b = r >> 6, r >> 12
        self.low[a] |= 1 << (r & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def discard(self, r: int) -> None:
        a, b = r >> 6, r >> 12
        self.low[a] &= ~(1 << (r & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)

    def first(self) -> int:
        """The lowest rank, or -1."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        a = (b << 6) + (self.mid[b] & -self.mid[b]).bit_length() - 1
        return (a << 6) + (self.low[a] & -self.low[a]).bit_length() - 1


class Codec:
    """Encoder and decoder for a {bytes: rank} vocabulary that holds all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.n = max(ranks.values()) + 1
        self.vocab: list[bytes] = [b""] * self.n
        for token, r in ranks.items():
            self.vocab[r] = token
        #: All tokens end to end, and where each begins.
        self.flat = np.frombuffer(b"".join(self.vocab), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in self.vocab])])
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, r in ranks.items():
            for i in range(1, len(token)):
                if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None:
                    pairs[left * self.n + right] = r
        # An open-addressed table: keys at their hash or the next free places.
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.pair_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left = (np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.probes = 0
        while len(left[0]):
            at = self._slot(left[0], self.probes)
            _, chosen = np.unique(at, return_index=True)
            chosen = chosen[self.keys[at[chosen]] < 0]
            self.keys[at[chosen]], self.pair_rank[at[chosen]] = left[0][chosen], left[1][chosen]
            rest = np.ones(len(at), bool)
            rest[chosen] = False
            left = (left[0][rest], left[1][rest])
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging tokens a and b, or -1 (also where either is negative)."""
        keys = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.n + b, -2)
        at = self._slot(keys, 0)
        found = np.where(self.keys[at] == keys, self.pair_rank[at], -1)
        open_ = np.flatnonzero((found < 0) & (keys >= 0) & (self.keys[at] >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = self._slot(keys[open_], probe)
            there = self.keys[at]
            hit = there == keys[open_]
            found[open_[hit]] = self.pair_rank[at[hit]]
            open_ = open_[~hit & (there >= 0)]
        return found

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of piece i are ids[bounds[i]:bounds[i+1]]."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(pieces) + 1, np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        place = np.int32 if n < 2**31 - 1 else np.int64
        piece = np.repeat(np.arange(len(pieces), dtype=place), sizes)
        # Node n is a sentinel on both ends of every list.
        tok = np.append(self.byte_id[data], np.int32(-1))
        at = np.arange(n + 1, dtype=place)
        nxt, prv = at + place(1), at - place(1)
        del at
        filled = sizes > 0
        nxt[bounds[1:][filled] - 1] = n
        prv[bounds[:-1][filled]] = n
        nxt[n] = prv[n] = n
        pair = self.rank(tok, tok[nxt])  # the current rank of each node's pair with the next
        queue: dict[int, list[np.ndarray]] = defaultdict(list)
        filled_ranks = RankBitmap(self.n)

        def push(where: np.ndarray, ranks: np.ndarray) -> None:
            if len(where) > 1:
                order = np.argsort(ranks, kind="stable")
                where, ranks = where[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                heads = ranks[np.concatenate([[0], cuts])].tolist()
                parts = [where[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True)]
            else:
                heads, parts = ranks.tolist(), [where]
            for r, part in zip(heads, parts, strict=False):
                queue[r].append(part)
                filled_ranks.add(r)

        live = np.flatnonzero(pair >= 0).astype(place)
        push(live, pair[live])
        while (r := filled_ranks.first()) >= 0:
            parts = queue.pop(r)
            filled_ranks.discard(r)
            p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            p = p[pair[p] == r]  # the others are stale
            if not len(p):
                continue
            q = nxt[p]
            if len(p) > 1:
                chained = np.zeros(len(p), bool)
                chained[1:] = p[1:] == q[:-1]
                if chained.any():  # overlapping pairs: every second one of a run, from the left
                    runs = np.flatnonzero(~chained)
                    place = np.arange(len(p)) - np.repeat(runs, np.diff(np.append(runs, len(p))))
                    p, q = p[place % 2 == 0], q[place % 2 == 0]
            # What a merge would make, the ones to its left being done and those to its right not.
            left, right = prv[p], nxt[q]
            left_tok = tok[left].copy()
            if len(p) > 1:
                left_tok[1:][left[1:] == q[:-1]] = r
            made = np.full(len(p), r, np.int32)
            low = self.rank(made, tok[right])
            before = self.rank(left_tok, made)
            unsafe = ((low >= 0) & (low < r)) | ((before >= 0) & (before < r))
            if unsafe.any() and len(p) > 1:
                mine = piece[p]
                alone = np.isin(mine, mine[unsafe])
                leftmost = np.append(True, mine[1:] != mine[:-1])
                back = p[alone & ~leftmost]
                if len(back):
                    push(back, np.full(len(back), r))
                take = ~alone | leftmost
                p, q, right = p[take], q[take], right[take]
            tok[p] = r
            tok[q] = -1
            pair[q] = -1
            nxt[p] = right
            prv[right] = p
            prv[n] = nxt[n] = n
            left = prv[p]
            pair[p] = self.rank(tok[p], tok[nxt[p]])
            pair[left] = self.rank(tok[left], tok[nxt[left]])
            pair[n] = -1
            both = np.concatenate([p, left])
            both = both[pair[both] >= 0]
            if len(both):
                push(both, pair[both])
        alive = tok[:n] >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        return tok[:n][alive].astype(np.uint32), kept[bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        sizes = self.begin[ids + 1] - self.begin[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.flat[at].tobytes()

    def encode_alone(self, text: bytes) -> np.ndarray:
        """The ids of one text, by its pre-tokens as they stand."""
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = Splitter.of(self.pattern)(data, np.array([0, len(data)]))
        return self.encode_pieces([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])[0].astype("<u4")

    def encode_rows(self, words: Words, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row's text, as little-endian unsigned 32-bit integers."""
        split, slices = Splitter.of(self.pattern), []
        for part in text_slices(pa.RecordBatch.from_arrays([column], names=["text"])):
            data, offsets = text_bytes(part.column(0))
            starts, ends, first = split(data, offsets)
            slices.append((words.number(self, data, starts, ends), first))
        words.encode_new(self)
        for numbers, first in slices:
            sizes = words.sizes[numbers]
            stops = np.concatenate([[0], np.cumsum(sizes)])
            ids = words.ids[np.repeat(words.starts[numbers] - stops[:-1], sizes) + np.arange(stops[-1])]
            for a, b in zip(stops[first[:-1]].tolist(), stops[first[1:]].tolist(), strict=True):
                yield ids[a:b]


class Splitter:
    """Cuts texts into pre-tokens: (starts, ends, first) in bytes, as by the pattern's matches from left to right.

    The usual pattern (contractions; letters, digits or other signs after at most one space; white space) is
    decided for a whole slice at once from each character's class; any other pattern is matched text by text.
    """

    USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    _SPACE, _LETTER, _DIGIT, _OTHER = range(4)

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).finditer
        self.usual = pattern == self.USUAL
        if self.usual:
            self.kind = np.full(0x110000, self._OTHER, np.uint8)
            every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
            for kind, own in ((self._LETTER, r"\p{L}+"), (self._DIGIT, r"\p{N}+"), (self._SPACE, r"\s+")):
                for m in regex.finditer(own, every):
                    self.kind[ord(m.group()[0]) : ord(m.group()[-1]) + 1] = kind

    @staticmethod
    @functools.cache
    def of(pattern: str) -> Splitter:
        return Splitter(pattern)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (self._by_class if self.usual else self._by_match)(data, offsets)

    def _by_match(self, data, offsets):
        starts, ends, first = [], [], [0]
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            text = data[a:b].tobytes().decode()
            at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) + a
            spans = [m.span() for m in self.find(text) if m.end() > m.start()]
            starts += [int(at[x]) for x, _ in spans]
            ends += [int(at[y]) for _, y in spans]
            first.append(len(starts))
        return np.array(starts, np.int64), np.array(ends, np.int64), np.array(first, np.int64)

    def _by_class(self, data, offsets):
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each character starts
        kind = self.kind[chars]
        rows = np.searchsorted(at, offsets)  # the character at which each row starts
        opens = np.zeros(len(chars) + 1, bool)
        opens[rows] = True  # a row's first character
        last = opens[1:]  # a row's last character
        opens = opens[:-1]
        same = np.zeros(len(chars), bool)  # of the kind of the character before, in the same row
        same[1:] = kind[1:] == kind[:-1]
        same &= ~opens
        cut = ~same
        space = kind == self._SPACE
        nextspace = np.zeros(len(chars), bool)
        nextspace[:-1] = space[1:]
        final = space & ~last & ~nextspace  # the last of a white-space run that text follows
        cut |= final
        joins = np.flatnonzero(final & (chars == 32)) + 1
        cut[joins] = False  # one space goes with what follows
        marks = np.flatnonzero((chars == 39) & cut)
        marks = marks[marks + 1 < len(chars)]
        marks = marks[~last[marks]]
        for suffix in ("s", "t", "m", "d", "re", "ve", "ll"):
            own = marks[chars[marks + 1] == ord(suffix[0])]
            if len(suffix) == 2:
                own = own[own + 2 < len(chars)]
                own = own[~last[own + 1] & (chars[own + 2] == ord(suffix[1]))]
            cut[own + 1] = False
            after = own + 1 + len(suffix)
            cut[after[after < len(chars)]] = True  # inside a longer word, or where a cut is anyway
        starts = at[cut]
        ends = np.append(starts[1:], len(data))
        return starts, ends, np.searchsorted(starts, offsets)


class Words:
    """Distinct pre-tokens that a worker has seen, by a 64-bit hash of their bytes, and their ids end to end."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[bytes] = []

    def number(self, codec: Codec, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each pre-token's number; those not seen before wait in ``new``."""
        hashes, first, inverse = np.unique(range_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        if not len(hashes):
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        old = self.known[place] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        fresh = first[~old]
        raw = data.tobytes()
        count = len(self.known)
        self.new += [raw[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
        numbers = np.empty(len(hashes), np.int64)
        if count:
            numbers[old] = self.at[place[old]]
        numbers[~old] = np.arange(count, count + len(fresh))
        known = np.concatenate([self.known, hashes[~old]])
        order = np.argsort(known, kind="stable")
        self.known, self.at = known[order], np.concatenate([self.at, numbers[~old]])[order]
        return numbers[inverse]

    def encode_new(self, codec: Codec) -> None:
        ids, bounds = codec.encode_pieces(self.new)
        self.starts = np.concatenate([self.starts, bounds[:-1] + len(self.ids)])
        self.sizes = np.concatenate([self.sizes, np.diff(bounds)])
        self.ids = np.concatenate([self.ids, ids.astype("<u4")])
        self.new = []


@functools.cache
def load(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


@functools.cache
def words_of(path: str, pattern: str) -> Words:
    """The worker's own pre-tokens, kept from task to task."""
    return Words()


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """``keep`` columns of every row, n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids (array of int).

    path: a rank file that every executor has at that place (a parameter; the file is never copied).
    """
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    schema = fields + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(batches):
        codec, words = load(path, pattern), words_of(path, pattern)
        for whole in batches:
            for batch in text_slices(whole, BATCH_BYTES):
                column = batch.column(len(keep))
                texts = pc.fill_null(column, "").cast(pa.large_binary())
                counts, digests, decoded, out = [], [], [], []
                if len(words.known) > CACHE_WORDS:
                    words.clear()
                for own, text in zip(codec.encode_rows(words, column), texts, strict=True):
                    back = codec.decode(own)
                    if back != text.as_py():  # two pre-tokens with one 64-bit hash: encoded again, apart
                        own = codec.encode_alone(text.as_py())
                        back = codec.decode(own)
                    counts.append(len(own))
                    digests.append(hashlib.sha256(own.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    if ids:
                        out.append(own.astype(np.int32))
                arrays = [*batch.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(ends, np.concatenate(out) if out else np.zeros(0, np.int32)))
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    small_batches(docs.sparkSession)
    return docs.select(*keep, docs["text"].alias("text")).mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), P.path(VOCABULARY), P.PATTERN, ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded documents: doc_id, n_tokens, the two digests and the ids."""
    import public_tokenizers as P

    return encode(docs, P.path(VOCABULARY), P.PATTERN)
