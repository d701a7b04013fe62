"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each text's set of word shingles gives a MinHash signature of BANDS * ROWS values; texts of equal sets are one
   class from then on, so thousands of copies cost one row. Signatures are written once.
2. Classes that share a band's values are banded candidates; only such pairs are ever compared. To ship each text once,
   the classes that buckets connect (families) are compared in one task where a family fits one (buckets of equal members
   count once).
3. Within a task signatures of candidates are compared in batches of ``BATCH`` values, a pair being given up once the
   posterior probability that its similarity reaches the threshold falls below ``MISS`` (uniform prior). Survivors are
   verified on their full shingle sets, the likeliest first, unless links already found connect the two. So no pair is
   emitted but those that connect.
4. A family too large for one task is cut into blocks. Each block is compared in itself and with the family's first class,
   which connects a large group of near copies in one pass. Then what a bucket that still holds several components has outside
   its largest is compared with blocks of the bucket's members, pairs already connected left out. Those outside the same
   component share blocks, so its members are sent once for many buckets, and a block whose buckets together have more rows
   than its family gets the family instead. So every pair of a bucket is compared or connected, at any size.
5. The connected parts of the verified links are the components.

At BANDS, ROWS a pair at the threshold 0.85 shares a band with probability 1 - 4e-7 (0.8: 1 - 5e-5).

Defined cases: null and empty texts, and texts without a word, have no shingles and are linked with nothing;
fewer than five words are one shingle; a null doc_id stays null, and real ids (below 2^62) lead its group;
rows of one doc_id are one node; an empty table gives an empty result; other columns are not looked at. Shingles are compared by
64-bit hashes. Memory: a worker holds a slice of texts (one whole text at least, about 60 bytes a byte) or one block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import (
    materialise,
    mix64,
    prefix_hash,
    range_hash,
    small_batches,
    stream64,
    string,
    table,
    text_bytes,
    text_slices,
    tidy,
    whole_groups,
    windows,
    words,
)
from velum.llm.components import components

SHINGLE = 5
BANDS, ROWS = 25, 5
BATCH = 25
MISS = 1e-4
PERCENT = 85
STAGE_PERCENT = 80
#: Shingles and members of a block.
BLOCK_SHINGLES = 300_000
BLOCK_MEMBERS = 400
#: Shingles of the blocks that one task gets, about.
TASK_SHINGLES = 4_000_000
#: Numbers (8 bytes each) up to which an id list is broadcast.
BROADCAST_IDS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIERS = stream64(3, BANDS * ROWS) | np.uint64(1)
_SHIFTS = stream64(4, BANDS * ROWS)


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each row's distinct shingles of k words."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, first = words(data, offsets)
    n = len(first) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = range_hash(prefix_hash(data), starts, ends)
    found, row = windows(h, first, k, 5)
    sizes = np.diff(first)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        coefficients = stream64(6, k) | np.uint64(1)
        extra = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k - 1):
                some = sizes[short] > j
                extra[some] += h[first[short[some]] + j] * coefficients[j]
            extra = mix64(extra + sizes[short].astype(np.uint64))
        found, row = np.concatenate([found, extra]), np.concatenate([row, short])
        by = np.argsort(row, kind="stable")
        found, row = found[by], row[by]
    with np.errstate(over="ignore"):
        _, once = np.unique(found ^ mix64(row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    once.sort()
    return found[once], np.searchsorted(row[once], np.arange(n + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, BANDS * ROWS) of 32-bit minima; rows without shingles have the largest value throughout."""
    filled = np.flatnonzero(np.diff(first) > 0)
    out = np.full((len(first) - 1, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    if len(filled):
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                out[filled, k] = np.minimum.reduceat(((hashes * _MULTIPLIERS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32), first[:-1][filled])
    return out


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    with np.errstate(over="ignore"):
        return total[first[1:]] - total[first[:-1]]


def _set_hash(hashes: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    return _row_sums(mix64(hashes ^ np.uint64(seed)), first)


_C1, _C2 = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def set_marks(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that identify each row's set."""
    return tuple(_set_hash(hashes, first, c).view(np.int64) for c in (_C1, _C2))


def sketch(docs: DataFrame) -> DataFrame:
    """(node, n_shingles, c1, c2, signature) of each row of (node, text); c1, c2 identify the set; a signature's values are in bytes."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole):
                hashes, first = shingles(batch.column(1))
                c1, c2 = set_marks(hashes, first)
                marks = signatures(hashes, first)
                raw = pa.Array.from_buffers(pa.binary(), len(marks), [None, pa.py_buffer((np.arange(len(marks) + 1) * marks.shape[1] * 4).astype(np.int32).tobytes()), pa.py_buffer(marks.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(c1), pa.array(c2), raw], names=["node", "n_shingles", "c1", "c2", "signature"])

    small_batches(docs.sparkSession)
    return docs.select("node", "text").mapInArrow(tidy(run), "node long, n_shingles long, c1 long, c2 long, signature binary")


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """For each number of batches compared, the fewest matches with which a pair goes on.

    With a uniform prior, m matches of n leave the similarity Beta(m + 1, n - m + 1), which exceeds t with the
    probability that of n + 1 draws at t at most m succeed.
    """
    t, out = percent / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


class _Sets:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def candidates(marks: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the pairs that share a band, between rows marked left and the others, or among all if none is left."""
    bands = marks.reshape(len(marks), BANDS, ROWS).astype(np.uint64)
    keys = np.zeros((len(marks), BANDS), np.uint64)
    for j in range(ROWS):
        keys = mix64(keys + bands[:, :, j] + np.uint64(j + 1))
    rows, others = (np.flatnonzero(left), np.flatnonzero(~left)) if left.any() else (np.arange(len(marks)),) * 2
    shared = np.zeros((len(rows), len(others)), bool)
    for b in range(BANDS):
        shared |= keys[rows, b][:, None] == keys[others, b][None, :]
    if not left.any():
        shared = np.triu(shared, 1)
    a, b = np.nonzero(shared)
    return rows[a], others[b]


class Banded:
    """How candidates of a block are found: pairs that share a band, without those that a batch of values rules out."""

    shingle = SHINGLE

    def read(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(pa.concat_arrays([column]).buffers()[2], np.uint32)[: len(column) * BANDS * ROWS].reshape(len(column), BANDS * ROWS)

    def pairs(self, marks: np.ndarray, mine: np.ndarray, left: np.ndarray, known: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) among the rows ``mine`` of what ``read`` gave, the likeliest first."""
        marks = marks[mine]
        a, b = candidates(marks, left)
        good = likely_sizes(a, b, known, sizes, percent)
        a, b = a[good], b[good]
        matches = np.zeros(len(a), np.int64)
        for i, least in enumerate(least_matches(percent)):
            at = slice(i * BATCH, (i + 1) * BATCH)
            matches += (marks[a, at] == marks[b, at]).sum(1)
            good = matches >= least
            a, b, matches = a[good], b[good], matches[good]
        by = np.argsort(-matches, kind="stable")
        return a[by], b[by]


def likely_sizes(a: np.ndarray, b: np.ndarray, known: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs aren't connected yet and have a smaller set that holds the share of the larger that the threshold asks for."""
    return (known[a] != known[b]) & (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])) & (sizes[b] > 0)


def connect(ids: np.ndarray, known: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect the similar ones of ``pairs``; rows of equal ``known`` component are connected already.

    hashes[first[i]:first[i+1]] are row i's shingles.
    """
    out, sets = [], _Sets(len(ids))
    if not len(pairs[0]):
        return out
    seen: dict[int, int] = {}
    for i, c in enumerate(known.tolist()):
        sets.up[i] = sets.find(seen.setdefault(c, i))
    own: dict[int, np.ndarray] = {}

    def members(i: int) -> np.ndarray:
        if i not in own:
            own[i] = np.sort(hashes[first[i] : first[i + 1]])
        return own[i]

    for x, y in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True):
        u, v = sets.find(x), sets.find(y)
        if u == v:
            continue
        p, q = members(x), members(y)
        if len(p) > len(q):
            p, q = q, p
        at = np.minimum(np.searchsorted(q, p), len(q) - 1)
        shared = int((q[at] == p).sum())
        if 100 * shared >= percent * (len(p) + len(q) - shared):
            sets.up[u] = v
            out.append((int(ids[x]), int(ids[y])))
    return out


def _compare(groups: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, method) -> DataFrame:
    """(a, b): verified links within the groups (g, i, j, id, left, known) of classes (id, n, c1, signature) with texts (id, text)."""
    groups = materialise(groups, "groups")
    rows = groups.join(classes.select("id", "n", "c1", "signature"), "id").join(texts, "id")
    total = groups.join(classes.select("id", "n"), "id").agg(F.sum("n").alias("n")).first()["n"] or 0
    spark = groups.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_SHINGLES))
    keys = ["g", "i", "j"]

    def run(batches):
        for batch in whole_groups(batches, 3, 6, BLOCK_SHINGLES):
            hashes, first = shingles(batch.column(9), method.shingle)
            g, i, j, ids, left, known, _, c1 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
            marks = method.read(batch.column(8))
            # Rows of one doc_id may have different texts: each text goes with its own signature, once.
            right = _set_hash(hashes, first, _C1).view(np.int64) == c1
            starts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            found: list[tuple[int, int]] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                mine = a + np.flatnonzero(right[a:b])
                if len(mine) < 2:
                    continue
                sizes = np.diff(first)[mine]
                own = np.concatenate([hashes[first[k] : first[k + 1]] for k in mine.tolist()])
                pairs = method.pairs(marks, mine, left[mine].astype(bool), known[mine], sizes, percent)
                found += connect(ids[mine], known[mine], pairs, own, np.concatenate([[0], np.cumsum(sizes)]), percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    dealt = rows.select(*keys, "id", "left", "known", "n", "c1", "signature", "text").repartition(tasks, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(run), "a long, b long")


def keep_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join with a written id list, broadcast if its counted size allows."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def _blocks() -> Column:
    return F.greatest(F.ceil(F.col("size") / BLOCK_MEMBERS), F.ceil(F.col("weight") / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _block(seed: int, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(blocks)).cast("int")


def links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): verified links that connect the similar classes. docs: (node, text); classes: (id, n, c1, signature)."""
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * ROWS * 4 + 1, F.lit(ROWS * 4)))))
    return link_buckets(docs, classes, classes.select("id", "c1", band.alias("key")), percent, Banded())


def link_buckets(docs: DataFrame, classes: DataFrame, keyed: DataFrame, percent: int, method) -> DataFrame:
    """(a, b): verified links that connect the similar classes among those that share a key of ``keyed`` (key, id, c1).

    docs: (node, text); classes: (id, n, c1, signature); method: candidates of a block by their signatures, as :class:`Banded`.
    """
    # Most keys have one id: those of several are found by two numbers a key, and only their rows are looked at further.
    shared = materialise(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub <> last").select("key"), "shared")
    met = materialise(keep_ids(keyed, shared, "key", "left_semi"), "met")
    marks = [F.bit_xor(F.xxhash64(F.lit(s), "id", "c1")).alias(f"s{s}") for s in (1, 2)]
    buckets = met.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), *marks)
    distinct = materialise(buckets.groupBy("s1", "s2", "hub", "last").agg(F.min("key").alias("key")).select("key", "hub"), "buckets")
    members = materialise(met.join(distinct, "key").select("key", "id", "hub").distinct(), "members")
    families = materialise(components(members.select(F.col("id").alias("a"), F.col("hub").alias("b"))), "families")
    ids = materialise(families.select("id"), "ids")
    # Signatures and texts of the candidates alone go on.
    classes = materialise(keep_ids(classes, ids, "id", "left_semi"), "candidates")
    weighed = families.join(classes.groupBy("id").agg(F.sum("n").alias("n")), "id")
    count = [F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")]
    sized = materialise(weighed.groupBy("component").agg(*count).withColumn("blocks", _blocks()), "sizes")
    zero, no = F.lit(0), F.lit(False)
    texts = materialise(keep_ids(docs.withColumnRenamed("node", "id"), ids, "id", "left_semi").dropDuplicates(["id", "text"]).select("id", "text"), "texts")
    # A family is one block, or several, in each of which its first class stands too.
    hub = F.col("id") == F.col("component")
    block = F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block(1, "blocks")))
    first = weighed.join(sized.select("component", "blocks"), "component").select(F.col("component").alias("g"), F.explode(block).alias("i"), zero.alias("j"), "id", no.alias("left"), F.col("id").alias("known"))
    found = materialise(_compare(first, classes, texts, percent, method), "links-first")
    many = sized.filter("blocks > 1").select("component")
    if many.isEmpty():
        return found
    # What a bucket holds outside its largest component meets the bucket's members.
    parts = materialise(components(found).withColumnsRenamed({"component": "known"}), "parts")
    known = materialise(weighed.join(many, "component").join(parts, "id", "left").select("component", "id", "n", F.coalesce("known", "id").alias("known")), "known")
    several = known.groupBy("component").agg(F.min("known").alias("least"), F.max("known").alias("last")).filter("least <> last").select("component")
    keys = F.collect_set("key").alias("keys")
    mine = members.groupBy("id").agg(keys).join(known.join(several, "component"), "id")
    mine = materialise(mine.select(F.explode("keys").alias("key"), "component", "id", "n", "known"), "crowded")
    per = mine.groupBy("key", "known").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("known", "c").alias("most"))
    placed = materialise(mine.join(per.filter("parts > 1").select("key", "most"), "key"), "placed")
    # Those outside one component share blocks, so that its members are sent once for many buckets; a bucket that fills blocks has its own.
    alone = materialise(placed.filter("known <> most").groupBy("component", "id", "n", "known").agg(F.min("most").alias("most"), F.min("key").alias("lead"), keys), "outside")
    leads = alone.groupBy("most", "lead").agg(*count).withColumn("own", _blocks())
    pools = leads.filter("own = 1").groupBy("most").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).select("most", _blocks().alias("pool"))
    own, pooled = F.col("own") > 1, F.pmod(F.xxhash64(F.lit(2), "lead"), F.col("pool")).cast("int")
    outer = alone.join(leads.select("most", "lead", "own"), ["most", "lead"]).join(pools, "most", "left")
    outer = materialise(outer.select(F.when(own, F.col("lead")).otherwise(F.col("most")).alias("g"), F.when(own, _block(2, "own")).otherwise(pooled).alias("i"), "component", "id", "known", "keys"), "outer")
    # A block meets the members of its ids' buckets, or, if those add up to more rows than its family has in such buckets, all these.
    touched = materialise(outer.select("g", "i", "component", F.explode("keys").alias("key")).distinct(), "touched")
    kin = materialise(placed.select("component", "id", "n", "known").distinct(), "kin")
    held = placed.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    rows = touched.join(held, "key").groupBy("g", "i", "component").agg(F.sum("held").alias("rows"))
    wide = rows.join(kin.groupBy("component").agg(F.count(F.lit(1)).alias("kin")), "component").filter("rows >= kin")
    wide = materialise(wide.select("g", "i", "component"), "wide")
    wide = F.broadcast(wide) if 3 * wide.count() <= BROADCAST_IDS else wide
    few = touched.join(wide, ["g", "i", "component"], "left_anti").join(placed.select("key", "id", "n", "known"), "key").select("g", "i", "id", "n", "known").distinct()
    inner = materialise(few.unionByName(kin.join(wide, "component").select("g", "i", "id", "n", "known")), "inner")
    sizes = materialise(inner.groupBy("g", "i").agg(*count).select("g", "i", _blocks().alias("blocks")), "block-sizes")
    sizes = F.broadcast(sizes) if 3 * sizes.count() <= BROADCAST_IDS else sizes
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    out = outer.join(sizes, ["g", "i"]).select("g", "i", every, "id", F.lit(True).alias("left"), "known")
    within = inner.join(sizes, ["g", "i"]).select("g", "i", _block(3, "blocks").alias("j"), "id", no.alias("left"), "known")
    return found.unionByName(_compare(out.unionByName(within), classes, texts, percent, method))


#: Nodes of rows without a doc_id are numbers from here on, so that real ids lead a group.
UNNAMED = 1 << 62


def node(key: Column, text: Column) -> Column:
    return F.coalesce(key.cast("long"), F.xxhash64(string(text)).bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED)))


def doc_id() -> Column:
    """The id that a node stands for: null for rows without one."""
    return F.when(F.col("node") < UNNAMED, F.col("node"))


def grouped(sketched: DataFrame, find: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(node, n_shingles, component_id) of each row of ``sketched`` (node, n_shingles, c1, c2, ...), written in the shared folder.

    find gives the links of the classes of equal sets (id, n, c1, c2, ...) and gets them and the nodes of copies that no class is named after.
    """
    some = sketched.filter("n_shingles > 0")
    # Sets without copies, most of them, are classes without a shuffle of signatures.
    copied = materialise(some.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("c1", "c2"), "copied")
    shared = F.broadcast(copied) if 2 * copied.count() <= BROADCAST_IDS else copied
    of_copies = some.join(shared, ["c1", "c2"], "left_semi")
    more = [c for c in sketched.columns if c not in ("node", "n_shingles", "c1", "c2")]
    one = F.col("node").alias("id"), F.col("n_shingles").alias("n"), *more, "c1", "c2"
    least = F.min("node").alias("id"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in more]
    firsts = of_copies.groupBy("c1", "c2").agg(*least)
    classes = materialise(some.join(shared, ["c1", "c2"], "left_anti").select(*one).unionByName(firsts), "classes")
    # Rows of one set hang on its class; rows of one doc_id and different sets are one node.
    heads = classes.select("c1", "c2", "id").join(shared, ["c1", "c2"], "left_semi")
    hung = of_copies.select("node", "c1", "c2").join(heads, ["c1", "c2"]).filter("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    whole = components(find(classes, hung.select(F.col("a").alias("node"))).union(hung))
    whole = materialise(whole.select(F.col("id").alias("node"), "component"), "components")
    rows = sketched.select("node", "n_shingles")
    joined = rows.join(F.broadcast(whole) if whole.count() <= BROADCAST_IDS // 4 else whole, "node", "left")
    return joined.select("node", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(node, n_shingles, component_id) of each row of ``docs``, written in the shared folder."""
    narrow = docs.select(node(F.col(key), F.col(text)).alias("node"), F.col(text).alias("text"))
    return grouped(materialise(sketch(narrow), "sketch"), lambda classes, _: links(narrow, classes, percent))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select(doc_id().alias("doc_id"), "n_shingles", "component_id", (F.col("node") == F.col("component_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id; of rows that share it, one."""
    found = materialise(near_duplicates(docs, percent=STAGE_PERCENT), "near")
    gone = materialise(found.filter("node <> component_id").select(F.col("node").alias("velum_node")).distinct(), "gone")
    again = materialise(found.groupBy("node").count().filter("count > 1").select(F.col("node").alias("velum_node")), "again")
    rest = keep_ids(docs.withColumn("velum_node", node(F.col("doc_id"), F.col("text"))), gone, "velum_node", "left_anti")
    if again.isEmpty():
        return rest.select(*docs.columns)
    single = keep_ids(rest, again, "velum_node", "left_anti")
    return single.union(keep_ids(rest, again, "velum_node", "left_semi").dropDuplicates(["velum_node"]).select(*single.columns)).select(*docs.columns)
