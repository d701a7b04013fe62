"""Prefix trie of conversations: every distinct sequence of first turns is a node.

1. Turns are numbered by a sort over ranges of (conversation, turn, role, text); a numpy pass numbers each range, and the few
   conversations that go on in the next range have the counts before them added. So a conversation may hold any share of the rows.
2. A numpy scan gives the polynomial prefix fingerprints: the sum of turn hashes times powers of a base modulo 2^64. A
   conversation is scanned in blocks of ``BLOCK`` turns, each beginning with the sum of those before.
3. Prefixes of one depth and fingerprint are a group, whose representative is its smallest conversation. Every member is verified
   turn by turn: its last turn must be its representative's (the same row, or equal role and text), its prefix without that turn must
   be in the group of the representative's. By induction groups are exact. From a group that fails on, all its members' prefixes
   get a fingerprint under another seed in addition, until none fails: so collisions split.
4. The nodes whose smallest member is one conversation are a path, which hangs on a node of another's path. Parents are rolled up over
   this tree of paths by pointer doubling (its height is small, long conversations are single paths), then along paths by running sums.

Defined cases: rows without a conversation id belong to none; turns of equal number stand in the order of role, then text (null number
first, null role or text empty); repeated rows are turns of their own; a conversation without turns is a member of the root; an
empty table gives an empty result; other columns are not looked at. A worker holds a slice of texts or one Arrow batch of numbers.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.llm.common import materialise, mix64, small_batches, string, table, text_bytes, text_slices, tidy, words

#: Turns of a conversation that are scanned or summed as one group.
BLOCK = 4096
#: Copies of a table of groups, each met by a share of the rows, so that a group of a third of all rows is split.
SALTS = 16
#: Numbers up to which an id list is broadcast.
BROADCAST_IDS = 500_000
#: Neighbouring ids that are joined to one string before a digest reads them in order.
CHUNK = 512
_BASE = 0x9FB21C651E98DF25  # odd

LONGS = "conv_id long, depth long"


class Trie(NamedTuple):
    """nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens); ends: (conv_id, depth, member)."""

    nodes: DataFrame
    ends: DataFrame


def number(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, t, ref, words, role, text): turns numbered from 1; ref is unique."""
    rows = turns.select(F.col(key).cast("long").alias("conv_id"), F.col(order).alias("turn"), string(role).alias("role"), string(text).alias("text")).filter("conv_id is not null")
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]

    def run(batches):
        part, last, count, at = TaskContext.get().partitionId(), None, 0, 0
        for whole in batches:
            for batch in text_slices(whole):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                n = len(ids)
                starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                sizes = np.diff(np.append(starts, n))
                rank = np.arange(1, n + 1) - np.repeat(starts, sizes)
                if ids[0] == last:
                    rank[: sizes[0]] += count
                _, _, first = words(*text_bytes(batch.column(3)))
                refs = np.int64(part << 33) + np.arange(at, at + n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(rank), pa.array(refs), pa.array(np.diff(first).astype(np.int64)), batch.column(2), batch.column(3)],
                    names=["conv_id", "part", "rank", "ref", "words", "role", "text"],
                )
                last, count, at = ids[-1], int(rank[-1]), at + n

    small_batches(turns.sparkSession)
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(tidy(run), "conv_id long, part int, rank long, ref long, words long, role string, text string")
    dealt = materialise(dealt, "turns")
    parts = dealt.groupBy("conv_id", "part").agg(F.max("rank").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # One conversation a range at most goes on from the range before, so there are fewer than ranges.
    later = materialise(parts.withColumn("before", before).filter("before > 0").select("conv_id", "part", "before"), "later")
    joined = dealt.join(F.broadcast(later), ["conv_id", "part"], "left")
    return joined.select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("t"), "ref", "words", "role", "text")


def turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "role", "text")


def _powers(depth: np.ndarray, block: int) -> np.ndarray:
    """_BASE ** (depth - 1) modulo 2**64, by two tables."""
    low, high = np.ones(block, np.uint64), np.ones(int(depth.max() - 1) // block + 1, np.uint64)
    step = np.uint64(pow(_BASE, block, 1 << 64))
    with np.errstate(over="ignore"):
        np.cumprod(np.full(block - 1, np.uint64(_BASE)), out=low[1:])
        np.cumprod(np.full(len(high) - 1, step), out=high[1:])
        return low[(depth - 1) % block] * high[(depth - 1) // block]


def _longs(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _scan(rows: DataFrame, bits: int | None) -> DataFrame:
    """Scan of (conv_id, depth, hash, base, ...) by blocks: (conv_id, depth, key, prev), or with bits None (conv_id, block, total) of whole blocks."""
    block = BLOCK
    mask = np.uint64((1 << (bits or 64)) - 1)

    def run(batches):
        last, carry = None, np.uint64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth = _longs(batch, 0), _longs(batch, 1)
            at = (depth - 1) // block
            with np.errstate(over="ignore"):
                terms = _longs(batch, 2).view(np.uint64) * _powers(depth, block)
                sums = np.cumsum(terms)
                starts = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (at[1:] != at[:-1])))
                sizes = np.diff(np.append(starts, len(conv)))
                ahead = np.append(np.uint64(0), sums)[starts]
                if last == (conv[0], at[0]):
                    ahead[0] = ahead[0] - carry
                local = sums - np.repeat(ahead, sizes)
                last, carry = (conv[-1], at[-1]), local[-1]
                if bits is None:
                    full = depth % block == 0
                    arrays, names = [conv[full], at[full], local[full].view(np.int64)], ["conv_id", "block", "total"]
                else:
                    whole = local + _longs(batch, 3).view(np.uint64)
                    arrays, names = [conv, depth, (mix64(whole) & mask).view(np.int64), (mix64(whole - terms) & mask).view(np.int64)], ["conv_id", "depth", "key", "prev"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    small_batches(rows.sparkSession)
    dealt = rows.select("conv_id", "depth", "hash", "base", F.expr(f"(depth - 1) div {block}").alias("block")).repartition("conv_id", "block").sortWithinPartitions("conv_id", "depth")
    return dealt.mapInArrow(tidy(run), "conv_id long, block long, total long" if bits is None else f"{LONGS}, key long, prev long")


def _bases(totals: DataFrame) -> DataFrame:
    """(conv_id, block, base): the sum of the blocks before, from (conv_id, block, total)."""

    def run(batches):
        last, carry = None, np.uint64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, at = _longs(batch, 0), _longs(batch, 1)
            with np.errstate(over="ignore"):
                sums = np.cumsum(_longs(batch, 2).view(np.uint64))
                starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
                ahead = np.append(np.uint64(0), sums)[starts]
                if last == conv[0]:
                    ahead[0] = ahead[0] - carry
                base = sums - np.repeat(ahead, np.diff(np.append(starts, len(conv))))
            last, carry = conv[-1], base[-1]
            yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array(at + 1), pa.array(base.view(np.int64))], names=["conv_id", "block", "base"])

    return totals.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(tidy(run), "conv_id long, block long, base long")


def fingerprints(steps: DataFrame, bits: int = 64) -> DataFrame:
    """(conv_id, depth, key, prev): fingerprints of the first depth and depth - 1 turns, from (conv_id, depth, hash, length)."""
    zero = F.lit(0).cast("long").alias("base")
    long = steps.filter(F.col("length") > BLOCK)
    if long.isEmpty():
        return _scan(steps.select("conv_id", "depth", "hash", zero), bits)
    totals = _scan(long.select("conv_id", "depth", "hash", zero), None)
    bases = materialise(_bases(totals), "bases")
    block = F.expr(f"(depth - 1) div {BLOCK}").alias("block")
    rows = steps.select("conv_id", "depth", "hash", block).join(bases, ["conv_id", "block"], "left")
    return _scan(rows.select("conv_id", "depth", "hash", F.coalesce("base", F.lit(0)).alias("base")), bits)


def _salted(rows: DataFrame, groups: DataFrame, on: list[str], spread: str) -> DataFrame:
    """Left join with a table of one row a key; rows of one key are split by ``spread``."""
    salt = F.pmod(F.xxhash64(F.lit(1), spread), F.lit(SALTS)).cast("int")
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(copies, [*on, "salt"], "left").drop("salt")


def _keep(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def _place(rows: DataFrame) -> DataFrame:
    """Rows with their group's representative (rep_id, rep_ref), size n, and whether both have one group without the last turn."""
    group = ["depth", "key", "extra"]
    reps = rows.groupBy(*group).agg(F.min(F.struct("conv_id", "ref", "prev", "prev_extra")).alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = (F.col("prev") == F.col("rep.prev")) & (F.col("prev_extra") == F.col("rep.prev_extra"))
    out = _salted(rows, reps, group, "conv_id")
    return out.select(*rows.columns, F.coalesce("rep.conv_id", "conv_id").alias("rep_id"), F.coalesce("rep.ref", "ref").alias("rep_ref"), F.coalesce("n", F.lit(1)).alias("n"), F.coalesce(same, F.lit(True)).alias("same_parent"))


def _different(placed: DataFrame, turns: DataFrame) -> DataFrame:
    """(ref, rep_ref) of turns that aren't their representative's, written."""
    pairs = materialise(placed.filter("ref <> rep_ref").select("ref", "rep_ref").distinct(), "pairs")
    wanted = materialise(pairs.select("ref").union(pairs.select("rep_ref")).distinct(), "refs")
    texts = _keep(turns.select("ref", "role", "text"), wanted, "ref")
    theirs = _keep(turns.select("ref", "role", "text"), materialise(pairs.select(F.col("rep_ref").alias("ref")).distinct(), "rep-refs"), "ref")
    both = _salted(pairs.join(texts, "ref"), theirs.select(F.col("ref").alias("rep_ref"), F.col("role").alias("rep_role"), F.col("text").alias("rep_text")), ["rep_ref"], "ref")
    return materialise(both.filter(~((F.col("role") == F.col("rep_role")) & (F.col("text") == F.col("rep_text")))).select("ref", "rep_ref"), "different")


def verified(steps: DataFrame, turns: DataFrame, bits: int = 64) -> DataFrame:
    """Steps with the representative of their exact group: (conv_id, depth, ref, words, length, rep_id, n), written."""
    none = F.lit(0).cast("long")
    print_of = fingerprints(steps, bits)
    rows = materialise(steps.join(print_of, ["conv_id", "depth"]).select("conv_id", "depth", "ref", "words", "length", "key", "prev", none.alias("extra"), none.alias("prev_extra")), "steps")
    seed = 0
    while True:
        placed = materialise(_place(rows), "placed")
        wrong = placed.join(_different(placed, turns), ["ref", "rep_ref"], "left_semi").union(placed.filter("not same_parent").select("ref", "rep_ref", *[c for c in placed.columns if c not in ("ref", "rep_ref")]))
        failing = materialise(wrong.select("depth", "key", "extra").distinct(), "failing")
        if failing.isEmpty():
            return placed.select("conv_id", "depth", "ref", "words", "length", "rep_id", "n")
        seed += 1
        begins = placed.join(failing, ["depth", "key", "extra"], "left_semi").groupBy("conv_id").agg(F.min("depth").alias("begin"))
        begins = materialise(begins, "begins")
        mine = rows.join(begins, "conv_id", "left_semi").select("conv_id", "depth", "ref", "length")
        fresh = fingerprints(mine.join(turns.select("ref", turn_hash(seed).alias("hash")), "ref"), bits).select("conv_id", "depth", F.col("key").alias("key2"), F.col("prev").alias("prev2"))
        more = rows.join(begins, "conv_id", "left").join(fresh, ["conv_id", "depth"], "left")
        extra = lambda c, by, lag: F.when(F.col("depth") - lag >= F.col("begin"), F.xxhash64(c, by)).otherwise(F.col(c)).alias(c)
        rows = materialise(more.select("conv_id", "depth", "ref", "words", "length", "key", "prev", extra("extra", "key2", 0), extra("prev_extra", "prev2", 1)), "steps")


def _subtrees(paths: DataFrame) -> DataFrame:
    """Paths (conv_id, up, at, leaves, saved) with leaves and saved summed over all paths below."""
    tops = materialise(paths.filter("up is not null").select(F.col("up").alias("conv_id")).distinct(), "tops")
    sums = [F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")]
    added = [(F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")]
    below = _keep(paths, tops, "conv_id", "left_anti").filter("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*sums)
    now = materialise(_keep(paths, tops, "conv_id").join(below, "conv_id", "left").select("conv_id", "up", *added), "rollup")
    while not now.filter("up is not null").isEmpty():
        below = now.filter("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*sums)
        jump = _salted(now.select("conv_id", "up"), now.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), ["up"], "conv_id")
        now = materialise(now.join(below, "conv_id", "left").select("conv_id", *added).join(jump.select("conv_id", F.col("next").alias("up")), "conv_id"), "rollup")
    whole = now.select("conv_id", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    return paths.join(whole, "conv_id", "left").select("conv_id", "up", "at", F.coalesce("all_leaves", "leaves").alias("leaves"), F.coalesce("all_saved", "saved").alias("saved"))


def prefix_trie(steps: DataFrame, lengths: DataFrame, turns: DataFrame, bits: int = 64) -> Trie:
    """Trie of the sequences ``steps`` (conv_id, depth, ref, words, hash, length), where depth is 1 to length without a gap.

    lengths: (conv_id, length) of every conversation, also of those without steps. turns: (ref, role, text); hash is its
    ``turn_hash(0)``. bits: of the fingerprints, fewer in tests alone.
    """
    placed = verified(steps, turns, bits)
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min(F.struct("conv_id", "length")).alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    root = materialise(root.select("r.conv_id", zero.alias("depth"), "n", zero.alias("words"), "r.length"), "root")
    least = F.lit(max([r["conv_id"] for r in root.collect()], default=None)).cast("long")  # a table of one row
    nodes = materialise(placed.filter("conv_id = rep_id").select("conv_id", "depth", "n", "words", "length").union(root), "nodes")
    saved = ((F.col("n") - 1) * F.col("words")).alias("saved")
    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("begin"), F.max("length").alias("length"), F.sum(saved).alias("saved"))
    hung = placed.select("conv_id", F.col("depth").alias("at"), F.col("rep_id").alias("up"))
    links = paths.select("conv_id", (F.col("begin") - 1).alias("at"), "length", "saved").join(hung, ["conv_id", "at"], "left")
    # What hangs on the root has the root's smallest member as parent.
    links = materialise(links.select("conv_id", F.when(F.col("at") >= 0, F.coalesce("up", least)).alias("up"), F.when(F.col("at") >= 0, F.col("at")).alias("at"), "length", "saved"), "paths")
    hooks = links.filter("up is not null").select(F.col("up").alias("conv_id"), F.col("at").alias("length")).distinct().withColumn("hooked", F.lit(1))
    leaves = F.when(F.col("hooked").isNull(), 1).otherwise(0).cast("long").alias("leaves")
    totals = _subtrees(materialise(links.join(hooks, ["conv_id", "length"], "left").select("conv_id", "up", "at", leaves, "saved"), "path-sums"))
    hangs = totals.filter("up is not null").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("more"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
    firsts = links.filter("up is not null").select("conv_id", (F.col("at") + 1).alias("depth"), F.col("up").alias("parent"))
    block = F.expr(f"depth div {BLOCK}").alias("block")
    children = (F.when(F.col("depth") < F.col("length"), 1).otherwise(0) + F.coalesce("more", zero)).alias("n_children")
    each = nodes.join(hangs, ["conv_id", "depth"], "left").join(firsts, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    each = each.select("conv_id", "depth", block, parent, F.col("n").alias("n_convs"), children, F.coalesce("leaves", zero).alias("leaves"), (saved + F.coalesce("below", zero)).alias("saved"))
    each = materialise(each.withColumn("leaves", F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)), "each")
    # Sums over what is deeper on the path: within a block, and of the blocks after.
    deeper = W.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = each.groupBy("conv_id", "block").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    later = blocks.select("conv_id", "block", F.sum("leaves").over(after).alias("later_leaves"), F.sum("saved").over(after).alias("later_saved")).filter("later_leaves is not null")
    summed = each.select("conv_id", "block", "depth", "parent_conv_id", "n_convs", "n_children", F.sum("leaves").over(deeper).alias("l"), F.sum("saved").over(deeper).alias("s")).join(later, ["conv_id", "block"], "left")
    out = summed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("l") + F.coalesce("later_leaves", zero)).alias("n_leaves"), (F.col("s") + F.coalesce("later_saved", zero)).alias("saved_tokens")
    )
    ends = placed.filter("depth = length").select(F.col("rep_id").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    bare = lengths.filter("length = 0").select(least.alias("conv_id"), zero.alias("depth"), F.col("conv_id").alias("member"))
    return Trie(out, ends.union(bare))


def id_digests(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (conv_id, depth, member): digest of the distinct members' decimal ids, ascending, joined by commas.

    Runs of ids are joined to short strings first. The digest of a node reads these in order, a batch at a time.
    """
    chunk = F.floor(F.col("member") / CHUNK).alias("chunk")
    listed = F.array_join(F.transform(F.array_sort(F.collect_set("member")), lambda x: x.cast("string")), ",").alias("ids")
    chunks = members.groupBy("conv_id", "depth", chunk).agg(listed)

    def run(batches):
        node, digest = None, hashlib.sha256()
        out = lambda done: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "depth", "ends_sha256"])
        for batch in batches:
            done: list[tuple] = []
            for conv, depth, ids in zip(_longs(batch, 0).tolist(), _longs(batch, 1).tolist(), batch.column(3), strict=True):
                if (conv, depth) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (conv, depth), hashlib.sha256()
                digest.update(ids.as_buffer())
            if done:
                yield out(done)
        if node is not None:
            yield out([(*node, digest.hexdigest())])

    small_batches(members.sparkSession)
    return chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk").mapInArrow(tidy(run), f"{LONGS}, ends_sha256 string")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, lengths) of the conversations as the query's contract rebuilds them, from numbered turns: the first turns of another, then the own."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    head = F.crc32(F.col("conv_id").cast("string")) % 4
    base = F.col("conv_id") - F.col("conv_id") % 20
    convs = materialise(convs.select("conv_id", "own", head.alias("head"), base.alias("base")), "convs")
    heads = convs.filter("conv_id = base").select("base", F.least("own", F.lit(3)).alias("have"))
    taken = F.least("head", F.coalesce("have", F.lit(0)))
    plan = convs.join(heads, "base", "left").select("conv_id", "base", "own", "head", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))
    plan = materialise(plan, "plan")
    narrow = turns.select("conv_id", "t", "ref", "words", turn_hash(0).alias("hash"))
    block = F.expr(f"t div {BLOCK}").alias("block")
    # A conversation's row meets its turns once a block of them.
    blocks = plan.select("conv_id", "head", "taken", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"own div {BLOCK}"))).alias("block"))
    own = narrow.select("*", block).join(blocks, ["conv_id", "block"]).filter("t > head").select("conv_id", (F.col("taken") + F.col("t") - F.col("head")).alias("depth"), "ref", "words", "hash", "length")
    lent = plan.filter("taken > 0").select("conv_id", "base", "length", F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("depth"))
    first = narrow.filter("t <= 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.col("t").alias("depth"), "ref", "words", "hash")
    lent = lent.join(first, ["base", "depth"]).select("conv_id", "depth", "ref", "words", "hash", "length")
    return materialise(own.union(lent), "rebuilt"), plan.select("conv_id", "length")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = number(table(spark, sf_dir, "conversations"))
    steps, lengths = rebuilt(turns)
    trie = prefix_trie(steps, lengths, turns)
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return trie.nodes.join(id_digests(trie.ends), ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
