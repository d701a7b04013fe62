"""The prefix trie against a brute-force trie of Python dictionaries."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import conversations
from velum.llm import prefix_trie as T

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(sequences):
    """Rows of the contract for {conv_id: [(role, text), ...]}."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(sequences):
        s = tuple(sequences[c])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        w = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += w
    sha = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def rebuild(rows):
    talks = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in talks.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + v[h:]
    return out


def rows_of(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_query_by_brute_force(spark, sf_dir, where):
    rows = conversations() if where == "odd" else [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(T.query(spark, sf_dir if where == "odd" else SF)) == brute(rebuild(rows))


def trie_of(spark, sequences, bits=64):
    rows = [(c, d, *x) for c, v in sequences.items() for d, x in enumerate(v)]
    turns = T.number(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    lengths = spark.createDataFrame([(c, len(v)) for c, v in sequences.items()], "conv_id long, length long")
    steps = turns.join(lengths, "conv_id").select("conv_id", F.col("t").alias("depth"), "ref", "words", T.turn_hash(0).alias("hash"), "length")
    trie = T.prefix_trie(steps, lengths, turns, bits)
    return rows_of(trie.nodes.join(T.id_digests(trie.ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))


def random_talks(seed, n=60, longest=14):
    r = random.Random(seed)
    out = {}
    for c in r.sample(range(-50, 2000), n):
        begin = r.choice(list(out.values())) if out and r.random() < 0.7 else []
        begin = begin[: r.randint(0, len(begin))]
        out[c] = begin + [(r.choice(["user", "bot"]), " ".join(r.choice("ab") for _ in range(r.randint(0, 3)))) for _ in range(r.randint(0, longest - len(begin)))]
    return out


@pytest.mark.parametrize("bits", [64, 5])
def test_collisions_are_split(spark, monkeypatch, bits):
    monkeypatch.setattr(T, "BLOCK", 4)  # long ones go over several blocks
    monkeypatch.setattr(T, "CHUNK", 16)
    monkeypatch.setattr(T, "BROADCAST_IDS", -1 if bits == 64 else 500_000)
    talks = random_talks(bits)
    assert trie_of(spark, talks, bits) == brute(talks)


def test_deep_trees_of_paths(spark):
    # Each conversation leaves the one before at its end: the tree of paths is as high as there are conversations.
    talks = {c: [("u", "x")] * c + [("u", f"own {c}"), ("u", "end")] for c in range(12)} | {100 + c: [("u", "x")] * 3 for c in range(40)}
    assert trie_of(spark, talks) == brute(talks)


def test_numbers_go_on_over_ranges(spark):
    rows = [(7, t % 500, "user", f"t{t}") for t in range(2000)] + [(c, None, None, None) for c in range(5)]
    out = T.number(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert len({r["ref"] for r in out}) == len(rows)
    got = [r["text"] for r in sorted((r for r in out if r["conv_id"] == 7), key=lambda r: r["t"])]
    assert got == [x for *_, x in sorted(r for r in rows if r[0] == 7)] and {r["t"] for r in out if r["conv_id"] == 7} == set(range(1, 2001))
