"""Periodic runs against a brute-force search over all periods and places."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from velum.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(w):
    """All runs as (start, length, period)."""
    n, best = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(24, 3 * q):
                best.setdefault((s, length), q)  # the smallest period of a stretch comes first
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def collapse(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_text(r):
    words = []
    for _ in range(r.randint(1, 6)):
        kind = r.random()
        unit = [r.choice("ab") if kind < 0.3 else f"w{r.randint(0, 8)}" for _ in range(r.randint(1, 30))]
        words += (unit * r.randint(1, 12))[: r.randint(1, 200)] if kind < 0.8 else [f"x{r.randint(0, 10**6)}" for _ in range(r.randint(1, 60))]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_by_brute_force(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(P, "PLACES", 50)
    r = random.Random(seed)
    texts = [periodic_text(r) for _ in range(60)] + [[], ["a"] * 23, ["a"] * 24, ["a"] * 1000, ["a", "b"] * 12, ["a", "b", "c"] * 7 + ["a", "b"], (["a"] * 5 + ["b"]) * 40, ["é", "日本"] * 30]
    texts += [[f"y{i}" for i in range(3000)]]  # many names that no run has
    r.shuffle(texts)
    column = pa.array([r.choice([" ", "  \n", "\t"]).join(t) if t else None for t in texts])
    found, collapsed = P._slice_runs(column)
    for w, got, text in zip(texts, found.to_pylist(), collapsed.to_pylist(), strict=True):
        want = brute(w)
        assert [(x["start"], x["length"], x["period"]) for x in got] == want
        assert text == collapse(w, want)


def test_names_are_equal_for_equal_words_alone():
    names = np.array([0, 1, 0, 1, 2, 0, 1, 0])
    level = P.next_level(names, 1)
    pairs = list(zip(names[:-1].tolist(), names[1:].tolist(), strict=True))
    assert all((level[i] == level[j]) == (pairs[i] == pairs[j]) for i in range(7) for j in range(7))
    assert len(P.next_level(names, 8)) == 0


def test_a_long_text_of_one_phrase():
    words = ["of", "the"] * 60_000 + [f"x{i}" for i in range(60_000)]
    found, collapsed = P._slice_runs(pa.array([" ".join(words)]))
    assert found.to_pylist() == [[{"start": 0, "length": 120_000, "period": 2}]]
    assert collapsed[0].as_py() == " ".join(["of", "the", *words[120_000:]])


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    top = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapse(w, found)))


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_query_by_brute_force(spark, sf_dir, where):
    d = sf_dir if where == "odd" else SF
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in P.query(spark, d).collect()]
    assert sorted(map(repr, got)) == sorted(repr(expected(r["doc_id"], r["text"])) for r in docs)
    assert where == "odd" or sum(x[1] for x in got) > 10


def test_keys_of_any_kind_and_clashing_columns(spark):
    docs = spark.createDataFrame([("k1", "la " * 30, "x"), (None, None, "y")], "key string, body string, runs string")
    out = {r["key"]: r for r in P.periodic_runs(docs, "key", "body").collect()}
    assert out["k1"]["collapsed"] == "la" and out["k1"]["runs"][0]["length"] == 30
    assert out[None]["collapsed"] == "" and out[None]["runs"] == []
