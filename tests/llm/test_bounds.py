"""Operators whose memory must not grow with what texts share."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from velum.llm import decontamination, language_id, quality_rules, substring_dedup


def test_items_of_a_template_add_no_windows():
    question = "which of the following is the best"
    text = " ".join(f"{prose(i, 20)} {question}" for i in range(100))
    h, first = decontamination.word_hashes(pa.array([text]))
    found = []
    for n in (50, 800):
        index = decontamination.Index(list(range(n)), [f"{question} {prose(1000 + i, 8)}" for i in range(n)])
        blocks = list(index.windows(h, first))
        found.append({w for row, start, size in blocks for w in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)})
        assert sum(len(b[0]) for b in blocks) <= 3 * 100 * 10
    assert len(found[1]) <= 2 * len(found[0])


def test_blocks_of_windows_find_the_same(monkeypatch):
    r = random.Random(3)
    items = [prose(i, r.randint(3, 25)) for i in range(60)] + ["which of the following is true " + prose(90 + i, 3) for i in range(40)]
    texts = [" ".join([prose(500 + i, 30), r.choice(items), prose(600 + i, 30), r.choice(items)]) for i in range(40)]
    index = decontamination.Index(list(range(len(items))), items)
    h, first = decontamination.word_hashes(pa.array(texts))
    want = sorted(zip(*(x.tolist() for x in index.search(h, first)), strict=True))
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 7)
    monkeypatch.setattr(decontamination, "BLOCK_NUMBERS", 500)
    assert sorted(zip(*(x.tolist() for x in index.search(h, first)), strict=True)) == want and len(want) >= 60


def test_the_language_sample_is_bounded_before_its_window(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"), F.concat(F.lit("palabra "), F.col("id").cast("string"), F.lit(" " + prose(1, 60))).alias("text"))
    seen = []
    real = language_id.Model

    class Kept(real):
        def __init__(self, texts, langs, landmarks):
            seen.append((len(texts), sorted(set(langs)), len(landmarks)))

    language_id.Model = Kept
    try:
        language_id.train(docs)
    finally:
        language_id.Model = real
    assert seen == [(2 * language_id.TRAIN_PER_LANG, ["a", "b"], 2 * language_id.LANDMARKS_PER_LANG)]


def test_languages_are_judged_in_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 120), ["a", "b", "c", None][i % 4]) for i in range(80)] + [(900, None, "empty")], "doc_id long, text string, lang string")
    rows = lambda: sorted(map(repr, quality_rules.judge(docs).collect()))
    want = rows()
    monkeypatch.setattr(quality_rules, "MODEL_ENTRIES", 1)
    assert rows() == want and len(want) == 81


def test_a_bitmap_has_bits_for_what_is_counted(spark):
    import numpy as np

    h = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bits = substring_dedup._bitmap(h)
    inside = np.array([r["h"] for r in h.collect()], np.int64)
    outside = np.array([r["h"] for r in spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
    assert 8 * len(bits) == 1 << 16 and substring_dedup._in_bitmap(bits, inside).all() and substring_dedup._in_bitmap(bits, outside).mean() < 0.1


def test_what_the_rules_find_does_not_stay(spark):
    from velum.llm import surrogates
    from velum.operators import detect
    from velum.rules import BY_NAME

    texts = [
        "RFC VICR770821QX3, CURP vicr770821mjclms04 y clave GRMNLS85031512M300.",
        "Llame al 3348219056 o al 33 4821 9056, (33) 4821-9056; CLABE 646180110400000007, tarjeta 4111 1111 1111 1111.",
        "x@y.example, ANA@NORTE.MX; versión v1.2.3.4 y 300.1.2.999 quedan, 10.20.30.40 no. RFC VICR770821QX3 otra vez.",
    ]
    rules = [BY_NAME[n] for n in ("curp", "voter_key", "rfc", "email", "card", "clabe", "phone")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = surrogates.pseudonymise(docs)
    values = lambda df: {(r["type"], r["value"].upper()) for r in detect.findings(df, rules).collect()}
    before = values(docs)
    assert len(before) == 10 and not before & values(out)
    new = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "v1.2.3.4 y 300.1.2.999 quedan" in new[2] and "10.20.30.40" not in new[2] and ".example.example" not in new[2]
    same = [w for w in new[0].replace(",", " ").split() if len(w) == 13]
    assert len(same) == 1 and same[0] in new[2] and new[0].split()[3].rstrip(",").islower()
