"""What must grow no faster than the input: tasks for what is made of small tables, and what a text or batch costs."""

import random
import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from velum import queries as Q
from velum.functions import needles as N
from velum.functions.filters import should_keep
from velum.operators import history as H
from velum.operators import model_layer as M

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_suppliers_are_dealt_over_tasks(spark, tmp_path):
    spark.range(2600).select(F.col("id").alias("s_suppkey"), F.lit("S").alias("s_name")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for made, rows in ((Q._written, 26_000), (Q._letters, 2600)):
        per_task = [r["count"] for r in made(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(per_task) == rows
        assert len(per_task) == 6 and max(per_task) < rows / 4


def test_normal_form_is_made_once_for_the_filter(spark):
    df = spark.createDataFrame([("Juan Soto", "name")], "v string, k string")
    assert plan(df.select(should_keep(F.col("v"), F.col("k")).alias("ok")).filter("ok is not null")).count("(?U)\\s+") <= 2


def test_additions_read_candidates_once(spark):
    assert plan(Q._inserted(spark, SF)).count("Window [") == 2  # the two of the candidates themselves


def test_grams_of_long_texts(spark):
    rng = random.Random(3)
    texts = ["", "ab", "abc", "a\U0001f600b\nc\U0001f601", "ñ́ x\r\ny", *("".join(rng.choice("ab\n\U0001f600é") for _ in range(40)) for _ in range(20))]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string").select("i", H.grams(F.col("t")).alias("g")).collect()
    for r in rows:
        t = texts[r["i"]] if r["i"] < len(texts) else ""
        assert r["g"] == list(dict.fromkeys(t[k : k + 3] for k in range(len(t) - 2)))
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400_000)), lambda i: F.char(97 + i % 26)), "").alias("t"))
    began = time.perf_counter()
    assert long.select(F.size(H.grams(F.col("t")))).first()[0] == 26
    assert time.perf_counter() - began < 20


def test_batches_are_few_rows_at_once():
    text = "una línea de texto\n" * 200
    texts = pa.array([text] * 3000 + [None])
    tracemalloc.start()
    try:
        got = M.cut_all(texts)
        found = N.by_slices([texts, pa.array([["línea", "texto"]] * 3001)], lambda t, n: None if t is None else N.places(t, n), pa.list_(pa.list_(pa.int32())))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8_000_000  # a batch of objects would be 12 MB of texts alone
    assert [(c["start"], c["chunk"]) for c in got[2999].as_py()] == [(a, text[a:b]) for a, b in M.cut_points(text)] and not got[3000].is_valid
    assert len(found[0].as_py()[0]) == 400 and not found[3000].is_valid


def test_even_and_uneven_white_space_fold_alike():
    for text in ("El  DE la", "a b", "\ta b \n c ", " x", "ÑANDÚ İ ß", ""):
        body, at = N.folded(text)
        want, places = "", []
        for i, c in enumerate(text.translate(N._FOLDED)):
            if not (c.isspace() and want.endswith(" ")):
                want, places = want + (" " if c.isspace() else c), [*places, i]
        assert (body, list(at)) == (want, places)
        assert N.key_of(text) == want.strip(" ")


def test_model_layer_keeps_texts_where_they_are(spark, tmp_path):
    spark.range(2600).select(F.col("id").alias("s_suppkey"), F.lit("S").alias("s_name")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    df = Q.QUERIES["model_layer"](spark, str(tmp_path))
    ran = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in ran and ran.count("SortMergeJoin") == 1
    assert ran.count("Exchange hashpartitioning") == 2  # the texts' own dealing and that of the tagger's spans
    assert not [x for x in ran.split("\n") if "Filter (" in x and "transform(" in x]  # spans are made once
    assert "regexp_replace" not in plan(M.chunks(Q._letters(spark, str(tmp_path))))  # before the dealing, so in one task


def test_answers_in_a_texts_row_are_those_by_chunks(spark):
    rng = random.Random(7)
    asked = spark.sparkContext.accumulator(0)
    words = ["Ana Ruiz", "ana  RUIZ", "Ana Ruiz Soto", "Norte Azul", "Calle Sol 12, col. Mar", "a@b.mx", "relleno", "falla", "\n", "ñandú", "\U0001f600"]

    def model(_, chunk):
        asked.add(1)
        if chunk.count("falla") % 3 == 2:
            raise ValueError("no answer")
        return {"names": ["x", *(f"Nadie {i}" for i in range(chunk.count("a") % 30)), " ana\truiz ", "Ana Ruiz Soto", "ANA RUIZ"], "organizations": ["Norte Azul"], "addresses": ["Calle Sol 12, col. Mar"], "emails": ["a@b.mx"] * 20}

    texts = [None, "", " \n\u2003\x85", "\x1c", "Ana Ruiz", "falla falla", *(" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 400, 2500]))) for _ in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    by_chunks = M.answer_spans(docs, M.gather(M.generate(M.chunks(docs), model)))
    want = {r["doc_id"]: r["spans"] for r in by_chunks.collect()}
    once, asked.value = asked.value, 0
    tagger = docs.filter("doc_id % 2 = 0").select("doc_id", F.array().cast(f"array<{M.S.SPAN}>").alias("spans"))
    got = {r["doc_id"]: r["spans"] for r in M.contextual(docs, model, tagger).collect()}
    assert got == {i: want.get(i, []) for i in range(len(texts))} and sum(map(len, got.values())) > 500
    assert asked.value == once == M.chunks(docs).count()


def test_first_of_each_form_of_many_answers(spark):
    value = lambda *v: [r["value"] for r in spark.createDataFrame([(list(v),)], "v array<string>").select(M._wanted(F.col("v"), "name", 0).alias("w")).first()["w"]]
    assert value("Zoé Sol", "b", " ana  ruiz", None, "zoé  SOL", "Ana Ruiz", "", "eco") == ["Zoé Sol", "ana  ruiz", "eco"]
    many = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.concat(F.lit("Nadie "), i.cast("string"))).alias("v"))
    began = time.perf_counter()
    assert many.select(F.size(M._wanted(F.col("v"), "name", 0))).first()[0] == 30_000
    assert time.perf_counter() - began < 20
