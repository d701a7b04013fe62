"""Candidates, redaction, review, classification, model layer, history, sources, store and streaming."""

import datetime as dt
import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.test_rules import CONTRACT
from velum import queries as Q
from velum.operators import classify as C
from velum.operators import detect as D
from velum.operators import history as H
from velum.operators import model_layer as M
from velum.operators import redact as R
from velum.operators import review as E
from velum.plans import redaction as P
from velum.sources import documents as S
from velum.sources import store
from velum.streaming import intake

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def redacted(spark, texts, change=lambda c: c):
    docs = docs_of(spark, texts)
    cands = change(D.candidates(D.findings(docs)))
    return {r["doc_id"]: r["redacted"] for r in R.redact(docs, cands).collect()}


def test_contract_redacted(spark):
    out = redacted(spark, [CONTRACT, None, "", "nada"])
    assert out[0] == (
        "Arrienda el local la C. [NOMBRE 1], de nacionalidad mexicana; su RFC es [RFC 1], su CURP [CURP 1], y vive en [DOMICILIO 1].\n"
        "Celular: [TELEFONO 1]\nBuzón: [CORREO 1]\nDepósitos a la CLABE [CLABE 1]\nRenta Luis Batalla (RFC [RFC 2], CURP [CURP 2]), tel. [TELEFONO 2], [CORREO 2]."
    )
    assert (out[1], out[2], out[3]) == (None, "", "nada")


def test_deselected_items_keep_their_text_and_number_nothing(spark):
    text = "a@b.mx, c@d.mx y A@B.MX"
    assert redacted(spark, [text])[0] == "[CORREO 1], [CORREO 2] y [CORREO 1]"
    assert redacted(spark, [text], lambda c: c.withColumn("is_selected", F.col("ordinal") > 1))[0] == "a@b.mx, [CORREO 1] y A@B.MX"
    assert redacted(spark, [text], lambda c: E.select_all(c, False))[0] == text
    tags = R.tags(D.candidates(D.findings(docs_of(spark, [text]))).withColumn("is_selected", F.col("ordinal") > 1)).orderBy("ordinal").collect()
    assert [r["tag"] for r in tags] == ["[CORREO -]", "[CORREO 1]"]


def test_located_without_regard_to_case_space_and_edges(spark):
    df = spark.createDataFrame([("El DE  la\nde la departamento (de la)", "de la"), ("a.b a+b", "a+b"), ("x", " "), (None, "x"), ("x", None), ("$5 [x] $5", "$5 [X]")], "t string, n string")
    out = [r[0] for r in df.select(R.exact_substrings(F.col("t"), F.col("n"))).collect()]
    assert out == [["DE  la", "de la", "de la"], ["a+b"], [], [], [], ["$5 [x]"]]


def test_addresses_grow_and_are_found_by_their_street(spark):
    text = "Vive en Calle Hidalgo 123, Colonia Centro, C.P. 06000. Antes en CALLE HIDALGO\n123, Piso 4, y ya."
    rows = spark.createDataFrame([(text, "Calle Hidalgo 123, Colonia Centro")], "t string, n string")
    got = rows.select(R.occurrence_ranges(F.col("t"), F.col("n"), F.lit("address")).alias("r"), R.occurrence_ranges(F.col("t"), F.col("n"), F.lit("email")).alias("e")).first()
    assert [text[a:b] for a, b in got["r"]] == ["Calle Hidalgo 123, Colonia Centro, C.P. 06000", "CALLE HIDALGO\n123, Piso 4"]
    assert [text[a:b] for a, b in got["e"]] == ["Calle Hidalgo 123, Colonia Centro"]


def test_longest_of_equal_starts_wins_and_nothing_overlaps(spark):
    docs = docs_of(spark, ["abc def ghi"])
    cands = spark.createDataFrame([(0, "x", 1, "abc", "name", "abc", True), (0, "y", 2, "abc def", "name", "abc def", True), (0, "z", 3, "def ghi", "rfc", "def ghi", True)], "doc_id int, cand_id string, ordinal int, original_text string, type string, norm string, is_selected boolean")
    assert R.redact(docs, cands).first()["redacted"] == "[NOMBRE 2] ghi"


def test_synchronise_looks_only_for_what_changed(spark):
    docs = docs_of(spark, ["a@b.mx c@d.mx"])
    cands = D.candidates(D.findings(docs))
    known = R.occurrences(docs, cands.filter("ordinal = 1")).withColumn("start", F.lit(99))
    assert sorted(r["start"] for r in R.synchronise(docs, cands, known).collect()) == [7, 99]
    moved = docs_of(spark, ["hola a todos, a@b.mx c@d.mx"])
    assert sorted(r["start"] for r in R.synchronise(moved, cands, known).collect()) == [14, 21]
    assert R.redact(moved, cands, R.synchronise(moved, cands, known)).first()["redacted"] == "hola a todos, [CORREO 1] [CORREO 2]"


def test_one_pass_redacts_as_the_tables_do(spark):
    texts = [CONTRACT, None, "", "nada", "a@b.mx, c@d.mx y A@B.MX " * 3, "el C. Juan Pérez y JUAN  PÉREZ, tel. (33) 4821-9056, 2024", "\ufdd0 a@b.mx \ufdd1"]
    docs = docs_of(spark, texts)
    want = R.redact(docs, D.candidates(D.findings(docs))).orderBy("doc_id").collect()
    assert P.redact_documents(docs).orderBy("doc_id").collect() == want
    assert want[6]["redacted"] == "\ufdd0 [CORREO 1] \ufdd1"


def test_saves_within_the_period_are_one(spark):
    rows = [("a", 0, 1), ("a", 300, 1), ("a", 700, 1), ("a", 1101, 1), ("a", 1101, 2), ("b", 5, 1)]
    saves = spark.createDataFrame(rows, "id string, ms long, n int").withColumn("updated_at", F.timestamp_millis("ms"))
    assert sorted((r["id"], r["ms"], r["n"]) for r in H.last_writes(saves, 400, "n").collect()) == [("a", 700, 1), ("a", 1101, 2), ("b", 5, 1)]


def test_review(spark):
    docs = docs_of(spark, ["uno a@b.mx dos Juan Soto tres c@d.mx"])
    cands = D.candidates(D.findings(docs))
    off = cands.withColumn("is_selected", F.lit(False))
    out = E.add(docs, off, spark.createDataFrame([(0, "juan  SOTO"), (0, "A@B.MX"), (0, "x"), (0, "[RFC 1]"), (0, "ausente"), (0, "tres"), (0, "Tres ")], "doc_id int, snippet string")).orderBy("ordinal").collect()
    assert [(r["original_text"], r["is_selected"]) for r in out] == [("a@b.mx", True), ("Juan Soto", True), ("tres", True), ("c@d.mx", False)]
    assert out[1]["type"] == "name"
    edits = spark.createDataFrame([(0, out[0]["cand_id"], "phone", None), (0, out[3]["cand_id"], "bogus", True)], "doc_id int, cand_id string, type string, is_selected boolean")
    after = {r["original_text"]: (r["type"], r["is_selected"]) for r in E.apply_edits(off, edits).collect()}
    assert after == {"a@b.mx": ("phone", False), "c@d.mx": ("email", True)}
    n = E.counts(E.apply_edits(off, edits)).first()
    assert (n["n_selected"], n["n_total"], n["label"]) == (1, 2, "1 de 2")


@pytest.mark.parametrize(("tag", "want"), [("organization", "organization"), ("place", "name"), (None, "name")])
def test_tagger_decides_last(spark, tag, want):
    assert spark.range(1).select(C.classify(F.lit("Zafiro Norte"), F.lit(tag).cast("string"))).first()[0] == want


def test_chunks_overlap_and_end():
    text = "".join(f"línea {i} {'x' * (i % 90)}\n" for i in range(200))
    cuts = M.cut_points(text)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(b - a <= 1800 for a, b in cuts)
    assert all(text[b - 1] == "\n" for _, b in cuts) and all(c == b - 200 for (_, b), (c, _) in zip(cuts, cuts[1:], strict=False))
    assert M.cut_points("x" * 1800) == [(0, 1800)] and M.cut_points("") == [(0, 0)]
    assert M.cut_points("a\n" + "x" * 4000)[:2] == [(0, 2), (2, 1802)]  # the step back would be no step on


def test_model_layer(spark):
    text = "La doctora Ana Ruiz Soto de Norte Azul escribe.\nAna Ruiz firma. Correo a@b.mx. " + "relleno " * 300

    def model(instructions, chunk):
        assert instructions == M.INSTRUCTIONS
        if "La doctora" not in chunk:
            raise ValueError("nothing")
        return {"names": ["Ana Ruiz", " ana  ruiz", "Ana Ruiz Soto", "x"], "organizations": ["Norte Azul"], "emails": ["a@b.mx"]}

    docs = docs_of(spark, [text, "sin nada", None])
    spans = {r["doc_id"]: [(s["type"], s["value"]) for s in r["spans"]] for r in M.contextual(docs, model).collect()}
    assert spans == {0: [("name", "Ana Ruiz Soto"), ("organization", "Norte Azul"), ("name", "Ana Ruiz"), ("email", "a@b.mx")], 1: [], 2: []}
    out = P.detect(docs, model).orderBy("ordinal").collect()
    assert [(r["type"], r["original_text"]) for r in out] == [("name", "Ana Ruiz Soto"), ("organization", "Norte Azul"), ("name", "Ana Ruiz"), ("email", "a@b.mx")]


def test_slow_models_time_out(spark):
    import time

    parts = M.chunks(docs_of(spark, ["uno"]))
    out = M.generate(parts, lambda _, c: time.sleep(1) or {}, timeout=0.05).collect()
    assert [r["ok"] for r in out] == [False] and M.gather(M.generate(parts, lambda _, c: {"names": ["a"] * 30})).first()["names"] == ["a"] * 24


def docx(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    word = docx({"word/document.xml": p("uno") + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p>", "word/footer1.xml": p("pie"), "word/Header2.xml": p("alto"), "word/footnotes.xml": p("nota"), "word/header9.xml": p(" ")})
    files = {"a.txt": "año".encode(), "b.TEXT": "a\xf1o".encode("latin-1"), "c.docx": word, "d.docx": b"no zip", "e.pdf": b"%PDF", "f.bin": b"x", "g.txt": b" \n", "h.docx": docx({"word/header1.xml": p("x")}), "i.doc": b"old"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    read = S.read_files(spark, str(tmp_path))
    out = {r["path"].rpartition("/")[2]: (r["text"], r["error_code"]) for r in S.extract(read).collect()}
    assert out == {
        "a.txt": ("año", None), "b.TEXT": ("año", None), "c.docx": ("uno\na\tb\nc\n\nalto\n\npie\n\nnota", None), "d.docx": (None, "unreadableWord"), "e.pdf": (None, "unreadablePDF"),
        "f.bin": (None, "unsupportedFileType"), "g.txt": (None, "emptyDocument"), "h.docx": (None, "unreadableWord"), "i.doc": (None, "unreadableWord"),
    }
    long = "palabra " * 10
    pages = lambda path, content: [(f"{long}\f", None), ("corto", " leído "), ("solo", None), (None, None)]
    out = {r["path"].rpartition("/")[2]: r["text"] for r in S.extract(read, pages, lambda path, content: content.decode("latin-1")).collect()}
    assert out["e.pdf"] == f"{long.strip()}\nleído\nsolo" and out["i.doc"] == "old"

    def failing(path, content):
        raise OSError("no pages")

    assert {r["error_code"] for r in S.extract(read.filter("path like '%.pdf'"), failing, failing).collect()} == {"unreadablePDF"}
    gone = read.withColumn("content", F.when(F.col("path").endswith(".docx"), None).otherwise(F.col("content")))
    assert {r["path"].rpartition("/")[2] for r in S.extract(gone).collect() if r["error_code"] == "readFailed"} == {"c.docx", "d.docx", "h.docx"}
    plan = S.extract(read, pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1


def test_vanished_files_are_reported(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("uno")
    out = S.extract_folder(spark, str(tmp_path))
    (tmp_path / "b.txt").unlink()
    assert {r["path"].rpartition("/")[2]: (r["text"], r["error_code"]) for r in out.collect()} == {"a.txt": ("uno", None), "b.txt": (None, "readFailed")}


def test_reading_order(spark):
    seen = spark.createDataFrame([(1, "der", 0.5, 0.951), (1, "izq", 0.1, 0.949), (1, "abajo", 0.0, 0.5)], "page int, text string, min_x double, max_y double")
    assert S.reading_order(seen, "page").first()["text"] == "izq\nder\nabajo"


def history(spark, rows):
    at = lambda d: dt.datetime(2024, 1, d)
    return spark.createDataFrame([(i, f"{i}.pdf", h, at(1), at(d), 1, f"{i}.pdf\ntexto {i}") for i, h, d in rows], H.SUMMARY)


def test_history(spark, tmp_path):
    h = history(spark, [("a", "h1", 3), ("b", "h2", 5), ("c", "h1", 4)])
    assert [r["id"] for r in H.ordered(h).collect()] == ["b", "c", "a"]
    files = spark.createDataFrame([("x", "h1"), ("y", "h9"), ("z", None)], "path string, file_hash string")
    assert [(r["path"], r["existing_id"]) for r in H.duplicates(files, h).collect()] == [("x", "c")]
    assert sorted(r["path"] for r in H.unseen(files, h).collect()) == ["y", "z"]
    assert [r["id"] for r in H.search(h, " TEXTO B").collect()] == ["b"] and H.search(h, "  ").count() == 3
    records = h.select("id", H.record(F.struct(*h.columns), F.lit("t"), F.array(F.struct(F.lit("k").alias("cand_id"), F.lit(1).alias("ordinal"), F.lit("v").alias("original_text"), F.lit("rfc").alias("type"), F.lit(True).alias("is_selected")))).alias("json"))
    store.write_records(records, f"{tmp_path}/records")
    store.write_records(spark.createDataFrame([("x", '{"summary": {"id": 5, '), ("y", "{}"), ("z", "not json")], "id string, json string"), f"{tmp_path}/records")
    store.write_records(records.filter("id = 'b'"), f"{tmp_path}/records")
    back, versions = store.read_records(spark, f"{tmp_path}/records"), store.read_versions(spark, f"{tmp_path}/records")
    assert back.count() == 6 and versions.count() == 7
    assert sorted(map(str, H.rebuild(back).collect())) == sorted(map(str, h.collect()))
    assert [r["candidates"][0]["type"] for r in store.load_record(versions, "b").collect()] == ["rfc"] and store.load_record(versions, "q").count() == 0
    store.write_records(records.filter("id = 'b'").withColumn("json", F.replace("json", F.lit('"rfc"'), F.lit('"curp"'))), f"{tmp_path}/records")
    assert [r["candidates"][0]["type"] for r in store.load_record(versions.sparkSession.read.parquet(f"{tmp_path}/records"), "b").collect()] == ["curp"]
    store.compact_records(spark, f"{tmp_path}/records", f"{tmp_path}/compact")
    assert store.read_versions(spark, f"{tmp_path}/compact").count() == 6
    index = f"{tmp_path}/index"
    assert [r["id"] for r in store.load_index(spark, index, f"{tmp_path}/records").collect()] == ["b", "c", "a"]
    store.replace_table(h.filter("id <> 'b'"), index)
    store.replace_table(h.filter("id = 'b'"), index)
    assert [r["id"] for r in store.load_index(spark, index, f"{tmp_path}/records").collect()] == ["b"]


def test_progress(spark):
    df, seen = store.with_progress(docs_of(spark, ["a", None, "c"]), "scan", "text")
    df.collect()
    assert seen.get == {"rows": 3, "text": 2}


def test_known_files_are_not_read_again(spark):
    files = spark.createDataFrame([("a.txt", bytearray(b"uno")), ("b.txt", bytearray(b"dos"))], "path string, content binary")
    known = history(spark, [("k", "x", 1)]).withColumn("file_hash", F.sha2(F.lit("uno").cast("binary"), 256))
    texts, again = P.scan_files(files, known)
    assert [r["text"] for r in texts.collect()] == ["dos"] and [r["path"] for r in again.collect()] == ["a.txt"]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in (("a.txt", "a@b.mx"), ("b.txt", "a@b.mx"), ("c.txt", "RFC GAMR770821QX3"), ("d.bin", "x@y.mx"), ("e.pdf", "x@y.mx")):
        (folder / name).write_text(text)
    stream = intake.new_documents(spark, str(folder))
    for _ in range(2):  # the second run finds nothing new
        intake.candidates_sink(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["original_text"] for r in out) == ["GAMR770821QX3", "a@b.mx"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql_gives_the_same(spark, duck, name):
    want = duck.execute(Q.ORACLE_SQL[name]).df()
    got = Q.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[sorted(got.columns)].astype(object).where(df[sorted(got.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_every_query_is_registered():
    assert set(Q.QUERIES) <= set(__spark_entry__.queries()) and set(Q.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
