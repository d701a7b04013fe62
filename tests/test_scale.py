"""What keeps its rows when documents have many findings or needles: places, claims, the automaton, the offset map, kept answers, the search index."""

import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from tests.test_operators import docs_of, docx, history
from velum.functions import needles as N
from velum.functions import spans as S
from velum.functions.text import fold
from velum.operators import classify as C
from velum.operators import detect as D
from velum.operators import history as H
from velum.operators import model_layer as M
from velum.operators import redact as R
from velum.operators import review as E
from velum.plans import redaction as P
from velum.sources import documents as F_
from velum.sources import store

SPANS = "array<struct<type:string,start:int,end:int,value:string,rule_id:int,source:string>>"


def random_spans(r, n, wide):
    return [(r.choice(["name", "organization", "address", "email"]), a, a + r.randint(1, 12), "v", i, "rule") for i in range(n) for a in [r.randint(0, wide)]]


def meets(a, b):
    return a[1] < b[2] and b[1] < a[2]


def claimed(spans, seed=()):
    out = list(seed)
    for x in spans:
        if not any(meets(x, y) for y in out):
            out.append(x)
    return out


def merged(base, more):
    out, kinds = list(base), ("name", "organization", "address")
    for x in more:
        at = next((i for i, y in enumerate(out) if meets(x, y)), None)
        if at is None:
            out.append(x)
        elif x[0] in kinds and out[at][0] in kinds and x[2] - x[1] > out[at][2] - out[at][1]:
            out[at] = x
    return out


def test_folds_by_clusters_are_those_over_all(spark):
    r = random.Random(4)
    rows = [(i, random_spans(r, r.choice([0, 1, 5, 40, 200]), r.choice([10, 300, 2000])), random_spans(r, r.choice([0, 3, 90]), 300)) for i in range(40)]
    df = spark.createDataFrame(rows, f"i int, a {SPANS}, b {SPANS}")
    a, b = F.col("a"), F.col("b")
    out = df.select("i", S.claim(a).alias("claim"), S.claim(b, a).alias("seeded"), S.merge(S.claim(a), b).alias("merge"), S.drop_contained(a).alias("within")).collect()
    plain = lambda spans: [tuple(x) for x in spans]
    inside = lambda x, y: y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] and y[2] - y[1] > x[2] - x[1]
    for g in out:
        _, a, b = rows[g["i"]]
        assert plain(g["claim"]) == claimed(a) and plain(g["seeded"]) == claimed(b, a)
        assert plain(g["merge"]) == merged(claimed(a), b)
        assert plain(g["within"]) == [x for x in a if not any(inside(x, y) for y in a)]


def test_running_sums_over_blocks(spark):
    df = spark.createDataFrame([([],), ([5],), (list(range(64)),), (list(range(65)),), ([3, 1] * 5000,)], "v array<int>")
    for v, got in df.select("v", S.running(F.col("v"), lambda a, b: a + b)).collect():
        assert got == [sum(v[: i + 1]) for i in range(len(v))] if len(v) < 100 else got[-3:] == [sum(v[:-2]), sum(v[:-1]), sum(v)]


def test_hundred_thousand_findings_in_a_text(spark):
    some = lambda n: docs_of(spark, [" ".join(f"u{i}@mail{i % 7}.example.mx y" for i in range(n))])
    D.findings(some(10)).count()
    began = time.perf_counter()
    found = D.findings(some(100_000)).agg(F.count(F.lit(1)), F.max("end"), F.count_distinct("value")).first()
    assert (found[0], found[2]) == (100_000, 100_000) and time.perf_counter() - began < 60


def test_many_needles_in_one_scan_are_those_found_alone(spark):
    r = random.Random(9)
    words = ["ana", "Ana", "de", "la", "ñandú", "x-1", "a.b", "(c)", "55", "ÉTÉ", "été", "İx", "nana", "ſol", "é"]
    texts = ["".join(r.choice(words) + r.choice([" ", "\n", "  ", " ", "", ", "]) for _ in range(60)) for _ in range(30)] + [None, "", " "]
    pool = ["ana", "ana de", "DE LA", "x-1", "a.b", "(c)", "55", "été", "ana ana", "sol", " ", "", "la\tla", "ÑANDÚ", "-1", "é"]
    df = spark.createDataFrame([(i, t, r.sample(pool, 9)) for i, t in enumerate(texts)], "i int, text string, needles array<string>")
    out = df.select("text", N.locate_all(F.col("text"), F.col("needles")).alias("all"), F.transform("needles", lambda n: R.locate(F.col("text"), n)).alias("each")).collect()
    assert all(g["all"] == g["each"] for g in out if g["text"] is not None) and sum(len(x) for g in out if g["text"] for x in g["all"]) > 300
    assert all(g["all"] is None for g in out if g["text"] is None)


def test_time_does_not_grow_with_the_needles():
    text = " ".join(f"palabra{i} de la" for i in range(60_000))
    took = []
    for n in (5, 500):
        began = time.perf_counter()
        found = N.places(text, [f"palabra{i * 7} de" for i in range(n)])
        took.append(time.perf_counter() - began)
        assert all(len(x) == 2 for x in found)
    assert took[1] < 2 * took[0] + 0.1


def edited(r, text, words, times):
    for _ in range(times):
        a = r.randint(0, len(text))
        text = text[:a] + r.choice(["", words(1), words(3), " ", "\n", ".", "a"]) + text[min(len(text), a + r.choice([0, 1, 5, 20])) :]
    return text


def test_changed_texts_give_what_a_whole_scan_gives():
    r = random.Random(1)
    words = lambda n: "".join(r.choice(["ana", "de", "la", "x-1", "a.b", "ñu", "Ana", "ana ana", "55", "(c)"]) + r.choice([" ", " ", "  ", ". ", ".\n", "\n", "; ", ""]) for _ in range(n))
    pieces = lambda t: [(hash(p), len(p)) for p in re.split(N.PIECE_END, t)]
    for _ in range(1500):
        old = words(r.choice([0, 3, 20, 80]))
        new = edited(r, old, words, r.randint(0, 3))
        needles = r.sample(["ana", "ana de", "de la", "x-1", "a.b", "55", "(c)", "la ana", "ñu", "ana ana", " ", "1"], 6)
        assert N.changed_places(new, pieces(new), needles, pieces(old), N.places(old, needles))[0] == N.places(new, needles)


def test_only_changed_regions_are_scanned(spark):
    r = random.Random(5)
    line = lambda i: f"línea {i} de a{i}@b.mx y c@d.mx en Calle Hidalgo {i % 7 + 10}, C.P. 06000.\n"
    old = ["".join(line(i) for i in range(k, k + 200)) for k in (0, 1000, 2000, 3000)]
    new = [old[0], edited(r, old[1], lambda n: " e@f.mx", 3), "c@d.mx " + old[2], old[3].replace("a3100@b.mx", "z@b.mx")]
    docs, now = docs_of(spark, old), docs_of(spark, new)
    cands = D.candidates(D.findings(docs)).filter("type <> 'address'").unionByName(D.candidates(D.findings(docs)).filter("type = 'address'").limit(5))
    known = R.occurrences(docs, cands)
    out = R.resynchronise(now, cands.filter("cand_id <> 'none'"), known, R.text_index(docs)).cache()
    want = R.occurrences(now, cands)
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 1500
    shares = {r["doc_id"]: r["share"] for r in out.filter("type = 'email'").groupBy("doc_id").agg(F.max(F.col("scanned") / F.col("n_chars")).alias("share")).collect()}
    assert shares[0] == 0 and all(shares[i] < 0.1 for i in (1, 2, 3))


def test_offsets_map_both_ways(spark):
    r, rows = random.Random(2), []
    for i in range(30):
        text = "".join(r.choice("abc é日\n") for _ in range(r.choice([0, 20, 300, 9000])))
        puts = [(a, min(a + r.randint(1, 9), len(text)), o, f"[X {o}]") for o in range(r.randint(0, 30)) if len(text) for a in [r.randrange(len(text))]]
        rows.append((i, text, puts))
    df = spark.createDataFrame(rows, "i int, text string, puts array<struct<start:int,end:int,ordinal:int,tag:string>>")
    df = df.withColumn("m", R.offset_map(F.col("puts"))).withColumn("out", R.stitch(F.col("text"), F.col("m")))
    ways = [F.transform(F.sequence(F.lit(0), F.length("text")), lambda p: R.to_redacted(F.col("m"), p)).alias("there"), F.transform(F.sequence(F.lit(0), F.length("out")), lambda p: R.to_original(F.col("m"), p)).alias("back")]
    for g in df.select("i", "m", "out", *ways).collect():
        _, text, puts = rows[g["i"]]
        want, at, back, there = "", 0, [], {}
        for a, b, _, tag in sorted(puts, key=lambda p: (p[0], -p[1], p[2])):
            if a >= at:
                for p in range(at, a):
                    there[p] = len(want) + p - at
                back += [*range(at, a), *[a] * len(tag)]
                want += text[at:a]
                there |= dict.fromkeys(range(a, b), len(want))
                want, at = want + tag, b
        there |= {p: len(want) + p - at for p in range(at, len(text) + 1)}
        assert g["out"] == want + text[at:] and g["back"] == back + list(range(at, len(text) + 1))
        assert g["there"] == [there[p] for p in range(len(text) + 1)]


def test_highlights_are_places_in_the_redacted_text(spark):
    docs = docs_of(spark, ["a@b.mx, c@d.mx y A@B.MX; antes [CORREO 1]", "nada"])
    cands = D.candidates(D.findings(docs)).withColumn("is_selected", F.col("ordinal") == 1)
    out = R.redact(docs, cands).orderBy("doc_id").first()["redacted"]
    got = R.highlights(docs, cands).orderBy("ordinal", "start").collect()
    assert [(r["needle"], out[r["start"] : r["end"]]) for r in got] == [("[CORREO 1]", "[CORREO 1]")] * 3 + [("c@d.mx", "c@d.mx")]
    original = docs.first()["text"]
    assert [original[r["original_start"] : r["original_end"]] for r in got] == ["a@b.mx", "A@B.MX", "[CORREO 1]", "c@d.mx"]


def test_long_documents_are_redacted_whole(spark):
    text = " ".join(f"u{i % 5000}@mail.example.mx y {'é' * (i % 5)}" for i in range(20_000))
    out = P.redact_documents(docs_of(spark, [text])).first()
    tags = {f"u{i}@mail.example.mx": f"[CORREO {i + 1}]" for i in range(5000)}
    assert out["redacted"] == " ".join(tags.get(w, w) for w in text.split(" ")) and out["n_replaced_candidates"] == 5000


def test_additions_take_the_texts_own_form_and_the_first_candidate(spark):
    docs = docs_of(spark, ["firma ana  ruiz y Ana Ruiz"])
    kinds = "doc_id int, cand_id string, ordinal int, original_text string, type string, norm string, is_selected boolean"
    out = E.add(docs, spark.createDataFrame([], kinds), spark.createDataFrame([(0, "ANA RUIZ")], "doc_id int, snippet string")).collect()
    assert [r["original_text"] for r in out] == ["ana  ruiz"]
    two = spark.createDataFrame([(0, "p", 1, "Ana Ruiz", "name", "ana ruiz", False), (0, "q", 2, "ana  ruiz", "organization", "ana ruiz", False)], kinds)
    out = E.add(docs, two, spark.createDataFrame([(0, "ANA RUIZ")], "doc_id int, snippet string")).orderBy("ordinal").collect()
    assert [(r["cand_id"], r["is_selected"]) for r in out] == [("p", True), ("q", False)]


def test_a_line_break_at_a_windows_start_does_not_cut():
    assert M.cut_points("\n" + "x" * 4000) == [(0, 1800), (1600, 3400), (3200, 4001)]


def test_pages_and_damaged_parts(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"x")), ("b.pdf", bytearray(b"y")), ("c.pdf", bytearray(b"z"))], "path string, content binary")
    read = lambda path, content: {b"x": [], b"y": [(None, None)]}.get(content) or ([] if content == b"x" else [(" ", "")])
    assert {r["path"]: r["error_code"] for r in F_.extract(files, read).collect()} == {"a.pdf": "emptyDocument", "b.pdf": "unreadablePDF", "c.pdf": "unreadablePDF"}
    whole = docx({"word/document.xml": "<w:p><w:r><w:t>uno</w:t></w:r></w:p><w:p><w:r><w:t>dos"})
    assert F_.docx_text(whole) == "uno\ndos"


@pytest.mark.parametrize("offset", [0.0, 0.0005, 0.0199])
def test_rows_of_jittered_lines(spark, offset):
    lines = [(1, f"{row}{col}", col / 10, 0.9 - 0.03 * row - offset + (0.009 if (row + col) % 2 else 0.0)) for row in range(9) for col in range(4)]
    r = random.Random(1)
    r.shuffle(lines)
    out = F_.reading_order(spark.createDataFrame(lines, "page int, text string, min_x double, max_y double"), "page").first()["text"]
    assert out.split("\n") == [f"{row}{col}" for row in range(9) for col in range(4)]


def test_composed_and_decomposed_texts_are_alike(spark):
    texts = ["Cédula profesional 12", "CAFÉ, Ñandú, Ångström", "Ελλάδα", "Йод", "tiếng Việt"]
    df = spark.createDataFrame([(t, unicodedata.normalize("NFD", t)) for t in texts], "c string, d string")
    rows = df.select(fold(F.col("c")).alias("c"), fold(F.col("d")).alias("d"), C.classify(F.col("c")).alias("kc"), C.classify(F.col("d")).alias("kd")).collect()
    assert all(r["c"] == r["d"] and r["kc"] == r["kd"] for r in rows) and rows[0]["kd"] == "cedula" and rows[4]["c"] == "tieng viet"


def test_answers_are_kept_by_content(spark, tmp_path):
    asked, path = tmp_path / "asked", f"{tmp_path}/answers"
    asked.mkdir()

    def model(instructions, chunk):
        import uuid

        (asked / uuid.uuid4().hex).write_text(chunk)
        if chunk == "falla":
            raise ValueError
        return {"names": [chunk.upper()]}

    parts = M.chunks(docs_of(spark, ["uno", "dos", "uno", "falla", "uno"]))
    for _ in range(2):
        out = sorted((r["doc_id"], r["ok"], tuple(r["names"])) for r in M.generate_once(parts, model, path).collect())
        assert out == [(0, True, ("UNO",)), (1, True, ("DOS",)), (2, True, ("UNO",)), (3, False, ()), (4, True, ("UNO",))]
    assert sorted(p.read_text() for p in asked.iterdir()) == ["dos", "falla", "falla", "uno"]
    M.generate_once(parts, model, path, instructions="otras").collect()
    assert len(list(asked.iterdir())) == 7


def test_a_written_search_index_reads_only_what_may_match(spark, tmp_path):
    h = history(spark, [(f"id{i}", "h", 1 + i % 9) for i in range(300)]).withColumn("search_preview", F.when(F.col("id").isin("id7", "id200"), "el zorro").otherwise(F.col("search_preview")))
    store.write_search_index(h, f"{tmp_path}/index")
    for q in (" ZORRO", "id200.pdf", "texto id11", "", "zo", "ausente", "d7.PDF"):
        assert sorted(r["id"] for r in store.search_index(spark, f"{tmp_path}/index", q).collect()) == sorted(r["id"] for r in H.search(h, q).collect())
    read = store.search_index(spark, f"{tmp_path}/index", "zorro").select(F.input_file_name()).distinct().count()
    plan = store.search_index(spark, f"{tmp_path}/index", "zorro")._jdf.queryExecution().executedPlan().toString()
    assert read <= 2 and "PartitionFilters: [part" in plan.replace("isnotnull(part#", "part#")


def test_page_ranges_give_what_whole_files_give(spark):
    pages = {f"f{n}.pdf": [(f"página {i} " + "palabra " * 9, None) if i % 3 else ("x", f"leída {i}") for i in range(n)] for n in (0, 1, 2, 7, 120)} | {"g.pdf": [(None, None)] * 3}
    def part(path, first, last):
        if path == "bad.pdf" and first > 1:
            raise OSError
        return pages.get(path, [("y" * 50, None)] * 4)[first:last]

    names = [*pages, "bad.pdf"]
    out = {r["path"]: (r["text"], r["error_code"]) for r in F_.extract_ranges(spark.createDataFrame([(n,) for n in names], "path string"), lambda p: len(pages.get(p, [0] * 4)), part, 2).collect()}
    whole = F_.extract(spark.createDataFrame([(n, bytearray(b"x")) for n in pages], "path string, content binary"), lambda p, c: pages[p]).collect()
    assert {k: v for k, v in out.items() if k != "bad.pdf"} == {r["path"]: (r["text"], r["error_code"]) for r in whole} and out["bad.pdf"] == (None, "unreadablePDF")
    assert out["f120.pdf"][0].count("\n") == 119
