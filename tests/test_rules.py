"""Rules, filter and spans: the sample contract, one positive, negative and boundary text per rule, and properties."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velum import fixed_values as V
from velum.functions import spans as S
from velum.functions.filters import should_keep
from velum.functions.text import fold, normalise, tokens, trim
from velum.operators import detect as D
from velum.rules import BY_NAME, RULES

#: A contract like those the rules are for; places are counted by hand below.
CONTRACT = (
    "Arrienda el local la C. Rosa Elena Villaseñor Campos, de nacionalidad mexicana; su RFC es VICR770821QX3, su CURP VICR770821MJCLMS04, "
    "y vive en Avenida Hidalgo 77, Colonia Roma,\nGuadalajara, C.P. 44100.\nCelular: +52 33 4821 9056\nBuzón: rosa.v@ejemplo.com\n"
    "Depósitos a la CLABE 646180110400000007\nRenta Luis Batalla (RFC BATL880214M62, CURP BATL880214HPLRNS07), tel. 22 7146 0385, l.batalla@notas.mx."
)
FOUND = [
    ("name", "Rosa Elena Villaseñor Campos"), ("rfc", "VICR770821QX3"), ("curp", "VICR770821MJCLMS04"),
    ("address", "Avenida Hidalgo 77, Colonia Roma,\nGuadalajara, C.P. 44100"), ("phone", "+52 33 4821 9056"), ("email", "rosa.v@ejemplo.com"),
    ("clabe", "646180110400000007"), ("rfc", "BATL880214M62"), ("curp", "BATL880214HPLRNS07"), ("phone", "22 7146 0385"), ("email", "l.batalla@notas.mx"),
]

#: rule -> (texts with the value that the rule alone finds, texts in which it finds nothing)
CASES = {
    "curp": ([("x gamr770821hjclrs04.", "gamr770821hjclrs04")], ["GBMR770821HJCLRS04", "GAMR770821HJCLRS04A", "GAMR770821XJCLRS09"]),
    "voter_key": ([("GRMNLS85031512M300", "GRMNLS85031512M300")], ["GRMNL85031512M300", "GRMNLS85031512X300"]),
    "rfc": ([("Ñ&L770821QX3", "Ñ&L770821QX3")], ["RFC GAMR770821QX3x", "GA770821QX3"]),
    "email": ([("<a.b+c@d-e.f.mx>", "a.b+c@d-e.f.mx")], ["a@b", "a@b.c"]),
    "cedula": ([("cedula profesional núm. 12345", "cedula profesional núm. 12345")], ["cédula 12345", "cédula profesional 1234"]),
    "serial": ([("número de serie: 3VWFE21C04M000001 ", None), ("numero de serie 3VWFE21C04M0000012", "3VWFE21C04M000001")], ["número de serie 3VWIE21C04M000001"]),
    "card": ([("4111 1111-1111 1111", "4111 1111-1111 1111")], ["4111  1111 1111 1111", "14111 1111 1111 1111", "4111111111111111"]),
    "passport": ([("PASAPORTE G12345678", "G12345678")], ["pasaporte GG1234567", "pasaporte G123456"]),
    "cic": ([("CIC: 123456789012", "123456789012")], ["XCIC 123456789012", "CIC 12345678901"]),
    "plate": ([("placas ABC 123 A", "ABC 123 A")], ["placa ABC123A", "placas AB-123"]),
    "birth": ([("nacidas  el 1 de mayo de 1990", "nacidas  el 1 de mayo de 1990")], ["nacido el mayo de 1990"]),
    "case_file": ([("EXPEDIENTE 12/2020", "EXPEDIENTE 12/2020")], ["expediente 1/2020", "expediente 12/20"]),
    "deed": ([("escritura publica numero 1,234,567", "escritura publica numero 1,234,567")], ["escritura número 12"]),
    "clabe": ([("a646180110400000007b", "646180110400000007")], ["6461801104000000071", "01218000123456789"]),
    "phone": ([("(33) 4821-9056", "(33) 4821-9056"), ("x3348219056x", "3348219056"), ("555 123 4567", "555 123 4567")], ["33482190569", "55/1234/5678"]),
    "address": ([("av. Madero 310 y más C. P. 06000", "av. Madero 310 y más C. P. 06000")], ["Calle 1 C.P. 06000", "Calle Madero 310"]),
    "company": ([("de Grupo Azul y Cía, S. de R.L.", "Grupo Azul y Cía, S. de R.L."), ("Notario Azul Norte s.a.p.i. de c.v.", "Azul Norte s.a.p.i. de c.v.")], ["grupo azul S.A. de C.V.", "Azul S.A. de C.V."]),
    "bank": ([("Banco del norte y", "del norte")], ["bancos Norte"]),
    "brand": ([("marca Zafiro,", "Zafiro")], ["marcas Zafiro"]),
    "notary": ([("notario publico no 12", "notario publico no 12")], ["notario no. 12"]),
    "electoral": ([("INSTITUTO NACIONAL ELECTORAL (INE)", "INSTITUTO NACIONAL ELECTORAL (INE)")], ["Instituto Electoral"]),
    "party": ([("ACTOR: JUAN PÉREZ\nOTRA", "JUAN PÉREZ")], ["Actor: JUAN PÉREZ", "ACTOR: JUAN\nPÉREZ"]),
    "titled": ([("Lic. Ana Soto\nFirma", "Ana Soto\nFirma")], ["LIC. Ana Soto", "Lic. ana soto"]),
    "citizen": ([("al C. Juan Pérez", "Juan Pérez")], ["el C. Juez Pérez Soto", "el c. Juan Pérez"]),
}


def found(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r["i"]: r["x"] for r in df.select("i", column(F.col("text")).alias("x")).collect()}


def test_sample_contract(spark):
    out = found(spark, [CONTRACT], D.rule_layer)[0]
    assert [(x["type"], x["value"]) for x in out] == FOUND
    assert all(CONTRACT[x["start"] : x["end"]] == x["value"] for x in out)


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, name):
    yes, no = CASES[name]
    yes = [(t, v) for t, v in yes if v]
    out = found(spark, [t for t, _ in yes] + no + [None, ""], lambda t: D.rule_spans(t, BY_NAME[name]))
    for i, (text, value) in enumerate(yes):
        assert [x["value"] for x in out[i]] == [value], text
        assert text[out[i][0]["start"] : out[i][0]["end"]] == value
    for i in range(len(yes), len(out)):
        assert out[i] == []


def test_triggers_are_necessary(spark):
    texts = [t for yes, no in CASES.values() for t in [*(t for t, _ in yes), *no]] + [CONTRACT, CONTRACT.upper(), CONTRACT.lower()]
    for rule in RULES:
        plain = found(spark, texts, lambda t, r=rule: F.size(S.matches(t, r.pattern, r.group)))
        assert plain == found(spark, texts, lambda t, r=rule: F.size(S.matches(t, r.pattern, r.group, r.trigger)))
    maybe, layer = found(spark, texts, D.likely), found(spark, texts, D.rule_layer)
    assert all(maybe[i] or not layer[i] for i in maybe)


def test_filter(spark):
    keep = [
        ("Juan Soto", "name"), ("Sol", "phone"), ("Grupo S.A. de C.V.", "organization"), ("Norte", "organization"), ("pago Norte", "organization"),
        ("abcdefghij", "identifier"), ("ab1cd", "identifier"), ("Calle Sol 123", "address"), ("Ana Juez", "name"),
    ]
    drop = [
        ("Julio Soto", "name"), ("Juan", "name"), ("de la", "email"), ("mayo", "phone"), ("Jueza de Distrito Ana", "name"), ("Ana juez en turno", "name"), ("Sol", "organization"),
        ("fecha pago", "organization"), ("renta", "organization"), ("2024", "identifier"), ("abcd", "identifier"), ("abcdefghi", "identifier"), ("Ciudad de México", "address"),
        ("Calle Sol", "address"), ("ab", "phone"), ("", "name"), (None, "name"), ("  ", "clabe"),
    ]
    df = spark.createDataFrame([(v, t, True) for v, t in keep] + [(v, t, False) for v, t in drop], "v string, t string, want boolean")
    assert df.filter(should_keep(F.col("v"), F.col("t")) != F.col("want")).collect() == []


def test_text_functions(spark):
    df = spark.createDataFrame([("  Año\n  NUEVO\t",), (None,), ("",)], "t string")
    out = df.select(normalise(F.col("t")), trim(F.col("t")), fold(F.col("t")), tokens(F.col("t"))).collect()
    assert tuple(out[0]) == ("año nuevo", "Año\n  NUEVO", "  ano\n  nuevo\t", ["Año", "NUEVO"])
    assert tuple(out[1]) == (None,) * 4 and tuple(out[2]) == ("", "", "", [])


span = st.tuples(st.sampled_from(["name", "organization", "email"]), st.integers(0, 30), st.integers(1, 12)).map(lambda x: (x[0], x[1], x[1] + x[2]))
lists = st.lists(span, max_size=7)


def claim_by_hand(spans, seed=()):
    out = list(seed)
    for x in spans:
        if not any(x[1] < y[2] and y[1] < x[2] for y in out):
            out.append(x)
    return out


def merge_by_hand(base, more):
    out, contextual = list(base), {"name", "organization", "address"}
    for x in more:
        at = next((i for i, y in enumerate(out) if x[1] < y[2] and y[1] < x[2]), None)
        if at is None:
            out.append(x)
        elif {x[0], out[at][0]} <= contextual and x[2] - x[1] > out[at][2] - out[at][1]:
            out[at] = x
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(lists, lists), min_size=40, max_size=60))
def test_folds_by_hand(spark, pairs):
    full = lambda spans: [(t, a, b, "v", i, "rule") for i, (t, a, b) in enumerate(spans)]
    base = [claim_by_hand(a) for a, _ in pairs]
    rows = [(i, full(a), full(b), full(c)) for i, ((a, b), c) in enumerate(zip(pairs, base, strict=True))]
    df = spark.createDataFrame(rows, f"i int, a array<{S.SPAN}>, b array<{S.SPAN}>, c array<{S.SPAN}>")
    out = df.select("i", S.claim(F.col("a")).alias("claimed"), S.claim(F.col("b"), F.col("c")).alias("seeded"), S.merge(F.col("c"), F.col("b")).alias("merged"), S.drop_contained(F.col("a")).alias("outer")).collect()
    bare = lambda xs: [(x["type"], x["start"], x["end"]) for x in xs]
    for r in out:
        (a, b), c = pairs[r["i"]], base[r["i"]]
        assert bare(r["claimed"]) == c and bare(r["seeded"]) == claim_by_hand(b, c) and bare(r["merged"]) == merge_by_hand(c, b)
        assert bare(r["outer"]) == [x for x in a if not any(y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] and y[2] - y[1] > x[2] - x[1] for y in a)]
        assert not any(x["start"] < y["end"] and y["start"] < x["end"] for x, y in itertools.combinations(r["claimed"], 2))


def test_fixed_values():
    assert [len(x) for x in (V.STOPWORDS, V.MONTHS, V.LEGAL_TERMS, V.COMMON_NOUNS)] == [37, 13, 19, 42]
    assert len(RULES) == 24 and [r.id for r in RULES] == list(range(1, 25)) and len(V.TYPES) == 10
