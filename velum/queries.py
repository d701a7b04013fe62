"""Queries over the driver's tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum import fixed_values as V
from velum.functions import spans as S
from velum.functions.filters import should_keep
from velum.functions.needles import locate_all
from velum.functions.text import fold, needle_pattern, normalise
from velum.operators import classify as C
from velum.operators import detect as D
from velum.operators import history as H
from velum.operators import redact as R
from velum.operators import review as E
from velum.operators.model_layer import chunks, contextual, gather, generate, supplement
from velum.plans import redaction as P
from velum.rules import BY_NAME
from velum.sources import documents as F_
from velum.sources.store import load_record, notification, with_progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Suppliers of a task where each becomes texts: its rows are small but what is made of them isn't.
_PER_TASK = 500


def _dealt(df: DataFrame, spark: SparkSession, d: str, key: str) -> DataFrame:
    """What is made of each supplier, dealt by a key over as many tasks as the table's rows ask for: the table itself is one small file, so one
    task. Joins, groups and windows by the key need no other shuffle, and the number stays where adaptive execution would join small parts."""
    return df.repartition(1 + _table(spark, d, "supplier").count() // _PER_TASK, key)


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


# --- Rules. Texts are made from customer keys in both engines: lead, value and tail, and every third text with a broken value.

_D18 = "lpad(cast(c_custkey AS string), 18, '4')"
_D4 = "lpad(cast(c_custkey % 10000 AS string), 4, '0')"
_D5 = "lpad(cast(c_custkey % 100000 AS string), 5, '1')"
_D6 = "lpad(cast(c_custkey % 1000000 AS string), 6, '2')"
_D8 = "lpad(cast(c_custkey AS string), 8, '5')"

#: rule -> (lead, value expression, tail, broken value expression); the expressions are SQL of both engines.
_CASES: dict[str, tuple[str, str, str, str]] = {
    "curp": ("CURP ", f"concat('GAMR', {_D6}, 'HJCLRS0', cast(c_custkey % 10 AS string))", ", fin", f"concat('GBMR', {_D6}, 'HJCLRS0')"),
    "voter_key": ("clave ", f"concat('GRMNLS', {_D8}, 'M3', lpad(cast(c_custkey % 100 AS string), 2, '0'))", " y", f"concat('GRMNLS', {_D8}, 'X')"),
    "rfc": ("con RFC ", f"concat('Ñ&LH', {_D6}, 'AB', cast(c_custkey % 10 AS string))", ".", f"concat('GAM', {_D5}, 'A')"),
    "email": ("correo ", f"concat('user.', {_D6}, '@mail', cast(c_custkey % 7 AS string), '.example.mx')", " y", f"concat('user.', {_D6}, '(a)mail')"),
    "cedula": ("tiene ", f"concat('Cédula  profesional número: ', {_D6})", " vigente", f"concat('Cédula profesional: ', {_D4})"),
    "serial": ("Número de serie (VIN): ", f"concat('3VWFE21C0', {_D8})", ", ok", f"concat('3VWOE21C0', {_D8})"),
    "card": ("tarjeta ", f"concat('4111 ', {_D4}, '-', {_D4}, ' 0005')", " y", f"concat('4111 ', {_D4}, '--', {_D4})"),
    "passport": ("Pasaporte mexicano: ", f"concat('G', {_D8})", ", y", f"concat('GH', {_D8})"),
    "cic": ("folio ( CIC ): ", f"concat({_D6}, {_D6})", " fin", f"concat({_D5}, {_D5})"),
    "plate": ("placas de circulación ", f"concat(CASE c_custkey % 2 WHEN 0 THEN 'ABC-' ELSE 'xyz ' END, lpad(cast(c_custkey % 100 AS string), 2, '3'), '-A')", ".", "concat('AB-', cast(c_custkey AS string))"),
    "birth": ("fue ", f"concat('nacida el 3 de Marzo de ', {_D4}, ' (45 años de edad)')", ", y", "concat('nacida en ', cast(c_custkey AS string))"),
    "case_file": ("el ", f"CASE c_custkey % 2 WHEN 0 THEN concat('Expediente: ', {_D5}, ' / 2024') ELSE 'EXPEDIENTE 12/1999' END", ", fin", f"concat('Expediente ', {_D5}, '-24')"),
    "deed": ("la ", f"concat('escritura pública número ', cast(1 + c_custkey % 900 AS string), ',', lpad(cast(c_custkey % 1000 AS string), 3, '0'))", " de", "concat('escritura número ', cast(c_custkey AS string))"),
    "clabe": ("CLABE ", _D18, ", fin", f"concat({_D18}, '1')"),
    "phone": (
        "Tel. ",
        f"CASE c_custkey % 5 WHEN 0 THEN concat('+52 1 55 ', {_D4}, '-', {_D4}) WHEN 1 THEN concat('(55) ', {_D4}, '.', {_D4}) WHEN 2 THEN concat('55-', {_D4}, ' ', {_D4}) "
        f"WHEN 3 THEN concat('555 123-', {_D4}) ELSE concat('55', {_D4}, {_D4}) END",
        " ext", f"concat('55/', {_D4}, '/', {_D4})",
    ),
    "address": (
        "en ",
        f"CASE c_custkey % 2 WHEN 0 THEN concat('Calle Hidalgo ', cast(c_custkey AS string), ',\n Col. Centro, C.P. ', {_D5}) ELSE concat('blvd. del Sol ', cast(c_custkey AS string), ', Piso 4, Código Postal ', {_D5}) END",
        ".", f"concat('Calle Hidalgo ', {_D4}, ' sin código')",
    ),
    "company": (
        "de ",
        "CASE c_custkey % 4 WHEN 0 THEN concat('Grupo', cast(c_custkey AS string), ' del Norte Azul, S.A. de C.V.') WHEN 1 THEN concat('Luz', cast(c_custkey AS string), ' Y Sombra S. de R.L.') "
        "WHEN 2 THEN concat('Casa', cast(c_custkey AS string), ' Roja S.A.P.I. de C.V.') ELSE concat('Rey', cast(c_custkey AS string), ' DEL Mar, S. de R.L. de C.V.') END",
        " y", "concat('grupo', cast(c_custkey AS string), ' del norte, S.A.')",
    ),
    "bank": ("en banco ", "CASE c_custkey % 2 WHEN 0 THEN concat('Norte', cast(c_custkey AS string)) ELSE concat('Sur', cast(c_custkey AS string), ' de México Azul') END", ", y", "concat('(', cast(c_custkey AS string), ')')"),
    "brand": ("marca ", f"concat('Zafiro', cast(c_custkey AS string))", ", y", "concat('(Z', cast(c_custkey AS string), ')')"),
    "notary": ("ante ", f"concat('Notario Público No. ', cast(c_custkey AS string))", " de", "concat('Notario No. ', cast(c_custkey AS string))"),
    "electoral": ("del ", "concat('Instituto Nacional Electoral', ' ( INE )')", ", y", "concat('Instituto Electoral ', cast(c_custkey AS string))"),
    "party": ("ACTOR : ", "concat('JUAN ', CASE WHEN c_custkey % 2 = 0 THEN 'PÉREZ' ELSE 'LÓPEZ RUIZ' END)", "\nFin", "concat('Juan ', cast(c_custkey AS string))"),
    "titled": ("la Dra. ", "concat('María ', CASE WHEN c_custkey % 2 = 0 THEN 'Pérez' ELSE 'Soto García Ruiz' END)", ", y", "concat('maría ', cast(c_custkey AS string))"),
    "citizen": ("por el C. ", "concat('Juan ', CASE WHEN c_custkey % 2 = 0 THEN 'Pérez' ELSE 'Carlos Soto' END)", ", y", "concat('Juez ', cast(c_custkey AS string))"),
}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_case(name: str, lead: str, value: str, tail: str, broken: str) -> None:
    rule = BY_NAME[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        made = F.expr(f"CASE WHEN c_custkey % 3 = 0 THEN {broken} ELSE {value} END".replace("\n", "\\n"))
        docs = _table(spark, d, "customer").select("c_custkey", F.concat(F.lit(lead), made, F.lit(tail)).alias("text"))
        return docs.select("c_custkey", F.explode(D.rule_spans(F.col("text"), rule)).alias("s")).select("c_custkey", "s.type", "s.start", "s.end", "s.value", "s.rule_id")

    duck = value.replace("AS string", "AS varchar").replace("\n", "' || chr(10) || '")
    sql = f"""SELECT c_custkey, '{rule.type}' AS type, {len(lead)}::INTEGER AS start, ({len(lead)} + length(v))::INTEGER AS "end", v AS value, {rule.id}::INTEGER AS rule_id
      FROM (SELECT c_custkey, {duck} AS v FROM customer WHERE c_custkey % 3 <> 0)"""
    _add(f"rule_{rule.id:02d}_{name}", run, sql)


for _name, _case in _CASES.items():
    _rule_case(_name, *_case)

# --- Findings in the driver's documents: addresses of e-mail and numbers in parentheses are what they hold.

_EMAIL = "(?i)[A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{2,}"
#: The five forms of a phone number in texts of which each sign but digits stands twice: so a bound that Duck's pattern takes with the
#: number still leaves its other half to the next one.
_G2 = "(?:[\\s\\-.]{2})"
_PHONES = "|".join(
    (
        f"\\+\\+52{_G2}*1?{_G2}*\\d{{2,3}}{_G2}*\\d{{3,4}}{_G2}*\\d{{4}}",
        f"\\(\\(\\d{{2,3}}\\)\\){_G2}*\\d{{3,4}}{_G2}*\\d{{4}}",
        f"(?:^|[^\\d])\\d{{2}}{_G2}\\d{{4}}{_G2}\\d{{4}}(?:$|[^\\d])",
        f"(?:^|[^\\d])\\d{{3}}{_G2}\\d{{3}}{_G2}\\d{{4}}(?:$|[^\\d])",
        "(?:^|[^\\d])\\d{10}(?:$|[^\\d])",
    )
)
_CALLS = f"""
d2 AS (SELECT doc_id, regexp_replace(text, '([^\\d])', '\\1\\1', 'g') AS x FROM documents),
c2 AS (SELECT doc_id, x, regexp_extract_all(x, '{_PHONES}') AS m, string_split_regex(x, '{_PHONES}') AS g FROM d2 WHERE regexp_matches(x, '{_PHONES}')),
c3 AS (SELECT doc_id, x, unnest(range(1, len(m) + 1)) AS i, m, g FROM c2),
c4 AS (SELECT doc_id, x, m[i] AS one, CASE WHEN m[i][1] IN ('+', '(') AND m[i][1] = m[i][2] THEN m[i] ELSE regexp_extract(m[i], '(?s)\\d.*\\d') END AS v,
  list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS pos FROM c3),
calls AS (SELECT doc_id, regexp_replace(v, '([^\\d])[^\\d]', '\\1', 'g') AS value,
  ((pos + strpos(one, v) - 1 + length(regexp_replace(left(x, (pos + strpos(one, v) - 1)::BIGINT), '[^\\d]', '', 'g'))) // 2)::INTEGER AS start FROM c4)
"""
#: Duck's places: lengths of the gaps and matches before. The text is folded of nothing, so they are code points.
_FOUND = f"""
parts AS (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL}') AS m, string_split_regex(text, '{_EMAIL}') AS g FROM documents WHERE regexp_matches(text, '{_EMAIL}')),
places AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, g FROM parts),
emails AS (SELECT doc_id, m[i] AS value, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INTEGER AS start FROM places)
"""


def _email_findings(spark: SparkSession, d: str) -> DataFrame:
    return D.findings(_table(spark, d, "documents"), [BY_NAME["email"]])


_add(
    "detect_email",
    lambda s, d: _email_findings(s, d).select("doc_id", "start", "end", "value"),
    f'WITH {_FOUND} SELECT doc_id, start, (start + length(value))::INTEGER AS "end", value FROM emails',
)
_add(
    "detect_phone",
    lambda s, d: D.findings(_table(s, d, "documents"), [BY_NAME["phone"]]).select("doc_id", "start", "end", "value"),
    f'WITH {_CALLS} SELECT doc_id, start, (start + length(value))::INTEGER AS "end", value FROM calls',
)
#: Of the rules only those for e-mail and phone numbers find anything in the driver's documents; e-mail claims first.
_ALL = f"""{_FOUND}, {_CALLS}, found AS (SELECT doc_id, 'email' AS type, start, (start + length(value))::INTEGER AS "end", value, 4 AS rule_id FROM emails
  UNION ALL SELECT doc_id, 'phone', start, (start + length(value))::INTEGER, value, 15 FROM calls c WHERE NOT EXISTS
    (SELECT 1 FROM emails e WHERE e.doc_id = c.doc_id AND e.start < c.start + length(c.value) AND c.start < e.start + length(e.value)))"""
_add("detect_all_rules", lambda s, d: D.findings(_table(s, d, "documents")), f"WITH {_ALL} SELECT *, 'rule' AS source FROM found")
_add(
    "findings_by_type",
    lambda s, d: D.findings_by_type(_email_findings(s, d)),
    f"WITH {_FOUND} SELECT 'email' AS type, count(*) AS n, count(DISTINCT lower(value)) AS n_values FROM emails HAVING count(*) > 0",
)
_CANDS = f"""{_FOUND}, cands AS (SELECT doc_id, norm, value AS original_text, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS ordinal FROM
 (SELECT *, lower(value) AS norm, row_number() OVER (PARTITION BY doc_id, lower(value) ORDER BY start) AS n FROM emails) WHERE n = 1)"""
_add(
    "candidate_dedup",
    lambda s, d: D.candidates(_email_findings(s, d)).select("doc_id", "ordinal", "original_text", "type", "norm", "is_selected"),
    f"WITH {_CANDS} SELECT doc_id, ordinal::INTEGER AS ordinal, original_text, 'email' AS type, norm, true AS is_selected FROM cands",
)


def _toggled(spark: SparkSession, d: str) -> DataFrame:
    """E-mail candidates, of which a reviewer has taken out those of even ordinal."""
    c = D.candidates(_email_findings(spark, d))
    edits = c.filter("ordinal % 2 = 0").select("doc_id", "cand_id", F.lit(None).cast("string").alias("type"), F.lit(False).alias("is_selected"))
    return E.apply_edits(c, edits)


_TOGGLED = _CANDS + ", toggled AS (SELECT *, ordinal % 2 = 1 AS is_selected FROM cands)"
_TAGS = _TOGGLED + """, tagged AS (SELECT *, CASE WHEN is_selected THEN concat('[CORREO ', sum(is_selected::INTEGER) OVER (PARTITION BY doc_id ORDER BY ordinal), ']')
 ELSE '[CORREO -]' END AS tag FROM toggled)"""
_add(
    "review_edits",
    lambda s, d: _toggled(s, d).select("doc_id", "norm", "type", "is_selected"),
    f"WITH {_TOGGLED} SELECT doc_id, norm, 'email' AS type, is_selected FROM toggled",
)
_add(
    "selected_counts",
    lambda s, d: E.counts(_toggled(s, d)),
    f"WITH {_TOGGLED} SELECT doc_id, count(*) FILTER (is_selected) AS n_selected, count(*) AS n_total, concat(count(*) FILTER (is_selected), ' de ', count(*)) AS label FROM toggled GROUP BY doc_id",
)
_add(
    "select_all",
    lambda s, d: E.select_all(_toggled(s, d), True).select("doc_id", "norm", "is_selected"),
    f"WITH {_TOGGLED} SELECT doc_id, norm, true AS is_selected FROM toggled",
)
_add("tag_numbering", lambda s, d: R.tags(_toggled(s, d)).select("doc_id", "ordinal", "tag"), f"WITH {_TAGS} SELECT doc_id, ordinal::INTEGER AS ordinal, tag FROM tagged")
_add(
    "focus_needle",
    lambda s, d: R.tags(_toggled(s, d)).select("doc_id", "ordinal", E.focus_needle(F.col("original_text"), F.col("tag"), F.col("is_selected")).alias("needle")),
    f"WITH {_TAGS} SELECT doc_id, ordinal::INTEGER AS ordinal, CASE WHEN is_selected THEN tag ELSE original_text END AS needle FROM tagged",
)
_add(
    "redact_email",
    lambda s, d: R.redact(_table(s, d, "documents"), _toggled(s, d)),
    f"""WITH {_TAGS}, puts AS (SELECT doc_id, count(*) AS n, list(concat(original_text, chr(1), tag) ORDER BY length(original_text) DESC) AS l FROM tagged WHERE is_selected GROUP BY doc_id)
    SELECT doc_id, CASE WHEN l IS NULL THEN text ELSE list_reduce(list_prepend(text, l), lambda acc, x: replace(acc, split_part(x, chr(1), 1), split_part(x, chr(1), 2))) END AS redacted,
      coalesce(n, 0) AS n_replaced_candidates FROM documents LEFT JOIN puts USING (doc_id)""",
)
#: The redacted texts, and in them each needle's places: those where it stands alone, by the lengths of what is between. All in small letters.
_SHOWN = f"""{_TAGS}, puts AS (SELECT doc_id, list(concat(original_text, chr(1), tag) ORDER BY length(original_text) DESC) FILTER (is_selected) AS l FROM tagged GROUP BY doc_id),
  shown AS (SELECT doc_id, lower(CASE WHEN l IS NULL THEN text ELSE list_reduce(list_prepend(text, l), lambda acc, x: replace(acc, split_part(x, chr(1), 1), split_part(x, chr(1), 2))) END) AS x FROM documents JOIN puts USING (doc_id)),
  cut AS (SELECT doc_id, ordinal, CASE WHEN is_selected THEN tag ELSE original_text END AS needle, x, string_split(x, lower(CASE WHEN is_selected THEN tag ELSE original_text END)) AS g FROM tagged JOIN shown USING (doc_id)),
  hits AS (SELECT doc_id, ordinal, needle, x, unnest(range(1, len(g))) AS i, g FROM cut),
  spots AS (SELECT doc_id, ordinal, needle, x, list_sum(list_transform(g[1:i], lambda y: length(y))) + (i - 1) * length(needle) AS a FROM hits)"""
_add(
    "highlights",
    lambda s, d: R.highlights(_table(s, d, "documents"), _toggled(s, d)).select("doc_id", "ordinal", "needle", "start", "end"),
    f"""WITH {_SHOWN} SELECT doc_id, ordinal::INTEGER AS ordinal, needle, a::INTEGER AS start, (a + length(needle))::INTEGER AS "end" FROM spots
    WHERE needle LIKE '[%' OR NOT (regexp_matches(x[a::BIGINT], '[\\p{{L}}\\p{{N}}_]') AND a > 0) AND NOT regexp_matches(x[(a + length(needle) + 1)::BIGINT], '[\\p{{L}}\\p{{N}}_]')""",
)


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    """For each place of a redacted text that stands for a candidate, what the original has there."""
    shown = R.highlights(_table(spark, d, "documents"), _toggled(spark, d)).filter("needle like '[%'")
    texts = _table(spark, d, "documents").select("doc_id", "text")
    return shown.join(texts, "doc_id").select("doc_id", "needle", F.lower(S.cut(F.col("text"), F.col("original_start"), F.col("original_end"))).alias("original"))


#: As often as each selected value stands in its text, that tag stands for it.
_add(
    "highlight_originals",
    _mapped,
    f"""WITH {_TAGS}, hits AS (SELECT doc_id, tag AS needle, norm AS original, len(string_split(lower(text), norm)) - 1 AS n FROM tagged JOIN documents USING (doc_id) WHERE is_selected)
    SELECT doc_id, needle, original FROM (SELECT *, unnest(range(n)) FROM hits)""",
)
_add(
    "redact_documents",
    lambda s, d: P.redact_documents(_table(s, d, "documents")),
    f"""WITH {_ALL}, firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, lower(value) ORDER BY start) AS n FROM found),
    numbered AS (SELECT doc_id, value, concat(CASE type WHEN 'email' THEN '[CORREO ' ELSE '[TELEFONO ' END, row_number() OVER (PARTITION BY doc_id, type ORDER BY start), ']') AS tag FROM firsts WHERE n = 1),
    -- Ten digits within a word (a token, say) are found but not replaced, as they have no word bounds.
    puts AS (SELECT doc_id, count(*) AS n, list(concat(value, chr(1), tag) ORDER BY length(value) DESC) AS l FROM numbered JOIN documents USING (doc_id)
      WHERE NOT regexp_full_match(value, '\\d{{10}}') OR regexp_matches(text, concat('(?:^|[^\\p{{L}}\\p{{N}}_])', value, '(?:$|[^\\p{{L}}\\p{{N}}_])')) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN l IS NULL THEN text ELSE list_reduce(list_prepend(text, l), lambda acc, x: replace(acc, split_part(x, chr(1), 1), split_part(x, chr(1), 2))) END AS redacted,
      coalesce(n, 0) AS n_replaced_candidates FROM documents LEFT JOIN puts USING (doc_id)""",
)


def _synchronised(spark: SparkSession, d: str) -> DataFrame:
    docs, c = _table(spark, d, "documents"), D.candidates(_email_findings(spark, d))
    known = R.occurrences(docs, c.filter("ordinal = 1"))
    return R.synchronise(docs, c, known).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


_add("incremental_occurrences", _synchronised, f"WITH {_FOUND} SELECT doc_id, count(*) AS n, min(start) AS first FROM emails GROUP BY doc_id")



def _moved(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences known of the texts as they were; since then every document of an odd number has got a greeting."""
    old = _table(spark, d, "documents").select("doc_id", "text")
    c = D.candidates(_email_findings(spark, d))
    now = old.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("hola, "), F.col("text"))).otherwise(F.col("text")))
    return R.synchronise(now, c, R.occurrences(old, c)).select("doc_id", "start", "end")


_add("incremental_changed_text", _moved, f"""WITH {_FOUND} SELECT doc_id, (start + 6 * (doc_id % 2))::INTEGER AS start, (start + 6 * (doc_id % 2) + length(value))::INTEGER AS "end" FROM emails""")



def _moved_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The same, by the pieces of the texts that are still there."""
    old = _table(spark, d, "documents").select("doc_id", "text")
    c = D.candidates(_email_findings(spark, d))
    now = old.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("hola, "), F.col("text"))).otherwise(F.col("text")))
    return R.resynchronise(now, c, R.occurrences(old, c), R.text_index(old)).select("doc_id", "start", "end")


_add("incremental_changed_pieces", _moved_pieces, ORACLE_SQL["incremental_changed_text"])

# --- All rules together, on texts with several types, overlaps, rejected values and repeats: text -> (type, rule, start, value) of each
# finding and the redacted text, worked out by hand from the rules; the SQL states them for each supplier.

_TEXTS: dict[str, tuple[list[tuple[str, int, int, str]], str]] = {
    "Tel. +52 33 4821 9056, (33) 4821-9056, 33 4821 9056, 555 123 4567 y 3348219056.": (
        [("phone", 15, 5, "+52 33 4821 9056"), ("phone", 15, 23, "(33) 4821-9056"), ("phone", 15, 39, "33 4821 9056"), ("phone", 15, 53, "555 123 4567"), ("phone", 15, 68, "3348219056")],
        "Tel. [TELEFONO 1], [TELEFONO 2], [TELEFONO 3], [TELEFONO 4] y [TELEFONO 5].",
    ),
    "CLABE 646180110400000007 y tarjeta 4111 1111 1111 1111": ([("clabe", 14, 6, "646180110400000007"), ("identifier", 7, 35, "4111 1111 1111 1111")], "CLABE [CLABE 1] y tarjeta [IDENTIFICADOR 1]"),
    "marca Sol, marca Zafiro y banco Norte Azul": ([("organization", 19, 17, "Zafiro"), ("organization", 18, 32, "Norte Azul")], "marca Sol, marca [EMPRESA 1] y banco [EMPRESA 2]"),
    "ACTOR: JUAN PÉREZ LÓPEZ\nel C. Ana Ruiz Soto y la Lic. Ana Ruiz": (
        [("name", 22, 7, "JUAN PÉREZ LÓPEZ"), ("name", 24, 30, "Ana Ruiz Soto"), ("name", 23, 54, "Ana Ruiz")],
        "ACTOR: [NOMBRE 1]\nel C. [NOMBRE 2] y la Lic. [NOMBRE 3]",
    ),
    "Grupo Azul y Norte, S.A. de C.V. con Luz del Sur, S. de R.L.": (
        [("organization", 17, 0, "Grupo Azul y Norte, S.A. de C.V."), ("organization", 17, 37, "Luz del Sur, S. de R.L.")],
        "[EMPRESA 1] con [EMPRESA 2]",
    ),
    "Calle Hidalgo 5, Col. Centro, C.P. 06000; av. Madero 310, Piso 2, Código Postal 06700.": (
        [("address", 16, 0, "Calle Hidalgo 5, Col. Centro, C.P. 06000"), ("address", 16, 42, "av. Madero 310, Piso 2, Código Postal 06700")],
        "[DOMICILIO 1]; [DOMICILIO 2].",
    ),
    "a.b@c.mx, RFC ÑABC770821QX3, CURP GAMR770821HJCLRS04; A.B@C.MX": (
        [("email", 4, 0, "a.b@c.mx"), ("rfc", 3, 14, "ÑABC770821QX3"), ("curp", 1, 34, "GAMR770821HJCLRS04"), ("email", 4, 54, "A.B@C.MX")],
        "[CORREO 1], RFC [RFC 1], CURP [CURP 1]; [CORREO 1]",
    ),
    "nacida el 3 de Marzo de 1990 (33 años), expediente 12/2024 y escritura pública número 1,234": (
        [("identifier", 11, 0, "nacida el 3 de Marzo de 1990 (33 años)"), ("identifier", 12, 40, "expediente 12/2024"), ("identifier", 13, 61, "escritura pública número 1,234")],
        "[IDENTIFICADOR 1], [IDENTIFICADOR 2] y [IDENTIFICADOR 3]",
    ),
    "cédula profesional núm. 12345; placas ABC-123-A; pasaporte G12345678; CIC: 123456789012": (
        [("cedula", 5, 0, "cédula profesional núm. 12345"), ("identifier", 10, 38, "ABC-123-A"), ("identifier", 8, 59, "G12345678"), ("identifier", 9, 75, "123456789012")],
        "[CEDULA 1]; placas [IDENTIFICADOR 1]; pasaporte [IDENTIFICADOR 2]; CIC: [IDENTIFICADOR 3]",
    ),
    "Número de serie (VIN): 3VWFE21C04M000001, clave GRMNLS85031512M300, Notario Público No. 12, Instituto Nacional Electoral (INE)": (
        [("identifier", 6, 23, "3VWFE21C04M000001"), ("identifier", 2, 48, "GRMNLS85031512M300"), ("identifier", 20, 68, "Notario Público No. 12"), ("organization", 21, 92, "Instituto Nacional Electoral (INE)")],
        "Número de serie (VIN): [IDENTIFICADOR 1], clave [IDENTIFICADOR 2], [IDENTIFICADOR 3], [EMPRESA 1]",
    ),
}


def _written(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): the texts above for each supplier."""
    each = F.posexplode(F.array(*map(F.lit, _TEXTS))).alias("i", "text")
    made = _table(spark, d, "supplier").select("s_suppkey", each).select((F.col("s_suppkey") * 100 + F.col("i")).alias("doc_id"), "text")
    return _dealt(made, spark, d, "doc_id")


_add(
    "detect_together",
    lambda s, d: D.findings(_written(s, d)).select("doc_id", "type", "rule_id", "start", "end", "value"),
    'SELECT s_suppkey * 100 + i AS doc_id, type, rule_id, start, (start + length(value))::INTEGER AS "end", value FROM supplier, (VALUES '
    + ", ".join(f"({i}, '{t}', {r}, {a}, {_sql_text(v)})" for i, (found, _) in enumerate(_TEXTS.values()) for t, r, a, v in found)
    + ") t(i, type, rule_id, start, value)",
)
_add(
    "candidates_together",
    lambda s, d: D.candidates(D.findings(_written(s, d))).select("doc_id", "ordinal", "original_text", "type"),
    "SELECT s_suppkey * 100 + i AS doc_id, ordinal::INTEGER AS ordinal, value AS original_text, type FROM supplier, (VALUES "
    + ", ".join(f"({i}, '{t}', {o}, {_sql_text(v)})" for i, (found, _) in enumerate(_TEXTS.values()) for o, (t, _, _, v) in enumerate(found, 1) if v != "A.B@C.MX")
    + ") t(i, type, ordinal, value)",
)
_REDACTED = (
    "SELECT s_suppkey * 100 + i AS doc_id, redacted, n AS n_replaced_candidates FROM supplier, (VALUES "
    + ", ".join(f"({i}, {_sql_text(out)}, {len({v.lower() for _, _, _, v in found})}::BIGINT)" for i, (found, out) in enumerate(_TEXTS.values()))
    + ") t(i, redacted, n)"
)
_add("redact_together", lambda s, d: P.redact_documents(_written(s, d)), _REDACTED)
_add("redact_from_tables", lambda s, d: R.redact(_written(s, d), D.candidates(D.findings(_written(s, d)))), _REDACTED)


def _retyped(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers call each first candidate an identifier, give each second one an unknown type, and leave out each third."""
    c = D.candidates(D.findings(_written(spark, d)))
    kind = F.when(F.col("ordinal") == 1, "identifier").when(F.col("ordinal") == 2, "nonsense")
    edits = c.select("doc_id", "cand_id", kind.alias("type"), F.when(F.col("ordinal") == 3, False).alias("is_selected"))
    return R.tags(E.apply_edits(c, edits)).select("doc_id", "ordinal", "type", "is_selected", "tag")


_CANDIDATES = "(VALUES " + ", ".join(f"({i}, '{t}', {o})" for i, (found, _) in enumerate(_TEXTS.values()) for o, (t, _, _, v) in enumerate(found, 1) if v != "A.B@C.MX") + ") t(i, found, ordinal)"
_LABELS = "CASE type " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, _, c in V.TYPES) + " END"
_add(
    "review_retype",
    _retyped,
    f"""WITH c AS (SELECT s_suppkey * 100 + i AS doc_id, ordinal::INTEGER AS ordinal, CASE WHEN ordinal = 1 THEN 'identifier' ELSE found END AS type, ordinal <> 3 AS is_selected FROM supplier, {_CANDIDATES})
    SELECT *, concat('[', {_LABELS}, ' ', CASE WHEN is_selected THEN (sum(is_selected::INTEGER) OVER (PARTITION BY doc_id, type ORDER BY ordinal))::VARCHAR ELSE '-' END, ']') AS tag FROM c""",
)


def _inserted(spark: SparkSession, d: str) -> DataFrame:
    """Manual additions to the texts: one that is known, in capitals; words before and after what was found; what can't be redacted."""
    docs = _written(spark, d)
    c = D.candidates(D.findings(docs)).withColumn("is_selected", F.lit(False))
    some = F.explode(F.array(*map(F.lit, ["zafiro", "MARCA  sol", "y banco", "Norte Azul", "x", "[RFC 1]", "ausente"])))
    return E.add(docs, c, docs.select("doc_id", some.alias("snippet"))).select("doc_id", "ordinal", "original_text", "type", "is_selected")


#: The third text has all four snippets; the additions go before the first candidate that stands later, by place.
_add(
    "manual_insert",
    _inserted,
    f"""WITH c AS (SELECT s_suppkey * 100 + i AS doc_id, i, ordinal, value AS original_text, type FROM supplier, (VALUES
      {", ".join(f"({i}, '{t}', {o}, {_sql_text(v)})" for i, (found, _) in enumerate(_TEXTS.values()) for o, (t, _, _, v) in enumerate(found, 1) if v != "A.B@C.MX")}) t(i, type, ordinal, value))
    SELECT doc_id, ordinal::INTEGER AS ordinal, original_text, type, false AS is_selected FROM c WHERE i <> 2
    UNION ALL SELECT s_suppkey * 100 + 2, o::INTEGER, v, t, b FROM supplier, (VALUES (1, 'marca Sol', 'name', true), (2, 'Zafiro', 'organization', true), (3, 'y banco', 'name', true), (4, 'Norte Azul', 'organization', true)) x(o, v, t, b)""",
)

# --- Location of any needle.

_NEEDLES = ("the", "of the", "is", "de la", "a.b")
_EDGE = "[^\\p{L}\\p{M}\\p{N}_]"
#: Duck's word bounds know ASCII only and it has no look-around, so edges are matched as signs. Each is doubled first, as two neighbours share one.
_DOUBLED = f"regexp_replace(text, '({_EDGE})', '\\1\\1', 'g')"


def _located(spark: SparkSession, d: str) -> DataFrame:
    each = _table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, _NEEDLES))).alias("needle"))
    return each.select("doc_id", "needle", F.size(R.locate(F.col("text"), F.col("needle"))).cast("long").alias("n")).filter("n > 0")


_add(
    "locate_occurrences",
    _located,
    f"WITH d AS MATERIALIZED (SELECT doc_id, {_DOUBLED} AS x FROM documents) "
    + " UNION ALL ".join(
        f"""SELECT doc_id, '{needle}' AS needle, len(regexp_extract_all(x, '(?:^|{_EDGE})(?i:{needle.replace(".", "[.][.]").replace(" ", chr(92) + "s+")})(?:$|{_EDGE})'))::BIGINT AS n FROM d WHERE n > 0"""
        for needle in _NEEDLES
    ),
)


def _located_together(spark: SparkSession, d: str) -> DataFrame:
    """The same occurrences, of all needles by one scan of each text."""
    found = _table(spark, d, "documents").select("doc_id", locate_all(F.col("text"), F.array(*map(F.lit, _NEEDLES))).alias("found"))
    each = found.select("doc_id", F.explode(F.arrays_zip(F.array(*map(F.lit, _NEEDLES)).alias("needle"), "found")).alias("x"))
    return each.select("doc_id", "x.needle", F.size("x.found").cast("long").alias("n")).filter("n > 0")


_add("locate_together", _located_together, ORACLE_SQL["locate_occurrences"])
_add(
    "exact_substrings",
    lambda s, d: _table(s, d, "documents").select("doc_id", F.explode(R.exact_substrings(F.col("text"), F.lit("of the"))).alias("found")),
    f"""SELECT doc_id, concat(left(f, 2), array_to_string(list_filter(string_split(f[3:-4], ''), lambda c, i: i % 2 = 1), ''), right(f, 3)) AS found
    FROM (SELECT doc_id, unnest(regexp_extract_all({_DOUBLED}, '(?i)(?:^|{_EDGE})(of\\s+the)(?:$|{_EDGE})', 1)) AS f FROM documents)""",
)
_add(
    "normalise_text",
    lambda s, d: _table(s, d, "benchmark").select("item_id", normalise(F.col("text")).alias("norm")),
    "SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM benchmark",
)
_add(
    "fold_accents",
    lambda s, d: _table(s, d, "benchmark").select("item_id", fold(F.col("text")).alias("folded")),
    "SELECT item_id, lower(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçý', 'aaaaaaeeeeiiiiooooouuuuncy')) AS folded FROM benchmark",
)

# --- Addresses: the street of a candidate and what follows it.


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer")
    street = F.concat(F.lit("Calle Hidalgo "), (F.col("c_custkey") % 900 + 100).cast("string"))
    return c.select(
        "c_custkey", street.alias("street"), F.concat(F.lit("Vive en "), street, F.lit(", Colonia Centro, Piso 3, C.P. "), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit(". Fin")).alias("text")
    )


_add(
    "address_expansion",
    lambda s, d: _addresses(s, d)
    .select("c_custkey", F.explode(R.occurrence_ranges(F.col("text"), F.col("street"), F.lit("address"))).alias("r"), R.street_core(F.col("street")).alias("core"))
    .select("c_custkey", "r.start", "r.end", "core"),
    """SELECT c_custkey, 8::INTEGER AS start, (8 + length('Calle Hidalgo 100, Colonia Centro, Piso 3, C.P. 00000'))::INTEGER AS "end", 'calle hidalgo ' || (c_custkey % 900 + 100) AS core FROM customer""",
)

# --- Folds over spans, made from line items: within an order, start is (l_partkey % 40), length 3 + l_suppkey % 9, priority the line number.

_KINDS = ("name", "organization", "address", "email")


def _spans(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_quantity") % 4 + 1).cast("int"))
    start = (F.col("l_partkey") % 40).cast("int")
    span = F.struct(
        kind.alias("type"), start.alias("start"), (start + 3 + (F.col("l_suppkey") % 9).cast("int")).alias("end"), F.lit("v").alias("value"), F.col("l_linenumber").cast("int").alias("rule_id"), F.lit("rule").alias("source")
    )
    rows = _table(spark, d, "lineitem").filter(only).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", span.alias("s"))
    return rows.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "s"))), lambda x: x["s"]).alias("spans"))


_SPANS = """spans AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, l_linenumber AS rule_id, (l_partkey % 40)::INTEGER AS s,
 (l_partkey % 40 + 3 + l_suppkey % 9)::INTEGER AS e, ['name', 'organization', 'address', 'email'][(l_quantity % 4 + 1)::INTEGER] AS type FROM lineitem)"""


def _flat(df: DataFrame, column: Column) -> DataFrame:
    return df.select("l_orderkey", F.explode(column).alias("s")).select("l_orderkey", F.col("s.start").alias("s"), F.col("s.end").alias("e"), "s.type", "s.rule_id")


_CLAIM = """claimed AS (SELECT l_orderkey, i, rule_id, s, e, type, [[s, e]] AS held, true AS ok FROM spans WHERE i = 1
 UNION ALL SELECT n.l_orderkey, n.i, n.rule_id, n.s, n.e, n.type,
   CASE WHEN len(list_filter(c.held, lambda h: n.s < h[2] AND h[1] < n.e)) = 0 THEN list_append(c.held, [n.s, n.e]) ELSE c.held END,
   len(list_filter(c.held, lambda h: n.s < h[2] AND h[1] < n.e)) = 0
   FROM claimed c JOIN spans n ON n.l_orderkey = c.l_orderkey AND n.i = c.i + 1)"""
_add(
    "claim_overlaps",
    lambda s, d: _flat(_spans(s, d), S.by_start(S.claim(F.col("spans")))),
    f"WITH RECURSIVE {_SPANS}, {_CLAIM} SELECT l_orderkey, s, e, type, rule_id::INTEGER AS rule_id FROM claimed WHERE ok",
)
_add(
    "drop_contained",
    lambda s, d: _flat(_spans(s, d), S.drop_contained(F.col("spans"))),
    f"""WITH {_SPANS} SELECT l_orderkey, s, e, type, rule_id::INTEGER AS rule_id FROM spans x WHERE NOT EXISTS (SELECT 1 FROM spans y
      WHERE y.l_orderkey = x.l_orderkey AND y.type = x.type AND y.s <= x.s AND y.e >= x.e AND y.e - y.s > x.e - x.s)""",
)


def _supplemented(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast(f"array<{S.SPAN}>")
    base = _spans(spark, d, "l_linenumber <= 1").select("l_orderkey", S.claim(F.col("spans")).alias("spans"))
    more = _spans(spark, d, "l_linenumber > 1").select("l_orderkey", F.transform("spans", lambda x: x.withField("value", F.lit("Juan Soto"))).alias("more"))
    return _flat(base.join(more, "l_orderkey", "full"), supplement(F.coalesce("spans", none), F.coalesce("more", none)))


_add(
    "supplement_spans",
    _supplemented,
    f"""WITH RECURSIVE {_SPANS.replace("FROM lineitem", "FROM lineitem WHERE l_linenumber = 1 OR l_quantity % 4 < 2")}, {_CLAIM}
      SELECT l_orderkey, s, e, type, rule_id::INTEGER AS rule_id FROM claimed WHERE ok""",
)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    base = _spans(spark, d, "l_linenumber <= 2").select("l_orderkey", S.claim(F.col("spans")).alias("base"))
    more = _spans(spark, d, "l_linenumber > 2").select("l_orderkey", F.col("spans").alias("more"))
    none = F.array().cast(f"array<{S.SPAN}>")
    both = base.join(more, "l_orderkey", "full")
    return _flat(both, S.by_start(S.merge(F.coalesce("base", none), F.coalesce("more", none))))


#: A replaced span keeps its place in the list, so the list is carried as a whole: [start, end, contextual, rule].
_OVER = "list_filter(range(1, len(m.acc) + 1), lambda k: m.acc[k][1] < n.e AND n.s < m.acc[k][2])"
_add(
    "merge_layers",
    _merged,
    f"""WITH RECURSIVE {_SPANS}, item AS (SELECT *, CASE WHEN type = 'email' THEN 0 ELSE 1 END AS ctx, ['name', 'organization', 'address', 'email'] AS kinds FROM spans),
    steps AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS k FROM item),
    m AS (SELECT l_orderkey, 0::BIGINT AS k, []::BIGINT[][] AS acc FROM (SELECT DISTINCT l_orderkey FROM steps)
      UNION ALL SELECT n.l_orderkey, n.k,
        CASE WHEN len({_OVER}) = 0 THEN list_append(m.acc, [n.s, n.e, n.ctx, n.rule_id, list_position(n.kinds, n.type)])
          WHEN n.rule_id > 2 AND n.ctx = 1 AND m.acc[{_OVER}[1]][3] = 1 AND n.e - n.s > m.acc[{_OVER}[1]][2] - m.acc[{_OVER}[1]][1]
          THEN list_concat(list_append(m.acc[1:{_OVER}[1]-1], [n.s, n.e, n.ctx, n.rule_id, list_position(n.kinds, n.type)]), m.acc[{_OVER}[1]+1:])
          ELSE m.acc END
      FROM m JOIN steps n ON n.l_orderkey = m.l_orderkey AND n.k = m.k + 1),
    done AS (SELECT l_orderkey, arg_max(acc, k) AS acc FROM m GROUP BY l_orderkey)
    SELECT l_orderkey, x[1]::INTEGER AS s, x[2]::INTEGER AS e, ['name', 'organization', 'address', 'email'][x[5]] AS type, x[4]::INTEGER AS rule_id FROM (SELECT l_orderkey, unnest(acc) AS x FROM done)""",
)

# --- The filter and the classifier, on snippets made in both engines.

_SNIPPETS = (
    "enero", "de la", "Julio Soto", "María Soto", "Juan", "C. Juez Quinto", "Ana Juez en Turno", "Grupo Azul S.A. de C.V.", "Norte", "Sol", "pago multa",
    "pago Norte", "2024", "1999", "ab1", "abcde", "expediente largo", "12345", "CDMX", "Ciudad de México", "Calle Hidalgo 5", "ok", "abc", "  ", "m.n. pesos",
)


def _values(items) -> str:
    return ", ".join("(" + _sql_text(x) + ")" for x in items)


def _snippet_frame(spark: SparkSession, d: str, items) -> DataFrame:
    """Each snippet for each supplier: the table makes the rows, both engines the same."""
    return _dealt(_table(spark, d, "supplier").select("s_suppkey"), spark, d, "s_suppkey").select("s_suppkey", F.explode(F.array(*map(F.lit, items))).alias("snippet"))


def _in(items) -> str:
    return "[" + ", ".join(map(_sql_text, items)) + "]"


_BASE = [*V.STOPWORDS, *V.MONTHS, *V.LEGAL_TERMS]
_add(
    "filter_candidates",
    lambda s, d: _snippet_frame(s, d, _SNIPPETS)
    .withColumn("type", F.explode(F.array(*map(F.lit, [t for t, _, _ in V.TYPES]))))
    .filter(should_keep(F.col("snippet"), F.col("type")))
    .groupBy("snippet", "type")
    .agg(F.count(F.lit(1)).alias("n")),
    f"""WITH x AS (SELECT snippet, type, lower(trim(regexp_replace(snippet, '\\s+', ' ', 'g'))) AS norm FROM (VALUES {_values(_SNIPPETS)}) a(snippet), (VALUES {_values([t for t, _, _ in V.TYPES])}) b(type)),
    y AS (SELECT *, string_split(norm, ' ') AS t, {_in(_BASE)} AS base, {_in([*V.MONTHS, *V.LEGAL_TERMS])} AS dated, {_in([*_BASE, *V.COMMON_NOUNS])} AS listed FROM x WHERE norm <> '')
    SELECT snippet, type, (SELECT count(*) FROM supplier) AS n FROM y WHERE len(list_filter(t, lambda w: NOT list_contains(base, w))) > 0 AND CASE type
      WHEN 'name' THEN len(t) >= 2 AND NOT list_has_any(t, dated) AND NOT regexp_matches(norm, '^(c\\. juez|c juez|juez de|jueza de|magistrado|magistrada)') AND norm NOT LIKE '%juez de lo%' AND NOT (norm LIKE '%juez%' AND norm LIKE '%en turno%')
      WHEN 'organization' THEN contains(norm, 's.a.') OR contains(norm, 's. de r.l') OR contains(norm, 's.a.p.i') OR (len(list_filter(t, lambda w: NOT list_contains(listed, w))) > 0 AND (len(t) > 1 OR length(norm) >= 5))
      WHEN 'identifier' THEN NOT (len(t) = 1 AND length(norm) < 5) AND NOT regexp_matches(norm, '^(19|20)\\d\\d$') AND (regexp_matches(norm, '\\d') OR length(norm) >= 10)
      WHEN 'address' THEN length(norm) >= 12 AND norm NOT IN ('méxico', 'mexico', 'cdmx', 'ciudad de méxico')
      ELSE length(norm) >= 3 END""",
)
#: snippet -> type, worked out by hand from the rules; the SQL states them.
_CLASSIFIED = {
    "": "name",
    "juan.soto@correo.mx": "email",
    "RFC GAMR770821QX3": "rfc",
    "Avenida Madero": "address",
    "vive en la ciudad de Puebla": "address",
    "Cédula Profesional en trámite": "cedula",
    "Alfa, Persona Moral": "organization",
    "Razón Social: Beta": "organization",
    "un marinero": "identifier",
    "la provincia": "identifier",
    "Pasaporte vencido": "identifier",
    "Nacida en mayo": "identifier",
    "Juan Pérez": "name",
    "33 4821 9056": "phone",
}
_add(
    "classify_snippets",
    lambda s, d: _snippet_frame(s, d, _CLASSIFIED).select("s_suppkey", "snippet", C.classify(F.col("snippet")).alias("type")),
    "SELECT s_suppkey, snippet, type FROM supplier, (VALUES " + ", ".join(f"({_sql_text(a)}, '{b}')" for a, b in _CLASSIFIED.items()) + ") t(snippet, type)",
)
_add(
    "classify_with_model",
    lambda s, d: _snippet_frame(s, d, _CLASSIFIED).select(
        "s_suppkey", "snippet", C.classify_with(F.when(F.col("s_suppkey") % 2 == 0, F.when(F.col("s_suppkey") % 4 == 0, "clabe").otherwise("unknown")), F.col("snippet")).alias("type")
    ),
    "SELECT s_suppkey, snippet, CASE WHEN s_suppkey % 4 = 0 THEN 'clabe' ELSE type END AS type FROM supplier, (VALUES " + ", ".join(f"({_sql_text(a)}, '{b}')" for a, b in _CLASSIFIED.items()) + ") t(snippet, type)",
)
_add(
    "classify_benchmark",
    lambda s, d: _table(s, d, "benchmark").select("item_id", C.classify(F.col("text")).alias("type")),
    # No rule covers 65 % of an item, so hints decide.
    "WITH b AS (SELECT item_id, lower(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçý', 'aaaaaaeeeeiiiiooooouuuuncy')) AS t FROM benchmark) SELECT item_id, CASE "
    + " ".join(f"WHEN {' OR '.join(f'contains(t, {_sql_text(h)})' for h in hints)} THEN '{kind}'" for hints, kind in ((V.ADDRESS_HINTS, "address"), (V.LICENCE_HINTS, "cedula"), (V.ORGANIZATION_HINTS, "organization"), (V.IDENTIFIER_HINTS, "identifier")))
    + " ELSE 'name' END AS type FROM b",
)
#: Licences with an accent of its own (as texts from PDF files have), within a letter, and without; and what isn't one.
_add(
    "classify_decomposed",
    lambda s, d: _table(s, d, "supplier").select("s_suppkey", C.classify(F.concat(F.element_at(F.array(*map(F.lit, ("Ce\u0301dula", "Cédula", "CEDULA", "Regla"))), (F.col("s_suppkey") % 4 + 1).cast("int")), F.lit(" profesional de "), "s_name")).alias("type")),
    "SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN 'cedula' ELSE 'name' END AS type FROM supplier",
)
_add(
    "redactable_snippets",
    lambda s, d: _snippet_frame(s, d, ["[CORREO 1]", "[RFC -]", "[correo 1]", "a", " ab ", "[OTRO 1]", "[OTRO 1", "[Otro 1]", "[OTRO uno]", ""]).filter(E.redactable(F.col("snippet"))).select("s_suppkey", "snippet"),
    "SELECT s_suppkey, snippet FROM supplier, (VALUES ('[correo 1]'), (' ab '), ('[OTRO 1'), ('[Otro 1]'), ('[OTRO uno]')) t(snippet)",
)
_add(
    "can_redact",
    lambda s, d: _table(s, d, "documents").select("doc_id", E.can_redact(F.col("text"), F.lit("of the")).alias("ok")),
    "SELECT doc_id, regexp_matches(text, '(?i)\\bof\\s+the\\b') AS ok FROM documents",
)
_add(
    "refine_type",
    lambda s, d: _table(s, d, "supplier").select("s_suppkey", E.refine(F.lit("name"), F.when(F.col("s_suppkey") % 2 == 0, "name").otherwise("phone"), F.when(F.col("s_suppkey") % 3 > 0, "email")).alias("type")),
    "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN 'phone' WHEN s_suppkey % 3 > 0 THEN 'email' ELSE 'name' END AS type FROM supplier",
)


def _added(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text")
    c = _toggled(spark, d)
    first = c.filter("ordinal = 2").select("doc_id", F.upper("original_text").alias("snippet"))  # known: is selected again
    fresh = c.filter("ordinal = 1").select("doc_id", F.lit("@").alias("snippet"))
    return E.add(docs, c, first.unionByName(fresh)).select("doc_id", "ordinal", "original_text", "is_selected", "type")


#: "@" is too short; the second candidate is selected again, and the order stays.
_add("manual_additions", _added, f"WITH {_CANDS} SELECT doc_id, ordinal::INTEGER AS ordinal, original_text, ordinal = 2 OR ordinal % 2 = 1 AS is_selected, 'email' AS type FROM cands")

# --- History. Its tables are made from the documents; those with a label are known, say, and all come in.

_HISTORY = """h AS (SELECT doc_id::VARCHAR AS id, concat('Doc', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.PDF' WHEN doc_id % 3 = 1 THEN '.docx' ELSE '.txt' END) AS file_name, sha256(text) AS file_hash,
  TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS processed_at, TIMESTAMP '2024-02-01' + to_seconds((doc_id * 7919) % 10007) AS updated_at, (doc_id % 5)::INTEGER AS candidate_count, text FROM documents)"""
_COLUMNS = "id, file_name, file_hash, processed_at, updated_at, candidate_count, search_preview"
_HIST = _HISTORY + ", hist AS (SELECT id, file_name, file_hash, processed_at, updated_at, candidate_count, concat(lower(file_name), chr(10), lower(left(text, 2000))) AS search_preview FROM h)"


def _history(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    name = F.concat(F.lit("Doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".docx").otherwise(".txt"))
    at = lambda day, n: (F.unix_seconds(F.lit(day).cast("timestamp")) + n).cast("timestamp")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        name.alias("file_name"),
        H.fingerprint(F.col("text")).alias("file_hash"),
        F.to_timestamp_ntz(F.date_format(at("2024-01-01 00:00:00", F.col("doc_id")), "yyyy-MM-dd HH:mm:ss")).alias("processed_at"),
        F.to_timestamp_ntz(F.date_format(at("2024-02-01 00:00:00", (F.col("doc_id") * 7919) % 10007), "yyyy-MM-dd HH:mm:ss")).alias("updated_at"),
        (F.col("doc_id") % 5).cast("int").alias("candidate_count"),
        H.search_preview(name, F.col("text")).alias("search_preview"),
    )


def _known(spark: SparkSession, d: str) -> DataFrame:
    """The history of the documents that have a label."""
    return _history(spark, d).join(_table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi")


_LABELLED = "(SELECT doc_id::VARCHAR FROM labels)"
_add("fingerprint", lambda s, d: _history(s, d).select("id", "file_hash"), f"WITH {_HISTORY} SELECT id, file_hash FROM h")
_add("search_preview", lambda s, d: _history(s, d).select("id", "search_preview"), f"WITH {_HIST} SELECT id, search_preview FROM hist")
_add(
    "file_kind",
    lambda s, d: _history(s, d).select("id", H.file_kind(F.col("file_name")).alias("kind")),
    f"WITH {_HISTORY} SELECT id, CASE WHEN file_name LIKE '%.PDF' THEN 'pdf' WHEN file_name LIKE '%.docx' THEN 'word' ELSE 'text' END AS kind FROM h",
)
_add(
    "duplicate_lookup",
    lambda s, d: H.duplicates(_history(s, d).select(F.col("id").alias("incoming"), "file_hash"), _known(s, d)).drop("existing_name"),
    f"""WITH {_HIST}, f AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY updated_at DESC, id) AS n FROM hist WHERE id IN {_LABELLED})
      SELECT i.id AS incoming, i.file_hash, f.id AS existing_id FROM hist i JOIN f ON f.file_hash = i.file_hash AND f.n = 1""",
)
_add(
    "unseen_files",
    lambda s, d: H.unseen(_history(s, d).select("id", "file_hash"), _known(s, d)),
    f"WITH {_HIST} SELECT id, file_hash FROM hist i WHERE NOT EXISTS (SELECT 1 FROM hist e WHERE e.file_hash = i.file_hash AND e.id IN {_LABELLED})",
)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """A change of every labelled document, and a new one for each."""
    h = _known(spark, d)
    new = h.withColumn("id", F.concat(F.lit("new"), F.col("id")))
    return h.unionByName(new).withColumn("candidate_count", F.lit(99)).withColumn("processed_at", F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))).withColumn("updated_at", F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00")))


_add(
    "history_upsert",
    lambda s, d: H.upsert(_history(s, d), _changes(s, d)).drop("search_preview"),
    f"""WITH {_HIST}, old AS (SELECT * FROM hist),
    ch AS (SELECT * REPLACE (99 AS candidate_count, TIMESTAMP '2025-01-01' AS processed_at, TIMESTAMP '2025-01-01' AS updated_at) FROM
      (SELECT * FROM hist WHERE id IN {_LABELLED} UNION ALL SELECT * REPLACE ('new' || id AS id) FROM hist WHERE id IN {_LABELLED}))
    SELECT id, file_name, file_hash, processed_at, updated_at, candidate_count FROM old WHERE id NOT IN (SELECT id FROM ch)
    UNION ALL SELECT ch.id, ch.file_name, ch.file_hash, coalesce(old.processed_at, ch.processed_at), ch.updated_at, ch.candidate_count FROM ch LEFT JOIN old USING (id)""",
)
_add(
    "history_delete",
    lambda s, d: H.delete(_history(s, d), _table(s, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))).select("id", "file_name"),
    f"WITH {_HIST} SELECT id, file_name FROM hist WHERE id NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1)",
)
_add(
    "history_order",
    lambda s, d: H.ordered(_history(s, d)).select("id", "updated_at"),
    f"WITH {_HIST} SELECT id, updated_at FROM hist ORDER BY updated_at DESC, id",
)
_add(
    "history_search",
    lambda s, d: H.search(_history(s, d), "  THE of ").select("id"),
    f"WITH {_HIST} SELECT id FROM hist WHERE contains(lower(file_name), 'the of') OR contains(search_preview, 'the of')",
)
_add(
    "history_search_indexed",
    lambda s, d: H.search_indexed(_history(s, d), H.postings(_history(s, d)), "  THE of ").select("id"),
    ORACLE_SQL["history_search"],
)
_add(
    "history_in_flight",
    lambda s, d: H.with_in_flight(_known(s, d), _history(s, d)).select("id", "rank"),
    f"""WITH {_HIST} SELECT id, (id IN {_LABELLED})::INTEGER AS rank FROM hist""",
)


def _rebuilt(spark: SparkSession, d: str) -> DataFrame:
    h = _history(spark, d)
    none = F.array().cast(H.RECORD["candidates"].dataType)
    made = h.select("id", H.record(F.struct(*h.columns), F.lit("t"), none).alias("json"))
    broken = made.withColumn("json", F.when(F.col("id").cast("long") % 5 == 0, F.substring("json", 1, 20)).otherwise(F.col("json")))
    return H.rebuild(broken).select("id", "file_name", "candidate_count", "search_preview")


_add("history_rebuild", _rebuilt, f"WITH {_HIST} SELECT id, file_name, candidate_count, search_preview FROM hist WHERE id::BIGINT % 5 <> 0")
_add(
    "last_writes",
    lambda s, d: H.last_writes(_table(s, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("updated_at"), "event_id"), 3_600_000, "event_id").select("id", "updated_at", "event_id"),
    """SELECT id, updated_at, event_id FROM (SELECT user_id AS id, ts AS updated_at, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events)
      WHERE later IS NULL OR later - updated_at > INTERVAL 1 HOUR""",
)


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Records of all documents, saved once; those with a label were saved again with 77 candidates."""
    none = F.array().cast(H.RECORD["candidates"].dataType)
    made = lambda h, n: h.select("id", F.lit(n).cast("long").alias("written"), H.record(F.struct(*h.columns), F.lit("t"), none).alias("json"))
    return made(_history(spark, d), 1).unionByName(made(_known(spark, d).withColumn("candidate_count", F.lit(77)), 2))


_add(
    "record_replace",
    lambda s, d: H.rebuild(H.latest_records(_versions(s, d))).select("id", "file_name", "candidate_count"),
    f"WITH {_HIST} SELECT id, file_name, CASE WHEN id IN {_LABELLED} THEN 77 ELSE candidate_count END AS candidate_count FROM hist",
)
_add(
    "record_lookup",
    lambda s, d: load_record(_versions(s, d), "7").select("summary.id", "summary.file_name", "summary.candidate_count", "original_text"),
    f"WITH {_HIST} SELECT id, file_name, CASE WHEN id IN {_LABELLED} THEN 77 ELSE candidate_count END AS candidate_count, 't' AS original_text FROM hist WHERE id = '7'",
)

# --- Sources and sinks.

_add(
    "extension_gate",
    lambda s, d: _history(s, d).select("id", F_.is_supported(F.concat(F.lit("/in/a.b/"), "file_name", F.when(F.col("id").cast("long") % 7 == 0, ".bak").otherwise(""))).alias("supported")),
    f"WITH {_HISTORY} SELECT id, id::BIGINT % 7 <> 0 AS supported FROM h",
)
_add(
    "decode_text",
    lambda s, d: _table(s, d, "documents").select("doc_id", F_.decode_text(F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.encode("text", "ISO-8859-1"))).alias("text")),
    "SELECT doc_id, text FROM documents",  # its texts have no other characters than Latin-1's
)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    pages = docs.select(
        F.concat(F.lit("f"), (F.col("doc_id") % 100).cast("string")).alias("path"),
        F.floor(F.col("doc_id") / 100).cast("int").alias("page_no"),
        F.concat("text", F.lit("\f")).alias("embedded"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(" recognised ")).alias("recognised"),
    )
    return F_.join_pages(pages)


_add(
    "pdf_pages",
    _pages,
    """WITH p AS (SELECT doc_id, concat('f', doc_id % 100) AS path, doc_id // 100 AS n, text AS em, CASE WHEN doc_id % 3 = 0 THEN 'recognised' END AS re FROM documents),
    t AS (SELECT path, n, CASE WHEN length(regexp_replace(em, '[^\\p{L}\\p{M}\\p{N}]', '', 'g')) >= 40 THEN regexp_replace(em, '^\\s+|\\s+$', '', 'g') ELSE coalesce(re, nullif(regexp_replace(em, '^\\s+|\\s+$', '', 'g'), '')) END AS t FROM p)
    SELECT path, string_agg(t, chr(10) ORDER BY n) AS text FROM t WHERE t <> '' GROUP BY path""",
)


def _paged_range(path: str, first: int, last: int) -> list[tuple[str | None, str | None]]:
    """Pages of a supplier's file: long ones as they are, short ones to be recognised, and each seventh without anything."""
    if path.endswith("5"):
        raise OSError("no pages")
    page = lambda i: f"Página {i} de {path}: " + "texto que se puede leer " * 3
    return [(None, "") if i % 7 == 6 else (page(i) + "\f", None) if i % 2 == 0 else ("corto", f" leído {i} ") for i in range(first, last)]


def _by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A file of a few pages for each supplier, by ranges of three; those whose number ends in 5 can't be read, in 0 can't be counted."""
    files = _table(spark, d, "supplier").select(F.concat(F.lit("/in/"), F.col("s_suppkey").cast("string")).alias("path"))

    def pages(path: str) -> int:
        if path.endswith("0"):
            raise OSError("no file")
        return int(path[4:]) % 23

    return F_.extract_ranges(files, pages, _paged_range, 3)


_add(
    "pdf_page_ranges",
    _by_ranges,
    """WITH f AS (SELECT s_suppkey, concat('/in/', s_suppkey) AS path, s_suppkey % 23 AS n FROM supplier),
    p AS (SELECT path, unnest(range(n)) AS i FROM f WHERE s_suppkey % 5 > 0),
    t AS (SELECT path, i, CASE WHEN i % 7 = 6 THEN '' WHEN i % 2 = 0 THEN trim(concat('Página ', i, ' de ', path, ': ', repeat('texto que se puede leer ', 3))) ELSE concat('leído ', i) END AS t FROM p),
    j AS (SELECT path, string_agg(t, chr(10) ORDER BY i) AS text FROM t WHERE t <> '' GROUP BY path)
    SELECT path, text, CASE WHEN s_suppkey % 10 = 0 THEN 'unreadablePDF' WHEN n = 0 THEN 'emptyDocument' WHEN text IS NULL THEN 'unreadablePDF' END AS error_code FROM f LEFT JOIN j USING (path)""",
)
_add(
    "raster_size",
    lambda s, d: _table(s, d, "part").select("p_partkey", F_.raster_size(F.col("p_partkey") % 900 + 100.0, F.lit(792.0), (F.col("p_size") % 4 * 90).cast("int")).alias("r")).select("p_partkey", "r.width", "r.height"),
    """SELECT p_partkey, round((CASE WHEN p_size % 2 = 1 THEN 792.0::DOUBLE ELSE w END) * s)::INTEGER AS width, round((CASE WHEN p_size % 2 = 1 THEN w ELSE 792.0::DOUBLE END) * s)::INTEGER AS height
      FROM (SELECT p_partkey, p_size, (p_partkey % 900 + 100)::DOUBLE AS w, least(3.0::DOUBLE, 2200.0::DOUBLE / greatest((p_partkey % 900 + 100)::DOUBLE, 792.0::DOUBLE)) AS s FROM part)""",
)
_add(
    "notifications",
    lambda s, d: _table(s, d, "supplier").select("s_suppkey", notification(F.col("s_nationkey"), F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0).alias("message")),
    """SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN NULL WHEN s_nationkey = 1 THEN '1 hallazgo para revisar' ELSE concat(s_nationkey, ' hallazgos para revisar') END AS message FROM supplier""",
)
_add(
    "type_dimension",
    lambda s, d: D.with_names(_written(s, d).transform(D.findings)).groupBy("type", "display_name", "tag_label").agg(F.count(F.lit(1)).alias("n")),
    "SELECT type, display_name, tag_label, n FROM (VALUES " + ", ".join(f"({_sql_text(a)}, {_sql_text(b)}, {_sql_text(c)})" for a, b, c in V.TYPES) + ") t(type, display_name, tag_label) JOIN (SELECT type, count(*) AS n FROM supplier, (VALUES "
    + ", ".join(f"('{t}')" for found, _ in _TEXTS.values() for t, *_ in found) + ") f(type) GROUP BY type) USING (type)",
)
_add(
    "model_chunks",
    lambda s, d: chunks(_table(s, d, "documents")).select("doc_id", "chunk_idx", "start", F.length("chunk").alias("n")),
    f"""WITH RECURSIVE c AS (SELECT doc_id, text, length(text) AS size, 0 AS i, 0 AS a, {(cut := "CASE WHEN A + 1800 < length(text) AND contains(substr(text, A + 2, 1799), chr(10)) THEN A + length(substr(text, A + 1, 1800)) - strpos(reverse(substr(text, A + 1, 1800)), chr(10)) + 1 ELSE least(A + 1800, length(text)) END").replace("A +", "0 +")} AS e
      FROM documents WHERE trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) <> ''
      UNION ALL SELECT doc_id, text, size, i + 1, b, {cut.replace("A +", "b +")} FROM (SELECT *, CASE WHEN e - 200 > a THEN e - 200 ELSE e END AS b FROM c WHERE e < size))
    SELECT doc_id, i::INTEGER AS chunk_idx, a::INTEGER AS start, (e - a)::INTEGER AS n FROM c""",
)
_add(
    "needle_patterns",
    lambda s, d: _table(s, d, "supplier").select("s_suppkey", needle_pattern(F.concat(F.lit("C.  "), "s_name")).alias("pattern")),
    "SELECT s_suppkey, concat('(?iuU)\\bC\\.\\s+', array_to_string(list_transform(string_split_regex(s_name, '\\s+'), lambda t: concat('\\b', regexp_replace(t, '([.#-])', '\\\\\\1', 'g'), '\\b')), '\\s+')) AS pattern FROM supplier",
)


# --- Files, pages and the model layer, with readers and a model that stand for those outside.


def _paged(path: str, content: bytes) -> list[tuple[str | None, str | None]]:
    if b"damaged" in content:
        raise OSError("no pages")
    if content == b"no sheets":
        return []
    return [(p, None) if len(p) > 50 else (p, "leído") for p in content.decode().split("|")]


def _old_word(path: str, content: bytes) -> str:
    return content.decode("latin-1").removeprefix("OLD ")


def _docx(name: str) -> bytes:
    """A Word file of two paragraphs, a table stop, a footer and a header."""
    out = io.BytesIO()
    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/footer1.xml", f"<w:ftr {word}>{run('pie')}</w:ftr>")
        z.writestr("word/document.xml", f"<w:document {word}><w:body>{run(name)}<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {word}>{run('alto')}</w:hdr>")
    return out.getvalue()


_LONG = "una página con texto bastante para que se le crea, sin duda"
#: File name -> content as Spark's SQL, and text and error as Duck's, for a supplier's name.
_FILES = {
    "a.txt": ("cast(s_name AS binary)", "s_name", "NULL"),
    "b.TEXT": ("encode('año', 'ISO-8859-1')", "'año'", "NULL"),
    "c.docx": ("docx", "concat(s_name, chr(10), 'a', chr(9), 'b', chr(10), 'c', chr(10), chr(10), 'alto', chr(10), chr(10), 'pie')", "NULL"),
    "d.docx": ("cast('no zip' AS binary)", "'no zip'", "NULL"),
    "e.doc": ("cast('OLD text' AS binary)", "'text'", "NULL"),
    "f.pdf": (f"cast('{_LONG}|x||y' AS binary)", f"concat('{_LONG}', chr(10), 'leído', chr(10), 'leído', chr(10), 'leído')", "NULL"),
    "g.pdf": ("cast('damaged' AS binary)", "NULL", "'unreadablePDF'"),
    "l.pdf": ("cast('no sheets' AS binary)", "NULL", "'emptyDocument'"),
    "m.pdf": ("cast(' ' AS binary)", "'leído'", "NULL"),
    "h.bin": ("cast('x' AS binary)", "NULL", "'unsupportedFileType'"),
    "i.txt": ("cast(' \t' AS binary)", "NULL", "'emptyDocument'"),
    "j.txt": ("cast(NULL AS binary)", "NULL", "'readFailed'"),
    "k": ("cast('x' AS binary)", "NULL", "'unsupportedFileType'"),
}


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    suppliers = _table(spark, d, "supplier").withColumn("docx", F.udf(_docx, "binary")("s_name"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.expr(sql).alias("content")) for name, (sql, _, _) in _FILES.items()])).alias("f")
    files = suppliers.select("s_suppkey", each).select(F.concat(F.lit("/in/"), F.col("s_suppkey").cast("string"), F.lit("."), F.col("f.name")).alias("path"), "f.content")
    return F_.extract(files, _paged, _old_word).select("path", "text", "error_code")


_add(
    "extract_files",
    _extracted,
    " UNION ALL ".join(f"SELECT concat('/in/', s_suppkey, '.{name}') AS path, {text} AS text, {error} AS error_code FROM supplier" for name, (_, text, error) in _FILES.items()),
)
_add(
    "reading_order",
    lambda s, d: F_.reading_order(_table(s, d, "part").select((F.col("p_partkey") % 50).alias("page"), F.col("p_name").alias("text"), ((F.col("p_partkey") % 97) / 97).alias("min_x"), (F.col("p_size") * 0.007 + (F.col("p_partkey") % 5) * 0.001).alias("max_y")), "page"),
    r"""WITH o AS (SELECT p_partkey % 50 AS page, p_name AS text, (p_partkey % 97)::DOUBLE / 97 AS min_x, p_size * 0.007::DOUBLE + (p_partkey % 5) * 0.001::DOUBLE AS max_y FROM part),
      g AS (SELECT *, coalesce((round(lag(max_y) OVER w - max_y, 6) > 0.02)::INTEGER, 0) AS gap FROM o WINDOW w AS (PARTITION BY page ORDER BY max_y DESC, min_x, text)),
      r AS (SELECT *, sum(gap) OVER (PARTITION BY page ORDER BY max_y DESC, min_x, text ROWS UNBOUNDED PRECEDING) AS row FROM g)
      SELECT page, regexp_replace(string_agg(text, chr(10) ORDER BY row, min_x, text), '^\s+|\s+$', '', 'g') AS text FROM r GROUP BY page""",
)


def _progress(spark: SparkSession, d: str) -> DataFrame:
    """What the observation of a scan of all documents holds once the scan is done."""
    df, seen = with_progress(_table(spark, d, "documents").select("doc_id", F.nullif(F.col("text"), F.lit("")).alias("text")), "scan", "text")
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["text"])], "rows long, texts long")


_add("progress_counts", _progress, "SELECT count(*) AS rows, count(nullif(text, '')) AS texts FROM documents")


def _answer(instructions: str, chunk: str) -> dict[str, list[str]]:
    """A model that names a supplier's parties and repeats itself, and fails on chunks without any."""
    if "Firma" not in chunk:
        raise ValueError("nothing asked" if not instructions else "no parties")
    return {"names": ["Ana Ruiz", " ana  ruiz", "Ana Ruiz Soto", "x"] + [f"Nadie {i}" for i in range(40)], "organizations": ["Norte Azul"], "phones": ["no hay"]}


def _letters(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): a letter for each supplier, longer than a chunk, with its parties at the start."""
    made = F.concat(F.lit("Firma Ana Ruiz Soto de Norte Azul en "), "s_name", F.lit(".\nANA RUIZ firma. "), F.repeat(F.lit("relleno "), F.lit(400)))
    return _dealt(_table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name"), spark, d, "doc_id").select("doc_id", made.alias("text"))


_add(
    "model_answers",
    lambda s, d: gather(generate(chunks(_letters(s, d)), _answer)).select("doc_id", F.size("names").alias("n_names"), F.size("organizations").alias("n_organizations"), F.size("emails").alias("n_emails")),
    "SELECT s_suppkey AS doc_id, 24 AS n_names, 1 AS n_organizations, 0 AS n_emails FROM supplier",
)


def _context(spark: SparkSession, d: str) -> DataFrame:
    """The model's spans supplemented by a tagger's: one overlaps, one is a word of the common nouns, one is of no wanted type, one is new."""
    docs = _letters(spark, d)
    span = lambda kind, a, b, value: F.struct(F.lit(kind).alias("type"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(value).alias("value"), F.lit(2000).alias("rule_id"), F.lit("tagger").alias("source"))
    tagged = docs.select("doc_id", F.array(span("name", 6, 14, "Ana Ruiz"), span("organization", 15, 18, "firma"), span("place", 34, 36, "en"), span("name", 0, 5, "Firma Sol")).alias("spans"))
    # An inner explode would be filtered by its size first, for which Spark makes the spans once more.
    found = contextual(docs, _answer, tagged).select("doc_id", F.explode_outer("spans").alias("s")).filter("s is not null")
    return found.select("doc_id", "s.type", "s.start", "s.end", "s.value", "s.source")


_add(
    "model_layer",
    _context,
    """SELECT s_suppkey AS doc_id, type, start, "end", value, source FROM supplier, (VALUES ('name', 0, 5, 'Firma Sol', 'tagger'), ('name', 6, 19, 'Ana Ruiz Soto', 'model'), ('organization', 23, 33, 'Norte Azul', 'model')) t(type, start, "end", value, source)
    UNION ALL SELECT s_suppkey, 'name', 39 + length(s_name), 47 + length(s_name), 'ANA RUIZ', 'model' FROM supplier""",
)
