"""The detection rules, in priority order: earlier rules claim text first.

Patterns are in Java's syntax. ``(?U)`` gives digits, spaces, words and word bounds their Unicode meaning, ``(?i)`` ignores case.
Where ``group`` is set the span is the pattern's only group, which ends where the match ends. ``trigger`` is a cheap pattern without
which there can't be a match, so that most texts are done with one fast scan.
"""

from __future__ import annotations

from typing import NamedTuple

# The letters that names and companies are made of, and the grammar of each rule.
_UP = "A-ZÁÉÍÓÚÜÑ"
_LOW = "a-záéíóúüñ"
_COMPANY = f"[{_UP}][A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9.&'’\\-]+"
_PERSON = f"[{_UP}][{_LOW}]+"
_ROLE = "Apoderado|Legal|Licenciado|Notario"
#: Link words in small letters, with a capital, and in capitals.
_LINKS = (
    "de|del|la|las|los|y|e|en",
    "De|Del|La|Las|Los|Y|E|En",
    "DE|DEL|LA|LAS|LOS|Y|E|EN",
)
_SA = "S\\.?\\s*A\\.?(?:\\s*P\\.?\\s*I\\.?)?\\s*(?:de\\s+)?C\\.?\\s*V\\."
_SRL = "S\\.?\\s*de\\s+R\\.?\\s*L\\.?(?:\\s*(?:de\\s+)?C\\.?\\s*V\\.?)?"
_GAP = "[\\s\\-.]"


class Rule(NamedTuple):
    id: int
    name: str
    type: str
    pattern: str
    group: bool = False
    trigger: str = ""


def _rules() -> tuple[Rule, ...]:
    any_case, exact = "(?iU)", "(?U)"
    connectors = "|".join(_LINKS)
    specs = [
        ("curp", "curp", any_case + "\\b[A-Z][AEIOUX][A-Z]{2}\\d{6}[HM][A-Z]{2}[B-DF-HJ-NP-TV-Z]{3}[A-Z0-9]\\d\\b"),
        ("voter_key", "identifier", any_case + "\\b[A-Z]{6}\\d{8}[HM][A-Z0-9]{3}\\b"),
        ("rfc", "rfc", any_case + "\\b[A-ZÑ&]{3,4}\\d{6}[A-Z0-9]{3}\\b"),
        ("email", "email", any_case + "[A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{2,}"),
        ("cedula", "cedula", any_case + "c[eé]dula\\s+profesional(?:\\s+n[uú]m(?:ero|\\.)?)?\\s*:?\\s*\\d{5,12}"),
        ("serial", "identifier", any_case + "n[uú]mero de serie(?:\\s*\\(\\s*VIN\\s*\\))?\\s*:?\\s*([A-HJ-NPR-Z0-9]{17})"),
        ("card", "identifier", exact + "\\b\\d{4}(?:[\\s\\-]\\d{4}){3}\\b"),
        ("passport", "identifier", any_case + "pasaporte(?:\\s+mexicano)?\\s*:?\\s*([A-Z]\\d{7,9})"),
        ("cic", "identifier", any_case + "(?:folio\\s*\\(\\s*CIC\\s*\\)|\\bCIC)\\s*:?\\s*(\\d{12,13})"),
        ("plate", "identifier", any_case + "placas(?:\\s+de\\s+circulaci[oó]n)?\\s+([A-Z]{3}[-\\s]?\\d{2,3}[-\\s]?[A-Z0-9]{1,3})"),
        ("birth", "identifier", any_case + "nacid[oa]s?\\s+el\\s+\\d{1,2}\\s+de\\s+[A-Za-zÁÉÍÓÚáéíóú]+\\s+de\\s+\\d{4}(?:\\s*\\(\\d{1,3}\\s+a[nñ]os(?:\\s+de\\s+edad)?\\))?"),
        ("case_file", "identifier", any_case + "expediente\\s*:?\\s*\\d{2,6}\\s*/\\s*\\d{4}"),
        ("deed", "identifier", any_case + "escritura\\s+p[uú]blica\\s+n[uú]mero\\s+(?:\\d{1,3}(?:,\\d{3})+|\\d{2,8})"),
        ("clabe", "clabe", exact + "(?<!\\d)\\d{18}(?!\\d)"),
        (
            "phone",
            "phone",
            any_case
            + "|".join(
                [
                    f"\\+52{_GAP}*1?{_GAP}*\\d{{2,3}}{_GAP}*\\d{{3,4}}{_GAP}*\\d{{4}}",
                    f"\\(\\d{{2,3}}\\){_GAP}*\\d{{3,4}}{_GAP}*\\d{{4}}",
                    f"(?<!\\d)\\d{{2}}{_GAP}\\d{{4}}{_GAP}\\d{{4}}(?!\\d)",
                    f"(?<!\\d)\\d{{3}}{_GAP}\\d{{3}}{_GAP}\\d{{4}}(?!\\d)",
                    "(?<!\\d)\\d{10}(?!\\d)",
                ]
            ),
        ),
        ("address", "address", any_case + "(?:Calle|Avenida|Av\\.|Boulevard|Blvd\\.|Paseo|Calzada|Privada)\\s+[\\s\\S]{8,240}?(?:C\\.?\\s*P\\.?|C[oó]digo\\s+Postal)\\s*\\d{5}"),
        (
            "company",
            "organization",
            exact + f"\\b(?!{_ROLE}|Lic|Demandado|Actor){_COMPANY}(?:(?:\\s+(?:{connectors}))?\\s+(?!{_ROLE}){_COMPANY}){{1,6}},?\\s*(?i:{_SA}|{_SRL})",
        ),
        ("bank", "organization", any_case + f"\\bbanco\\s+({_COMPANY}(?:\\s+{_COMPANY}){{0,3}})"),
        ("brand", "organization", any_case + f"\\bmarca\\s+([{_UP}][A-Za-zÁÉÍÓÚÜÑ0-9\\-]+)"),
        ("notary", "identifier", any_case + "Notario\\s+P[uú]blico\\s+No\\.?\\s*\\d+"),
        ("electoral", "organization", any_case + "Instituto Nacional Electoral(?:\\s*\\(\\s*INE\\s*\\))?"),
        ("party", "name", exact + f"(?:ACTOR|DEMANDADO|QUEJOSO|IMPUTADO|OFENDIDO|TERCERO\\s+INTERESADO)\\s*:\\s*([{_UP}]+(?:[ \\t]+[{_UP}]+){{1,8}})"),
        ("titled", "name", exact + f"\\b(?:[Ll]ic(?:enciado|enciada)?|[Dd]ra?|[Mm]tro)\\.?\\s+({_PERSON}(?:\\s+(?!Apoderado|Legal|Notario){_PERSON}){{1,3}})"),
        ("citizen", "name", exact + f"\\b(?:el|la|al|El|La|Al)\\s+C\\.\\s+(?!Juez|Jueza|JUEZ|JUEZA|Magistrado|Magistrada)({_PERSON}(?:\\s+{_PERSON}){{1,5}})"),
    ]
    triggers = {
        "curp": "\\d{6}", "voter_key": "\\d{8}", "rfc": "\\d{6}", "email": "@", "card": "\\d{4}", "clabe": "\\d{18}", "phone": "\\d{4}",
        "cedula": "(?iu)profesional", "serial": "(?iu)de serie", "passport": "(?iu)pasaporte", "cic": "(?iu)cic", "plate": "(?iu)placas",
        "birth": "(?iu)nacid", "case_file": "(?iu)expediente", "deed": "(?iu)escritura", "bank": "(?iu)banco", "brand": "(?iu)marca",
        "notary": "(?iu)notario", "electoral": "(?iu)instituto nacional", "address": "\\d{5}", "party": "ACTOR|DEMANDADO|QUEJOSO|IMPUTADO|OFENDIDO|INTERESADO",
        "company": "[cC]\\.?\\s*[vV]\\.|[dD][eE]\\s+[rR]\\.?\\s*[lL]", "titled": "(?:[Ll]ic|ciad[oa]|[Dd]ra?|tro)\\.?\\s+[A-ZÁÉÍÓÚÜÑ]", "citizen": "C\\.",
    }
    grouped = {"serial", "passport", "cic", "plate", "bank", "brand", "party", "titled", "citizen"}
    unicode = lambda t: "(?U)" + t if "\\d" in t or "\\s" in t else t
    return tuple(Rule(i, name, kind, pattern, name in grouped, unicode(triggers[name])) for i, (name, kind, pattern) in enumerate(specs, 1))


RULES = _rules()
BY_NAME = {r.name: r for r in RULES}

# The tail of an address after its street, and the street with its number.
ADDRESS_TAIL = (
    "(?iU)^(?:,?\\s*(?:C\\.?P\\.?\\s*\\d{5}|C[oó]digo\\s+Postal\\s*\\d{5}|Col(?:onia)?\\.?\\s+[^,.]{2,40}|Depto\\.?\\s*[\\w\\-]+"
    "|Despacho\\s+\\d+|Piso\\s+\\d+|Alcald[ií]a\\s+[^,.]{2,40}|Ciudad de México|Estado de México))+"
)
STREET_CORE = "(?iU)(?:Calle|Avenida|Av\\.|Boulevard|Blvd\\.|Paseo|Calzada|Privada)\\s+.+?\\s+\\d+[A-Za-z\\-]?"
