"""Surrogates for personal data (built-in functions only).

One pattern finds e-mail addresses, IP addresses, phone, card, account and social security numbers, official identifiers (tax, population
and voter's keys), access keys, secrets after a cue, and names after a title. Each distinct entity gets one surrogate of its type, drawn by a keyed hash of its normal form: given names by gender (of a
known first name, else of the titles it is met with) and script, surnames by script, numbers with as many digits, secrets of the same
signs, valid check digits where there were some. Each occurrence is then written in its own format: its separators, its capitals.

Coreference: the parts of a name are entities of their own, a given name or a surname, so "Mr. John Fooson", "Mr. Fooson" and
"Fooson" share a surname's surrogate. Names met after a title are replaced wherever they or their parts stand in the same text, with or
without a title, as written or in capitals (articles and the like, and single letters, only within a name).

Collision checks: a surrogate that two entities drew, or that is itself an entity of the table, is drawn again for all but one. Every
further draw has more room (names get more syllables, numbers more digits, secrets more signs), so a format without room is left rather
than kept; what still collides after ``MAX_ROUNDS`` gets a digest of 160 bits. So different entities stay different in the whole table,
and no entity can fail it.

Scale: what is shuffled is one row per distinct entity and task, then one per occurrence; texts without a sign of personal data are done
after a fast scan, and other texts move only where the replacements are too many bytes to broadcast. Joins are on entities, where Spark
splits a frequent one (adaptive skew joins), and on texts, known by two 64-bit hashes of different seeds.

Defined cases: null and empty texts stay; a null doc_id is as any other; repeated rows get the same surrogates; values without a letter or
digit (a masked password) are no entities and stay; an empty table gives an empty result; other columns pass through. Scripts other than
Latin, Cyrillic and Greek get Latin names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import discard, materialise, string, table

#: Bytes of replacements (with 64 for each row and value) up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
MAX_ROUNDS = 12
DEFAULT_KEY = "velum-surrogates"

_MALE_TITLES = ["mr", "herr", "monsieur", "m", "señor", "sr", "г-н", "господин", "κύριος"]
_FEMALE_TITLES = ["mrs", "ms", "miss", "frau", "madame", "mme", "mlle", "señora", "sra", "srta", "г-жа", "госпожа", "κυρία"]
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Srta|Sra|Sr|Г-н|г-н|Г-жа|г-жа|Господин|Госпожа|Κύριος|Κυρία"
_TITLE_LETTERS = "[DFHMPSГгΚ]"
#: Parts of names that aren't replaced where they stand alone.
_PARTICLES = ["al", "bin", "da", "de", "del", "den", "der", "di", "du", "el", "ibn", "la", "las", "le", "les", "los", "the", "van", "von"]
_NAME = "\\p{Lu}[\\p{Ll}']+(?:-\\p{Lu}\\p{Ll}+)?(?: \\p{Lu}[\\p{Ll}']+(?:-\\p{Lu}\\p{Ll}+)?){0,2}"
_CUE = "(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?"
#: Each alternative begins with what is cheap to test and seldom there.
_NAMED = f"(?<= )(?=\\p{{Lu}})(?<=(?<![\\p{{L}}-])(?:{_TITLES})[.]?[ ]){_NAME}"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
#: Three to six letters, a date and a mark: keys of tax payers, persons and voters.
_OFFICIAL = "(?i:[A-ZÑ&]{3,4}\\d{6}[A-Z0-9]{3}|[A-Z]{4}\\d{6}[HM][A-Z]{5}[A-Z0-9]\\d|[A-Z]{6}\\d{8}[HM][A-Z0-9]{3})"
PATTERN = "|".join(
    (
        "(?<![\\p{L}\\p{N}._%+-])(?=[^\\s@]+@)[\\p{L}\\p{N}._%+-]+@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)*\\.\\p{L}{2,}",
        f"(?<=[=: \"'])(?i:(?<={_CUE}[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?))(?=[_/+.-]*[A-Za-z0-9])[A-Za-z0-9_/+.-]{{6,}}[A-Za-z0-9_/+-]",
        "A(?<![A-Za-z0-9]A)KIA[0-9A-Z]{16}(?![A-Za-z0-9])",
        "(?=[\\d(+])(?:"
        f"(?<![\\p{{L}}\\d.]){_OCTET}(?:\\.{_OCTET}){{3}}(?!\\.?\\d)"
        "|(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])"
        "|(?<!\\d)\\d(?:[ -]?\\d){12,18}(?!\\d)"
        "|(?<![\\d+])(?:\\+\\d{1,3}[ .-]?)?(?:\\(\\d{2,4}\\)[ .-]?|\\d{2,4}[ .-])\\d{3,4}[ .-]\\d{4}(?!\\d)"
        "|(?<![\\p{L}\\d.,-])\\d{10}(?![\\p{L}\\d]))",
        f"(?<![\\p{{L}}\\p{{N}}&]){_OFFICIAL}(?![\\p{{L}}\\p{{N}}])",
        _NAMED,
    )
)
_TITLED = f"(?={_TITLE_LETTERS})(?:{_TITLES})[.]? \\p{{Lu}}"
_CUED = f"[=:](?<=(?i:{_CUE})[ ]{{0,2}}[=:])"

# Given names by script and gender, and syllables of surnames by script.
_GIVEN = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sofia", "Teresa", "Vera"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Felix", "Hugo", "Ivan", "Leon", "Martin", "Oscar", "Paul", "Victor"],
    ("latin", "n"): ["Alex", "Andrea", "Chris", "Dominique", "Kim", "Robin", "Sam", "Sascha", "Toni", "Val"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("cyrillic", "m"): ["Антон", "Борис", "Иван", "Марк", "Олег", "Павел", "Роман", "Юрий"],
    ("cyrillic", "n"): ["Женя", "Саша", "Валя", "Слава"],
    ("greek", "f"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Γιώργος", "Δημήτρης", "Νίκος", "Πέτρος"],
    ("greek", "n"): ["Άλεξ", "Κρις"],
}
_SYLLABLES = {
    "latin": ["bar", "cor", "dal", "fen", "gar", "hol", "kel", "lan", "mar", "nor", "per", "ral", "sen", "tor", "val", "wen"],
    "cyrillic": ["бар", "вер", "гор", "дол", "кар", "лан", "мир", "нов", "пол", "рад", "сел", "тор", "фед", "хол", "чер", "юр"],
    "greek": ["βαρ", "γερ", "δημ", "καλ", "λαμ", "μαρ", "νικ", "παπ", "ρουσ", "σταυ", "τσι", "φιλ", "χρι", "ψαρ", "θεο", "ζαν"],
}


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def kind(value: Column, cued: Column) -> Column:
    """The type of what matched; cued: whether a cue of a secret stands before it."""
    digits = F.length(F.regexp_replace(value, "\\D", ""))
    return (
        F.when(value.contains("@"), "email")
        .when(cued, "secret")
        .when(value.rlike("^\\d{1,3}(\\.\\d{1,3}){3}$"), "ip")
        .when(value.rlike("^AKIA[0-9A-Z]{16}$"), "access_key")
        .when(value.rlike("^\\d{3}-\\d{2}-\\d{4}$"), "ssn")
        .when(value.rlike(f"^{_OFFICIAL}$"), "official")
        .when(value.rlike("^\\d[\\d -]+\\d$") & (digits >= 13), "card")
        .when(value.rlike("^[+(\\d][\\d() .-]+\\d$"), "phone")
        .otherwise("name")
    )


def normal(kind_: Column, value: Column) -> Column:
    """What makes two occurrences the same entity."""
    return (
        F.when(kind_.isin("ssn", "card", "phone"), F.regexp_replace(value, "\\D", ""))
        .when(kind_.isin("email", "given", "surname"), F.lower(value))
        .when(kind_ == "official", F.upper(value))
        .otherwise(value)
    )


def _hex(seed: Column) -> Column:
    return F.sha2(seed, 256)


def _number(seed: Column, at: int, below: int) -> Column:
    """0 .. below - 1 from eight hexadecimal digits of a hash."""
    return F.pmod(F.conv(F.substring(_hex(seed), 1 + 8 * at, 8), 16, 10).cast("long"), F.lit(below)).cast("int")


def _digits(seed: Column) -> Column:
    """64 decimal digits."""
    return F.translate(_hex(seed), "abcdef", "038527")


def _same_signs(value: Column, seed: Column) -> Column:
    """Letters for letters (a-f where the value is hexadecimal), digits for digits, other signs as they are."""
    stream = _hex(seed)
    hexadecimal = value.rlike("^[0-9a-fA-F]+$")

    def sign(i: Column) -> Column:
        c = value.substr(i, F.lit(1))
        n = F.conv(stream.substr(F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        letter = F.char((F.when(hexadecimal, F.pmod(n, F.lit(6))).otherwise(F.pmod(n, F.lit(26))) + 97).cast("long"))
        return F.when(c.rlike("\\d"), F.pmod(n, F.lit(10)).cast("string")).when(c.rlike("\\p{Lu}"), F.upper(letter)).when(c.rlike("\\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), sign), "")


def _luhn(digits: Column, check: bool) -> Column:
    """The Luhn sum modulo 10 of a string of digits; check: as if a check digit were still to come."""
    size = F.length(digits)

    def term(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.pmod(size - i, F.lit(2)) == (0 if check else 1)
        return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), size), term), F.lit(0), lambda a, x: a + x), F.lit(10))


def _more(seed: Column, attempt: Column) -> Column:
    """Further digits from the third draw on."""
    return F.when(attempt >= 2, _digits(F.concat(seed, F.lit("+"))).substr(F.lit(1), attempt - 1)).otherwise("")


def _card(norm: Column, seed: Column, attempt: Column) -> Column:
    size = F.length(norm)
    body = F.concat(F.substring(norm, 1, 1), _digits(seed).substr(F.lit(1), size - 2), _more(seed, attempt))
    check = F.pmod(10 - _luhn(body, True), F.lit(10)).cast("string")
    return F.when(_luhn(norm, False) == 0, F.concat(body, check)).otherwise(F.concat(body, _digits(seed).substr(F.lit(40), F.lit(1))))


def _phone(norm: Column, seed: Column, attempt: Column) -> Column:
    """The country code stays; the exchange is 555, kept for fiction, as long as that has room."""
    size, d = F.length(norm), _digits(seed)
    return F.concat(
        F.when(
            size >= 10,
            F.concat(
                norm.substr(F.lit(1), size - 10),
                (2 + _number(seed, 6, 8)).cast("string"),
                d.substr(F.lit(1), F.lit(2)),
                F.when(attempt < 1, F.lit("555")).otherwise(d.substr(F.lit(3), F.lit(3))),
                d.substr(F.lit(6), F.lit(4)),
            ),
        ).otherwise(d.substr(F.lit(1), size)),
        _more(seed, attempt),
    )


def _secret(norm: Column, seed: Column, attempt: Column) -> Column:
    """The same signs, and from the third draw on two more for each."""
    return F.concat(_same_signs(norm, seed), F.when(attempt >= 2, F.substring(_hex(F.concat(seed, F.lit("+"))), 1, 62).substr(F.lit(1), 2 * attempt - 2)).otherwise(""))


def _email(norm: Column, seed: Column, attempt: Column, key: str) -> Column:
    """Other letters and digits before the at; one other name for each domain, with its last part."""
    domain = F.substring_index(norm, "@", -1)
    name = F.translate(F.substring(_hex(F.concat(F.lit(key + "|domain|"), domain)), 1, 20), "0123456789", "ghijklmnop")
    last = F.substring_index(domain, ".", -1)
    return F.concat(_secret(F.substring_index(norm, "@", 1), seed, attempt), F.lit("@"), name, F.lit(".example"), F.when(last == "example", "").otherwise(F.concat(F.lit("."), last)))


def _script(norm: Column) -> Column:
    return F.when(norm.rlike("\\p{IsCyrillic}"), "cyrillic").when(norm.rlike("\\p{IsGreek}"), "greek").otherwise("latin")


def _syllables(script: Column, seed: Column, n: Column) -> Column:
    values = F.lit(None)
    for s, own in _SYLLABLES.items():
        values = F.when(script == s, _array(own)).otherwise(values)
    drawn = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(values, 1 + _number(F.concat(seed, i.cast("string")), 0, 16)))
    return F.when(n > 0, F.array_join(drawn, "")).otherwise("")


def _given(norm: Column, gender: Column, seed: Column, attempt: Column) -> Column:
    """A given name of the script and gender, with a syllable more for each further draw."""
    script = _script(norm)
    out = F.lit(None).cast("string")
    for (s, g), values in _GIVEN.items():
        out = F.when((script == s) & (gender == g), F.lower(_array(values)[_number(seed, 0, len(values))])).otherwise(out)
    return F.concat(out, _syllables(script, seed, attempt))


def _surname(norm: Column, seed: Column, attempt: Column) -> Column:
    return _syllables(_script(norm), seed, attempt + 2)


def draw(kind_: Column, norm: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate, in normal form, of the given draw; a digest after ``MAX_ROUNDS``."""
    seed = F.concat_ws("|", F.lit(key), kind_, norm, attempt.cast("string"))
    octet = [(_number(seed, i, 254) + 1).cast("string") for i in range(4)]
    return (
        F.when(attempt >= MAX_ROUNDS, F.translate(F.substring(_hex(seed), 1, 40), "0123456789", "ghijklmnop"))
        .when(kind_ == "email", _email(norm, seed, attempt, key))
        .when(kind_ == "ip", F.concat(F.concat_ws(".", *octet), F.when(attempt >= 4, F.concat(F.lit("."), _more(seed, attempt))).otherwise("")))
        .when(kind_ == "card", _card(norm, seed, attempt))
        .when(kind_ == "phone", _phone(norm, seed, attempt))
        .when(kind_ == "ssn", F.concat(_digits(seed).substr(F.lit(1), F.lit(9)), _more(seed, attempt)))
        .when(kind_ == "access_key", F.concat(F.lit("AKIA"), _secret(F.substring(norm, 5, 16), seed, attempt)))
        .when(kind_ == "given", _given(norm, gender, seed, attempt))
        .when(kind_ == "surname", _surname(norm, seed, attempt))
        .otherwise(_secret(norm, seed, attempt))
    )


def render(kind_: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in an occurrence's own format; digits beyond the format's follow it."""
    signs = F.split(value, "")
    filled = F.aggregate(
        signs,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda a, c: F.when(c.rlike("^\\d$"), F.struct(F.concat(a["out"], surrogate.substr(a["k"] + 1, F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))
        ),
        lambda a: F.concat(a["out"], surrogate.substr(a["k"] + 1, F.length(surrogate))),
    )
    capitals = value == F.upper(value)
    return (
        F.when(kind_.isin("ssn", "card", "phone"), filled)
        .when(kind_.isin("given", "surname"), F.when(capitals, F.upper(surrogate)).otherwise(F.initcap(surrogate)))
        .when((kind_ == "email") & capitals, F.upper(surrogate))
        .when(kind_ == "official", F.when(value == F.lower(value), F.lower(surrogate)).otherwise(F.upper(surrogate)))
        .otherwise(surrogate)
    )


def likely(text: Column) -> Column:
    """Whether a text can hold an entity: scans that are cheap at each place."""
    return F.coalesce(text.contains("@") | text.rlike("\\d[\\d ().-]{5}") | text.contains("AKIA") | text.rlike(_CUED) | text.rlike(_TITLED), F.lit(False))


def _known(text: Column) -> Column:
    """The names that stand after a title, and those of their parts that count alone, longest first."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(_NAMED), F.lit(0)))
    parts = F.filter(F.flatten(F.transform(names, lambda n: F.split(n, " "))), lambda p: ~F.lower(p).isin(_PARTICLES))
    every = F.array_distinct(F.concat(names, parts))
    longest = F.array_sort(every, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.when(text.rlike(_TITLED), longest).otherwise(F.array().cast("array<string>"))


def _pattern(known: Column) -> Column:
    """PATTERN, and before it the known names of a text, as written or in capitals (they hold letters, apostrophes, hyphens and blanks alone)."""
    both = F.flatten(F.transform(known, lambda n: F.array(n, F.upper(n))))
    return F.when(F.size(known) > 0, F.concat(F.lit("(?=\\p{Lu})(?<![\\p{L}\\p{N}-])(?:"), F.array_join(both, "|"), F.lit(f")(?![\\p{{L}}\\p{{N}}-])|{PATTERN}"))).otherwise(F.lit(PATTERN))


def found(docs: DataFrame) -> DataFrame:
    """(row1, row2, known, values, before) of each row of (row1, row2, text) that has entities: what matched, in order, and the end of the text before each."""
    named = docs.filter(likely(F.col("text"))).withColumn("known", _known(F.col("text")))
    values = F.regexp_extract_all(F.col("text"), _pattern(F.col("known")), F.lit(0))
    gaps = F.transform(F.split(F.col("text"), _pattern(F.col("known"))), lambda g: F.substring(g, -30, 30))
    return named.select("row1", "row2", "known", values.alias("values"), gaps.alias("before")).filter(F.size("values") > 0)


def pieces(hits: DataFrame) -> DataFrame:
    """(row1, row2, pos, part, kind, norm, value, title): entities of each occurrence; names give one for each part.

    The last part of a name is a surname. A name of one part is a given name if full names of its text have it so, and none as a surname.
    """
    full = F.transform(F.filter(F.col("known"), lambda n: n.contains(" ")), lambda n: F.split(F.lower(n), " "))
    first = F.flatten(F.transform(full, lambda p: F.slice(p, 1, F.size(p) - 1)))
    last = F.transform(full, lambda p: F.element_at(p, -1))
    each = hits.select("row1", "row2", first.alias("first"), last.alias("last"), F.posexplode(F.arrays_zip("values", F.slice("before", 1, F.size("values")).alias("before")))).select(
        "row1", "row2", "pos", "first", "last", F.col("col.values").alias("value"), F.col("col.before").alias("before")
    )
    each = each.withColumn("sort", kind(F.col("value"), F.col("before").rlike(f"(?i){_CUE}[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?$")))
    words = F.split("value", " ")
    given = F.array_contains("first", F.lower("value")) & ~F.array_contains("last", F.lower("value"))
    parts = F.transform(words, lambda w, i: F.struct(F.when((i + 1 < F.size(words)) | ((F.size(words) == 1) & given), "given").otherwise("surname").alias("kind"), w.alias("value")))
    whole = F.array(F.struct(F.col("sort").alias("kind"), F.col("value").alias("value")))
    split = each.select("row1", "row2", "pos", "before", F.posexplode(F.when(F.col("sort") == "name", parts).otherwise(whole)).alias("part", "x"))
    return split.select(
        "row1", "row2", "pos", "part", "x.kind", normal(F.col("x.kind"), F.col("x.value")).alias("norm"), "x.value", F.lower(F.regexp_extract("before", "(\\S+?)[.]? $", 1)).alias("title")
    )


def _pool(kind_: Column) -> Column:
    """Kinds whose surrogates must differ from each other's."""
    return F.when(kind_.isin("given", "surname"), "name").when(kind_.isin("ssn", "card", "phone"), "digits").otherwise(kind_)


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for entities (kind, norm, gender), distinct within each pool of kinds and from all entities of it."""
    columns = ["kind", "norm", "gender", "attempt", "surrogate"]
    fresh = draw(F.col("kind"), F.col("norm"), F.col("gender"), F.col("attempt"), key)
    now = materialise(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", fresh), "surrogates")
    for _ in range(MAX_ROUNDS):
        pooled = now.withColumn("pool", _pool(F.col("kind")))
        # Of those with one surrogate the first entity keeps it, unless it is an entity itself.
        shared = pooled.groupBy("pool", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("kind", "norm")).alias("first"))
        taken = pooled.select("pool", F.col("norm").alias("surrogate"), F.lit(True).alias("taken")).distinct()
        bad = materialise(
            shared.join(taken, ["pool", "surrogate"], "left").filter((F.col("n") > 1) | F.col("taken")).select("pool", "surrogate", "first", F.coalesce("taken", F.lit(False)).alias("taken")),
            "collisions",
        )
        if bad.isEmpty():
            discard(bad)
            break
        again = pooled.join(bad, ["pool", "surrogate"], "left").withColumn("redo", F.coalesce(F.col("taken") | (F.struct("kind", "norm") != F.col("first")), F.lit(False)))
        again = again.withColumn("attempt", F.when(F.col("redo"), F.col("attempt") + 1).otherwise(F.col("attempt")))
        before = now
        now = materialise(again.withColumn("surrogate", F.when(F.col("redo"), fresh).otherwise(F.col("surrogate"))).select(*columns), "surrogates")
        discard(before, bad)
    return now.select("kind", "norm", "surrogate")


def pseudonymise(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and velum_replaced: the number of entities replaced in the row."""
    rows = ["velum_row1", "velum_row2"]
    marked = docs.withColumn("velum_row1", F.xxhash64(string(text))).withColumn("velum_row2", F.xxhash64(F.lit("second"), string(text)))
    texts = marked.select(F.col("velum_row1").alias("row1"), F.col("velum_row2").alias("row2"), F.col(text).alias("text"))
    hits = materialise(found(texts).dropDuplicates(["row1", "row2"]), "hits")
    each = pieces(hits)
    known = lambda g: F.array_contains(_array([n for (_, x), names in _GIVEN.items() if x == g for n in names]), F.initcap("norm"))
    vote = F.when(F.col("title").isin(_FEMALE_TITLES), 1).when(F.col("title").isin(_MALE_TITLES), -1).otherwise(0)
    votes = F.col("votes")
    entities = (
        each.groupBy("kind", "norm")
        .agg(F.sum(vote).alias("votes"))
        .withColumn("gender", F.when(F.col("kind") != "given", "n").when(known("f"), "f").when(known("m"), "m").when(votes > 0, "f").when(votes < 0, "m").otherwise("n"))
        .select("kind", "norm", "gender")
    )
    chosen = mapping(entities, key)
    part = F.struct("part", render(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new"))
    rendered = (
        each.join(chosen, ["kind", "norm"])
        .groupBy("row1", "row2", "pos")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["new"]), " ").alias("new"))
        .groupBy("row1", "row2")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("velum_new"))
        .join(hits.select("row1", "row2", F.col("known").alias("velum_known")), ["row1", "row2"])
        .withColumnsRenamed({"row1": "velum_row1", "row2": "velum_row2"})
    )
    new = materialise(rendered, "replacements")
    weight = F.lit(64) * (1 + F.size("velum_new") + F.size("velum_known")) + F.octet_length(F.array_join("velum_new", "")) + F.octet_length(F.array_join("velum_known", ""))
    if (new.agg(F.sum(weight).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES:
        joined = marked.join(F.broadcast(new), rows, "left")
    else:
        # Only texts that may hold an entity are shuffled.
        some = likely(F.col(text))
        joined = marked.filter(some).join(new, rows, "left").unionByName(marked.filter(~some), allowMissingColumns=True)
    parts = F.zip_with(F.split(F.col(text), _pattern(F.col("velum_known"))), F.col("velum_new"), lambda gap, n: F.concat(gap, F.coalesce(n, F.lit(""))))
    return joined.withColumn(text, F.when(F.col("velum_new").isNotNull(), F.array_join(parts, "")).otherwise(F.col(text))).select(
        *docs.columns, F.coalesce(F.when(F.col("velum_new").isNotNull(), F.size("velum_new")), F.lit(0)).cast("long").alias("velum_replaced")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("velum_replaced").alias("n_replaced"), "text")
