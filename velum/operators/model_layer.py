"""The contextual layer: chunks for an outside model, its answers located in the text, a tagger's spans added.

The model itself is a parameter; none is built in. Everything around it is deterministic.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum import fixed_values as V
from velum.functions import spans as S
from velum.functions.filters import should_keep
from velum.functions.needles import by_slices, locate_all
from velum.functions.text import normalise, trim

#: A model gets instructions and a chunk, and returns {field: list of strings} for the fields of MODEL_FIELDS.
Model = Callable[[str, str], dict[str, list[str]]]
#: Calls past their time that a task lets run on; then it waits for one of them to end.
MAX_LATE = 4
ANSWER = ", ".join(f"{f} array<string>" for f, _, _ in V.MODEL_FIELDS)
_ASKED = pa.struct([("ok", pa.bool_()), *((f, pa.list_(pa.string())) for f, _, _ in V.MODEL_FIELDS)])
_SOLID = regex.compile(r"\P{White_Space}")


#: What a generative model is asked, unless the caller asks otherwise.
INSTRUCTIONS = (
    "Lee el fragmento de un documento legal y copia, tal como aparecen, los datos que identifican a las partes: personas, empresas, domicilios completos, "
    "teléfonos, correos, cédulas profesionales y otros identificadores. No inventes ni corrijas nada; deja vacía la lista de la que no haya datos. "
    "No incluyas autoridades, leyes, fechas sueltas ni importes."
)


def cut_points(text: str) -> list[tuple[int, int]]:
    """(start, end) of each chunk: CHUNK characters at most, ending after the window's last line break if it has one beyond its start, the next
    beginning CHUNK_OVERLAP before that, but always after the last start."""
    if len(text) <= V.CHUNK:
        return [(0, len(text))]
    out, at = [], 0
    while at < len(text):
        end = min(at + V.CHUNK, len(text))
        if end < len(text) and (line := text.rfind("\n", at, end)) > at:
            end = line + 1
        out.append((at, end))
        if end == len(text):
            break
        back = end - V.CHUNK_OVERLAP
        at = back if back > at else end
    return out


_CHUNKS = pa.list_(pa.struct([("chunk_idx", pa.int32()), ("start", pa.int32()), ("chunk", pa.string())]))


def cut_all(texts: pa.Array) -> pa.Array:
    """Each text's chunks, as array<struct<chunk_idx,start,chunk>>."""
    return by_slices([texts], lambda t: t if t is None else [(i, a, t[a:b]) for i, (a, b) in enumerate(cut_points(t))], _CHUNKS)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_idx, start, chunk) of every document with text."""

    @F.arrow_udf("array<struct<chunk_idx:int,start:int,chunk:string>>")
    def cut(texts: pa.Array) -> pa.Array:
        return cut_all(texts)

    # Ends at the first sign that isn't white space, as Spark may do it before texts are dealt, where few tasks have them all.
    some = docs.filter(F.coalesce(F.col(text).rlike("(?U)\\S"), F.lit(False)))
    return some.select(key, F.explode(cut(F.col(text))).alias("c")).select(key, "c.*")


@contextlib.contextmanager
def _asking(model: Model, timeout: float, instructions: str) -> Iterator[Callable[[str], tuple]]:
    """Asks the model about a chunk: (ok, each field's list); an error or timeout gives none, and is no failure of the job."""
    pool, late = ThreadPoolExecutor(MAX_LATE + 1), set()

    def ask(chunk: str) -> tuple:
        nonlocal late
        late = {call for call in late if not call.done()}
        if len(late) >= MAX_LATE:
            late = wait(late, return_when=FIRST_COMPLETED).not_done
        call = pool.submit(model, instructions, chunk)
        try:
            answer, ok = call.result(timeout), True
        except Exception:  # the model's own errors, of any kind, and timeouts
            answer, ok = {}, False
            late.add(call)
        return ok, *([str(x) for x in answer.get(f, [])] for f, _, _ in V.MODEL_FIELDS)

    try:
        yield ask
    finally:
        pool.shutdown(wait=False)


def generate(parts: DataFrame, model: Model, key: str = "doc_id", timeout: float = V.MODEL_TIMEOUT_S, instructions: str = INSTRUCTIONS) -> DataFrame:
    """(key, chunk_idx, ok, fields): the model's answer to each chunk."""
    schema = f"`{key}` {dict(parts.dtypes)[key]}, chunk_idx int, ok boolean, {ANSWER}"
    names = [key, "chunk_idx", *(f.name for f in _ASKED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _asking(model, timeout, instructions) as ask:
            for batch in batches:
                answers = by_slices([batch.column(2)], ask, _ASKED)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *answers.flatten()], names=names)

    return parts.select(key, "chunk_idx", "chunk").mapInArrow(run, schema)


def answered(rows: DataFrame, model: Model, text: str = "text", timeout: float = V.MODEL_TIMEOUT_S, instructions: str = INSTRUCTIONS) -> DataFrame:
    """Rows with the model's answers to their text's chunks, in order, as ``answers``: what :func:`chunks` and :func:`generate` make, in the text's own
    row. A task asks about its texts one chunk after another either way, so nothing is shuffled or joined to have them together again."""
    at = rows.columns.index(text)
    kind = pa.list_(pa.struct([("chunk_idx", pa.int32()), *_ASKED]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _asking(model, timeout, instructions) as ask:
            every = lambda t: [(i, *ask(t[a:b])) for i, (a, b) in enumerate(cut_points(t))] if t and _SOLID.search(t) else []
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, by_slices([batch.column(at)], every, kind)], names=[*batch.schema.names, "answers"])

    out = T.StructType([*rows.schema, T.StructField("answers", T.ArrayType(T.StructType.fromDDL(f"chunk_idx int, ok boolean, {ANSWER}")))])
    return rows.mapInArrow(run, out)


def generate_once(parts: DataFrame, model: Model, path: str, key: str = "doc_id", timeout: float = V.MODEL_TIMEOUT_S, instructions: str = INSTRUCTIONS) -> DataFrame:
    """:func:`generate` with answers kept by content in a Parquet folder: a chunk is asked once for given instructions, however many documents
    have it and however often they come; failures aren't kept, so they are asked again the next time.

    The folder grows by one part a call. What is new is asked when this is called, the result is lazy.
    """
    spark = parts.sparkSession
    fields = [f for f, _, _ in V.MODEL_FIELDS]
    schema = f"chunk_hash string, {ANSWER}"
    hashed = parts.withColumn("chunk_hash", F.sha2(F.concat_ws("\0", F.lit(instructions), "chunk"), 256))
    known = lambda: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)  # the folder is there from now on
    fresh = hashed.select("chunk_hash", "chunk", F.lit(0).alias("chunk_idx")).join(known().select("chunk_hash"), "chunk_hash", "left_anti").dropDuplicates(["chunk_hash"])
    generate(fresh, model, "chunk_hash", timeout, instructions).filter("ok").select("chunk_hash", *fields).write.mode("append").parquet(path)
    # Two calls at once may both keep an answer; one of them counts.
    answers = known().groupBy("chunk_hash").agg(F.min(F.struct(*fields)).alias("a"))
    joined = hashed.join(answers, "chunk_hash", "left")
    empty = F.array().cast("array<string>")
    return joined.select(key, "chunk_idx", F.col("a").isNotNull().alias("ok"), *[F.coalesce(F.col(f"a.{f}"), empty).alias(f) for f in fields])


def _lists(answers: Column) -> list[Column]:
    """The fields' lists over answers in order of chunks, each chunk's cut to the field's most."""
    cut = lambda f, n: lambda x: F.slice(F.coalesce(x[f], F.array().cast("array<string>")), 1, n)
    return [F.flatten(F.transform(answers, cut(f, n))).alias(f) for f, _, n in V.MODEL_FIELDS]


def gather(answers: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fields): each document's lists over its chunks in order, each chunk's cut to the field's most; none if every chunk failed."""
    of_chunks = F.collect_list(F.struct("chunk_idx", *[f for f, _, _ in V.MODEL_FIELDS]))
    return answers.filter("ok").groupBy(key).agg(F.sort_array(of_chunks).alias("answers")).select(key, *_lists(F.col("answers")))


def _wanted(values: Column, kind: str, rank: int) -> Column:
    """What is looked for of a list's values: the first of each normal form, as array<struct<type,rule_id,value>>."""
    keyed = F.filter(F.transform(values, lambda v, i: F.struct(normalise(v).alias("n"), i.alias("i"), trim(v).alias("v"))), lambda x: F.length(x["n"]) >= V.MIN_MODEL_VALUE)
    # Sorted, so equal forms are neighbours: a long text's answers aren't compared each with each.
    firsts = S.once(F.array_sort(keyed), lambda k: F.filter(k, lambda x, j: (j == 0) | (F.try_element_at(k, F.greatest(j, F.lit(1)))["n"] != x["n"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: F.struct(F.lit(kind).alias("type"), F.lit(1000 + rank).alias("rule_id"), x["v"].alias("value")))


def _with_spans(rows: DataFrame, text: str) -> DataFrame:
    """Rows of a text and the fields' lists, with ``spans`` in place of the lists."""
    none, fields = F.array().cast(f"array<{S.SPAN}>"), [f for f, _, _ in V.MODEL_FIELDS]
    wanted = F.concat(*[_wanted(F.coalesce(F.col(f), F.array().cast("array<string>")), kind, i) for i, (f, kind, _) in enumerate(V.MODEL_FIELDS)])
    some = rows.select(*[c for c in rows.columns if c not in fields], wanted.alias("wanted"))
    located = some.withColumn("found", locate_all(F.when(F.size("wanted") > 0, F.col(text)), F.transform("wanted", lambda w: w["value"])))

    def span(w: Column, m: Column) -> Column:
        value = S.cut(F.col(text), m["start"], m["end"]).alias("value")
        return F.struct(w["type"].alias("type"), m["start"].alias("start"), m["end"].alias("end"), value, w["rule_id"].alias("rule_id"), F.lit("model").alias("source"))

    every = F.coalesce(F.flatten(F.zip_with("wanted", "found", lambda w, places: F.transform(places, lambda m: span(w, m)))), none)
    return located.withColumn("spans", S.by_start(S.drop_contained(F.filter(every, lambda x: should_keep(x["value"], x["type"]))))).drop("wanted", "found")


def answer_spans(docs: DataFrame, answers: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): what the gathered answers name, where it stands in the text (filtered by what stands there), without spans inside longer
    ones of their type. One scan of a text finds all its values."""
    return _with_spans(docs.select(key, text).join(answers, key), text).select(key, "spans")


def supplement(spans: Column, tagger: Column) -> Column:
    """A tagger's person and company spans added where they overlap nothing accepted; in order of place."""
    good = F.filter(tagger, lambda x: x["type"].isin("name", "organization") & (F.length(trim(x["value"])) >= V.MIN_MODEL_VALUE) & should_keep(x["value"], x["type"]))
    return S.by_start(S.claim(good, spans))


def contextual(docs: DataFrame, model: Model | None = None, tagger: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) for :func:`velum.operators.detect.findings`: the model's spans supplemented by the tagger's (key, spans); the tagger's alone
    for documents of which the model answered nothing."""
    empty = F.array().cast(f"array<{S.SPAN}>")
    rows = docs.select(key, text)
    # Merged, as Spark would judge by the files that texts and spans were made of, and send all of a side to each task.
    rows = rows.join(tagger.select(key, F.col("spans").alias("tagged")).hint("merge"), key, "left") if tagger is not None else rows.withColumn("tagged", empty)
    if model:
        asked = answered(rows, model, text).withColumn("answers", F.filter("answers", lambda a: a["ok"]))
        rows = _with_spans(asked.select(*rows.columns, *_lists(F.col("answers"))), text)
    else:
        rows = rows.withColumn("spans", empty)
    return rows.select(key, supplement(F.coalesce("spans", empty), F.coalesce("tagged", empty)).alias("spans"))
