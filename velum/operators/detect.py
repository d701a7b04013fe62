"""Detection: rules and an optional model layer give findings, findings give candidates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum import fixed_values as V
from velum.functions import spans as S
from velum.functions.filters import should_keep
from velum.functions.text import contains_any, normalise, trim
from velum.rules import RULES, Rule


def all_spans(text: Column, rules: Iterable[Rule] = RULES) -> Column:
    """array<span> of the rules over the whole text, rule after rule. The value is trimmed, the place isn't.

    Each rule whose trigger the text has marks its matches in a copy of it; places are then counted in the same way for all.
    """

    def one(t: Column, r: Rule) -> Column:
        marks = S.marked(t, r.pattern, r.group)
        return F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.type).alias("type"), F.lit(r.group).alias("group"), (F.when(t.rlike(r.trigger), marks) if r.trigger else marks).alias("marks"))

    def span(r: Column, m: Column) -> Column:
        return F.struct(r["type"].alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), r["rule_id"].alias("rule_id"), F.lit("rule").alias("source"))

    rows = lambda t: F.filter(F.array(*[one(t, r) for r in sorted(rules)]), lambda r: r["marks"].isNotNull())
    every = S.once(S.plain(text), lambda t: F.flatten(F.transform(rows(t), lambda r: F.transform(S.places(r["marks"], r["group"]), lambda m: span(r, m)))))
    return F.transform(S.own_values(text, every), lambda x: x.withField("value", trim(x["value"])))


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<span> of one rule."""
    return all_spans(text, [rule])


def rule_layer(text: Column, rules: Iterable[Rule] = RULES) -> Column:
    """array<span> of all rules: rejected values claim nothing, then earlier rules (and places) claim text first; in order of place."""
    return S.by_start(S.claim(F.filter(all_spans(text, rules), lambda x: should_keep(x["value"], x["type"]))))


def likely(text: Column, rules: Iterable[Rule] = RULES) -> Column:
    """Whether any rule's trigger is in the text: two scans in place of one per rule, for the many texts that hold nothing."""
    rules = list(rules)
    words = [r.trigger[5:] for r in rules if r.trigger.startswith("(?iu)")]
    signs = sorted({r.trigger for r in rules} - {f"(?iu){w}" for w in words})
    low = F.translate(F.lower(text), "ſ", "s")  # in an array, so that it is made once for all words
    named = F.exists(F.array(low), lambda x: contains_any(x, words)) if words else F.lit(False)
    return F.coalesce(text.rlike("|".join(signs)) | named if signs else named, F.lit(False))


def _built(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(likely, layer) of a named text column: they are large expressions, so they are made once and kept as long as the Spark context."""
    kept = vars(docs.sparkSession.sparkContext).setdefault("_velum_columns", {})
    if (text, rules) not in kept:
        kept[text, rules] = likely(F.col(text), rules), rule_layer(F.col(text), rules)
    return kept[text, rules]


def spans_of(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text") -> tuple[Column, Column]:
    """(maybe, spans) over the columns of ``docs``: whether a text can hold anything, and array<span> of what it holds."""
    return _built(docs, text, tuple(rules))


def findings(docs: DataFrame, rules: Iterable[Rule] = RULES, model: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, type, start, end, value, rule_id, source): one row per finding.

    model: (key, spans) of the model layer, merged into the rules' spans. Null texts have no findings.
    """
    maybe, layer = _built(docs, text, tuple(rules))
    if model is None:
        found = docs.select(key, text).filter(maybe).withColumn("spans", layer)
    else:
        found = docs.select(key, text).withColumn("spans", F.when(maybe, layer).otherwise(F.array().cast(f"array<{S.SPAN}>")))
    if model is not None:
        found = found.join(model.select(key, F.col("spans").alias("more")), key, "left").withColumn("spans", S.by_start(S.merge(F.col("spans"), F.coalesce("more", F.array().cast(f"array<{S.SPAN}>")))))
    # The outer form keeps Spark from testing the size of the spans first, which would make them twice.
    return found.select(key, F.explode_outer("spans").alias("s")).filter("s is not null").select(key, "s.*")


def candidates(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cand_id, ordinal, original_text, type, norm, is_selected): the first finding of each type and normal form, in order of place.

    Windows are within one document, whose findings are few against the table.
    """
    norm = normalise(F.col("value"))
    first = W.partitionBy(key, "type", "norm").orderBy("start", "end", "rule_id")
    place = W.partitionBy(key).orderBy("start", "end", "rule_id", "type")
    return (
        found.withColumn("norm", norm)
        .filter((F.length("norm") >= V.MIN_CANDIDATE) & should_keep(F.col("value"), F.col("type")))
        .withColumn("n", F.row_number().over(first))
        .filter("n = 1")
        .withColumn("ordinal", F.row_number().over(place))
        .select(
            key,
            F.sha2(F.concat_ws("|", F.col(key).cast("string"), "type", "norm"), 256).alias("cand_id"),
            "ordinal",
            F.col("value").alias("original_text"),
            "type",
            "norm",
            F.lit(True).alias("is_selected"),
        )
    )


def row_candidates(spans: Column) -> Column:
    """:func:`candidates` of one document's spans: array<struct<ordinal,original_text,type,norm>>, in order of place.

    Spans are sorted by type and normal form, where the first of each run stays, and back by place.
    """
    item = lambda s: F.struct(s["type"].alias("type"), normalise(s["value"]).alias("norm"), s["start"].alias("start"), s["end"].alias("end"), s["rule_id"].alias("rule_id"), s["value"].alias("value"))
    good = F.filter(spans, lambda s: should_keep(s["value"], s["type"]))
    keyed = F.array_sort(F.filter(F.transform(good, item), lambda x: F.length(x["norm"]) >= V.MIN_CANDIDATE))

    def firsts(k: Column) -> Column:
        before = lambda i: F.element_at(k, i)  # noqa: E731  i counts from 0, places from 1
        new = lambda x, i: F.when(i == 0, True).otherwise((before(F.greatest(i, F.lit(1)))["type"] != x["type"]) | (before(F.greatest(i, F.lit(1)))["norm"] != x["norm"]))
        return F.filter(k, new)

    place = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rule_id"].alias("rule_id"), x["type"].alias("type"), x["norm"].alias("norm"), x["value"].alias("value"))
    placed = F.array_sort(F.transform(S.once(keyed, firsts), place))
    return F.transform(placed, lambda x, i: F.struct((i + 1).alias("ordinal"), x["value"].alias("original_text"), x["type"].alias("type"), x["norm"].alias("norm")))


def findings_by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower("value")).alias("n_values"))


def with_names(found: DataFrame) -> DataFrame:
    """Findings with their type's display name and tag label."""
    names = F.create_map(*[F.lit(x) for a, b, _ in V.TYPES for x in (a, b)])
    return found.withColumn("display_name", names[F.col("type")]).withColumn("tag_label", tag_label(F.col("type")))


def tag_label(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _, label in V.TYPES:
        out = F.when(kind == name, label).otherwise(out)
    return out
