"""Classification of a snippet that a reviewer marked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velum import fixed_values as V
from velum.functions.text import contains_any, fold, trim
from velum.operators.detect import rule_layer


def classify(snippet: Column, tagger: Column | None = None) -> Column:
    """The type of a snippet: blank is a name; a rule that covers most of it decides; then hints; then a tagger's type; else a name.

    tagger: a column with the type that an outside tagger gives, or null. Of equally long matches the first in place decides.
    """
    body = trim(snippet)
    longest = F.array_sort(rule_layer(body), lambda a, b: F.when(F.length(a["value"]) != F.length(b["value"]), F.length(b["value"]) - F.length(a["value"])).otherwise(a["start"] - b["start"]))
    best = F.try_element_at(longest, F.lit(1))
    plain = fold(body)
    known = tagger if tagger is not None else F.lit(None).cast("string")
    return (
        F.when(F.coalesce(body, F.lit("")) == "", "name")
        .when(F.length(best["value"]) >= V.CLASSIFY_SHARE * F.length(body), best["type"])
        .when(contains_any(plain, V.ADDRESS_HINTS), "address")
        .when(contains_any(plain, V.LICENCE_HINTS), "cedula")
        .when(contains_any(plain, V.ORGANIZATION_HINTS), "organization")
        .when(contains_any(plain, V.IDENTIFIER_HINTS), "identifier")
        .when(known.isin("address", "organization", "name"), known)
        .otherwise("name")
    )


def classify_with(model_type: Column, snippet: Column) -> Column:
    """A model's answer if it is one of the types, else the deterministic one."""
    return F.when(model_type.isin([t for t, _, _ in V.TYPES]), model_type).otherwise(classify(snippet))
