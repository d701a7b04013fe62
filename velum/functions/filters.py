"""The candidate filter: is a value worth keeping as its type? One boolean column, no user function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from velum import fixed_values as V
from velum.functions.spans import once
from velum.functions.text import contains_any, listed, normalise

_BASE = [*V.STOPWORDS, *V.MONTHS, *V.LEGAL_TERMS]


def _keep_name(norm: Column, parts: Column) -> Column:
    court = reduce(lambda a, b: a | b, [norm.startswith(p) for p in V.COURT_PREFIXES])
    return (
        (F.size(parts) >= 2)
        & ~F.exists(parts, lambda t: listed(t, [*V.MONTHS, *V.LEGAL_TERMS]))
        & ~court
        & ~norm.contains("juez de lo")
        & ~(norm.contains("juez") & norm.contains("en turno"))
    )


def _keep_organization(norm: Column, parts: Column) -> Column:
    known = F.forall(parts, lambda t: listed(t, [*_BASE, *V.COMMON_NOUNS]))
    return contains_any(norm, V.COMPANY_FORMS) | (~known & ((F.size(parts) > 1) | (F.length(norm) >= V.MIN_SINGLE_ORGANIZATION)))


def _keep_identifier(norm: Column, parts: Column) -> Column:
    short = (F.size(parts) == 1) & (F.length(norm) < V.MIN_SINGLE_IDENTIFIER)
    return ~short & ~norm.rlike("^(?:19|20)\\d{2}$") & (norm.rlike("(?U)\\d") | (F.length(norm) >= V.MIN_PLAIN_IDENTIFIER))


def should_keep(value: Column, kind: Column) -> Column:
    """False for null or blank values and for values made of listed words alone; else by the type's own test."""

    def test(norm: Column) -> Column:
        parts = F.split(norm, " ")
        own = (
            F.when(kind == "name", _keep_name(norm, parts))
            .when(kind == "organization", _keep_organization(norm, parts))
            .when(kind == "identifier", _keep_identifier(norm, parts))
            .when(kind == "address", (F.length(norm) >= V.MIN_ADDRESS) & ~listed(norm, V.BARE_PLACES))
            .otherwise(F.length(norm) >= V.MIN_OTHER)
        )
        return (norm != "") & ~F.forall(parts, lambda t: listed(t, _BASE)) & own

    # The normal form is used in many places, so it is made once.
    return F.coalesce(once(normalise(value), test), F.lit(False))
