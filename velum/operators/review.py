"""Reviewers' edits on candidate rows, as joins with tables of edits and additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum import fixed_values as V
from velum.functions import spans as S
from velum.functions.needles import locate_all
from velum.functions.text import normalise, trim
from velum.operators.classify import classify
from velum.operators.redact import locate

NEW = "array<struct<norm:string,snippet:string,exact:string,at:int>>"


def counts(cands: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_selected, n_total, label)."""
    n = cands.groupBy(key).agg(F.count_if("is_selected").alias("n_selected"), F.count(F.lit(1)).alias("n_total"))
    return n.withColumn("label", F.format_string("%d de %d", "n_selected", "n_total"))


def select_all(cands: DataFrame, selected: bool) -> DataFrame:
    return cands.withColumn("is_selected", F.lit(selected))


def apply_edits(cands: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Toggle and retype: edits (key, cand_id, type?, is_selected?); null leaves a field, unknown types are not taken."""
    e = edits.select(key, "cand_id", F.when(F.col("type").isin([t for t, _, _ in V.TYPES]), F.col("type")).alias("new_type"), F.col("is_selected").alias("new_selected"))
    joined = cands.join(e, [key, "cand_id"], "left")
    return joined.withColumn("type", F.coalesce("new_type", "type")).withColumn("is_selected", F.coalesce("new_selected", "is_selected")).select(*cands.columns)


def redactable(snippet: Column) -> Column:
    """Two characters at least, and not itself a tag: any label of capitals counts, with a number or a dash."""
    body = trim(snippet)
    return F.coalesce((F.length(body) >= V.MIN_REDACTABLE) & ~body.rlike("^\\[[A-Z]+ (?:\\p{Nd}+|-)\\]$"), F.lit(False))


def can_redact(text: Column, snippet: Column) -> Column:
    return redactable(snippet) & (F.size(locate(text, snippet)) > 0)


def first_range(text: Column, needle: Column) -> Column:
    """struct(start, end) of the first occurrence; null if there is none."""
    return F.try_element_at(locate(text, needle), F.lit(1))


def add(docs: DataFrame, cands: DataFrame, additions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidates after manual additions (key, snippet).

    The candidate is what stands in the text where the snippet is first found. If one of its normal form is there already, of any type, the
    first such in the list is just selected. Others get a type guessed from the snippet and a place in the list before the first candidate
    that occurs later in the text, else at the end. Snippets that can't be redacted, and repeats, change nothing.
    """
    snippets = additions.select(key, trim(F.col("snippet")).alias("snippet")).filter(redactable(F.col("snippet")))
    wanted = snippets.groupBy(key).agg(F.collect_set("snippet").alias("wanted"))
    # Candidates come in once, as one array a document, so what finds them runs once; one scan of a text finds its snippets and candidates.
    listed = cands.groupBy(key).agg(F.collect_list(F.struct("cand_id", "ordinal", "original_text", "type", "norm", "is_selected")).alias("cands"))
    every = docs.select(key, text).join(listed, key, "left").join(wanted, key, "left").filter("cands is not null or wanted is not null")
    none = F.array().cast(dict(listed.dtypes)["cands"])
    every = every.withColumn("cands", F.coalesce("cands", none)).withColumn("wanted", F.coalesce("wanted", F.array().cast("array<string>")))
    some = F.size("wanted") > 0
    found = every.withColumn("found", locate_all(F.when(some, F.col(text)), F.when(some, F.concat("wanted", F.transform("cands", lambda c: c["original_text"])))))
    first = lambda i: F.try_element_at(F.try_element_at(F.col("found"), i), F.lit(1))  # noqa: E731  i counts from 1
    at = F.transform("wanted", lambda s, i: F.struct(s.alias("snippet"), first(i + 1).alias("r")))
    exact = F.transform(F.filter(at, lambda x: x["r"].isNotNull()), lambda x: F.struct(x["snippet"].alias("snippet"), S.cut(F.col(text), x["r"]["start"], x["r"]["end"]).alias("exact"), x["r"]["start"].alias("at")))
    found = found.withColumn("exact", F.when(some, exact)).withColumn("places", F.transform("cands", lambda c, i: F.when(some, first(F.size("wanted") + i + 1)["start"])))
    # Of what has one normal form the least counts.
    normed = found.withColumn("new", F.array_sort(F.transform("exact", lambda x: F.struct(normalise(x["exact"]).alias("norm"), x["snippet"].alias("snippet"), x["exact"].alias("exact"), x["at"].alias("at")))))
    firsts = F.filter("new", lambda x, i: F.when(i == 0, True).otherwise(F.try_element_at(F.col("new"), F.greatest(i, F.lit(1)))["norm"] != x["norm"]))
    normed = normed.withColumn("new", F.coalesce(firsts, F.array().cast(NEW)))
    hit = lambda c: F.exists("new", lambda x: x["norm"] == c["norm"]) & ~F.exists("cands", lambda o: (o["norm"] == c["norm"]) & (o["ordinal"] < c["ordinal"]))
    before = lambda x: F.array_min(F.transform(F.filter(F.arrays_zip("cands", "places"), lambda z: z["places"] > x["at"]), lambda z: z["cands"]["ordinal"]))
    last = F.coalesce(F.array_max(F.transform("cands", lambda c: c["ordinal"])), F.lit(0))

    def row(rank: Column, at: Column, norm: Column, c: Column | None = None, x: Column | None = None) -> Column:
        own = lambda name, kind: F.lit(None).cast(kind) if c is None else c[name]
        text_of = c["original_text"] if x is None else x["exact"]
        selected = F.lit(True) if c is None else c["is_selected"] | hit(c)
        snippet = F.lit(None).cast("string") if x is None else x["snippet"]
        return F.struct(
            rank.alias("rank"), at.alias("at"), norm.alias("norm"), own("cand_id", "string").alias("cand_id"), text_of.alias("original_text"), own("type", "string").alias("type"), selected.alias("is_selected"), snippet.alias("snippet")
        )

    old = F.transform(F.arrays_zip("cands", "places"), lambda z: row(z["cands"]["ordinal"].cast("double"), z["places"], z["cands"]["norm"], c=z["cands"]))
    fresh = F.filter("new", lambda x: ~F.exists("cands", lambda c: c["norm"] == x["norm"]))
    added = F.transform(fresh, lambda x: row(F.coalesce(before(x) - 0.5, last + 1.0).cast("double"), x["at"], x["norm"], x=x))
    rows = normed.select(key, F.posexplode(F.array_sort(F.concat(old, added))).alias("i", "r")).select(key, (F.col("i") + 1).alias("ordinal"), "r.*")
    manual = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit("manual"), "norm"), 256)
    fresh_row = F.col("snippet").isNotNull()
    return (
        rows.withColumn("cand_id", F.when(fresh_row, manual).otherwise(F.col("cand_id")))
        .withColumn("type", F.when(fresh_row, classify(F.col("snippet"))).otherwise(F.col("type")))
        .select(*cands.columns)
    )


def refine(guess: Column, current: Column, refined: Column) -> Column:
    """A later classification counts only where the reviewer hasn't changed the guessed type."""
    return F.when((current == guess) & refined.isNotNull(), refined).otherwise(current)


def focus_needle(original: Column, tag: Column, selected: Column) -> Column:
    """What to highlight in the redacted text: the tag of a selected candidate, else its text."""
    return F.when(selected, tag).otherwise(original)
