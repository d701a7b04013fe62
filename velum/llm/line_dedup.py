"""Site-relative line frequency (built-in functions only).

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it divided by
the number of the host's pages; lines above ``MAX_RATIO`` on at least ``MIN_PAGES`` pages are boilerplate
and go from every page of that host. The counts cover every page and line.

Scale: a page sends one 64-bit number per distinct line, combined before the shuffle, so a line on a third
of all pages costs one row per task. A host keeps fewer than (mean distinct lines per page) / MAX_RATIO
boilerplate lines, so each host's array is small; all arrays together are broadcast only when their counted
number is below ``BROADCAST_LINES``. Beyond it they are joined by (host, salt), which splits a hot host.

Each row is a page, so a document copied on more than ``MAX_RATIO`` of a host's pages loses all its lines on every
page. The pipeline's stage, after which one copy should stay, counts a line and a host's pages over its distinct texts.

Defined cases: a null host is a host of its own; a null text stays null; lines without a word are never
dropped; repeated rows count as pages each; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import materialise, string, table
from velum.llm.quality_rules import distinct_texts

MAX_RATIO = 0.1
MIN_PAGES = 5
#: Boilerplate lines (8 bytes each) up to which they are broadcast.
BROADCAST_LINES = 1_000_000
SALTS = 64
_WORD = "[^ \\t-\\r]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _host(host: Column) -> Column:
    return F.coalesce(host.cast("string"), F.lit("\x01null"))


def _marked(text: Column) -> Column:
    """The hashes of the lines that have a word."""
    return F.transform(F.filter(_lines(text), lambda x: x.rlike(_WORD)), lambda x: F.xxhash64(x))


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines, for hosts that have any; without ``copies`` equal texts of a host are one page."""
    pages = docs.select(_host(host).alias("h"), text.alias("t"))
    if not copies:
        pages = distinct_texts(pages, "h", "t")
    totals = pages.groupBy("h").agg(F.count(F.lit(1)).alias("total"))
    # The number of hosts' totals isn't bounded; Spark picks this join's kind from the sizes it measures.
    seen = pages.select("h", F.explode(F.array_distinct(_marked(F.col("t")))).alias("line")).groupBy("h", "line").agg(F.count(F.lit(1)).alias("n"))
    return (
        seen.filter(F.col("n") >= min_pages)
        .join(totals, "h")
        .filter(F.col("n") > max_ratio * F.col("total"))
        .groupBy("h")
        .agg(F.collect_list("line").alias("lines"))
    )


def clean(docs: DataFrame, host: Column, text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """``docs`` with ``text`` lacking its host's boilerplate lines, and ``velum_dropped``: the number of lines that went."""
    found = materialise(boilerplate(docs, host, F.col(text), max_ratio, min_pages, copies), "boilerplate")
    size = found.agg(F.sum(F.size("lines")).alias("n")).first()["n"] or 0
    pages = docs.withColumn("velum_h", _host(host))
    if size <= BROADCAST_LINES:
        marked = pages.join(F.broadcast(found.select(F.col("h").alias("velum_h"), F.col("lines").alias("velum_lines"))), "velum_h", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        marked = pages.withColumn("velum_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(
            found.select(F.col("h").alias("velum_h"), F.col("lines").alias("velum_lines"), salts.alias("velum_salt")), ["velum_h", "velum_salt"], "left"
        )
    lines = _lines(F.col(text))
    # Hash-based: the page's own boilerplate, of which there is little or none, out of its host's.
    own = F.array_intersect(_marked(F.col(text)), F.col("velum_lines"))
    kept = F.filter(lines, lambda x: ~(F.array_contains(F.col("velum_own"), F.xxhash64(x)) & x.rlike(_WORD)))
    some = F.size("velum_own") > 0
    return (
        marked.withColumn("velum_own", F.when(F.col("velum_lines").isNotNull(), own))
        .withColumn("velum_kept", F.when(some, kept))
        .withColumn("velum_dropped", F.when(some, F.coalesce(F.size(lines) - F.size("velum_kept"), F.lit(0))).otherwise(0).cast("long"))
        .withColumn(text, F.when(F.col("velum_dropped") > 0, F.array_join("velum_kept", "\n")).otherwise(F.col(text)))
        .select(*[c for c in docs.columns], "velum_dropped")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.size(_lines(string("text"))).cast("long").alias("n_lines"))
    out = clean(docs, F.col("source"))
    return out.select("doc_id", "source", "n_lines", F.col("velum_dropped").alias("n_dropped"), "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their sources' boilerplate lines, counted over distinct texts; n_chars follows the text."""
    return clean(docs, F.col("source"), copies=False).drop("velum_dropped").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


ORACLE = f"""
WITH pages AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(source, chr(1) || 'null') AS h, text, string_split(text, chr(10)) AS ls FROM documents),
totals AS (SELECT h, count(*) AS total FROM pages GROUP BY h),
seen AS (SELECT h, line, count(*) AS n FROM (SELECT h, unnest(list_distinct(ls)) AS line FROM pages)
  WHERE regexp_matches(line, '[^ \\t\\n\\v\\f\\r]') GROUP BY h, line),
bad AS (SELECT h, list(line) AS drops FROM seen JOIN totals USING (h) WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * total GROUP BY h),
kept AS (SELECT p.*, CASE WHEN drops IS NULL OR ls IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(drops, x)) END AS ks FROM pages p LEFT JOIN bad USING (h))
SELECT doc_id, source, coalesce(len(ls), 1)::BIGINT AS n_lines, coalesce(len(ls) - len(ks), 0)::BIGINT AS n_dropped,
  CASE WHEN ls IS NULL THEN NULL ELSE array_to_string(ks, chr(10)) END AS text FROM kept
"""
