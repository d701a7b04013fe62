"""The document history: fingerprints, duplicate lookup, upsert, delete, search and order, all on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum import fixed_values as V
from velum.functions.text import trim

#: Characters of a gram of the search index.
GRAM = 3
SUMMARY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("candidate_count", T.IntegerType()),
        T.StructField("search_preview", T.StringType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("summary", SUMMARY),
        T.StructField("original_text", T.StringType()),
        T.StructField(
            "candidates",
            T.ArrayType(
                T.StructType(
                    [T.StructField("cand_id", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("original_text", T.StringType()), T.StructField("type", T.StringType()), T.StructField("is_selected", T.BooleanType())]
                )
            ),
        ),
    ]
)


def fingerprint(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def search_preview(file_name: Column, text: Column) -> Column:
    return F.concat(F.lower(file_name), F.lit("\n"), F.lower(F.substring(text, 1, V.PREVIEW)))


def file_kind(file_name: Column) -> Column:
    ext = F.lower(F.regexp_extract(file_name, "\\.([^./\\\\]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("doc", "docx"), "word").otherwise("text")


def duplicates(files: DataFrame, history: DataFrame) -> DataFrame:
    """Incoming files (with file_hash) that are known: with the latest summary of equal hash, as existing_*."""
    # The summary of least (age, id) by an aggregate, which is partly done before the shuffle: many files may have one hash (empty ones).
    age = -F.unix_micros(F.col("updated_at").cast("timestamp"))
    first = history.groupBy("file_hash").agg(F.min(F.struct(F.coalesce(age, F.lit(2**62)).alias("age"), "id", "file_name")).alias("x"))
    return files.join(first.select("file_hash", F.col("x.id").alias("existing_id"), F.col("x.file_name").alias("existing_name")), "file_hash")


def unseen(files: DataFrame, history: DataFrame) -> DataFrame:
    """Incoming files that no summary knows: a cheap anti join before any text is extracted."""
    return files.join(history.select("file_hash"), "file_hash", "left_anti")


def upsert(history: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace or append by id; a replaced row keeps its processed_at. Of changes with one id the latest counts."""
    last = changes.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("file_hash")))).filter("n = 1").drop("n")
    old = history.select("id", F.col("processed_at").alias("old_processed"))
    fresh = last.join(old, "id", "left").withColumn("processed_at", F.coalesce("old_processed", "processed_at")).select(*history.columns)
    return history.join(changes.select("id"), "id", "left_anti").select(*history.columns).unionByName(fresh)


def delete(history: DataFrame, ids: DataFrame) -> DataFrame:
    return history.join(ids.select("id"), "id", "left_anti").select(*history.columns)


def ordered(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("updated_at"), "id")


def search(history: DataFrame, query: str) -> DataFrame:
    """Rows whose file name or preview contains the trimmed query in lower case; a blank query finds all."""
    q = F.lower(trim(F.lit(query)))
    return history.filter((q == "") | F.lower("file_name").contains(q) | F.col("search_preview").contains(q))


def grams(text: Column) -> Column:
    """array<string>: the different runs of GRAM characters of a text; none if it is shorter."""
    # One scan looks ahead from each character; substrings would count from the text's start each time.
    every = F.regexp_extract_all(text, F.lit("(?s)(?=(%s))." % ("." * GRAM)), F.lit(1))
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def query_grams(query: str) -> list[str]:
    q = query.strip().lower()
    return sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})


def searched(history: DataFrame) -> Column:
    """What :func:`search` looks at, in one text."""
    return F.concat_ws("\n", F.lower("file_name"), "search_preview")


def postings(history: DataFrame, place: str = "id") -> DataFrame:
    """(gram, place): the inverted index of what is searched; each gram with the ids, or other places, that have it."""
    return history.select(F.explode(grams(searched(history))).alias("gram"), place).distinct()


def places_with(posts: DataFrame, query: str, place: str = "id") -> DataFrame:
    """(place): those that have all grams of a query."""
    wanted = query_grams(query)
    return posts.filter(F.col("gram").isin(wanted)).groupBy(place).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select(place)


def search_indexed(history: DataFrame, posts: DataFrame, query: str) -> DataFrame:
    """:func:`search` of the rows that :func:`postings` leave; a query of fewer than GRAM characters has no grams and looks at all."""
    if not query_grams(query):
        return search(history, query)
    return search(history.join(places_with(posts, query), "id", "left_semi"), query)


def with_in_flight(history: DataFrame, jobs: DataFrame) -> DataFrame:
    """Placeholders for running jobs (columns of the history) that it doesn't hold yet, ranked before the others."""
    waiting = jobs.join(history.select("id"), "id", "left_anti").select(*history.columns)
    return waiting.withColumn("rank", F.lit(0)).unionByName(history.withColumn("rank", F.lit(1)))


def record(summary: Column, text: Column, candidates: Column) -> Column:
    """A document's record as JSON."""
    return F.to_json(F.struct(summary.alias("summary"), text.alias("original_text"), candidates.alias("candidates")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "ignoreNullFields": "false"})


def rebuild(records: DataFrame, column: str = "json") -> DataFrame:
    """The index from record JSON; what can't be read, or has no id, is skipped."""
    parsed = F.from_json(F.col(column), RECORD, {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})
    return records.select(parsed.alias("r")).filter("r.summary.id is not null").select("r.summary.*")


def latest_records(records: DataFrame) -> DataFrame:
    """(id, json) of (id, written, json): each id's last version; of versions written at once the greatest."""
    return records.groupBy("id").agg(F.max(F.struct("written", "json"))["json"].alias("json"))


def last_writes(saves: DataFrame, period_ms: int = V.DEBOUNCE_MS, *ties: str) -> DataFrame:
    """The saves (id, updated_at) that are written: those that no later save of their id follows within the period.

    Of saves at one time the last by the columns ``ties`` counts.
    """
    following = F.lead("updated_at").over(W.partitionBy("id").orderBy("updated_at", *ties))
    late = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp")) > 1000 * period_ms
    return saves.withColumn("velum_written", F.coalesce(late, F.lit(True))).filter("velum_written").drop("velum_written")
