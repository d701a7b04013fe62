"""The record store: one JSON record per document, of which the last version counts, and an index table, replaced as a whole."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from velum.operators import history as H

#: Folders that records are dealt into by id, so that one record is looked for in one of them.
PARTS = 64


def _part(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(PARTS)).cast("int")


def write_records(records: DataFrame, path: str) -> None:
    """Records (id, json): each replaces the one of its id. A write is appended as a new version, seen as a whole once it is committed."""
    versions = records.select("id", F.lit(time.time_ns()).alias("written"), "json", _part(F.col("id")).alias("part"))
    versions.repartition("part").sortWithinPartitions("id").write.mode("append").partitionBy("part").parquet(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, written long, json string, part int").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, json): the last version of each record."""
    return H.latest_records(read_versions(spark, path))


def compact_records(spark: SparkSession, path: str, target: str) -> None:
    """The last versions alone, in a new folder."""
    write_records(read_records(spark, path), target)


def load_record(versions: DataFrame, doc_id: str) -> DataFrame:
    """The record of an id, of :func:`read_versions`; no row if it is missing or can't be read. The id filters files and row groups."""
    own = versions.filter((F.col("id") == doc_id) & (F.col("part") == _part(F.lit(doc_id)))) if "part" in versions.columns else versions.filter(F.col("id") == doc_id)
    parsed = F.from_json("json", H.RECORD, {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})
    return H.latest_records(own).select(parsed.alias("r")).filter("r.summary.id is not null").select("r.*")


def replace_table(df: DataFrame, root: str) -> str:
    """Write a new version beside the old one and then point to it; readers see one or the other, never a part.

    The pointer is renamed over the old one, which the file system does at once.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    current, fresh = hadoop.Path(f"{root}/CURRENT"), hadoop.Path(f"{root}/CURRENT-{version}")
    fs = fresh.getFileSystem(conf)
    stream = fs.create(fresh, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    rename = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(current), over)
    return version


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The version that the pointer names."""
    version = spark.read.text(f"{root}/CURRENT").first()["value"]
    return spark.read.parquet(f"{root}/{version}")


def load_index(spark: SparkSession, index_root: str, records_path: str) -> DataFrame:
    """The index, newest first; rebuilt from the records if there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    pointer = fs_path(f"{index_root}/CURRENT")
    there = pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer)
    return H.ordered(read_table(spark, index_root) if there else H.rebuild(read_records(spark, records_path)))


def write_search_index(history: DataFrame, path: str) -> None:
    """The history dealt into folders by id, and for each gram the folders that have it (PARTS at most)."""
    dealt = history.withColumn("part", _part(F.col("id")))
    dealt.repartition("part").sortWithinPartitions("id").write.partitionBy("part").parquet(f"{path}/rows")
    H.postings(dealt, "part").repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """:func:`velum.operators.history.search` of a written index: only folders that have all grams of the query are read.

    The grams' filter reaches the index's row groups, and the list of folders is bounded by their number.
    """
    rows = spark.read.parquet(f"{path}/rows")
    if H.query_grams(query):
        rows = rows.filter(F.col("part").isin([r["part"] for r in H.places_with(spark.read.parquet(f"{path}/grams"), query, "part").collect()]))
    return H.search(rows, query).drop("part")


def notification(n: Column, active: Column, watching: Column) -> Column:
    """The message after a scan, in the singular or plural; none while the user is looking on."""
    message = F.when(n == 1, "1 hallazgo para revisar").otherwise(F.concat(n.cast("string"), F.lit(" hallazgos para revisar")))
    return F.when(~(active & watching), message)


def with_progress(df: DataFrame, name: str, *counted: str) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that holds, once an action is done, its rows and the non-null values of the given columns."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c)).alias(c) for c in counted]), seen
