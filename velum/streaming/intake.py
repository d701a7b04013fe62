"""A folder as a stream of new documents, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from velum.operators import history as H
from velum.plans.redaction import detect
from velum.sources.documents import decode_text, extension


def new_documents(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """(path, file_hash, text, modification_time) of text files as they arrive; equal contents count once within the watermark."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .filter(extension(F.col("path")).isin("txt", "text"))
    )
    keyed = files.select("path", H.fingerprint(F.col("content")).alias("file_hash"), decode_text(F.col("content")).alias("text"), F.col("modificationTime").alias("modification_time"))
    return keyed.withWatermark("modification_time", late).dropDuplicatesWithinWatermark(["file_hash"])


def candidates_sink(stream: DataFrame, target: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Each micro-batch's candidates, appended to a Parquet folder. Without a trigger interval what is there is taken once.

    A batch number in the path makes a repeated batch overwrite itself, so a restart writes nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        detect(batch.select(F.col("file_hash").alias("doc_id"), "text")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def arrivals(stream: DataFrame, window: str = "10 minutes") -> DataFrame:
    """(window, n): files per time window of their modification; late ones count until the watermark passes."""
    return stream.groupBy(F.window("modification_time", window)).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "n")
