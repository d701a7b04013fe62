"""Rendezvous hashing of stable record keys over weighted shards (built-in functions only).

A record goes to the shard with the largest ``ln(u) / weight`` where ``u`` in (0, 1) is a hash of the
key and the shard's number. The key and the shards alone decide, so a further shard only takes records
to itself (its share of them), and removing one only moves the records it held.

Defined cases: a null key is one fixed key; a null text has no bytes; repeated rows are all kept and
each gets a slot; an empty table gives an empty result; other columns are not touched or looked at.
Positions within a shard come from counts per (shard, bucket), and equal rows are counted before the
shuffle, so neither a hot key nor a large shard is ever sorted in one task. The scores are computed once and written
without texts; the number of buckets grows with the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.llm.common import materialise, string, table

SHARDS = 40
#: Parts of a shard that are numbered apart, and rows of a part beyond which there are that many times more parts.
BUCKETS = 64
BUCKET_ROWS = 100_000
#: Parts of all shards up to which their counts (24 bytes each) are broadcast.
BROADCAST_PARTS = 200_000
RECORD_OVERHEAD = 16


def _unit(key: Column, shard: Column) -> Column:
    """A hash of (key, shard) strictly between 0 and 1, exact in a double (44 bits)."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 11)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 44)


def rendezvous(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct(score, negated shard) of the winning shard among ``first .. first+len(weights)-1``."""
    scores = [
        F.struct((F.log(_unit(key, F.lit(first + i))) / F.lit(float(w))).alias("score"), F.lit(-(first + i)).alias("neg"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return F.array_max(F.array(*scores))


def record_key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("\x01null"))


def assign(docs: DataFrame, weights: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot): every row of ``docs`` once. grown_shard: with one more shard of weight 1."""
    weights = weights or [1.0] * SHARDS
    k = record_key(F.col(key))
    body = string(text)
    written = materialise(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(body) + RECORD_OVERHEAD).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
        )
        .groupBy("key", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("k", record_key(F.col("key")))
        .withColumn("best", rendezvous(F.col("k"), weights))
        .withColumn("next", rendezvous(F.col("k"), [1.0], len(weights)))
        .select(
            "key", "size", "text_crc32", "n",
            (-F.col("best.neg")).alias("shard"),
            (-F.greatest("best", "next")["neg"]).alias("grown_shard"),
            F.crc32(F.concat_ws("/", "k", F.col("size").cast("string"), F.col("text_crc32").cast("string")).cast("binary")).alias("crc"),
        ),
        "placed",
    )
    buckets = BUCKETS * max(1, math.ceil(written.count() / (len(weights) * BUCKETS * BUCKET_ROWS)))
    placed = written.withColumn("bucket", F.pmod("crc", F.lit(buckets))).drop("crc")
    starts = (
        placed.groupBy("shard", "bucket")
        .agg(F.sum("n").alias("held"))
        .withColumn("start", F.sum("held").over(W.partitionBy("shard").orderBy("bucket")) - F.col("held"))
        .select("shard", "bucket", "start")
    )
    within = W.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32")
    return (
        placed.join(F.broadcast(starts) if buckets * len(weights) <= BROADCAST_PARTS else starts, ["shard", "bucket"])
        .withColumn("from", F.col("start") + F.sum("n").over(within) - F.col("n"))
        .withColumn("slot", F.explode(F.sequence("from", F.col("from") + F.col("n") - 1)))
        .select(F.col("key").alias(key), "size", "text_crc32", "shard", "grown_shard", "slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


ORACLE = f"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
lookup AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
body AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(doc_id::VARCHAR, chr(1) || 'null') AS k FROM documents),
sized AS (SELECT doc_id, k, (strlen(x) + {RECORD_OVERHEAD})::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM body, lookup),
scored AS (SELECT k, s.range AS s, ln((('0x' || substr(md5(k || ':' || s.range), 1, 11))::BIGINT::DOUBLE + 0.5) / {1 << 44}) AS score
  FROM (SELECT DISTINCT k FROM body), range({SHARDS + 1}) s),
placed AS (SELECT k, arg_max(s, score) FILTER (s < {SHARDS}) AS shard, arg_max(s, score) AS grown_shard FROM scored GROUP BY k),
keyed AS (SELECT *, concat(k, '/', size, '/', text_crc32) AS kk FROM sized),
bucketed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(kk)), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT % {BUCKETS} AS bucket FROM keyed, lookup)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM bucketed JOIN placed USING (k)
"""
