"""Connected components of a link table by alternating large-star and small-star steps.

Links stay distributed; every step is written to the shared folder, so a lost executor costs one step at most.
A step keeps at most as many links as it got plus one per node, and the number of steps grows with the logarithm
of the longest chain. Nodes may have null or clashing names in the caller's tables: only the columns a and b are looked at; null ids
must not be given. Repeated links and links of a node with itself change nothing; an empty table gives an empty result. Up to ``ONE_TASK`` links (16 bytes each, counted before each step) a step is one task without a shuffle;
more are dealt out by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import discard, materialise


ONE_TASK = 400_000


def _mark(links: DataFrame) -> tuple:
    # Wrapping sums: only compared with the step before.
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): every node of ``links`` (a, b: any integers) with the smallest node that it is connected to."""
    now = materialise(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )  # a > b always
    mark, before = _mark(now), now
    while mark[0]:
        if mark[0] <= ONE_TASK:
            now = now.coalesce(1)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(own, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        after = materialise(moved.select("x.a", "x.b").filter("a > b").distinct(), "links")
        fresh = _mark(after)
        discard(before)
        now, before, done, mark = after, after, fresh == mark, fresh
        if done:
            break
    # Now each node is linked with its component's smallest node alone.
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
