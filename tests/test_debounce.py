"""The stream of saves against the batch operator on the same events."""

import random

from pyspark.sql import functions as F

from velum.operators import history as H
from velum.streaming import debounce


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(8)
    rows, at = [], 0
    for i in range(300):
        at += r.choice([0, 1, 100, 399, 400, 401, 2000])
        rows.append((r.choice("abc"), at, f"{i:04d}"))
    # Batches come nearly in order: each is shuffled, and some events come a batch late.
    batches = [rows[i : i + 60] for i in range(0, 300, 60)]
    for a, b in zip(batches, batches[1:], strict=False):
        b.append(a.pop(r.randrange(len(a))))
    last = [("end", 10_000_000, "x")]
    before = {k: spark.conf.get(k, None) for k in debounce.STATE_STORE}
    for k, v in debounce.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        folder = tmp_path / "in"
        folder.mkdir()
        stream = spark.readStream.schema("id string, ms long, n string").option("maxFilesPerTrigger", "1").json(str(folder))
        saves = stream.withColumn("updated_at", F.timestamp_millis("ms"))
        for i, batch in enumerate([*batches, last, [("end", 10_000_001, "y")]]):
            r.shuffle(batch)
            (folder / f"{i}.json").write_text("\n".join(f'{{"id": "{a}", "ms": {b}, "n": "{c}"}}' for a, b, c in batch))
            query = debounce.last_writes(saves, "10 minutes", 400, "n").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            query.awaitTermination(120)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted((x["id"], x["ms"], x["tie"]) for x in spark.read.parquet(f"{tmp_path}/out").withColumn("ms", F.unix_millis("updated_at")).collect())
    table = spark.createDataFrame(rows, "id string, ms long, n string").withColumn("updated_at", F.timestamp_millis("ms"))
    want = sorted((x["id"], x["ms"], x["n"]) for x in H.last_writes(table, 400, "n").collect())
    assert got == want and 30 < len(want) < 300
