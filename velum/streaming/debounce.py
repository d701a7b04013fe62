"""Saves of documents as a stream: of saves that follow each other within a period only the last is written."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from velum import fixed_values as V

#: What the session must be set to for state with timers.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_HELD = T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", T.StringType())])


class _Debounce(StatefulProcessor):
    """Holds an id's saves (microseconds, tie) until the watermark has passed them by the period; then one is written if no later one followed.

    A timer stands at the end of each held save's period, when all saves that could follow it in time have come. So what an id holds is bounded by
    its saves within the period and the watermark's delay.
    """

    def __init__(self, period_us: int):
        self.period = period_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saves = handle.getListState("saves", _HELD)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        fresh = [(r["velum_at"], r["velum_tie"]) for r in rows]
        if fresh:
            self.saves.appendList(fresh)
            for at in {at for at, _ in fresh}:
                self.handle.registerTimer(self._ends(at))
        return iter(())

    def _ends(self, at: int) -> int:
        """Milliseconds at which a save's period is over."""
        return (at + self.period) // 1000 + 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted((r[0], r[1]) for r in self.saves.get())
        written, kept = [], []
        for save, following in zip(held, [*held[1:], None], strict=True):
            if self._ends(save[0]) > now:
                kept.append(save)
            elif following is None or following[0] - save[0] > self.period:
                written.append(Row(id=key[0], at=save[0], tie=save[1]))
        if kept:
            self.saves.put(kept)
        else:
            self.saves.clear()
        return iter(written)

    def close(self) -> None:
        pass


def last_writes(saves: DataFrame, delay: str = "1 minute", period_ms: int = V.DEBOUNCE_MS, tie: str | None = None) -> DataFrame:
    """(id, updated_at, tie): :func:`velum.operators.history.last_writes` of a stream of saves (id, updated_at), each as soon as its period is over.

    delay: how late a save may come; what comes later than the watermark is left out. Of saves at one time the last by the column ``tie``
    (as a string) counts. The session needs STATE_STORE.
    """
    at = F.unix_micros(F.col("updated_at").cast("timestamp")).alias("velum_at")
    held = saves.select(F.col("id").cast("string").alias("id"), F.col("updated_at").cast("timestamp").alias("updated_at"), at, (F.col(tie).cast("string") if tie else F.lit("")).alias("velum_tie"))
    out = (
        held.withWatermark("updated_at", delay)
        .groupBy("id")
        .transformWithState(statefulProcessor=_Debounce(period_ms * 1000), outputStructType="id string, at long, tie string", outputMode="Append", timeMode="EventTime")
    )
    return out.select("id", F.timestamp_micros("at").alias("updated_at"), "tie")
