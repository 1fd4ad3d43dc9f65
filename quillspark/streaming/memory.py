"""Chat memory with state that lapses in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TURN = "turn long, role string, text string"
#: What ``chat_memory`` gives.
MEMORY = "conv_id long, turns array<struct<turn:long,role:string,text:string>>, until_ms long, lapsed boolean, primed boolean"
HELD = "turns array<struct<turn:long,role:string,text:string>>, until_ms long"


class _Memory(StatefulProcessor):
    """One value for each conversation, the window and until when it holds, and a timer for that moment."""

    def __init__(self, n: int, ttl_ms: int):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, until = [], None
        if self.held.exists():
            kept, until = self.held.get()
            turns = [(t["turn"], t["role"], t["text"]) if not isinstance(t, tuple) else tuple(t) for t in kept]
        pdf, primed = pd.concat(list(rows)).sort_values(["at_ms", "turn"], kind="stable"), False
        for at, turn, role, text, history in zip(*(pdf[c].tolist() for c in ("at_ms", "turn", "role", "text", "history")), strict=True):
            if until is None or at > until:
                # A miss: the window begins anew, with what the durable history has from before.
                turns = [tuple(h[c] for c in ("turn", "role", "text")) for h in (history if history is not None else [])]
                turns, primed = sorted((h for h in turns if h[0] < turn), key=lambda h: h[0]), bool(turns)
            turns, until = [*turns, (turn, role, text)][-self.n :], max(at + self.ttl_ms, until or 0)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until)
        self.held.update((turns, until))
        yield self._row(key, turns, until, False, primed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield self._row(key, [], expiredTimerInfo.getExpiryTimeInMs(), True, False)

    @staticmethod
    def _row(key: tuple, turns: list[tuple], until: int, lapsed: bool, primed: bool) -> pd.DataFrame:
        shown = [{"turn": t, "role": r, "text": x} for t, r, x in turns]
        return pd.DataFrame({"conv_id": [key[0]], "turns": [shown], "until_ms": [until], "lapsed": [lapsed], "primed": [primed]})

    def close(self) -> None:
        pass


def chat_memory(turns: DataFrame, n: int = 6, ttl_ms: int = 86_400_000, lateness: str = "0 seconds", history: DataFrame | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text, at), a stream, to MEMORY: after every batch the window of each conversation that spoke, its last ``n`` turns, and a row
    with ``lapsed`` for each that has been silent for ``ttl_ms`` when the watermark (``at`` less ``lateness``) passes.

    Each turn renews the time.  A turn later than that finds nothing: the window begins anew, or, with ``history`` (conv_id, turns; an array of TURN),
    from the last turns there that come before it.  Within a batch, turns are taken in order of time.  A conversation's state is ``n`` turns and one timer; turns
    later than the watermark are dropped.  The state store must be one that keeps timers, such as that of RocksDB: see ``with_timers``."""
    timed = turns.withWatermark("at", lateness).select("conv_id", "turn", "role", "text", F.unix_millis("at").alias("at_ms"), "at")
    if history is None:
        timed = timed.withColumn("history", F.lit(None).cast("array<struct<turn:long,role:string,text:string>>"))
    else:
        timed = timed.join(history.select("conv_id", F.col("turns").alias("history")), "conv_id", "left")
    return timed.groupBy("conv_id").transformWithStateInPandas(_Memory(n, ttl_ms), MEMORY, "Update", "EventTime")


def with_timers(spark) -> None:
    """Have the session's streams keep their state where timers can be kept."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
