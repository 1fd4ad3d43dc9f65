"""Structured Streaming forms of indexing and of chat memory."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 1) -> DataFrame:
    """A Parquet file or folder of such as a stream; written as a pattern, which a single file needs.  Without ``files_per_trigger``, all files that are there
    make one batch: event time that is not in the order of the files then makes no row late."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def index_stream(source: DataFrame, transform, sink: str, status: str, checkpoint: str):
    """Transform each micro-batch, append it to the sink, and append its status row: batch_id, rows, state.  A batch that fails is recorded as
    such and raised, so that a restart tries it again; a batch that a restart repeats replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def tell(n: int, state: str) -> None:
            spark.createDataFrame([(batch_id, n, state)], "batch_id long, rows long, state string").write.mode("overwrite").parquet(f"{status}/batch_id={batch_id}")

        try:
            path = f"{sink}/batch_id={batch_id}"
            transform(batch).write.mode("overwrite").parquet(path)
            tell(spark.read.parquet(path).count(), "ready")
        except Exception:
            tell(0, "failed")
            raise

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain(source: DataFrame, index, checkpoint: str, first: int = 0):
    """Keep a ``LexicalIndex`` up to date with a stream of chunks (id, text): each micro-batch is the batch of the index with its number, counted from
    ``first``, so what a restart repeats takes its own place."""
    return source.writeStream.foreachBatch(lambda batch, no: index.add(first + no, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Events of each type by tumbling window of event time, with late data dropped after the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


MEMORY = "conv_id long, turns array<struct<turn:long,role:string,text:string>>, expires_ms long"


def memory_stream(turns: DataFrame, n: int = 6, ttl_ms: int = 86_400_000, expire: bool = True) -> DataFrame:
    """The last n turns of each conversation after every batch, with the processing time until which they hold: each write renews it, and a
    conversation that lapsed begins anew.

    ``expire`` also removes the state of conversations that stay silent.  A query that runs until its input ends must not set it: timers
    keep such a query running."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs() if expire else int(time.time() * 1000)
        held = list(zip(*state.get[:3])) if state.exists and state.get[3] > now else []
        for pdf in batches:
            held += list(zip(pdf["turn"].tolist(), pdf["role"].tolist(), pdf["text"].tolist()))
        held = sorted(held, key=lambda t: t[0])[-n:]
        state.update((*(list(c) for c in zip(*held)), now + ttl_ms))
        if expire:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [[{"turn": t, "role": r, "text": x} for t, r, x in held]], "expires_ms": [now + ttl_ms]})

    keyed = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id")
    state = "turns array<long>, roles array<string>, texts array<string>, expires_ms long"
    return keyed.applyInPandasWithState(update, MEMORY, state, "update", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)
