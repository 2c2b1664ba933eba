"""Event logs as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counts_by_window(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Extension: events of each type per window of event time; what is later than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def throttled(events: DataFrame, interval: float) -> DataFrame:
    """ST-THROTTLE on a stream: an event of a user comes out if it is at least `interval` seconds after the last
    one that came out; that time is the key's state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (float("-inf"),)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at, event in zip(rows["at"], rows["event_id"], strict=True):
            if at - last >= interval:
                last = float(at)
                out.append(event)
        state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": out})

    timed = events.withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "last double", "append", GroupStateTimeout.NoTimeout)


def append_log(events: DataFrame, path: str, checkpoint: str):
    """ST-LOG: the stream as an append-only table; the checkpoint holds the offsets (ST-REPLAY after a restart)."""
    return events.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
