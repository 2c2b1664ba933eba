"""Progress and event logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import fold


def weights(stages: DataFrame, enabled: Column) -> DataFrame:
    """ST-STAGES: weights of the enabled stages, summing to 1."""
    some = stages.where(enabled)
    return some.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1))))


def overall(parts: DataFrame, keys: list[str]) -> DataFrame:
    """A-PROGRESS, ST-PARTS: progress of a part counts from its offset, at 1 / parts."""
    return parts.groupBy(*keys).agg((F.sum(F.col("weight") * F.col("done")) * 100 / F.max("parts") + F.max("part") * 100.0 / F.max("parts")).alias("overall"))


def replay(log: DataFrame, cursor: int, first_available: int) -> DataFrame:
    """ST-REPLAY: events after a cursor; an error if events between them are gone."""
    if cursor < first_available - 1:
        raise ValueError(f"events {cursor + 1} to {first_available - 1} are no longer kept")
    return log.where((F.col("sequence") > cursor) & (F.col("sequence") >= first_available))


def until_terminal(log: DataFrame, keys: list[str], order: str, terminal: Column) -> DataFrame:
    """ST-TERMINAL: events up to and with the first terminal one of each key."""
    before = F.coalesce(F.max(terminal.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return log.withColumn("_over", before).where("_over = 0").drop("_over")


def missing_terminal(log: DataFrame, keys: list[str], terminal: Column) -> DataFrame:
    """Keys that have no terminal event, for which an error is made up."""
    return log.groupBy(*keys).agg(F.max(terminal.cast("int")).alias("_t")).where("_t = 0").select(*keys, F.lit("error").alias("event_type"))


def throttle(log: DataFrame, keys: list[str], order: str, at: Column, interval: float) -> DataFrame:
    """ST-THROTTLE: an event comes out if it is at least `interval` after the last one that CAME OUT."""

    def step(last, row):
        due = row.at - last >= interval
        return due, row.at if due else last

    rows = log.select(*keys, order, at.alias("at"))
    return fold(rows, keys, ["at", order], "due boolean", lambda: float("-inf"), step).where("due").select(*keys, order)
