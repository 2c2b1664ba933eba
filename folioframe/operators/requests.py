"""Requests over time: rates, waits, progress events, cancelling, and the summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The lines of a run's summary, by the column that each states.
SUMMARY = {
    "original": "\tOriginal PDF: {}",
    "seconds": "\tTotal time: {} seconds",
    "mono": "\tMonolingual PDF: {}",
    "dual": "\tDual-language PDF: {}",
    "glossary": "\tAuto-extracted glossary: {}",
    "peak_memory": "\tPeak memory usage: {} MB",
    "characters": "\tTotal valid character count: {}",
    "tokens": "\tTotal valid text token count (gpt-4o): {}",
}
SUMMARY_HEAD, SUMMARY_NONE = "Translation results:", "No translation results available"


def at_rate(requests: DataFrame, keys: list[str], order: list[str], arrival: Column, per_second: float) -> DataFrame:
    """B-RATE: `start` of each request, at least 1 / per_second after the one before it and not before its arrival.

    A start is the latest of (an earlier or its own arrival + the intervals since), hence a running maximum.
    """
    own = Window.partitionBy(*keys).orderBy(*order)
    since = (F.row_number().over(own) - 1) / F.lit(float(per_second))
    return requests.withColumn("_since", since).withColumn("start", F.max(arrival - F.col("_since")).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_since")).drop("_since")


def retry_wait(attempt: Column, least: float = 1.0, most: float = 15.0) -> Column:
    """B-RETRY: seconds to wait after a failed attempt (from 1): doubling, between the two bounds."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.pow(F.lit(2.0), F.least(attempt, F.lit(60)) - 1)))


def retried(requests: DataFrame, failures: Column, most_attempts: int = 100) -> DataFrame:
    """B-RETRY: `attempts`, seconds `waited` and `gave_up` of requests that fail so often; there is no wait after the last attempt."""
    attempts = F.least(F.greatest(F.coalesce(failures, F.lit(0)), F.lit(0)) + 1, F.lit(most_attempts)).cast("int")
    waits = F.transform(F.filter(F.sequence(F.lit(1), attempts), lambda k: k < attempts), lambda k: retry_wait(k))
    return requests.withColumns({"attempts": attempts, "waited": F.aggregate(waits, F.lit(0.0), lambda a, w: a + w), "gave_up": F.coalesce(failures >= most_attempts, F.lit(False))})


def stage_events(updates: DataFrame, keys: list[str]) -> DataFrame:
    """ST-EVENTS: events of runs (keys) from updates: stage_no, stage, weight, seq, current, total.

    Each stage gives a start, its updates, and an end if it got to its total. Overall progress counts the weights of
    the stages that are complete, and this one's share; weights sum to 1. A total of 0 is complete.
    """
    last = updates.groupBy(*keys, "stage_no", "stage", "weight").agg(F.max("total").alias("total"), F.max_by("current", "seq").alias("current"))
    complete = F.col("current") == F.col("total")
    before = Window.partitionBy(*keys).orderBy("stage_no").rowsBetween(Window.unboundedPreceding, -1)
    stages = last.withColumns({"before": F.coalesce(F.sum(F.when(complete, F.col("weight")).otherwise(0.0)).over(before), F.lit(0.0)), "complete": complete})
    shape = [*keys, "stage_no", "stage", "weight", "before", "total"]
    starts = stages.select(*shape, F.lit(0).cast("long").alias("current"), F.lit("progress_start").alias("type"), F.lit(None).cast("long").alias("seq"))
    ends = stages.where("complete").select(*shape, F.col("total").alias("current"), F.lit("progress_end").alias("type"), F.lit(None).cast("long").alias("seq"))
    moves = updates.drop("total", "stage", "weight").join(stages.drop("current", "complete"), [*keys, "stage_no"]).select(*shape, "current", F.lit("progress_update").alias("type"), "seq")
    share = F.when(F.col("total") == 0, 1.0).otherwise(F.col("current") / F.nullif(F.col("total"), F.lit(0)))
    return starts.unionByName(moves).unionByName(ends).withColumns({"stage_progress": F.when(F.col("type") == "progress_start", 0.0).otherwise(100 * share), "overall": 100 * (F.col("before") + F.col("weight") * share)}).drop("before", "weight")


def until_cancelled(log: DataFrame, cancels: DataFrame, keys: list[str]) -> DataFrame:
    """ST-CANCEL: events (keys, at, type) before their run was cancelled (keys, cancelled_at), and an error then."""
    first = cancels.groupBy(*keys).agg(F.min("cancelled_at").alias("cancelled_at"))
    kept = log.join(first, keys, "left").where(F.col("cancelled_at").isNull() | (F.col("at") < F.col("cancelled_at")))
    runs = log.select(*keys).distinct().join(first, keys)
    return kept.select(*keys, "at", "type").unionByName(runs.select(*keys, F.col("cancelled_at").alias("at"), F.lit("error").alias("type")))


def summary(**values: Column) -> Column:
    """R-RESULT: a run's summary; what is null, empty or zero has no line, but for counts, which are stated at zero."""
    lines = []
    for name, line in SUMMARY.items():
        if name in values:
            v, (head, tail) = values[name], line.split("{}")
            said = v.isNotNull() if name in ("characters", "tokens") else F.coalesce(~v.cast("string").isin("", "0", "0.0"), F.lit(False))
            shown = F.format_string("%.2f", v.cast("double")) if name == "seconds" else v.cast("string")
            lines.append(F.when(said, F.concat(F.lit(head), shown, F.lit(tail))))
    body = F.concat_ws("\n", *lines)
    return F.when(body == "", F.lit(SUMMARY_NONE)).otherwise(F.concat(F.lit(SUMMARY_HEAD + "\n"), body))
