"""Order-dependent operators: runs, islands, folds with a reset.

Order is a column. Where a rule looks only at neighbours, a window says it; where what came out before
decides, sorted rows stream through an Arrow function (`fold`, `by_group`): one call takes many groups, and a
fold holds no more of a group than its state.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: str, new: Column, name: str = "run") -> DataFrame:
    """W-RUN-TAG and other islands: a number that rises at each row where `new` holds."""
    return df.withColumn(name, F.sum(F.coalesce(new, F.lit(False)).cast("long")).over(Window.partitionBy(*keys).orderBy(order)))


def first_of(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """U-DEDUP-KEEP-FIRST: the first row of each key, by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def mode_first(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """A-MODE-FIRST: the most frequent value of each key; ties: the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return first_of(counts, keys, [F.desc("n"), F.asc("_first")]).drop("_first")


def batches(df: DataFrame, keys: list[str], order: str, size: str, most_size: int, most_items: int) -> DataFrame:
    """B-LLM, B-TERM: batch numbers; a batch ends after the row that brings it over either limit."""

    def step(state, row):
        number, total, n = state
        total, n = total + (row.size or 0), n + 1
        return number, (number + 1, 0, 0) if total > most_size or n > most_items else (number, total, n)

    rows = df.select(*keys, order, F.col(size).cast("long").alias("size"))
    return fold(rows, keys, order, "batch long", lambda: (0, 0, 0), step).drop("size")


_KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def fold(df: DataFrame, keys: list[str], order: str | list[str], schema: str, start: Callable[[], object], step: Callable[[object, object], tuple]) -> DataFrame:
    """Rows of each key in order; step(state, row) gives the new column's value and the next state.

    schema: the name and type of the new column. Nulls in rows are None.
    """
    name, kind = schema.split(" ", 1)
    at, row_of = [df.columns.index(k) for k in keys], namedtuple("Row", df.columns, rename=True)

    def run(parts: Iterable[pa.RecordBatch]):
        key = state = None
        for b in parts:
            out = []
            for row in map(row_of._make, zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if (own := tuple(row[i] for i in at)) != key:
                    key, state = own, start()
                value, state = step(state, row)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, _KINDS[kind])], names=[*b.schema.names, name])

    return _in_order(df, keys, [order] if isinstance(order, str) else order).mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{name}` {kind}"]))


def by_group(df: DataFrame, keys: list[str], order: list[str], schema: str, made: Callable[[list[tuple]], Iterable[tuple]]) -> DataFrame:
    """keys and the columns of schema: made(rows) of each group, rows as tuples of the other columns in order.

    A key is a line or a page, whose rows fit a task.
    """
    kinds, fields = dict(df.dtypes), [x.split(" ") for x in schema.split(", ")]
    rest = [c for c in df.columns if c not in keys]

    def run(parts: Iterable[pa.RecordBatch]):
        key, rows, out = None, [], []

        def batch():
            columns = list(zip(*out, strict=True))
            own = [pa.array(columns[i], types[i]) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(c, _KINDS[t]) for c, (_, t) in zip(columns[len(keys) :], fields, strict=True))], names=[*keys, *(n for n, _ in fields)])

        for b in parts:
            types = [b.schema.field(k).type for k in keys]
            owners = zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys), strict=True)
            for own, row in zip(owners, zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in rest), strict=True), strict=True):
                if own != key and rows:
                    out += [(*key, *x) for x in made(rows)]
                    rows = []
                    if len(out) >= 50_000:
                        yield batch()
                        out = []
                key = own
                rows.append(row)
        if rows:
            out += [(*key, *x) for x in made(rows)]
        if out:
            yield batch()

    return _in_order(df, keys, order).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema]))


def adjacent_pairs(df: DataFrame, keys: list[str], order: str, fits: Column) -> DataFrame:
    """J-PAIR-COL: greedy pairs of neighbours. `fits`: whether a row pairs with the next one.

    In a run of rows that fit, every second one starts a pair.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    flagged = df.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    islands = flagged.withColumn("_isle", F.sum((~F.coalesce(F.lag("_fits").over(w), F.lit(False))).cast("long")).over(w))
    inner = Window.partitionBy(*keys, "_isle").orderBy(order)
    return islands.withColumn("pair_start", F.col("_fits") & (F.row_number().over(inner) % 2 == 1)).drop("_fits", "_isle")
