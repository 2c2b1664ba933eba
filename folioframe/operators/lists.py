"""Rows of contents pages and lists: ranges of lines of a page that form one item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def _page(df: DataFrame, keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)


def marker_ranges(lines: DataFrame, keys: list[str], order: str, marker: Column, least: int = 2) -> DataFrame:
    """W-BULLET-RANGES: an item runs from its marker to the line before the next one, if a page has enough."""
    w, page = _page(lines, keys, order)
    flagged = lines.withColumn("_m", F.coalesce(marker, F.lit(False)))
    items = flagged.withColumn("_item", F.sum(F.col("_m").cast("long")).over(w)).withColumn("_all", F.sum(F.col("_m").cast("long")).over(page))
    return items.where((F.col("_item") > 0) & (F.col("_all") >= least)).groupBy(*keys, "_item").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_item")


def manning_ranges(lines: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """W-BULLET-MANNING: as marker_ranges, but an appendix label goes with the marker after it."""
    w, _ = _page(lines, keys, order)
    marked, label = F.col(text).rlike(t.MARKED), F.col(text).rlike(t.APPENDIX)
    flagged = lines.withColumns({"_before": F.coalesce(F.lag(label).over(w), F.lit(False)), "_next": F.coalesce(F.lead(marked).over(w), F.lit(False))})
    return marker_ranges(flagged, keys, order, (marked & ~F.col("_before")) | (label & F.col("_next")))


def terminal_ranges(lines: DataFrame, keys: list[str], order: str, text: str = "text", least: int = 2) -> DataFrame:
    """W-TOC-OREILLY: a row ends at a line with a page label at its end."""
    w, page = _page(lines, keys, order)
    end = F.col(text).rlike(t.TERMINAL_LABEL)
    flagged = lines.withColumn("_e", F.coalesce(end, F.lit(False)).cast("long"))
    rows = flagged.withColumns({"_row": F.sum("_e").over(w) - F.col("_e"), "_all": F.sum("_e").over(page)})
    return rows.where((F.col("_row") < F.col("_all")) & (F.col("_all") >= least)).groupBy(*keys, "_row").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_row")


def single_rows(lines: DataFrame, keys: list[str], order: str, row: Column, least: int = 3) -> DataFrame:
    """W-TRACTION: rows that stand for themselves, if a page has enough."""
    _, page = _page(lines, keys, order)
    hit = lines.where(row).withColumn("_all", F.count(F.lit(1)).over(page))
    return hit.where(F.col("_all") >= least).select(*keys, F.col(order).alias("first"), F.col(order).alias("last"))


def toc_runs(lines: DataFrame, keys: list[str], order: str, text: str = "text", x2: str = "x2", slack: float = 12.0, least: int = 2) -> DataFrame:
    """W-TOC-RUNS: runs of adjacent numbered rows whose right edges stay within a slack of the run's FIRST.

    The anchor is the run's first row, so candidates of a page are folded in order, in the JVM.
    """
    rows = lines.where(t.numbered_row(F.col(text))).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("i"), F.col(x2).alias("x")))).alias("_rows"))
    empty = F.array().cast("array<struct<first:bigint,last:bigint,anchor:double>>")

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        grows = (F.size(acc) > 0) & (r["i"] == last["last"] + 1) & (F.abs(r["x"] - last["anchor"]) <= slack)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), r["i"].alias("last"), last["anchor"].alias("anchor"))))
        return F.when(grows, grown).otherwise(F.concat(acc, F.array(F.struct(r["i"].alias("first"), r["i"].alias("last"), r["x"].alias("anchor")))))

    safe = F.aggregate("_rows", empty, lambda acc, r: F.when(F.size(acc) == 0, F.array(F.struct(r["i"].alias("first"), r["i"].alias("last"), r["x"].alias("anchor")))).otherwise(step(acc, r)))
    return rows.select(*keys, F.explode(safe).alias("_r")).where(F.col("_r.last") - F.col("_r.first") + 1 >= least).select(*keys, F.col("_r.first").alias("first"), F.col("_r.last").alias("last"))


def list_items(lines: DataFrame, keys: list[str], order: str, text: str = "text", x: str = "x", slack: float = 8.0, least: int = 3) -> DataFrame:
    """W-LIST-GENERIC: items of three or more markers of one family at the run's first left edge.

    An item ends before the next marker of its run, the run's last item at the page's end.
    """
    w, page = _page(lines, keys, order)
    kind = F.when(F.regexp_extract(text, t.LIST_ITEM, 1).rlike("^[0-9]"), F.lit("number")).otherwise(F.lit("bullet"))
    marked = lines.withColumn("_end", F.max(order).over(page)).where(F.col(text).rlike(t.LIST_ITEM)).withColumn("_kind", kind)

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, begin = pdf.sort_values(order), [], 0
        at, kinds, left, end = pdf[order].tolist(), pdf["_kind"].tolist(), pdf[x].tolist(), int(pdf["_end"].iloc[0])
        for i in range(1, len(at) + 1):
            if i == len(at) or kinds[i] != kinds[begin] or abs(left[i] - left[begin]) > slack:
                if i - begin >= least:
                    out += [(a, b - 1) for a, b in zip(at[begin:i], [*at[begin + 1 : i], end + 1], strict=True)]
                begin = i
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(out) for k in keys}, "first": [a for a, _ in out], "last": [b for _, b in out]})

    kinds = dict(lines.dtypes)
    return marked.select(*keys, order, x, "_kind", "_end").groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "first long", "last long"]))


def dispatch(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W-TOC-DISPATCH: ranges of the first recogniser that finds any on a page, in order of certainty."""
    found = [("numbered", toc_runs(lines, keys, order)), ("marker", marker_ranges(lines, keys, order, F.col("text").rlike(t.MARKED))), ("terminal", terminal_ranges(lines, keys, order)), ("list", list_items(lines, keys, order))]
    every = None
    for rank, (name, ranges) in enumerate(found):
        some = ranges.select(*keys, "first", "last", F.lit(name).alias("rule"), F.lit(rank).alias("_rank"))
        every = some if every is None else every.unionByName(some)
    best = F.min("_rank").over(Window.partitionBy(*keys))
    return every.withColumn("_best", best).where("_rank = _best").drop("_rank", "_best")
