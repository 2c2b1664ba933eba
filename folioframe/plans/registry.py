"""Queries by name with their SQL, and the tables that they share.

Raw documents hold none of the structures that the operators recognise, so queries work on lines
decorated by a rule that Spark and SQL state alike. It adds to lines, before, after or as lines of their own; no text is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL; `{lines}` etc. are the shared tables."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql
            for name, table in (("{words}", WORDS_SQL), ("{regions}", REGIONS_SQL), ("{lines}", LINES_SQL)):
                text = text.replace(name, f"({table})")
            ORACLES[f.__name__] = text
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decoration(line: str) -> str:
    """How a raw line is decorated, by (7 doc_id + line) mod 24; a short text follows it as a line of its own. Valid in Spark and in DuckDB."""
    return f"""CASE (doc_id * 7 + {line}) % 24
  WHEN 0 THEN concat('- ', raw) WHEN 1 THEN concat('■ ', raw) WHEN 2 THEN concat('3. ', raw)
  WHEN 3 THEN concat('1.2 ', raw, ' 17') WHEN 4 THEN concat(raw, chr(10), '204') WHEN 5 THEN concat(raw, chr(10), 'xiv') WHEN 6 THEN concat(raw, chr(10), '(cid:7)')
  WHEN 7 THEN concat(raw, repeat('.', 24)) WHEN 8 THEN concat(raw, '-') WHEN 9 THEN concat('a  b ', raw)
  WHEN 10 THEN concat(raw, chr(10), 'total_sum = foo.bar(1);') WHEN 11 THEN concat(raw, chr(10), '12.5') WHEN 12 THEN concat(raw, chr(10), '  ') WHEN 13 THEN concat('Chapter 4 ', raw)
  WHEN 14 THEN concat(raw, chr(10), 'iv 1 25 51') WHEN 15 THEN concat(raw, chr(10), '1.3 New Hardware 207') WHEN 16 THEN concat(raw, chr(10), 'appendix A')
  WHEN 17 THEN concat(raw, chr(10), 'Channels 1 1 •') WHEN 18 THEN concat(raw, chr(10), 'table of contents') WHEN 19 THEN concat(raw, chr(10), '• item') ELSE raw END"""


LINES_SQL = f"""SELECT *, 40.0::DOUBLE + 15 * (line % 9 // 8) AS x, 40.0::DOUBLE + 15 * (line % 9 // 8) + 5 * length(text) AS x2,
  788.0::DOUBLE - 14 * (line % 50) AS y, 800.0::DOUBLE - 14 * (line % 50) AS y2
FROM (SELECT *, line // 50 AS page_no FROM (SELECT doc_id, unnest(t) AS text, unnest(range(len(t))) AS line
  FROM (SELECT doc_id, string_split(array_to_string(list_transform(string_split(text, chr(10)), lambda raw, i: {decoration('(i - 1)')}), chr(10)), chr(10)) AS t FROM documents)))"""

#: Fixed grid of regions on every page: ten lines each, labels in turn.
LABELS = ("text", "title", "table_text", "formula", "figure", "list_item", "header", "isolate_formula")
REGIONS_SQL = f"""SELECT doc_id, page_no, id, ({list(LABELS)})[(doc_id + id) % 8 + 1] AS label, 40.0::DOUBLE + 100 * (id % 3) AS x,
  240.0::DOUBLE + 100 * (id % 3) AS x2, 660.0::DOUBLE - 140 * (id // 3) AS y, 805.0::DOUBLE - 140 * (id // 3) AS y2
FROM (SELECT DISTINCT doc_id, page_no FROM ({LINES_SQL})), (SELECT unnest(range(15)) AS id)"""

WORDS_SQL = f"""SELECT doc_id, page_no, line, word, text, y, y2, x0 + 5 * pos AS x, x0 + 5 * pos + 5 * length(text) AS x2
FROM (SELECT doc_id, page_no, line, word, text, y, y2, x0,
    coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM (SELECT doc_id, page_no, line, y, y2, x AS x0, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' ')))) AS word FROM ({LINES_SQL})))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, page_no, text, x, y, x2, y2 of decorated lines."""
    decorated = F.expr(f"array_join(transform(split(text, chr(10)), (raw, line) -> {decoration('line')}), chr(10))")
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(decorated, "\n")).alias("line", "text"))
    out = each.withColumn("line", F.col("line").cast("long")).select("doc_id", "line", F.expr("line div 50").alias("page_no"), "text")
    x = F.expr("40D + 15 * (line % 9 div 8)")
    return out.withColumns({"x": x, "x2": x + 5 * F.length("text"), "y": F.expr("788D - 14 * (line % 50)"), "y2": F.expr("800D - 14 * (line % 50)")})


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, line, word, text and box of the words of decorated lines."""
    each = lines(spark, sf_dir).select("doc_id", "page_no", "line", "y", "y2", F.col("x").alias("x0"), F.posexplode(F.split("text", " ")).alias("word", "text"))
    before = Window.partitionBy("doc_id", "line").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("x0") + 5 * F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return each.select("doc_id", "page_no", "line", F.col("word").cast("long").alias("word"), "text", "y", "y2", at.alias("x"), (at + 5 * F.length("text")).alias("x2"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, id, label and box of a fixed grid of regions."""
    pages = lines(spark, sf_dir).select("doc_id", "page_no").distinct()
    each = pages.select("doc_id", "page_no", F.explode(F.expr("sequence(0L, 14L)")).alias("id"))
    label = F.array(*map(F.lit, LABELS))[((F.col("doc_id") + F.col("id")) % 8).cast("int")]
    return each.withColumns(
        {"label": label, "x": F.expr("40D + 100 * (id % 3)"), "x2": F.expr("240D + 100 * (id % 3)"), "y": F.expr("660D - 140 * (id div 3)"), "y2": F.expr("805D - 140 * (id div 3)")}
    )
