"""Replies of an external engine: parsing, validation, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_start, strip_fence, words_and_marks


def parse(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """L-PARSE: (row, id, output) of a reply: a list, or an object with translations, or one object; fences,
    prose around the JSON and ids as strings are tolerated. A reply that cannot be read gives no row."""
    raw = json_start(strip_fence(F.col(reply)))
    item = "array<struct<id:string,output:string,input:string,text:string>>"
    listed = F.from_json(raw, item)
    wrapped = F.from_json(raw, f"struct<translations:{item}>")["translations"]
    one = F.from_json(raw, item.removeprefix("array<").removesuffix(">"))
    items = F.when(raw.startswith("["), listed).when(wrapped.isNotNull(), wrapped).otherwise(F.array(one))
    return replies.select("*", F.explode(items).alias("_i")).select("*", F.expr("try_cast(_i.id as bigint)").alias("id"), F.coalesce("_i.output", "_i.text", "_i.input").alias("output")).drop("_i").where("id is not null")


def reject_reason(source: Column, output: Column, same_text_check: bool = True) -> Column:
    """L-VALIDATE: why an output is rejected, null if it isn't.

    Tokens are words and marks. Rules: no output; an empty source; over 10 tokens and the same text; tokens
    out of (0.3, 3) of the source's; over 20 tokens and fewer than 5 edits.
    """
    n, m = words_and_marks(source), words_and_marks(output)
    share = F.try_divide(m.cast("double"), n.cast("double"))
    rules = F.when(output.isNull(), F.lit("no output")).when(n == 0, F.lit("empty source"))
    if same_text_check:
        rules = rules.when((n > 10) & (F.trim(source) == F.trim(output)), F.lit("same text"))
    rules = rules.when((share <= 0.3) | (share >= 3), F.lit("length"))
    if same_text_check:
        rules = rules.when((n > 20) & F.levenshtein(source, output, 4).between(0, 4), F.lit("too few edits"))
    return rules


def ids_match(expected: Column, got: Column) -> Column:
    """J-IDMATCH, U-ID-SET-EQ: the same ids, each once."""
    return (F.size(F.array_except(expected, got)) == 0) & (F.size(F.array_except(got, expected)) == 0) & (F.size(got) == F.size(expected))


def degrade(items: DataFrame) -> DataFrame:
    """L-EPUB-DEGRADE, L-FALLBACK: the batch's output if valid, else the single one, else the source."""
    out = F.coalesce("batch_output", "single_output", "source")
    step = F.when(F.col("batch_output").isNotNull(), F.lit("batch")).when(F.col("single_output").isNotNull(), F.lit("single")).otherwise(F.lit("source"))
    return items.withColumns({"output": out, "step": step})


def term_pairs(rows: DataFrame) -> DataFrame:
    """L-TERM-PARSE: trimmed, non-empty pairs; sources under 100 characters; short unchanged ones go."""
    trimmed = rows.withColumns({"source": F.trim("source"), "target": F.trim("target")})
    return trimmed.where((F.length("source").between(1, 99)) & (F.length("target") > 0) & ~((F.col("source") == F.col("target")) & (F.length("source") < 3)))
