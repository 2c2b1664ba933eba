"""Glossaries, terms, and the result cache as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, normal_key
from .ordered import first_of, mode_first


def glossary(entries: DataFrame, order: str, target: str | None = None) -> DataFrame:
    """U-DEDUP-KEEP-FIRST, SRC-GLOSS: entries of the target language (or of none), the first of each normal key."""
    if target is not None:
        same = F.replace(F.lower("target_language"), F.lit("_"), F.lit("-")) == F.lit(target.lower().replace("_", "-"))
        entries = entries.where(F.col("target_language").isNull() | same)
    return first_of(entries.withColumn("key", normal_key(F.col("source"))).where("key <> ''"), ["key"], [order])


def choose(user: DataFrame, auto: DataFrame | None, extracting: bool) -> DataFrame:
    """J-GLOSS-CHOICE, U-UNION-GLOSS: the extracted glossary alone while extracting, else both."""
    if auto is None:
        return user
    return auto if extracting else user.unionByName(auto)


def _inside(terms: set[str], most: int = 200_000):
    """Column function: which of `terms`, none with a space inside, a text's words hold, each once."""
    sizes = sorted({len(x) for x in terms})

    def of_word(word: str) -> tuple[str, ...]:
        return tuple({word[i : i + n] for n in sizes for i in range(len(word) - n + 1)} & terms)

    @F.arrow_udf("array<string>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in texts:
            out = []
            for x in batch.to_pylist():
                found: set[str] = set()
                for word in (x or "").split():
                    hits = known.get(word)
                    if hits is None:
                        hits = of_word(word)
                        if len(known) >= most:
                            known.clear()
                        if len(word) <= 64:
                            known[word] = hits
                    if hits:
                        found.update(hits)
                out.append(list(found))
            yield pa.array(out, pa.list_(pa.string()))

    return run


def active_terms(texts: DataFrame, entries: DataFrame, text: str = "text", most: int = 5_000) -> DataFrame:
    """J-GLOSS: (text row, entry) where the text holds the entry's source, A-Z without case.

    A term may start inside a word. At most `most` entries (the count is checked) go to all workers: those without
    spaces are looked up in each text's words, a word once as long as it is remembered, and those with spaces are
    tested against each text. For more, terms and texts meet by shared three-letter pieces: each term by its first,
    each text by all of its own.
    """
    t, e = texts.withColumn("_low", ascii_lower(F.col(text))), entries.withColumn("_src", ascii_lower(F.col("source")))
    hit = F.instr(F.col("_low"), F.col("_src")) > 0
    held = [r["_src"] for r in e.select("_src").where("_src is not null").limit(most + 1).collect()]
    if len(held) <= most:
        words = {x for x in held if x.split() == [x]}
        found = t.withColumn("_src", F.explode(_inside(words)("_low"))).join(F.broadcast(e), "_src").drop("_src", "_low")
        spaced = [x for x in set(held) if x not in words]
        if not spaced:
            return found
        return found.unionByName(t.join(F.broadcast(e.where(F.col("_src").isin(spaced))), hit).drop("_low", "_src"))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_low") - 2, F.lit(1))), lambda i: F.substr("_low", i, F.lit(3))))
    long = t.withColumn("_piece", F.explode(pieces)).join(e.where(F.length("_src") >= 3).withColumn("_head", F.substring("_src", 1, 3)), F.col("_piece") == F.col("_head")).where(hit)
    short = t.join(F.broadcast(e.where(F.length("_src") < 3)), hit)  # at most 2 characters: a bounded number
    return long.drop("_piece", "_head", "_low", "_src").unionByName(short.drop("_low", "_src"))


def vote(pairs: DataFrame, order: str) -> DataFrame:
    """A-TERM-VOTE: the most frequent target of each source; ties: the one seen first."""
    return mode_first(pairs, ["source"], "target", order)


def known(terms: DataFrame, entries: DataFrame) -> DataFrame:
    """G-CONTAINS: terms whose normal key some entry has."""
    return terms.withColumn("_key", normal_key(F.col("term"))).join(entries.select(F.col("key").alias("_key")), "_key", "left_semi").drop("_key")


def cache_key(engine: Column, params: dict[str, str], text: Column) -> Column:
    """C-KEY: engine, parameters in order of their names, exact text."""
    import json

    return F.sha2(F.concat_ws("\x1f", engine, F.lit(json.dumps(params, sort_keys=True, ensure_ascii=False)), text), 256)


def cache_latest(entries: DataFrame, keys: list[str]) -> DataFrame:
    """C-SET: the newest entry of each key."""
    return first_of(entries, keys, [F.desc("id")])


def cache_get(requests: DataFrame, entries: DataFrame, keys: list[str], value: str) -> DataFrame:
    """C-GET: requests with the cached value, null where there is none."""
    return requests.join(cache_latest(entries, keys).select(*keys, value), keys, "left")


def cache_evict(entries: DataFrame, keep: int = 50_000) -> DataFrame:
    """C-EVICT: entries newer than the newest id less `keep`."""
    newest = entries.agg(F.max("id").alias("_newest"))
    return entries.join(F.broadcast(newest), F.col("id") > F.col("_newest") - keep).drop("_newest")


def latest_title(df: DataFrame, keys: list[str], order: str, title: Column) -> Column:
    return F.last(title, True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
