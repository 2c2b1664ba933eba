"""Requests to an external engine and the engine's call."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def request_json(items: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """L-PROMPT: a batch's texts as JSON, in order, numbered from 0."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return items.groupBy(*keys).agg(F.to_json(F.transform(rows, lambda x, i: F.struct(i.alias("id"), x["t"].alias("input")))).alias("request"))


def prompt(role: Column, hints: Column, terms: Column, request: Column) -> Column:
    """L-PROMPT: role, hints, terms and the texts, each part left out if empty."""
    part = lambda head, c: F.when(F.length(c) > 0, F.concat(F.lit(head), c))
    return F.concat_ws("\n\n", role, part("Context:\n", hints), part("Terms:\n", terms), part("Texts:\n", request))


def with_placeholders(runs: list[tuple[str, str]], most: int = 400) -> tuple[str, list[tuple[str, str]]]:
    """L-INPUT: a paragraph's text of (kind, text) runs: formulas as <bN>, styled runs between <bN> and </bN+1>.

    Numbers rise by 1 for a formula and by 2 for a styled run. With more than `most` placeholders, styles go.
    """
    styled = sum(kind != "plain" for kind, _ in runs) <= most
    out, kept, n = [], [], 1
    for kind, text in runs:
        if kind == "formula":
            out.append(f"<b{n}>")
            kept.append((f"<b{n}>", text))
            n += 1
        elif kind == "style" and styled:
            out.append(f"<b{n}>{text}</b{n + 1}>")
            kept.append((f"<b{n}>", f"</b{n + 1}>"))
            n += 2
        else:
            out.append(text)
    return "".join(out), kept


def restore(output: str, kept: list[tuple[str, str]], source: str) -> list[tuple[str, str]]:
    """L-RESTORE: (kind, text) runs of an output; placeholders that no run has are dropped unless the source
    has them too."""
    formulas = {a: b for a, b in kept if not b.startswith("</b")}
    pairs = {a: b for a, b in kept if b.startswith("</b")}
    out: list[tuple[str, str]] = []
    at = 0
    plain = lambda s: "".join(p for p in re.split(r"(</?b\d+>)", s) if not re.fullmatch(r"</?b\d+>", p) or p in source and p not in formulas and p not in pairs and p not in pairs.values())
    for m in re.finditer(r"<b\d+>", output):
        if m.start() < at:
            continue
        token = m.group()
        end = output.find(pairs[token], m.end()) if token in pairs else -1
        if token not in formulas and end < 0:
            continue
        out.append(("plain", plain(output[at : m.start()])))
        if token in formulas:
            out.append(("formula", formulas[token]))
            at = m.end()
        else:
            out.append(("style", plain(output[m.end() : end])))
            at = end + len(pairs[token])
    out.append(("plain", plain(output[at:])))
    return [(k, s) for k, s in out if s]


def translate(requests: DataFrame, cache: DataFrame, keys: list[str], engine: Callable[[list[str]], list[str]], text: str = "text") -> DataFrame:
    """L-TRANSLATE: cached outputs, and the engine's for the distinct texts that the cache lacks."""
    from .terms import cache_get

    known = cache_get(requests, cache, keys, "output")
    missing = known.where("output is null").select(*keys, text).distinct()
    kinds = dict(missing.dtypes)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(_new=engine(pdf[text].tolist()))

    done = missing.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in missing.columns), "_new string"])).drop(*[c for c in [text] if c not in keys])
    return known.join(done, keys, "left").withColumn("output", F.coalesce("output", "_new")).drop("_new")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC and runs of Unicode white space as one space; Spark has no such function."""
    return text.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).split()))
