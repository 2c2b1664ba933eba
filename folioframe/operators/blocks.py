"""HTML and EPUB: blocks, class statistics, roles, segments."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .ordered import fold

#: Tags that make a block, and tags whose content is no text.
BLOCK_TAGS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "dt", "dd", "td", "th", "caption", "figcaption", "div", "title", "footer", "nav")
OPAQUE_TAGS = ("script", "style", "svg", "math")
BLOCKS = "index long, tag string, class string, text string"


class _Blocks(HTMLParser):
    """Innermost block of each text, in document order; tolerant of tags left open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.opaque = 0
        self.out: list[list] = []

    def handle_starttag(self, tag, attrs):
        if tag in OPAQUE_TAGS:
            self.opaque += 1
        elif tag in BLOCK_TAGS:
            if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
                self.stack.pop()
            self.stack.append((tag, dict(attrs).get("class") or ""))
            self.out.append([*self.stack[-1], ""])

    def handle_endtag(self, tag):
        if tag in OPAQUE_TAGS:
            self.opaque = max(0, self.opaque - 1)
        elif tag in [s[0] for s in self.stack]:
            while self.stack.pop()[0] != tag:
                pass
            if self.stack:
                self.out.append([*self.stack[-1], ""])

    def handle_data(self, data):
        if not self.opaque and self.stack and self.out:
            self.out[-1][2] += data


def blocks_of(html: str | None) -> list[tuple[str, str, str]]:
    """(tag, class, text) of blocks with text."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return [(tag, cls, " ".join(text.split())) for tag, cls, text in parser.out if text.strip()]


def blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """E-BLOCKS, E-SLOTS, E-BLOCKSTREAM: ordered blocks of HTML pages, by a tolerant parser in Arrow batches."""

    def run(batches):
        for pdf in batches:
            rows = [(i, k, *b) for i, html in zip(pdf[id_col], pdf[html_col], strict=True) for k, b in enumerate(blocks_of(html))]
            yield pd.DataFrame(rows, columns=[id_col, "index", "tag", "class", "text"])

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {dict(pages.dtypes)[id_col]}, {BLOCKS}")


def class_stats(blocks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A-CLASS-STATS: counts, medians and shares of a class's blocks."""
    s = F.trim(F.col(text))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return blocks.where(s != "").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile(F.length(s), 0.5).alias("median_length"),
        F.percentile(F.size(F.split(s, r"[ \t\n]+")), 0.5).alias("median_words"),
        share(s.rlike(r"""[.!?:;"'”’)\]}]$""")).alias("ends"),
        share(t.folio(s)).alias("folios"),
        share(t.code_like(s)).alias("code"),
        share(F.coalesce(F.try_divide(upper, letters) > 0.6, F.lit(False))).alias("upper"),
    )


def body_size(stats: DataFrame, order: str = "class") -> DataFrame:
    """A-BODY-FONT: the declared size (1 if none) of the most blocks; ties: the first class."""
    sizes = stats.groupBy(F.coalesce("size", F.lit(1.0)).alias("size")).agg(F.sum("n").alias("n"), F.min(order).alias("first"))
    return sizes.orderBy(F.desc("n"), "first").limit(1).select(F.col("size").alias("body_size"))


def roles(stats: DataFrame) -> DataFrame:
    """A-ROLE: the role of each class from its statistics and declaration (size, bold, monospace, right)."""
    sized = stats.join(F.broadcast(body_size(stats)))  # one row
    size = F.coalesce("size", F.lit(1.0))
    label = (F.col("n") > 0) & (F.col("median_words") <= 4) & (F.col("ends") >= 0.5)
    role = (
        F.when(F.col("monospace"), "code")
        .when((F.col("n") >= 5) & (F.col("median_length") <= 8) & (F.col("folios") >= 0.75) & F.col("right"), "page_number")
        .when((F.col("n") >= 5) & (F.col("code") >= 0.35), "code")
        .when(size >= F.col("body_size") * 1.15, "heading")
        .when(F.col("bold") & ~label & (F.col("median_words") <= 12), "heading")
        .when((F.col("n") >= 3) & (F.col("upper") >= 0.6) & (F.col("median_words") <= 10), "heading")
        .when(size <= F.col("body_size") * 0.7, "caption")
        .otherwise("body")
    )
    return sized.withColumn("role", role).drop("body_size")


def segments(blocks: DataFrame, keys: list[str], order: str, most: int = 1200) -> DataFrame:
    """W-JOIN-BLOCKS: numbers of joined blocks of one role; code always joins, text up to `most` characters
    and only while a sentence is unfinished. Columns role, text."""

    def step(state, row):
        number, role, size, ended = state
        text = (row.text or "").strip()
        joins = role == row.role and (role == "code" or (role == "body" and not ended and size + len(text) <= most))
        number, size = (number, size + len(text)) if joins else (number + 1, len(text))
        return number, (number, row.role, size, text[-1:] in ".!?:;\"'”’)]}")

    return fold(blocks, keys, order, "segment long", lambda: (0, None, 0, True), step)
