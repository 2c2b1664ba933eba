"""What is written back: translations in documents, style sheets, entries in boxes, boxes without descent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import fold, mode_first

#: Containers whose children may not be wrapped.
STRICT = ("ul", "ol", "dl", "menu", "tr", "table", "thead", "tbody", "tfoot", "select")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def element(tag: Column, inner: Column, cls: Column | str = "", lang: str | None = None) -> Column:
    """Markup of an element; a null or empty class is left out."""
    c = F.lit(cls) if isinstance(cls, str) else cls
    own = F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(' class="'), c, F.lit('"'))).otherwise("")
    spoken = F.lit(f' lang="{lang}"' if lang else "")
    return F.concat(F.lit("<"), tag, own, spoken, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))


def write_back(blocks: DataFrame, keys: list[str], order: str, mode: str = "side_by_side", lang: str | None = None) -> DataFrame:
    """E-WRITE: keys and `html` of each segment, whose blocks (tag, class, parent, inner, translation) come in order.

    The first block carries the translation. `replace` puts it in place of all blocks, behind the first one's leading
    white space; `bilingual` appends it; `side_by_side` makes two cells, within the first block where its parent's children
    may not be wrapped (further blocks follow it). A null translation, or a segment without text, leaves the source as it is.
    A segment's blocks fit a row.
    """
    if mode not in ("replace", "bilingual", "side_by_side"):
        raise ValueError(f"unknown output mode: {mode}")
    block = F.struct(F.col(order).alias("at"), "tag", F.coalesce("class", F.lit("")).alias("class"), F.coalesce("inner", F.lit("")).alias("inner"), "parent", "translation")
    each = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(block)).alias("b")).withColumn("h", F.col("b")[0])
    h, div = F.col("h"), F.lit("div")
    own = F.transform("b", lambda x: element(x["tag"], x["inner"], x["class"]))
    source, later = F.array_join(own, ""), F.array_join(F.slice(own, 2, F.greatest(F.size("b"), F.lit(1))), "")
    said = escaped(h["translation"])
    copy = element(h["tag"], said, F.trim(F.concat(h["class"], F.lit(" bdoc-translation"))))
    if mode == "replace":
        out = element(h["tag"], F.concat(F.regexp_extract(h["inner"], r"^(\s*)", 1), said), h["class"])
    elif mode == "bilingual":
        out = F.concat(source, copy)
    else:
        pair = lambda left, right: element(div, F.concat(element(div, left, "bdoc-src"), element(div, right, "bdoc-dst", lang)), "bdoc-pair")
        inside = F.concat(element(h["tag"], pair(h["inner"], said), F.trim(F.concat(h["class"], F.lit(" bdoc-paired")))), later)
        out = F.when(F.coalesce(h["parent"].isin(*STRICT), F.lit(False)), inside).otherwise(pair(source, copy))
    worded = F.exists("b", lambda x: F.trim(x["inner"]) != "")
    return each.select(*keys, F.when(worded & h["translation"].isNotNull(), out).otherwise(source).alias("html"))


def relative_href(document: Column, folder: Column, name: str) -> Column:
    """E-STYLE-LINK: the way from a document to a file in the package's folder, both named from the archive's root."""
    at = F.filter(F.split(F.regexp_replace(document, "[^/]*$", ""), "/"), lambda s: s != "")
    to = F.concat(F.filter(F.split(folder, "/"), lambda s: s != ""), F.array(F.lit(name)))
    same = F.zip_with(at, to, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    common = F.when(first == 0, F.least(F.size(at), F.size(to))).otherwise(first - 1).cast("int")
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(at) - common), F.slice(to, common + 1, F.size(to))), "/")


def with_style_link(html: Column, href: Column) -> Column:
    """E-STYLE-LINK: a page with a link to the style sheet at its head's end, once; pages without a head stay."""
    link = F.concat(F.lit('<link rel="stylesheet" type="text/css" href="'), href, F.lit('"/>'))
    at = F.locate("</head>", F.lower(html))
    return F.when((at == 0) | F.contains(html, F.concat(F.lit('href="'), href, F.lit('"'))), html).otherwise(F.concat(F.substring(html, F.lit(1), at - 1), link, F.substring(html, at, F.length(html))))


def fill_boxes(entries: DataFrame, keys: list[str], order: str, size: str, capacity: int, boxes: int, gap: int = 1) -> DataFrame:
    """R-REF-FILL: `box` (from 0) of each entry: boxes are filled in order, with a gap between entries of a box.

    An entry that fits no box, and all after it, and what is beyond the last box, have box -1 (overflow).
    """

    def step(state, row):
        box, used = state
        need = max(row.size or 0, 0)
        if box < 0 or need > capacity:
            return -1, (-1, 0)
        if used is not None and used + gap + need > capacity:
            box, used = box + 1, None
        if box >= boxes:
            return -1, (-1, 0)
        return box, (box, need if used is None else used + gap + need)

    rows = entries.select(*keys, order, F.col(size).cast("long").alias("size"))
    return fold(rows, keys, order, "box long", lambda: (0, None), step)


def without_descent(chars: DataFrame, fonts: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """P-DESCENT: characters (font, size, vertical, x, y, x2, y2) moved by their font's descent, and `shift_x`, `shift_y` of paragraphs (keys).

    A paragraph moves by the most frequent descent of its characters (ties: the first), to the side only if all of those are
    vertical. Characters without a known font stay and don't count.
    """
    known = fonts.groupBy("font").agg(F.max("descent").alias("_descent"))
    each = chars.join(known, "font", "left").withColumn("descent", F.col("_descent") * F.col("size") / 1000).drop("_descent")
    by, side = F.coalesce("descent", F.lit(0.0)), F.coalesce("vertical", F.lit(False))
    across, down = F.when(side, by).otherwise(0.0), F.when(side, 0.0).otherwise(by)
    moved = each.withColumns({"x": F.col("x") + across, "x2": F.col("x2") + across, "y": F.col("y") - down, "y2": F.col("y2") - down})
    counted = each.where("descent is not null")
    most = mode_first(counted, keys, "descent", order).select(*keys, "descent")
    sides = counted.groupBy(*keys).agg(F.every(side).alias("_side"))
    shifts = most.join(sides, keys).select(*keys, F.when(F.col("_side"), F.col("descent")).otherwise(0.0).alias("shift_x"), F.when(F.col("_side"), 0.0).otherwise(-F.col("descent")).alias("shift_y"))
    return moved.drop("descent"), shifts
