"""Joins by box. Every join has the page's keys as an equality, so that it is a hash or merge join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, intersection, ioa, overlaps

#: Labels by priority for a character, most important first; the first place of a label counts.
PRIORITY = (
    "number", "reference", "reference_content", "algorithm", "formula_caption", "isolate_formula", "table_footnote", "table_caption", "figure_caption", "figure_title",
    "chart_title", "table_title", "table_cell_hybrid", "table_text", "wireless_table_cell", "wired_table_cell", "abandon", "title", "abstract", "paragraph_title", "content",
    "doc_title", "footnote", "header", "footer", "seal", "plain text", "tiny text", "author_info_hybrid", "list_item_hybrid", "text", "paragraph_hybrid", "paragraph",
    "table_cell", "figure_text", "list_item", "title", "caption", "footnote_hybrid", "footnote", "formula", "formula_hybrid", "page_header", "page_footer", "reference_hybrid",
    "document_hybrid", "academic_paper_hybrid", "form_or_table_hybrid", "presentation_slide_hybrid", "webpage_screenshot_hybrid", "manga_or_comic_hybrid", "advertisement_hybrid",
    "magazine_or_newspaper_hybrid", "other_hybrid", "table_cell_hybrid", "figure_text_hybrid", "title_hybrid", "caption_hybrid", "code_algo_hybrid", "line_number_hybrid",
    "page_header_hybrid", "page_footer_hybrid", "page_number_hybrid", "unknown_hybrid", "fallback_line", "table", "figure", "image",
)
#: Labels whose regions hold text.
TEXT_LABELS = (
    "plain text", "tiny text", "title", "abandon", "figure_caption", "table_caption", "table_text", "table_footnote", "paragraph_title", "abstract", "content", "figure_title",
    "table_title", "doc_title", "footnote", "header", "footer", "seal", "text", "chart_title", "paragraph", "table_cell", "figure_text", "list_item", "caption", "page_header",
    "page_footer", "wired_table_cell", "wireless_table_cell", "paragraph_hybrid", "table_cell_hybrid", "caption_hybrid", "unknown_hybrid", "figure_text_hybrid",
    "list_item_hybrid", "title_hybrid", "fallback_line", "author_info_hybrid", "page_header_hybrid", "page_footer_hybrid", "footnote_hybrid",
)
BODY_LABELS = ("text", "plain text", "paragraph_hybrid")


def pairs(a: DataFrame, b: DataFrame, keys: list[str], how: str, condition) -> DataFrame:
    """a join b on equal keys and a condition over the aliases a and b."""
    on = condition
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), on, how)


def best_region(chars: DataFrame, regions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """J-CHAR-LAYOUT: each character's region by label priority, then covered share, then id; null if none
    overlaps. Labels without a priority come last."""
    rank = F.create_map(*[F.lit(x) for name in dict.fromkeys(PRIORITY) for x in (name, PRIORITY.index(name))])
    ranked = regions.withColumn("_rank", F.coalesce(rank[F.col("label")], F.lit(len(PRIORITY))))
    a, b = Box.of("a"), Box.of("b")
    joined = pairs(chars, ranked, keys, "left", intersection(a, b) > 0)
    own = Window.partitionBy(*[F.col(f"a.{k}") for k in order]).orderBy(F.asc("b._rank"), F.desc(ioa(a, b)), F.asc("b.id"))
    return joined.withColumn("_n", F.row_number().over(own)).where("_n = 1").select("a.*", F.col("b.id").alias("region"), F.col("b.label").alias("label"))


def first_formula(chars: DataFrame, regions: DataFrame, keys: list[str], order: list[str], share: float = 0.4, second: tuple[str, str, str, str] | None = None) -> DataFrame:
    """J-CHAR-FORMULA: least id of the regions labelled formula that cover more than a share of the character.

    second: columns of the character's other box, which counts where it covers less than 0.2 of the first.
    """
    if second:
        a, b = Box.of(), Box.of(names=second)
        chars = chars.withColumns({c: F.when(ioa(a, b) < 0.2, F.col(o)).otherwise(F.col(c)) for c, o in zip(("x", "y", "x2", "y2"), second, strict=True)})
    joined = pairs(chars, regions.where("label = 'formula'"), keys, "left", ioa(Box.of("a"), Box.of("b")) > share)
    return joined.groupBy(*[F.col(f"a.{k}") for k in order]).agg(F.min("b.id").alias("formula"))


def covered(a: DataFrame, b: DataFrame, keys: list[str], share: float) -> DataFrame:
    """J-CURVE-FIG, J-CURVE-PARA: boxes of which some b covers more than a share."""
    return pairs(a, b, keys, "left_semi", ioa(Box.of("a"), Box.of("b")) > share)


def uncovered(a: DataFrame, b: DataFrame, keys: list[str], share: float) -> DataFrame:
    """U-EXCEPT-CLAIMED: the others."""
    return pairs(a, b, keys, "left_anti", ioa(Box.of("a"), Box.of("b")) > share)


def isolate_formulas(regions: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """J-LAYOUT-ISO: formula regions that no text region covers get the label isolate_formula."""
    texts = regions.where(F.col("label").isin(*TEXT_LABELS)).select(*keys, F.lit(True).alias("_text"), "x", "y", "x2", "y2")
    formulas = regions.where("label = 'formula'")
    alone = uncovered(formulas, texts, keys, share).select(*keys, "id").withColumn("_alone", F.lit(True))
    return regions.join(alone, [*keys, "id"], "left").withColumn("label", F.when(F.col("_alone"), F.lit("isolate_formula")).otherwise(F.col("label"))).drop("_alone")


def overlapping_pairs(boxes: DataFrame, keys: list[str], order: str, height: float = 0.15, width: float = 12.0) -> DataFrame:
    """J-SELF-OVERLAP: pairs of a page that overlap by a share of the smaller height and by a width."""
    a, b = Box.of("a"), Box.of("b")
    tall = F.least(a.y2, b.y2) - F.greatest(a.y, b.y) > F.least(a.y2 - a.y, b.y2 - b.y) * height
    wide = F.least(a.x2, b.x2) - F.greatest(a.x, b.x) > width
    return pairs(boxes, boxes, keys, "inner", tall & wide & (F.col(f"a.{order}") < F.col(f"b.{order}")))


def free_space(boxes: DataFrame, keys: list[str], order: str, right: float, floor: float) -> DataFrame:
    """J-RIGHT-SPACE, J-BOTTOM-SPACE: nearest obstacle to the right and below, else the page's limits."""
    a, b = Box.of("a"), Box.of("b")
    beside = (b.x >= a.x2) & (a.y < b.y2) & (b.y < a.y2)
    below = (b.y2 <= a.y) & (a.x < b.x2) & (b.x < a.x2)
    other = F.col(f"a.{order}") != F.col(f"b.{order}")
    joined = pairs(boxes, boxes, keys, "left", other & (beside | below))
    return joined.groupBy(*[F.col(f"a.{k}").alias(k) for k in [*keys, order]]).agg(
        F.coalesce(F.min(F.when(beside, b.x)), F.lit(right)).alias("right_limit"), F.coalesce(F.max(F.when(below, b.y2)), F.lit(floor)).alias("bottom_limit")
    )


def best_formula(elements: DataFrame, formulas: DataFrame, keys: list[str], order: list[str], far: float = 50.0) -> DataFrame:
    """J-ELEM-FORMULA: an element's formula: one that covers 0.95 of it, else the nearest within reach.

    Ties go to the least id.
    """
    from ..functions.geometry import distance

    a, b = Box.of("a"), Box.of("b")
    exact = ioa(a, b) >= 0.95
    score = F.when(exact, F.lit(1.0)).otherwise(0.5 + 0.4 * (1 - distance(a, b) / far))
    joined = pairs(elements, formulas, keys, "inner", exact | (distance(a, b) < far))
    own = Window.partitionBy(*[F.col(f"a.{k}") for k in order]).orderBy(F.desc(exact), F.desc(score), F.asc("b.id"))
    return joined.withColumn("_score", score).withColumn("_n", F.row_number().over(own)).where("_n = 1").select(*[F.col(f"a.{k}") for k in order], F.col("b.id").alias("formula"), F.round("_score", 6).alias("score"))


def grown(boxes: DataFrame, others: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """J-BOX-SUBSET: boxes grown to hold those others that are nearly the same."""
    from ..functions.geometry import iou

    a, b = Box.of("a"), Box.of("b")
    joined = pairs(boxes, others, keys, "left", iou(a, b) > share)
    size = {"x": F.least, "y": F.least, "x2": F.greatest, "y2": F.greatest}
    pick = {"x": F.min, "y": F.min, "x2": F.max, "y2": F.max}
    return joined.groupBy(*[F.col(f"a.{k}").alias(k) for k in [*keys, "id"]]).agg(*[size[c](F.first(F.col(f"a.{c}")), F.coalesce(pick[c](F.col(f"b.{c}")), F.first(F.col(f"a.{c}")))).alias(c) for c in size])


def band_semi(a: DataFrame, b: DataFrame, keys: list[str], slack: float = 2.5, least: int = 3) -> DataFrame:
    """J-BULLET-ALIGN: rows whose middle lies within a slack of some b's, on pages with enough of each."""
    middle = lambda t: (F.col(f"{t}.y") + F.col(f"{t}.y2")) / 2
    enough = lambda t: t.groupBy(*keys).count().where(F.col("count") >= least).select(*keys)
    a, b = a.join(enough(a), keys, "left_semi"), b.join(enough(b), keys, "left_semi")
    return pairs(a, b, keys, "left_semi", F.abs(middle("a") - middle("b")) <= slack)
