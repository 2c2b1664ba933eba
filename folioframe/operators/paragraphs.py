"""Filters, measures and notices of paragraphs, and names, ids and paths of what they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placeholder_only(parts: DataFrame, keys: list[str], formula: Column, text: Column) -> DataFrame:
    """F-PLACEHOLDER-ONLY: keys and whether a paragraph has text, but each of its parts is a formula or white space."""
    blank = F.coalesce(text.rlike(r"^\s+$"), F.lit(False))
    return parts.groupBy(*keys).agg((F.every(formula | blank) & (F.sum(F.length(text)) > 0)).alias("only"))


def translatable_formula(text: Column, y_offset: Column, all_in_layout: Column) -> Column:
    """F-TRANSLATABLE-FORMULA: digits, commas, dots and spaces on the line's height, not all within formula regions."""
    return ~all_in_layout & (y_offset <= 0.1) & text.rlike(r"^[0-9, .]+$")


def dispatch_order(work: DataFrame, tokens: str, seq: str) -> DataFrame:
    """S-PRIO: work with its place; the most tokens first, then first come, first served. Numbers are dealt within
    each priority, whose starts are sums over priorities, so that no single task sorts all rows."""
    priority = (F.lit(1_048_576) - F.col(tokens)).alias("priority")
    each = work.select("*", priority)
    sizes = each.groupBy("priority").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("priority", (F.sum("_n").over(Window.orderBy("priority")) - F.col("_n")).alias("_before"))
    return each.join(starts, "priority").withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy("priority").orderBy(seq))).drop("_before")


def union_render(**kinds: DataFrame) -> DataFrame:
    """U-UNION-RENDER: what a page shows, of several kinds, as one table; columns that a kind lacks are null."""
    out = None
    for name, df in kinds.items():
        each = df.withColumn("kind", F.lit(name))
        out = each if out is None else out.unionByName(each, allowMissingColumns=True)
    return out


def paragraph_measures(chars: DataFrame, keys: list[str], left_out: str) -> DataFrame:
    """P-MAX-HEIGHT, P-LENGTH-EXCEPT: the greatest height, and the width but for given characters."""
    counted = ~F.coalesce(F.col("text").isin(*left_out), F.lit(False))
    return chars.groupBy(*keys).agg(F.max(F.col("y2") - F.col("y")).alias("max_height"), F.sum(F.when(counted, F.col("x2") - F.col("x")).otherwise(0.0)).alias("width"))


def without_role(blocks: DataFrame, role: str = "code") -> DataFrame:
    """L-SKIP-ROLE: blocks that are translated: all but those of a role; a null role is translated."""
    return blocks.where(~F.coalesce(F.col("role") == role, F.lit(False)))


def with_notices(paragraphs: DataFrame, refused: Column, notice: str, height: float = 1.1) -> DataFrame:
    """L-CONTENT-FILTER: a notice above each paragraph that the service refused, beside all paragraphs."""
    added = paragraphs.where(refused).withColumns({"text": F.lit(notice), "y": F.col("y2"), "y2": F.col("y2") + height})
    return paragraphs.withColumn("notice", F.lit(False)).unionByName(added.withColumn("notice", F.lit(True)))


def unique_name(names: DataFrame, base: str) -> DataFrame:
    """A glossary's name that is not among names (column name): the base, or the base with the least free #k.

    The least k that is free follows a number in use (or 0) whose successor is free.
    """
    number = F.when(F.col("name") == base, F.lit(0)).when(F.col("name").rlike(r"#[1-9][0-9]{0,17}$") & (F.regexp_replace("name", "#[0-9]+$", "") == base), F.regexp_extract("name", "#([0-9]+)$", 1).cast("long"))
    used = names.select(number.cast("long").alias("k")).where("k is not null").distinct()
    free = used.select((F.col("k") + 1).alias("k")).join(used, "k", "left_anti").agg(F.min("k").alias("k"))
    taken = used.agg(F.max((F.col("k") == 0).cast("int")).alias("taken"))
    return free.join(taken).select(F.when(F.coalesce("taken", F.lit(0)) == 0, F.lit(base)).otherwise(F.concat(F.lit(f"{base}#"), F.col("k").cast("string"))).alias("name"))


def paragraph_id(*parts: Column) -> Column:
    """An id of a paragraph that any run gives alike, in place of a random one."""
    return F.substring(F.sha2(F.concat_ws("/", *[p.cast("string") for p in parts]), 256), 1, 16)


def split_fragment(href: Column) -> tuple[Column, Column]:
    """(path, fragment) of a link."""
    at = F.instr(href, "#")
    return F.when(at > 0, F.substring(href, F.lit(1), at - 1)).otherwise(href), F.when(at > 0, F.substring(href, at + 1, F.length(href))).otherwise("")


def resolve_path(href: Column, base: Column) -> Column:
    """A link without its fragment as a path from the archive's root: relative to base's folder, `.` and `..`
    resolved; the base itself for a link that is a fragment alone."""
    path = F.url_decode(F.regexp_replace(split_fragment(href)[0], r"\+", "%2B"))
    whole = F.when(path.startswith("/"), F.regexp_replace(path, "^/+", "")).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), path))
    steps = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    up = lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    joined = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/")
    return F.when(path == "", base).otherwise(F.when(joined == "", ".").otherwise(joined))


def css_sizes(sheets: DataFrame, keys: list[str], css: Column) -> DataFrame:
    """keys, class, font_size in em: of flat rules with classes; the last rule of a class counts.

    Blocks of at-rules are left out with what is nested in them. em and rem as they are, % by 100, pt by 12, px by 16.
    """
    flat = F.regexp_replace(css, r"@[^{}]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", "")
    rules = sheets.select(*keys, F.posexplode(F.regexp_extract_all(flat, F.lit(r"([^{}]*\{[^{}]*)\}"), 1)).alias("at", "rule"))
    body = F.lower(F.regexp_extract("rule", r"\{(.*)$", 1))
    size = F.try_element_at(F.regexp_extract_all(body, F.lit(r"(?:^|;)\s*font-size\s*:\s*([^;]*)"), 1), F.lit(-1))
    number, unit = F.regexp_extract(F.trim("size"), r"^(-?[0-9.]+)(em|rem|%|pt|px)?$", 1), F.regexp_extract(F.trim("size"), r"^(-?[0-9.]+)(em|rem|%|pt|px)?$", 2)
    each = rules.select(*keys, "at", F.explode(F.regexp_extract_all(F.regexp_extract("rule", r"^([^{]*)\{", 1), F.lit(r"\.([A-Za-z0-9_-]+)"), 1)).alias("class"), F.when(F.regexp_count(body, F.lit(":")) > 0, size).alias("size"), (F.regexp_count(body, F.lit(":")) > 0).alias("says")).where("says")
    in_em = F.expr("try_cast(number as double)") / F.when(F.col("unit") == "%", 100.0).when(F.col("unit") == "pt", 12.0).when(F.col("unit") == "px", 16.0).otherwise(1.0)
    last = each.groupBy(*keys, "class").agg(F.max_by("size", "at").alias("size"))
    return last.withColumns({"number": number, "unit": unit}).select(*keys, "class", in_em.alias("font_size"))


def hyphen_choices(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """What stands between the two halves (left, right) of a hyphenated word: `seam` at a line's end, where the
    hyphen stays only if the hyphenated form alone is a word of the vocabulary (word), and `inline` within a
    line, where it goes only if the joined form alone is one."""
    left, right = F.lower("left"), F.lower("right")
    known = vocabulary.select(F.lower("word").alias("_word")).distinct().withColumn("_in", F.lit(True))
    marked = pairs.withColumns({"_joined": F.concat(left, right), "_hyphened": F.concat(left, F.lit("-"), right)})
    for c in ("_joined", "_hyphened"):
        marked = marked.join(known.withColumnsRenamed({"_word": c, "_in": f"{c}_in"}), c, "left")
    joined, hyphened = F.coalesce("_joined_in", F.lit(False)), F.coalesce("_hyphened_in", F.lit(False))
    return marked.withColumns({"seam": F.when(hyphened & ~joined, "-").otherwise(""), "inline": F.when(joined & ~hyphened, "").otherwise("-")}).drop("_joined", "_hyphened", "_joined_in", "_hyphened_in")


def font_boxes(fonts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a map of each font to its box (columns font, x, y, x2, y2): of one font the least box."""
    boxes = fonts.groupBy(*keys, "font").agg(F.min(F.struct("x", "y", "x2", "y2")).alias("box"))
    return boxes.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("font", "box")))).alias("boxes"))
