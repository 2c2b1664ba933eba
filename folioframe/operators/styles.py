"""Styles, runs and formulas of a line's characters.

A style is (font, size, state). Rules that depend on what came out before are folded over a page's rows in
order (`ordered.fold`): tolerances chain from a run's first row, not from neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import by_group, fold


def same_style(a: str, b: str) -> Column:
    """P-STYLE-EQ: same font and state, sizes less than 0.02 apart; null equals null."""
    return F.col(f"{a}.font").eqNullSafe(F.col(f"{b}.font")) & F.col(f"{a}.state").eqNullSafe(F.col(f"{b}.state")) & close_size(a, b)


def close_size(a: str, b: str) -> Column:
    return F.coalesce(F.abs(F.col(f"{a}.size") - F.col(f"{b}.size")) < 0.02, F.col(f"{a}.size").isNull() & F.col(f"{b}.size").isNull())


def same_but_size(a: str, b: str) -> Column:
    """P-STYLE-EQ-SIZE: same font and state, size ratio within (0.7, 1.3)."""
    ratio = F.try_divide(F.col(f"{a}.size"), F.col(f"{b}.size"))
    return F.col(f"{a}.font").eqNullSafe(F.col(f"{b}.font")) & F.col(f"{a}.state").eqNullSafe(F.col(f"{b}.state")) & F.coalesce((ratio > 0.7) & (ratio < 1.3), F.lit(False))


def same_but_font(a: str, b: str) -> Column:
    """P-STYLE-EQ-FONT: same size and state."""
    return F.col(f"{a}.state").eqNullSafe(F.col(f"{b}.state")) & close_size(a, b)


def needs_placeholder(a: str, b: str, font_map: Column) -> Column:
    """P-NEEDS-PH: a run's style differs from the base in more than size, or in a font that maps to another."""
    mapped = F.coalesce(font_map[F.col(f"{a}.font")] == font_map[F.col(f"{b}.font")], F.lit(False))
    return ~(same_style(a, b) | same_but_size(a, b) | (same_but_font(a, b) & mapped))


def style_runs(chars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W-RUN-STYLE: run numbers; a row joins while its style equals the run's FIRST; a formula stands alone
    and the style before it goes on to be compared with.

    Columns font, size, state, formula (boolean).
    """

    def step(state, row):
        number, style, after_formula = state
        if row.formula:
            return number + 1, (number + 1, style, True)
        alike = lambda a, b: a is b if a is None or b is None else abs(a - b) < 0.02
        same = style is not None and style[0] == row.font and style[2] == row.state and alike(style[1], row.size)
        if same and not after_formula:
            return number, (number, style, False)
        return number + 1, (number + 1, style if same else (row.font, row.size, row.state), False)

    return fold(chars, keys, order, "run long", lambda: (0, None, False), step)


def base_style(styles: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A-STYLE-INTERSECT: parts that styles agree on, in order; once the size is null the next style replaces
    the whole accumulator."""
    kind = "struct<font:string,size:double,state:string>"
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(F.col("font").cast("string").alias("font"), F.col("size").cast("double").alias("size"), F.col("state").cast("string").alias("state")).alias("s")))), lambda x: x["s"])
    nothing = F.lit(None).cast(kind)

    def step(acc: Column, s: Column) -> Column:
        keep = lambda f, kind: F.when(acc[f].eqNullSafe(s[f]), acc[f]).otherwise(F.lit(None).cast(kind)).alias(f)
        met = F.struct(keep("font", "string"), F.when(F.abs(acc["size"] - s["size"]) < 0.02, acc["size"]).otherwise(F.lit(None).cast("double")).alias("size"), keep("state", "string"))
        return F.when(acc.isNull() | acc["size"].isNull(), s).otherwise(met)

    return styles.groupBy(*keys).agg(F.aggregate(rows, nothing, step).alias("_s")).select(*keys, "_s.*")


def classify(chars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W-CLASSIFY: whether a character belongs to a formula, by itself, by its neighbour before, or as a corner
    mark: much smaller than the text before it, or as small as the corner mark before it.

    Columns text, size, starts (may begin a formula), goes_on (may continue one).
    """

    def step(state, row):
        inside, size, corner = state
        known = size is not None and row.size is not None
        small = known and row.size < 0.79 * size
        stays = corner and known and row.size < size / 0.79 and row.size <= 1.1 * 0.79 * size
        corner = bool(small or stays)
        formula = bool(row.starts or corner or (inside and row.goes_on))
        return formula, (formula, size if corner or row.size is None else row.size, corner)

    return fold(chars, keys, order, "formula boolean", lambda: (False, None, False), step)


def islands(chars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W-PARA-ISLANDS: paragraph numbers; a new one at another region (but for a space), another object, or a
    bullet where the paragraph is empty; characters under a twentieth of the median area stay.

    Columns region, object, text, area, median.
    """

    def step(state, row):
        number, region, obj, empty = state
        text = row.text or ""
        blank = not text.strip()
        tiny = row.area is not None and row.median is not None and row.area < 0.05 * row.median
        new = number == 0 or (not tiny and ((row.region != region and not blank) or row.object != obj or (empty and text != "" and text in "■•◦▪")))
        if new:
            number, region, obj, empty = number + 1, row.region, row.object, True
        return number, (number, region, obj, empty and blank)

    return fold(chars, keys, order, "paragraph long", lambda: (0, None, None, True), step)


def stacked(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W-STACKED: glyphs of a tall line by baseline, from the top; a cluster's FIRST glyph sets its y and its
    tolerance max(2, 0.35 height). Columns y, height."""

    def step(state, row):
        number, y = state
        if y is None or abs(y - row.y) > max(2.0, 0.35 * row.height):
            number, y = number + 1, row.y
        return number, (number, y)

    return fold(lines.withColumn("_down", -F.col("y")), keys, "_down", "baseline long", lambda: (0, None), step).drop("_down")


def merge_numbered(paragraphs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W-LINENO-MERGE: bodies parted by line numbers are one; once a number followed a body, every next body
    of the same region and object joins too. Columns region, object, number (digits and spaces alone)."""

    def step(state, row):
        into, region, obj, seen = state
        here = getattr(row, order)
        known = row.region is not None and row.object is not None
        if row.number and into is not None:
            return here, (into, region, obj, True)
        if seen and known and row.region == region and row.object == obj:
            return into, (into, region, obj, True)
        return here, (here, row.region if known else None, row.object if known else None, False)

    return fold(paragraphs, keys, order, "merged long", lambda: (None, None, None, False), step)


def united(boxes: list[tuple], slack: float) -> list[list]:
    """[id, x, y, x2, y2, n] of boxes (id, x, y, x2, y2) in order of x, merged until none touch.

    A stretch that a gap parts from others stays apart whatever merges; one whose boxes share a height is one
    box. Else each box takes in all it touches, with what it has grown to, before the next one comes.
    """
    out, stretch = [], []

    def close():
        left = [[i, x, y, x2, y2, 1] for i, x, y, x2, y2 in stretch]
        if max(b[2] for b in left) < min(b[4] for b in left):
            left = [[min(b[0] for b in left), left[0][1], min(b[2] for b in left), max(b[3] for b in left), max(b[4] for b in left), len(left)]]
        apart: list[list] = []
        for b in left:
            k = 0
            while k < len(apart):
                a = apart[k]
                if a[1] - slack <= b[3] and b[1] - slack <= a[3] and a[2] < b[4] and b[2] < a[4]:
                    b = [min(a[0], b[0]), min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), a[5] + b[5]]
                    del apart[k]
                    k = 0
                else:
                    k += 1
            apart.append(b)
        out.extend(apart)

    end = None
    for box in boxes:
        if stretch and box[1] - slack > end:
            close()
            stretch = []
        end = max(end, box[3]) if stretch else box[3]
        stretch.append(box)
    if stretch:
        close()
    return out


def merge_formulas(formulas: DataFrame, keys: list[str], slack: float = 5.0) -> DataFrame:
    """W-FORMULA-MERGE: formulas of a line whose boxes touch or nearly touch are one, until none do.

    Columns id, x, y, x2, y2; a merged formula has the least id and n, the number of its parts.
    """
    rows = formulas.select(*keys, F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "x2", "y2")])
    return by_group(rows, keys, ["x", "id"], "id long, x double, y double, x2 double, y2 double, n long", lambda boxes: united(boxes, slack))


def split_formula(text: Column) -> Column:
    """W-FORMULA-SPLIT: parts at commas outside brackets; closing brackets too many count for nothing."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.array(F.lit(0)).alias("cuts"))

    def step(acc: Column, c: Column) -> Column:
        depth = F.when(c.isin("(", "[", "{"), acc["depth"] + 1).when(c.isin(")", "]", "}"), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        cut = (c == ",") & (acc["depth"] == 0)
        return F.struct((acc["at"] + 1).alias("at"), depth.alias("depth"), F.when(cut, F.concat(acc["cuts"], F.array(acc["at"] + 1))).otherwise(acc["cuts"]).alias("cuts"))

    ends = F.aggregate(F.split(text, ""), start, step, lambda acc: F.concat(acc["cuts"], F.array(F.length(text) + 1)))
    between = lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.substring(text, F.get(e, k - 1) + 1, F.get(e, k) - F.get(e, k - 1) - 1))
    return F.transform(F.array(ends), between)[0]


def spread_overlaps(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """W-OVERLAP-FIX: vertical overlaps of boxes of a page are split at their middle, 1 to each side, again and
    again; a box within another stays. Columns id, x, y, x2, y2."""

    def made(rows: list[tuple]) -> list[list]:
        b = [list(r) for r in rows]
        # Boxes that are apart sideways never meet, as only heights change.
        beside = [(i, j) for i, a in enumerate(b) for j, c in enumerate(b[i + 1 :], i + 1) if a[1] < c[3] and c[1] < a[3]]
        for _ in range(len(b) ** 2):
            moved = False
            for i, j in beside:
                p, q = (b[i], b[j]) if b[i][4] >= b[j][4] else (b[j], b[i])
                if p[2] >= q[4]:
                    continue
                inside = (p[1] <= q[1] and p[3] >= q[3] and p[2] <= q[2]) or (q[1] <= p[1] and q[3] >= p[3] and q[2] <= p[2] and q[4] >= p[4])
                middle = (p[2] + q[4]) / 2
                if not inside and middle + 1 < p[4] and middle - 1 > q[2]:
                    p[2], q[4], moved = middle + 1, middle - 1, True
            if not moved:
                break
        return b

    rows = boxes.select(*keys, F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "x2", "y2")])
    return by_group(rows, keys, ["id"], "id long, x double, y double, x2 double, y2 double", made)


def cluster_lines(chars: DataFrame, keys: list[str], reach: float = 3.5) -> DataFrame:
    """W-LINE-CLUSTER: characters of a page into lines: bands that overlap by more than half, then neighbours
    within `reach` mean widths. Columns id, x, y, x2, y2; gives id and line."""

    def made(rows: list[tuple]) -> list[tuple]:
        bands, top, low = [], None, None
        for i, x, y, x2, y2 in rows:
            if top is None or (min(top, y2) - max(low, y)) <= 0.5 * min(top - low, y2 - y):
                top, low = y2, y
                bands.append([])
            bands[-1].append((x, i, x2))
        far, line, out = reach * sum(r[3] - r[1] for r in rows) / len(rows), 0, []
        for band in bands:
            end = None
            for x, i, x2 in sorted(band):
                line += end is None or x - end > far
                end = x2
                out.append((i, line))
        return out

    rows = chars.select(*keys, F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "x2", "y2")])
    return by_group(rows, keys, [F.desc("y2"), F.asc("x"), F.asc("id")], "id long, line long", made)


def formula_offsets(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W-FORMULA-OFFSET: shifts of each formula from the text beside it on its line.

    Columns formula (boolean), x, y, x2, y2. The neighbour just before and just after counts if it is text
    that overlaps by more than 0.6 of the smaller height; of two, the one that overlaps more, or both if
    alike. Shifts under 0.1, and those to the left text over 10 or under -5, are 0.
    """
    from pyspark.sql import Window

    from ..functions.geometry import Box, y_ratio

    w = Window.partitionBy(*keys).orderBy(order)
    beside = {f"_{s}{c}": f(c).over(w) for s, f in (("l", F.lag), ("r", F.lead)) for c in ("formula", "x", "y", "x2", "y2")}
    each = items.withColumns(beside).where("formula")
    own = Box.of()
    share = {s: F.when(~F.col(f"_{s}formula"), y_ratio(own, Box.of(names=(f"_{s}x", f"_{s}y", f"_{s}x2", f"_{s}y2")))) for s in "lr"}
    fits = {s: F.coalesce(share[s] > 0.6, F.lit(False)) for s in "lr"}
    left = fits["l"] & ~(fits["r"] & (share["l"] < share["r"]))
    right = fits["r"] & ~(fits["l"] & (share["r"] < share["l"]))
    dx = F.when(left, F.col("x") - F.col("_lx2")).otherwise(0.0)
    dy = F.when(left, F.col("y") - F.col("_ly")).when(right, F.col("y") - F.col("_ry")).otherwise(0.0)
    return each.withColumns({"x_offset": F.when((F.abs(dx) < 0.1) | (dx > 10) | (dx < -5), 0.0).otherwise(dx), "y_offset": F.when(F.abs(dy) < 0.1, 0.0).otherwise(dy)}).drop(*beside)


def effective_size(size: Column, em_height: Column) -> Column:
    """P-TYPE3: font size times the font's em height, where that is a positive number."""
    return F.when((em_height > 0) & ~F.isnan(em_height) & (em_height < float("inf")), size * em_height).otherwise(size)


def fonts_in_scope(chars: DataFrame, page_fonts: DataFrame, object_fonts: DataFrame) -> DataFrame:
    """J-FONT, F-FORMULA-FONT-SCOPE: each character's font name: its object's font of that id, else its page's."""
    a = chars.join(object_fonts.withColumnRenamed("name", "_own"), ["doc_id", "object", "font"], "left")
    return a.join(page_fonts.withColumnRenamed("name", "_page"), ["doc_id", "font"], "left").withColumn("name", F.coalesce("_own", "_page")).drop("_own", "_page")


def fonts_by_paragraph(chars: DataFrame, pattern: str) -> DataFrame:
    """R-FONTS-BY-PARA: fonts of the paragraphs whose id matches, by name."""
    return chars.where(F.col("paragraph").rlike(pattern)).groupBy("paragraph").agg(F.sort_array(F.collect_set("name")).alias("fonts"))


def scale_links(links: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """R-LINK-SCALE: links with a numeric target, their boxes rescaled."""
    return links.where("target >= 0").withColumns({"x": F.col("x") * sx, "x2": F.col("x2") * sx, "y": F.col("y") * sy, "y2": F.col("y2") * sy})
