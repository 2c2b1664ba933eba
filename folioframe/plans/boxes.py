"""Queries over lines, words and regions by their boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import boxes as op
from .registry import lines, query, regions, words

PAGE = ["doc_id", "page_no"]
_RANK = "CASE label " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(op.PRIORITY)) + f" ELSE {len(op.PRIORITY)} END"
_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x, b.x), 0) * greatest(least(a.y2, b.y2) - greatest(a.y, b.y), 0)"
_IOA = f"coalesce({_INTER} / nullif((a.x2 - a.x) * (a.y2 - a.y), 0), 0)"
_DIST = "sqrt(pow(greatest(a.x - b.x2, b.x - a.x2, 0), 2) + pow(greatest(a.y - b.y2, b.y - a.y2, 0), 2))"
_TEXTS = "(" + ", ".join(f"'{x}'" for x in op.TEXT_LABELS) + ")"


@query("SELECT doc_id, page_no, min(x) AS x, min(y) AS y, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM {lines} GROUP BY ALL")
def q_lines_bbox(spark, sf):
    """A-BBOX."""
    return lines(spark, sf).groupBy(*PAGE).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, line, word, region, label FROM (
  SELECT a.doc_id, a.line, a.word, b.id AS region, b.label,
    row_number() OVER (PARTITION BY a.doc_id, a.line, a.word ORDER BY {_RANK.replace('CASE label', 'CASE b.label')}, {_IOA} DESC, b.id) AS n
  FROM {{words}} a LEFT JOIN {{regions}} b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND {_INTER} > 0) WHERE n = 1""")
def q_word_layout_best(spark, sf):
    """J-CHAR-LAYOUT."""
    return op.best_region(words(spark, sf), regions(spark, sf), PAGE, ["doc_id", "line", "word"]).select("doc_id", "line", "word", "region", "label")


@query(f"""SELECT a.doc_id, a.line, a.word, min(b.id) AS formula FROM {{words}} a LEFT JOIN (SELECT * FROM {{regions}} WHERE label = 'formula') b
  ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND {_IOA} > 0.4 GROUP BY ALL""")
def q_word_formula(spark, sf):
    """J-CHAR-FORMULA, F-ISOLATED-FORMULA."""
    return op.first_formula(words(spark, sf), regions(spark, sf), PAGE, ["doc_id", "line", "word"])


@query(f"""SELECT a.doc_id, a.line FROM {{lines}} a WHERE EXISTS (SELECT 1 FROM {{regions}} b WHERE b.label IN ('figure', 'table_text')
  AND a.doc_id = b.doc_id AND a.page_no = b.page_no AND {_IOA} > 0.3)""")
def q_layout_semi(spark, sf):
    """J-CURVE-FIG, J-CURVE-PARA."""
    return op.covered(lines(spark, sf), regions(spark, sf).where("label in ('figure', 'table_text')"), PAGE, 0.3).select("doc_id", "line")


@query(f"""SELECT a.doc_id, a.line FROM {{lines}} a WHERE NOT EXISTS (SELECT 1 FROM {{regions}} b WHERE b.label = 'title'
  AND a.doc_id = b.doc_id AND a.page_no = b.page_no AND {_IOA} > 0.1) AND EXISTS (SELECT 1 FROM {{regions}} b WHERE b.label = 'figure'
  AND a.doc_id = b.doc_id AND a.page_no = b.page_no AND {_IOA} > 0.1)""")
def q_nonformula_lines(spark, sf):
    """J-NONFORMULA-LINES, U-EXCEPT-CLAIMED."""
    r = regions(spark, sf)
    return op.covered(op.uncovered(lines(spark, sf), r.where("label = 'title'"), PAGE, 0.1), r.where("label = 'figure'"), PAGE, 0.1).select("doc_id", "line")


@query(f"""SELECT a.doc_id, a.page_no, a.id, CASE WHEN a.label = 'formula' AND NOT EXISTS (SELECT 1 FROM {{regions}} b WHERE b.label IN {_TEXTS}
  AND a.doc_id = b.doc_id AND a.page_no = b.page_no AND {_IOA} > 0.5) THEN 'isolate_formula' ELSE a.label END AS label FROM {{regions}} a""")
def q_isolated(spark, sf):
    """J-LAYOUT-ISO."""
    return op.isolate_formulas(regions(spark, sf), PAGE).select(*PAGE, "id", "label")


@query("""SELECT a.doc_id, a.page_no, a.id AS first, b.id AS second FROM {regions} a JOIN {regions} b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.id < b.id
  AND least(a.y2, b.y2) - greatest(a.y, b.y) > least(a.y2 - a.y, b.y2 - b.y) * 0.15 AND least(a.x2, b.x2) - greatest(a.x, b.x) > 12""")
def q_overlap_pairs(spark, sf):
    """J-SELF-OVERLAP."""
    return op.overlapping_pairs(regions(spark, sf), PAGE, "id").select("a.doc_id", "a.page_no", F.col("a.id").alias("first"), F.col("b.id").alias("second"))


@query("""SELECT a.doc_id, a.page_no, a.id, coalesce(min(CASE WHEN b.x >= a.x2 AND a.y < b.y2 AND b.y < a.y2 THEN b.x END), 540) AS right_limit,
  coalesce(max(CASE WHEN b.y2 <= a.y AND a.x < b.x2 AND b.x < a.x2 THEN b.y2 END), 44) AS bottom_limit
  FROM {regions} a LEFT JOIN {regions} b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.id <> b.id GROUP BY ALL""")
def q_free_space(spark, sf):
    """J-RIGHT-SPACE, J-BOTTOM-SPACE."""
    return op.free_space(regions(spark, sf), PAGE, "id", 540.0, 44.0)


@query(f"""SELECT doc_id, line, word, formula, round(score, 6) AS score FROM (SELECT a.doc_id, a.line, a.word, b.id AS formula,
    CASE WHEN {_IOA} >= 0.95 THEN 1.0 ELSE 0.5 + 0.4 * (1 - {_DIST} / 50) END AS score,
    row_number() OVER (PARTITION BY a.doc_id, a.line, a.word ORDER BY ({_IOA} >= 0.95) DESC, CASE WHEN {_IOA} >= 0.95 THEN 1.0 ELSE 0.5 + 0.4 * (1 - {_DIST} / 50) END DESC, b.id) AS n
  FROM {{words}} a JOIN (SELECT * FROM {{regions}} WHERE label = 'formula') b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND ({_IOA} >= 0.95 OR {_DIST} < 50)) WHERE n = 1""")
def q_element_formula(spark, sf):
    """J-ELEM-FORMULA."""
    return op.best_formula(words(spark, sf), regions(spark, sf).where("label = 'formula'"), PAGE, ["doc_id", "line", "word"])


@query(f"""SELECT a.doc_id, a.page_no, a.id, least(any_value(a.x), coalesce(min(b.x), any_value(a.x))) AS x, least(any_value(a.y), coalesce(min(b.y), any_value(a.y))) AS y,
    greatest(any_value(a.x2), coalesce(max(b.x2), any_value(a.x2))) AS x2, greatest(any_value(a.y2), coalesce(max(b.y2), any_value(a.y2))) AS y2
  FROM {{regions}} a LEFT JOIN (SELECT doc_id, page_no, x + 1 AS x, y - 1 AS y, x2 + 1 AS x2, y2 + 1 AS y2 FROM {{regions}}) b
  ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND {_INTER} / ((a.x2 - a.x) * (a.y2 - a.y) + (b.x2 - b.x) * (b.y2 - b.y) - {_INTER}) > 0.95 GROUP BY a.doc_id, a.page_no, a.id""")
def q_box_subset(spark, sf):
    """J-BOX-SUBSET: each region against all regions moved and enlarged a little."""
    r = regions(spark, sf)
    moved = r.selectExpr("doc_id", "page_no", "x + 1 as x", "y - 1 as y", "x2 + 1 as x2", "y2 + 1 as y2")
    return op.grown(r, moved, PAGE)


@query("""WITH l AS (SELECT *, (y + y2) / 2 AS m FROM {lines}), t AS (SELECT * FROM l WHERE line % 3 <> 0), b AS (SELECT * FROM l WHERE line % 2 = 0),
  e AS (SELECT doc_id, page_no FROM t GROUP BY ALL HAVING count(*) >= 3 INTERSECT SELECT doc_id, page_no FROM b GROUP BY ALL HAVING count(*) >= 3)
  SELECT t.doc_id, t.line FROM t JOIN e USING (doc_id, page_no) WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = t.doc_id AND b.page_no = t.page_no AND abs(b.m - t.m) <= 2.5)""")
def q_bullet_align(spark, sf):
    """J-BULLET-ALIGN."""
    l = lines(spark, sf)  # noqa: E741
    return op.band_semi(l.where("line % 3 <> 0"), l.where("line % 2 = 0"), PAGE).select("doc_id", "line")


@query(f"""SELECT a.doc_id, a.page_no, a.id, b.id AS other, a.x < b.x2 AND b.x < a.x2 AND a.y < b.y2 AND b.y < a.y2 AS overlap, round({_IOA}, 6) AS ioa,
    round({_INTER} / ((a.x2 - a.x) * (a.y2 - a.y) + (b.x2 - b.x) * (b.y2 - b.y) - {_INTER}), 6) AS iou, round(greatest(least(a.y2, b.y2) - greatest(a.y, b.y), 0) / least(a.y2 - a.y, b.y2 - b.y), 6) AS y_ratio,
    greatest(least(a.x2, b.x2 + 2) - greatest(a.x, b.x - 2), 0) * greatest(least(a.y2, b.y2 + 2) - greatest(a.y, b.y - 2), 0) / ((a.x2 - a.x) * (a.y2 - a.y)) >= 0.95 AS inside,
    round({_DIST}, 6) AS distance, round((b.x2 - b.x) / (a.x2 - a.x), 6) AS scale_x, round(b.x - a.x * ((b.x2 - b.x) / (a.x2 - a.x)), 6) AS shift_x
  FROM {{regions}} a JOIN {{regions}} b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND b.id = (a.id * 7 + 3) % 15""")
def q_box_measures(spark, sf):
    """P-BOX-OVERLAP, P-IOU, P-IOA, P-CONTAIN, P-DIST, P-TRANSFORM."""
    a, b = g.Box.of("a"), g.Box.of("b")
    t = g.transform(a, b)
    r = regions(spark, sf)
    each = op.pairs(r, r, PAGE, "inner", F.col("b.id") == (F.col("a.id") * 7 + 3) % 15)
    return each.select(
        "a.doc_id", "a.page_no", "a.id", F.col("b.id").alias("other"), g.overlaps(a, b).alias("overlap"), F.round(g.ioa(a, b), 6).alias("ioa"), F.round(g.iou(a, b), 6).alias("iou"), F.round(g.y_ratio(a, b), 6).alias("y_ratio"),
        g.contains(b, a).alias("inside"), F.round(g.distance(a, b), 6).alias("distance"), F.round(t["scale_x"], 6).alias("scale_x"), F.round(t["shift_x"], 6).alias("shift_x"),
    )


@query("""SELECT doc_id, page_no, id, greatest(0, least(trunc(x / 3 - 1)::INT, 199))::DOUBLE AS x, greatest(0, least(trunc(300 - y2 / 3 - 1)::INT, 299))::DOUBLE AS y,
  greatest(0, least(trunc(x2 / 3 + 1)::INT, 199))::DOUBLE AS x2, greatest(0, least(trunc(300 - y / 3 + 1)::INT, 299))::DOUBLE AS y2 FROM {regions}""")
def q_page_coordinates(spark, sf):
    """P-COORD."""
    r = regions(spark, sf).selectExpr("doc_id", "page_no", "id", "x / 3 as x", "y / 3 as y", "x2 / 3 as x2", "y2 / 3 as y2")
    b = g.to_page(g.Box.of(), F.lit(200.0), F.lit(300.0))
    return r.select("doc_id", "page_no", "id", *[v.alias(n) for n, v in b._asdict().items()])


@query("""SELECT doc_id, page_no, id, round(x / 100 * 0.5 + y * 2, 6) AS a, round(x / 100 * 3 + y, 6) AS b, round(x2 * 0.5 + 2 * (y2 / 100), 6) AS c, round(x2 * 3 + y2 / 100, 6) AS d,
  (id * 0.5 + 2 * 7 + 5)::DOUBLE AS e, (id * 3 + 7 + 6)::DOUBLE AS f FROM {regions}""")
def q_matrices(spark, sf):
    """P-MATRIX."""
    m = (F.col("x") / 100, F.col("y"), F.col("x2"), F.col("y2") / 100, F.col("id").cast("double"), F.lit(7.0))
    n = tuple(F.lit(v) for v in (0.5, 3.0, 2.0, 1.0, 5.0, 6.0))
    return regions(spark, sf).select("doc_id", "page_no", "id", *[F.round(v, 6).alias(k) for k, v in zip("abcdef", g.multiply(m, n), strict=True)])


@query("""SELECT l.doc_id, l.page_no, l.line, r.n + row_number() OVER (PARTITION BY l.doc_id, l.page_no ORDER BY l.line) AS id, 'fallback_line' AS label
  FROM {lines} l JOIN (SELECT doc_id, page_no, count(*) AS n FROM {regions} GROUP BY ALL) r USING (doc_id, page_no)""")
def q_fallback_lines(spark, sf):
    """W-FALLBACK-LINE: line regions whose ids go on after the page's own."""
    from pyspark.sql import Window

    n = regions(spark, sf).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line"))
    return lines(spark, sf).join(n, PAGE).select(*PAGE, "line", (F.col("n") + at).alias("id"), F.lit("fallback_line").alias("label"))


@query("""SELECT l.doc_id, l.page_no, l.line, least(l.x, r.x) AS x, least(l.y, r.y) AS y, greatest(l.x2, r.x2) AS x2, greatest(l.y2, r.y2) AS y2
  FROM {lines} l JOIN {regions} r ON l.doc_id = r.doc_id AND l.page_no = r.page_no AND r.id = (l.line % 50) // 10 * 3""")
def q_fill_background(spark, sf):
    """P-FILL-BG: union of a paragraph's box and its region's."""
    l, r = lines(spark, sf).alias("l"), regions(spark, sf).alias("r")  # noqa: E741
    on = (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.page_no") == F.col("r.page_no")) & (F.col("r.id") == F.expr("l.line % 50 div 10 * 3"))
    return l.join(r, on).select("l.doc_id", "l.page_no", "l.line", F.least("l.x", "r.x").alias("x"), F.least("l.y", "r.y").alias("y"), F.greatest("l.x2", "r.x2").alias("x2"), F.greatest("l.y2", "r.y2").alias("y2"))
