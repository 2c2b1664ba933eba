"""Queries over styles, formulas and HTML blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import blocks, styles
from .registry import lines, query, regions, table, words

_STYLE = "CASE (doc_id + line) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS font, (CASE line % 5 WHEN 0 THEN 10 WHEN 1 THEN 10.01 WHEN 2 THEN 12 WHEN 3 THEN 13.5 ELSE 8 END)::DOUBLE AS size, CASE WHEN line % 4 = 0 THEN 'g' END AS state"


def _styled(spark, sf):
    size = F.expr("cast(case line % 5 when 0 then 10 when 1 then 10.01 when 2 then 12 when 3 then 13.5 else 8 end as double)")
    return lines(spark, sf).withColumns({"font": F.expr("case (doc_id + line) % 3 when 0 then 'A' when 1 then 'B' end"), "size": size, "state": F.expr("case when line % 4 = 0 then 'g' end")})


@query(f"""WITH s AS (SELECT doc_id, line, {_STYLE} FROM {{lines}}) SELECT a.doc_id, a.line, a.font IS NOT DISTINCT FROM b.font AND a.state IS NOT DISTINCT FROM b.state AND abs(a.size - b.size) < 0.02 AS equal,
  a.font IS NOT DISTINCT FROM b.font AND a.state IS NOT DISTINCT FROM b.state AND a.size / b.size > 0.7 AND a.size / b.size < 1.3 AS but_size, a.state IS NOT DISTINCT FROM b.state AND abs(a.size - b.size) < 0.02 AS but_font FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.line = a.line + 3""")
def q_style_predicates(spark, sf):
    """P-STYLE-EQ, P-STYLE-EQ-SIZE, P-STYLE-EQ-FONT."""
    s = _styled(spark, sf).select("doc_id", "line", "font", "size", "state")
    j = s.alias("a").join(s.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.line") == F.col("a.line") + 3))
    return j.select("a.doc_id", "a.line", styles.same_style("a", "b").alias("equal"), styles.same_but_size("a", "b").alias("but_size"), styles.same_but_font("a", "b").alias("but_font"))


@query(f"""WITH s AS (SELECT doc_id, line, {_STYLE} FROM {{lines}}), m AS (SELECT * FROM (VALUES ('A', 'X'), ('B', 'X')) v(f, o)), j AS (SELECT a.doc_id, a.line, a.font af, b.font bf, a.size asz, b.size bsz, a.state ast, b.state bst, ma.o ao, mb.o bo FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.line = a.line + 3 LEFT JOIN m ma ON ma.f = a.font LEFT JOIN m mb ON mb.f = b.font)
  SELECT doc_id, line, NOT ((af IS NOT DISTINCT FROM bf AND ast IS NOT DISTINCT FROM bst AND (abs(asz - bsz) < 0.02 OR (asz / bsz > 0.7 AND asz / bsz < 1.3))) OR (ast IS NOT DISTINCT FROM bst AND abs(asz - bsz) < 0.02 AND coalesce(ao = bo, false))) AS needed FROM j""")
def q_needs_placeholder(spark, sf):
    """P-NEEDS-PH, J-FONT, Y-FONTMAP."""
    s = _styled(spark, sf).select("doc_id", "line", "font", "size", "state")
    j = s.alias("a").join(s.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.line") == F.col("a.line") + 3))
    return j.select("a.doc_id", "a.line", styles.needs_placeholder("a", "b", F.create_map(*map(F.lit, ("A", "X", "B", "X")))).alias("needed"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, page_no, line, line % 6 = 5 AS formula, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line) AS k, {_STYLE} FROM {{lines}}),
  r AS (SELECT doc_id, page_no, line, k, 1::BIGINT AS run, font, size, state, NOT formula AS has, formula AS after FROM s WHERE k = 1 UNION ALL
  SELECT s.doc_id, s.page_no, s.line, s.k, r.run + (s.formula OR r.after OR NOT alike)::INT, CASE WHEN s.formula OR alike THEN r.font ELSE s.font END, CASE WHEN s.formula OR alike THEN r.size ELSE s.size END, CASE WHEN s.formula OR alike THEN r.state ELSE s.state END, r.has OR NOT s.formula, s.formula
  FROM r JOIN s ON s.doc_id = r.doc_id AND s.page_no = r.page_no AND s.k = r.k + 1, LATERAL (SELECT r.has AND r.font IS NOT DISTINCT FROM s.font AND r.state IS NOT DISTINCT FROM s.state AND abs(r.size - s.size) < 0.02 AS alike))
  SELECT doc_id, line, run FROM r""")
def q_style_runs(spark, sf):
    """W-RUN-STYLE."""
    return styles.style_runs(_styled(spark, sf).withColumn("formula", F.col("line") % 6 == 5), ["doc_id", "page_no"], "line").select("doc_id", "line", "run")


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k, {_STYLE} FROM {{lines}}), r AS (SELECT doc_id, k, font, size, state FROM s WHERE k = 1 UNION ALL
  SELECT s.doc_id, s.k, CASE WHEN r.size IS NULL OR r.font IS NOT DISTINCT FROM s.font THEN s.font END, CASE WHEN r.size IS NULL THEN s.size WHEN abs(r.size - s.size) < 0.02 THEN r.size END, CASE WHEN r.size IS NULL OR r.state IS NOT DISTINCT FROM s.state THEN s.state END FROM r JOIN s ON s.doc_id = r.doc_id AND s.k = r.k + 1)
  SELECT doc_id, font, size, state FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS n FROM r) WHERE n = 1""")
def q_base_style(spark, sf):
    """A-STYLE-INTERSECT."""
    return styles.base_style(_styled(spark, sf), ["doc_id"], "line")


@query()
def q_classify(spark, sf):
    """W-CLASSIFY, P-PAGE-FORMULAS, F-TRANSFORM-FORMULA."""
    c = F.substring("text", 1, 1)
    each = words(spark, sf).where("text <> ''").withColumns({"size": F.expr("cast(10 - 3 * (word % 4 div 3) as double)"), "starts": t.formula_start(c), "goes_on": t.formula_middle(c)})
    return styles.classify(each, ["doc_id", "line"], "word").select("doc_id", "line", "word", "formula")


@query()
def q_para_islands(spark, sf):
    """W-PARA-ISLANDS."""
    each = words(spark, sf).withColumns({"region": F.expr("line div 4"), "object": F.expr("line div 9"), "area": F.expr("(x2 - x) * (y2 - y)"), "median": F.lit(300.0), "at": F.expr("line * 100000 + word")})
    return styles.islands(each, ["doc_id", "page_no"], "at").select("doc_id", "line", "word", "paragraph")


@query()
def q_stacked(spark, sf):
    """W-STACKED."""
    each = words(spark, sf).selectExpr("doc_id", "line", "word", "y + (word % 3) * 5 + word * 0.0001 as y", "10D as height")
    return styles.stacked(each, ["doc_id", "line"], "word").select("doc_id", "line", "word", "baseline")


@query("""WITH RECURSIVE s AS (SELECT doc_id, page_no, line, line // 7 AS region, regexp_matches(text, '^[0-9 \\t\\n\\r\\f]*$') AS number, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line) AS k FROM {lines}),
  r AS (SELECT doc_id, page_no, line, k, line AS merged, line AS into_, region, false AS seen FROM s WHERE k = 1 UNION ALL
  SELECT s.doc_id, s.page_no, s.line, s.k, CASE WHEN NOT s.number AND r.seen AND s.region = r.region THEN r.into_ ELSE s.line END, CASE WHEN s.number OR r.seen AND s.region = r.region THEN r.into_ ELSE s.line END,
    CASE WHEN s.number OR r.seen AND s.region = r.region THEN r.region ELSE s.region END, s.number OR r.seen AND s.region = r.region FROM r JOIN s ON s.doc_id = r.doc_id AND s.page_no = r.page_no AND s.k = r.k + 1)
  SELECT doc_id, line, merged FROM r""")
def q_lineno_merge(spark, sf):
    """W-LINENO-MERGE."""
    each = lines(spark, sf).select("doc_id", "page_no", "line", F.expr("line div 7").alias("region"), F.lit(1).alias("object"), t.digits_and_space(F.col("text")).alias("number"))
    return styles.merge_numbered(each, ["doc_id", "page_no"], "line").select("doc_id", "line", "merged")


@query("""WITH w AS (SELECT *, word % 3 = 0 AS first, max(x2) OVER (PARTITION BY doc_id, line, word % 3 = 0 ORDER BY x, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {words}),
  s AS (SELECT *, sum((before IS NULL OR x - 5 > before)::INT) OVER (PARTITION BY doc_id, line, first ORDER BY x, word) AS k FROM w)
  SELECT doc_id, line, first, min(word) AS id, min(x) AS x, min(y) AS y, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM s GROUP BY doc_id, line, first, k""")
def q_formula_merge(spark, sf):
    """W-FORMULA-MERGE over all words, those of either role on their own; words of a line share its height."""
    each = words(spark, sf).withColumns({"id": F.col("word"), "first": F.expr("word % 3 = 0")})
    return styles.merge_formulas(each, ["doc_id", "line", "first"])


_OPEN, _SHUT = "c IN ('(', '[', '{')", "c IN (')', ']', '}')"


@query(f"""WITH c AS (SELECT doc_id, line, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM {{lines}} WHERE text <> ''),
  d AS (SELECT *, sum(CASE WHEN {_OPEN} THEN 1 WHEN {_SHUT} THEN -1 ELSE 0 END) OVER w AS s FROM c WINDOW w AS (PARTITION BY doc_id, line ORDER BY i)),
  e AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id, line ORDER BY i)) AS depth FROM d),
  p AS (SELECT *, sum((c = ',' AND depth = 0)::INT) OVER (PARTITION BY doc_id, line ORDER BY i) AS part FROM e),
  n AS (SELECT doc_id, line, part, count(*) - max((part > 0)::INT) AS size FROM p GROUP BY ALL)
  SELECT doc_id, line, (max(part) + 1)::BIGINT AS parts, max(size)::BIGINT AS longest FROM n GROUP BY ALL UNION ALL SELECT doc_id, line, 1, 0 FROM {{lines}} WHERE text = ''""")
def q_formula_split(spark, sf):
    """W-FORMULA-SPLIT, F-SPLIT-FORMULA."""
    parts = lines(spark, sf).select("doc_id", "line", F.explode(styles.split_formula(F.col("text"))).alias("p"))
    return parts.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("parts"), F.max(F.length("p")).cast("long").alias("longest"))


@query()
def q_overlap_fix(spark, sf):
    """W-OVERLAP-FIX."""
    return styles.spread_overlaps(regions(spark, sf), ["doc_id", "page_no"])


@query()
def q_line_cluster(spark, sf):
    """W-LINE-CLUSTER."""
    return styles.cluster_lines(words(spark, sf).withColumn("id", F.expr("line * 100000 + word")), ["doc_id", "page_no"])


@query()
def q_blocks(spark, sf):
    """E-BLOCKS, E-SLOTS, SRC-XHTML; tested on small pages."""
    return blocks.blocks(table(spark, sf, "pages"), "page_id", "html")


_STATS = """SELECT lang, source AS class, count(*) AS n, median(length(trim(text))) AS median_length, median(len(string_split_regex(trim(text), '[ \\t\\n]+'))) AS median_words, round(avg(regexp_matches(trim(text), '[.!?:;"''”’)\\]}]$')::INT), 6) AS ends,
  round(avg((length(regexp_replace(trim(text), '[^\\p{Lu}]', '', 'g')) / nullif(length(regexp_replace(trim(text), '[^\\p{L}]', '', 'g')), 0) > 0.6)::INT), 6) AS upper FROM documents WHERE trim(text) <> '' GROUP BY ALL"""


@query(_STATS.replace("> 0.6)::INT", "> 0.6 AND length(regexp_replace(trim(text), '[^\\p{L}]', '', 'g')) > 0)::INT"))
def q_class_stats(spark, sf):
    """A-CLASS-STATS, with the source for the class."""
    d = table(spark, sf, "documents").withColumnRenamed("source", "class")
    return blocks.class_stats(d, ["lang", "class"]).drop("folios", "code")


@query()
def q_roles(spark, sf):
    """A-ROLE, A-BODY-FONT on the pages' tags; tested on small tables."""
    stats = blocks.class_stats(blocks.blocks(table(spark, sf, "pages"), "page_id", "html").drop("class").withColumnRenamed("tag", "class"), ["class"])
    declared = stats.withColumns({"size": F.when(F.col("class").startswith("h"), F.lit(1.6)), "bold": F.col("class") == "title", "monospace": F.col("class") == "pre", "right": F.lit(False)})
    return blocks.roles(declared).select("class", "n", "role")


@query()
def q_segments(spark, sf):
    """W-JOIN-BLOCKS."""
    each = lines(spark, sf).withColumn("role", F.when(t.code_like(F.col("text")), "code").when(t.folio(F.col("text")), "page_number").otherwise("body"))
    return blocks.segments(each, ["doc_id"], "line").select("doc_id", "line", "role", "segment")


@query("""SELECT role, count(*) AS n, round(sum(length(text))::DOUBLE / sum(sum(length(text))) OVER (), 6) AS share FROM (SELECT lang AS role, text FROM documents) GROUP BY role""")
def q_probe(spark, sf):
    """E-PROBE: blocks and share of characters of each role."""
    from pyspark.sql import Window

    per = table(spark, sf, "documents").groupBy(F.col("lang").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    return per.select("role", "n", F.round(F.col("c").cast("double") / F.sum("c").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


@query("""SELECT doc_id, y, string_agg(text, ' ' ORDER BY x, word) AS joined, min(x) AS x, max(x2) AS x2 FROM {words} GROUP BY doc_id, page_no, y""")
def q_row_words(spark, sf):
    """R-ROW-WORDS: words of a height as one row."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word", "text"))), lambda s: s["text"]), " ")
    return words(spark, sf).groupBy("doc_id", "page_no", "y").agg(row.alias("joined"), F.min("x").alias("x"), F.max("x2").alias("x2")).drop("page_no")


@query("""SELECT doc_id, line, CASE WHEN line >= coalesce(f, 1000000000) THEN 'source' ELSE 'dual' END AS kept FROM {lines} LEFT JOIN (SELECT doc_id, min(line) AS f FROM {lines} WHERE line >= 15 AND regexp_matches(text, '^[0-9]+\\.') GROUP BY doc_id) USING (doc_id)""")
def q_ref_pages(spark, sf):
    """R-REF-PAGES: from the first reference on, the source is kept."""
    l = lines(spark, sf)  # noqa: E741
    first = l.where((F.col("line") >= 15) & F.col("text").rlike(r"^[0-9]+\.")).groupBy("doc_id").agg(F.min("line").alias("f"))
    return l.join(first, "doc_id", "left").select("doc_id", "line", F.when(F.col("line") >= F.coalesce("f", F.lit(1_000_000_000)), "source").otherwise("dual").alias("kept"))



@query("""WITH i AS (SELECT doc_id, line, word, word % 3 = 1 AS formula, x, x2, y + (word % 4) * 2 AS y, y2 + (word % 4) * 2 AS y2 FROM {words}), n AS (SELECT *, lag(formula) OVER w AS lf, lag(x2) OVER w AS lx2, lag(y) OVER w AS ly, lag(y2) OVER w AS ly2, lead(formula) OVER w AS rf, lead(y) OVER w AS ry, lead(y2) OVER w AS ry2 FROM i WINDOW w AS (PARTITION BY doc_id, line ORDER BY word)),
  s AS (SELECT *, CASE WHEN NOT lf THEN greatest(least(y2, ly2) - greatest(y, ly), 0) / least(y2 - y, ly2 - ly) END AS ls, CASE WHEN NOT rf THEN greatest(least(y2, ry2) - greatest(y, ry), 0) / least(y2 - y, ry2 - ry) END AS rs FROM n WHERE formula),
  f AS (SELECT *, coalesce(ls > 0.6, false) AS l0, coalesce(rs > 0.6, false) AS r0 FROM s), g AS (SELECT *, l0 AND NOT (r0 AND ls < rs) AS l, r0 AND NOT (l0 AND rs < ls) AS r FROM f), d AS (SELECT *, CASE WHEN l THEN x - lx2 ELSE 0 END AS dx, CASE WHEN l THEN y - ly WHEN r THEN y - ry ELSE 0 END AS dy FROM g)
  SELECT doc_id, line, word, (CASE WHEN abs(dx) < 0.1 OR dx > 10 OR dx < -5 THEN 0 ELSE dx END)::DOUBLE AS x_offset, (CASE WHEN abs(dy) < 0.1 THEN 0 ELSE dy END)::DOUBLE AS y_offset FROM d""")
def q_formula_offset(spark, sf):
    """W-FORMULA-OFFSET."""
    i = words(spark, sf).selectExpr("doc_id", "line", "word", "word % 3 = 1 as formula", "x", "x2", "y + (word % 4) * 2 as y", "y2 + (word % 4) * 2 as y2")
    return styles.formula_offsets(i, ["doc_id", "line"], "word").select("doc_id", "line", "word", "x_offset", "y_offset")


@query("""WITH c AS (SELECT doc_id, line, 'F' || (line % 3) AS font, line % 4 AS object, (line // 5)::VARCHAR AS paragraph FROM {lines}), n AS (SELECT c.*, coalesce(CASE WHEN object = 2 AND font <> 'F1' THEN 'CMMI10' END, CASE font WHEN 'F0' THEN 'Arial' WHEN 'F1' THEN 'ABCDEF+' || ['txmiaX', 'CMUSerif-Roman', 'Code2000', 'MSTT31', 'MSReference', 'txsys', 'AsanaX', 'Logix', 'NewCM', 'Erewhon', 'Luciole', 'CMR10', 'FiraMono', 'Georgia'][(doc_id % 14 + 1)] END) AS name FROM c)
  SELECT doc_id, paragraph, coalesce(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), []) AS fonts, count(*) FILTER (name IN ('CMMI10', 'ABCDEF+txmiaX', 'ABCDEF+AsanaX', 'ABCDEF+Logix', 'ABCDEF+NewCM', 'ABCDEF+Erewhon', 'ABCDEF+Luciole', 'ABCDEF+FiraMono')) AS formulas FROM n GROUP BY doc_id, paragraph""")
def q_fonts(spark, sf):
    """J-FONT, F-FORMULA-FONT, F-FORMULA-FONT-SCOPE, R-FONTS-BY-PARA."""
    from ..functions.fonts import formula_font

    c = lines(spark, sf).selectExpr("doc_id", "line", "concat('F', line % 3) as font", "line % 4 as object", "cast(line div 5 as string) as paragraph")
    ids = c.select("doc_id").distinct()
    names = F.array(*map(F.lit, ("txmiaX", "CMUSerif-Roman", "Code2000", "MSTT31", "MSReference", "txsys", "AsanaX", "Logix", "NewCM", "Erewhon", "Luciole", "CMR10", "FiraMono", "Georgia")))
    second = F.struct(F.lit("F1").alias("font"), F.concat(F.lit("ABCDEF+"), names[(F.col("doc_id") % 14).cast("int")]).alias("name"))
    page = ids.select("doc_id", F.explode(F.array(F.struct(F.lit("F0").alias("font"), F.lit("Arial").alias("name")), second)).alias("f")).select("doc_id", "f.*")
    own = ids.select("doc_id", F.lit(2).cast("long").alias("object"), F.explode(F.array(F.lit("F0"), F.lit("F2"))).alias("font"), F.lit("CMMI10").alias("name"))
    named = styles.fonts_in_scope(c, page, own)
    formulas = named.groupBy("doc_id", "paragraph").agg(F.sum(F.coalesce(formula_font(F.col("name")), F.lit(False)).cast("int")).cast("long").alias("formulas"))
    keyed = named.withColumn("paragraph", F.concat_ws("/", "doc_id", "paragraph"))
    found = styles.fonts_by_paragraph(keyed, "/[0-9]+$").selectExpr("cast(split(paragraph, '/')[0] as bigint) as doc_id", "split(paragraph, '/')[1] as paragraph", "fonts")
    return found.join(formulas, ["doc_id", "paragraph"])


@query("""SELECT doc_id, line, target, x / 2 AS x, x2 / 2 AS x2, y * 0.75 AS y, y2 * 0.75 AS y2, CASE WHEN line % 3 > 0 THEN 10 * (line % 3) * 0.5 ELSE 10 END::DOUBLE AS size FROM (SELECT *, line % 5 - 1 AS target FROM {lines}) WHERE target >= 0""")
def q_link_scale(spark, sf):
    """R-LINK-SCALE, P-TYPE3."""
    l = lines(spark, sf).withColumn("target", F.col("line") % 5 - 1)  # noqa: E741
    size = styles.effective_size(F.lit(10.0), (F.col("line") % 3) * F.lit(0.5))
    return styles.scale_links(l, F.lit(0.5), F.lit(0.75)).select("doc_id", "line", "target", "x", "x2", "y", "y2", size.alias("size"))
