"""Queries over paragraphs, names, paths and style sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paragraphs as op
from .registry import lines, query, regions, table, words

#: A link and a style sheet of every line, by its number.
_HREF = "case line % 6 when 0 then 'a/../b c.html#x' when 1 then '#top' when 2 then '/img//p.png' when 3 then '../up.html' when 4 then './d%20e.html#' else 'plain.html' end"
_CSS = "concat('.c', line % 3, ' p, .d {color: red; font-size: ', line % 5, case line % 4 when 0 then 'em' when 1 then '%' when 2 then 'pt' else 'px' end, '} @media print {.c0 {font-size: 9em} .x {top: 1px}} .e {margin:0} .c', line % 3, '{font-size: large }')"


@query("""SELECT doc_id, line, bool_and(word % 3 = 0 OR regexp_full_match(text, '\\s+')) AND sum(length(text)) > 0 AS only FROM {words} GROUP BY doc_id, line""")
def q_placeholder_only(spark, sf):
    """F-PLACEHOLDER-ONLY, with every third word as a formula."""
    return op.placeholder_only(words(spark, sf), ["doc_id", "line"], F.col("word") % 3 == 0, F.col("text"))


@query("""SELECT doc_id, line, word FROM {words} WHERE word % 5 <> 0 AND (word % 4) * 0.05 <= 0.1 AND regexp_matches(text, '^[0-9, .]+$')""")
def q_translatable_formula(spark, sf):
    """F-TRANSLATABLE-FORMULA."""
    return words(spark, sf).where(op.translatable_formula(F.col("text"), (F.col("word") % 4) * 0.05, F.col("word") % 5 == 0)).select("doc_id", "line", "word")


@query("""SELECT doc_id, row_number() OVER (ORDER BY length(coalesce(text, '')) DESC, doc_id) AS place, 1048576 - length(coalesce(text, '')) AS priority FROM documents""")
def q_dispatch_order(spark, sf):
    """S-PRIO, with characters for tokens."""
    d = table(spark, sf, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))
    return op.dispatch_order(d, "tokens", "doc_id").select("doc_id", "place", "priority")


@query("""SELECT kind, doc_id, page_no, count(*) AS n, count(text) AS texts, count(label) AS labels FROM (SELECT 'line' AS kind, doc_id, page_no, text, NULL AS label FROM {lines} UNION ALL SELECT 'region', doc_id, page_no, NULL, label FROM {regions}) GROUP BY ALL""")
def q_render_union(spark, sf):
    """U-UNION-RENDER."""
    both = op.union_render(line=lines(spark, sf), region=regions(spark, sf))
    return both.groupBy("kind", "doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.count("label").alias("labels"))


@query("""SELECT doc_id, page_no, max(y2 - y) AS max_height, sum(CASE WHEN text IN ('•', '-', '■') THEN 0 ELSE x2 - x END)::DOUBLE AS width FROM {words} GROUP BY ALL""")
def q_paragraph_measures(spark, sf):
    """P-MAX-HEIGHT, P-LENGTH-EXCEPT."""
    return op.paragraph_measures(words(spark, sf), ["doc_id", "page_no"], "•-■")


@query("""SELECT doc_id, line FROM {lines} WHERE CASE WHEN line % 7 = 3 THEN NULL WHEN line % 3 = 0 THEN 'code' ELSE 'body' END IS DISTINCT FROM 'code'""")
def q_skip_role(spark, sf):
    """L-SKIP-ROLE."""
    return op.without_role(lines(spark, sf).withColumn("role", F.expr("case when line % 7 = 3 then null when line % 3 = 0 then 'code' else 'body' end"))).select("doc_id", "line")


@query("""SELECT doc_id, line, false AS notice, length(text) AS size, y, y2 FROM {lines} UNION ALL SELECT doc_id, line, true, 7, y2, y2 + 1.1 FROM {lines} WHERE line % 10 = 4""")
def q_notices(spark, sf):
    """L-CONTENT-FILTER, with every tenth line refused."""
    l = lines(spark, sf).select("doc_id", "line", "text", "y", "y2")  # noqa: E741
    return op.with_notices(l, F.col("line") % 10 == 4, "refused").select("doc_id", "line", "notice", F.length("text").cast("long").alias("size"), "y", "y2")


@query("""WITH n AS (SELECT DISTINCT CASE WHEN source = 'src0' THEN 0 ELSE substr(source, 4)::BIGINT END AS k FROM documents WHERE regexp_matches(source, '^src[0-9]+$')) SELECT 'src#' || min(k + 1) AS name FROM n WHERE k + 1 NOT IN (SELECT k FROM n)""")
def q_unique_name(spark, sf):
    """Unique glossary names, with numbered sources for the names in use."""
    names = table(spark, sf, "documents").where(F.col("source").rlike("^src[0-9]+$")).select(F.when(F.col("source") == "src0", "src").otherwise(F.concat(F.lit("src#"), F.substring("source", 4, 20))).alias("name"))
    return op.unique_name(names, "src")


@query("""SELECT doc_id, line, substr(sha256(doc_id || '/' || page_no || '/' || line), 1, 16) AS id FROM {lines}""")
def q_paragraph_ids(spark, sf):
    """Stable ids in place of random base58 ones."""
    return lines(spark, sf).select("doc_id", "line", op.paragraph_id(F.col("doc_id"), F.col("page_no"), F.col("line")).alias("id"))


@query("""SELECT doc_id, line, CASE line % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'top' ELSE '' END AS fragment, CASE line % 6 WHEN 0 THEN 'OPS/t/b c.html' WHEN 1 THEN 'OPS/t/n.html' WHEN 2 THEN 'img/p.png' WHEN 3 THEN 'OPS/up.html' WHEN 4 THEN 'OPS/t/d e.html' ELSE 'OPS/t/plain.html' END AS path FROM {lines}""")
def q_paths(spark, sf):
    """Paths resolved and fragments split."""
    href = F.expr(_HREF)
    return lines(spark, sf).select("doc_id", "line", op.split_fragment(href)[1].alias("fragment"), op.resolve_path(href, F.lit("OPS/t/n.html")).alias("path"))


@query("""WITH s AS (SELECT doc_id, line, (line % 5) / CASE line % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 100.0 WHEN 2 THEN 12.0 ELSE 16.0 END AS em FROM {lines}) SELECT doc_id, line, unnest(['c' || (line % 3), 'd', 'e']) AS class, unnest([NULL, em, NULL])::DOUBLE AS font_size FROM s""")
def q_css_sizes(spark, sf):
    """CSS rules and font sizes: at-rules are left out, a class's last rule counts."""
    return op.css_sizes(lines(spark, sf).select("doc_id", "line", F.expr(_CSS).alias("css")), ["doc_id", "line"], F.col("css"))


@query("""WITH l AS (SELECT doc_id, line, regexp_extract(text, '([A-Za-z]+)[.]?-$', 1) AS l, regexp_extract(lead(text) OVER (PARTITION BY doc_id ORDER BY line), '^([a-z]+)', 1) AS r FROM {lines}), v AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+(?:-[a-z]+)?')) AS w FROM {lines}))
  SELECT doc_id, line, CASE WHEN h.w IS NOT NULL AND j.w IS NULL THEN '-' ELSE '' END AS seam, CASE WHEN j.w IS NOT NULL AND h.w IS NULL THEN '' ELSE '-' END AS inline FROM l LEFT JOIN v j ON j.w = lower(l.l || l.r) LEFT JOIN v h ON h.w = lower(l.l || '-' || l.r) WHERE l.l <> '' AND l.r <> ''""")
def q_hyphens(spark, sf):
    """Hyphen repair at seams and inline, between a line and the next."""
    from pyspark.sql import Window

    l = lines(spark, sf)  # noqa: E741
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("line"))
    pairs = l.select("doc_id", "line", F.regexp_extract("text", "([A-Za-z]+)[.]?-$", 1).alias("left"), F.regexp_extract(after, "^([a-z]+)", 1).alias("right")).where("left <> '' and right <> ''")
    vocabulary = l.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+(?:-[a-z]+)?"), F.lit(0))).alias("word"))
    return op.hyphen_choices(pairs, vocabulary).select("doc_id", "line", "seam", "inline")


@query("""SELECT doc_id, page_no, count(DISTINCT label) AS fonts, min(x) FILTER (label = 'title') AS title_x, bool_or(label = 'title') AS has_title FROM {regions} GROUP BY ALL""")
def q_font_boxes(spark, sf):
    """Maps of fonts to boxes, with labels for fonts."""
    m = op.font_boxes(regions(spark, sf).withColumnRenamed("label", "font"), ["doc_id", "page_no"])
    return m.select("doc_id", "page_no", F.size("boxes").cast("long").alias("fonts"), F.try_element_at("boxes", F.lit("title"))["x"].alias("title_x"), F.map_contains_key("boxes", "title").alias("has_title"))
