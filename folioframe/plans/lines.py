"""Queries over decorated lines: predicates, aggregates, runs, lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import lists, ordered
from .registry import lines, query, regions, table, words

PAGE = ["doc_id", "page_no"]


def _re(column: str, pattern: str) -> str:
    """DuckDB's test of a pattern; its flag for case stands apart."""
    flag = ", 'i'" if pattern.startswith("(?i)") else ""
    return f"regexp_matches({column}, '{pattern.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}'{flag})"


_T = "trim(text)"
_SIGNS = "(length(text) - length(translate(text, '{}[]()<>=;|&#$@\\/*+_', '')))"
_CODE = f"(coalesce({_SIGNS} / nullif(length(text), 0) >= 0.12, false) OR (regexp_matches(text, '^[ \\t]*[0-9]+[ \\t]') AND {_SIGNS} >= 2) OR {_re('ltrim(text)', t.CODE_START)} OR {_re('text', t.QUOTED)} OR {_re('text', t.SNAKE)} OR {_re('text', t.DOTTED)} OR {_re('text', t.ASSIGNED)})"


@query(f"""SELECT doc_id, line, {_re(_T, t.NUMERIC)} AS is_numeric, length({_T}) <= 8 AND {_re(_T, t.FOLIO)} AS folio, length({_T}) <= 400 AND {_re(_T, t.PAGE_LIST)} AS page_list,
  regexp_matches(text, '^[{t.BULLETS}]') AS bullet, regexp_matches(text, '^[0-9 \\t\\n\\r\\f]*$') AS digits, {_re('text', t.DOT_LEADER)} AS dots,
  {_re('text', t.NUMBERED_START)} AND {_re('text', t.PAGE_END)} AS numbered, {_CODE} AS code FROM {{lines}}""")
def q_line_predicates(spark, sf):
    """F-NUMERIC, F-PAGENUM, F-PAGELIST, F-BULLET, F-DIGIT-SPACE, F-DOTLEADER, F-TOC-NUMBERED, F-CODE."""
    c = F.col("text")
    return lines(spark, sf).select(
        "doc_id", "line", t.numeric(c).alias("is_numeric"), t.folio(c).alias("folio"), t.page_list(c).alias("page_list"), t.bullet(c).alias("bullet"), t.digits_and_space(c).alias("digits"), t.dot_leader(c).alias("dots"), t.numbered_row(c).alias("numbered"), t.code_like(c).alias("code")
    )


@query("""SELECT doc_id, avg(regexp_matches(text, '^\\(cid:[0-9]+\\)$')::INT) > 0.03 AS unmapped, count(*) AS n FROM {lines} GROUP BY doc_id""")
def q_cid_documents(spark, sf):
    """F-CID-PARA, F-CID-DOC, F-CID-DOC-P: share of unmapped glyph texts, with a share that splits these data."""
    return lines(spark, sf).groupBy("doc_id").agg((F.avg(F.col("text").rlike(t.CID).cast("int")) > 0.03).alias("unmapped"), F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, line, page_no FROM {lines} WHERE list_bool_or([page_no + 1 BETWEEN r.lo AND r.hi FOR r IN [{lo: 1, hi: 1}, {lo: 3, hi: 3}, {lo: 6, hi: 999999999}]])""")
def q_page_ranges(spark, sf):
    """F-PAGES, F-PAGE-IN."""
    from ..operators.pages import in_ranges

    return lines(spark, sf).where(in_ranges(F.col("page_no") + 1, "-1,3,6-")).select("doc_id", "line", "page_no")


@query(r"""SELECT doc_id, line, word, contains(c, '(cid:') OR (c <> ' ' AND (regexp_matches(c, '^[\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}\p{Co}]') OR regexp_matches(c, '^[Ͱ-Ͽ]'))) OR regexp_matches(c, '^[0-9\[\]•]') AS starts,
  starts OR c LIKE ',%' AS goes_on FROM (SELECT *, substr(text, 1, 1) AS c FROM {words}) WHERE text <> ''""")
def q_formula_chars(spark, sf):
    """F-FORMULA-START, F-FORMULA-MID on the first character of words."""
    c = F.substring("text", 1, 1)
    return words(spark, sf).where("text <> ''").select("doc_id", "line", "word", t.formula_start(c).alias("starts"), t.formula_middle(c).alias("goes_on"))


@query(r"""SELECT doc_id, sum(length(text))::BIGINT AS chars, sum(length(regexp_replace(text, '[\p{Cc}\p{Co}]', '', 'g')))::BIGINT AS valid, sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]')))::BIGINT AS tokens FROM {lines} GROUP BY doc_id""")
def q_counts(spark, sf):
    """A-COUNTS, F-VALID-CHAR, F-CONTROL, token-count proxy."""
    c = F.col("text")
    return lines(spark, sf).groupBy("doc_id").agg(F.sum(F.length(c)).alias("chars"), F.sum(F.length(F.regexp_replace(c, r"[\p{Cc}\p{Co}]", ""))).alias("valid"), F.sum(t.words_and_marks(c)).cast("long").alias("tokens"))


@query("SELECT doc_id, page_no, round(median(x2 - x), 6) AS median_width, round(median((x2 - x) * (y2 - y)), 6) AS median_area FROM {lines} GROUP BY ALL")
def q_median_line_width(spark, sf):
    """A-MEDIAN-WIDTH, A-MEDIAN-AREA."""
    return lines(spark, sf).groupBy(*PAGE).agg(F.round(F.expr("percentile(x2 - x, 0.5)"), 6).alias("median_width"), F.round(F.expr("percentile((x2 - x) * (y2 - y), 0.5)"), 6).alias("median_area"))


@query("""WITH g AS (SELECT doc_id, page_no, gap FROM (SELECT doc_id, page_no, lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY line) - y2 + (line % 4) AS gap FROM {lines}) WHERE gap > 0)
  SELECT p.doc_id, p.page_no, coalesce(list_sort(list(g.gap) FILTER (g.gap IS NOT NULL))[count(g.gap) // 2 + 1], 10.0) AS spacing FROM (SELECT DISTINCT doc_id, page_no FROM {lines}) p LEFT JOIN g USING (doc_id, page_no) GROUP BY ALL""")
def q_upper_median_spacing(spark, sf):
    """A-UPPER-MEDIAN: 10 where a page has no positive gap."""
    gap = F.lag("y").over(Window.partitionBy(*PAGE).orderBy("line")) - F.col("y2") + F.col("line") % 4
    gaps = F.sort_array(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))))
    return lines(spark, sf).withColumn("gap", gap).groupBy(*PAGE).agg(gaps.alias("g")).select(*PAGE, F.coalesce(F.get("g", F.floor(F.size("g") / 2).cast("int")), F.lit(10.0)).alias("spacing"))


@query("""SELECT doc_id, value, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM (SELECT doc_id, length(text) % 5 AS value, count(*) AS n, min(line) AS first FROM {lines} GROUP BY ALL)) WHERE k = 1""")
def q_mode_first(spark, sf):
    """A-MODE-FIRST."""
    return ordered.mode_first(lines(spark, sf).withColumn("value", F.expr("cast(length(text) % 5 as bigint)")), ["doc_id"], "value", "line")


@query("""SELECT doc_id, least(scale, cap) AS scale, n FROM (SELECT doc_id, line, (40 + line % 7)::DOUBLE / 50 AS scale, count(*) OVER (PARTITION BY doc_id) AS n FROM {lines})
  JOIN (SELECT doc_id, min(v) AS cap FROM (SELECT doc_id, v, n, max(n) OVER (PARTITION BY doc_id) AS top FROM (SELECT doc_id, (40 + line % 7)::DOUBLE / 50 AS v, sum(1 + length(text)) AS n FROM {lines} GROUP BY ALL)) WHERE n = top GROUP BY doc_id) USING (doc_id)""")
def q_scale_cap(spark, sf):
    """A-MODE-MIN, Y-CAP: scales capped at the smallest of the weighted modes."""
    each = lines(spark, sf).withColumn("scale", F.expr("cast(40 + line % 7 as double) / 50"))
    weights = each.groupBy("doc_id", "scale").agg(F.sum(1 + F.length("text")).alias("w"))
    cap = weights.groupBy("doc_id").agg(F.max_by("scale", F.struct("w", -F.col("scale"))).alias("cap"))
    return each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).join(cap, "doc_id").select("doc_id", F.least("scale", "cap").alias("scale"), "n")


@query("SELECT doc_id, coalesce(min(CASE WHEN line % 3 = 0 THEN length(text) END), 100)::BIGINT AS render_order FROM {lines} GROUP BY doc_id")
def q_render_min(spark, sf):
    """A-RENDER-MIN: least order, null-safe, with a default."""
    return lines(spark, sf).groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("line") % 3 == 0, F.length("text"))), F.lit(100)).cast("long").alias("render_order"))


@query("""WITH h AS (SELECT doc_id, page_no, (i)::BIGINT AS bin, sum(d)::BIGINT AS d FROM (SELECT doc_id, page_no, (y * 4)::BIGINT AS i, 1 AS d FROM {lines} UNION ALL SELECT doc_id, page_no, (y2 * 4)::BIGINT, -1 FROM {lines}) GROUP BY ALL)
  SELECT doc_id, page_no, bin, sum(d) OVER (PARTITION BY doc_id, page_no ORDER BY bin)::BIGINT AS n FROM h""")
def q_gap_hist(spark, sf):
    """W-GAP-HIST: how many lines cover each 0.25 of height, from +1 and -1 at their edges."""
    some = lines(spark, sf)
    edge = lambda c, d: some.select(*PAGE, F.round(F.col(c) * 4).cast("long").alias("bin"), F.lit(d).cast("long").alias("d"))
    steps = edge("y", 1).unionAll(edge("y2", -1)).groupBy(*PAGE, "bin").agg(F.sum("d").alias("d"))
    return steps.select(*PAGE, "bin", F.sum("d").over(Window.partitionBy(*PAGE).orderBy("bin")).alias("n"))


@query("""WITH s AS (SELECT doc_id, page_no, y AS sep FROM {lines} WHERE line % 3 = 0), l AS (SELECT *, (y + y2) / 2 AS m FROM {lines})
  SELECT l.doc_id, l.line, count(s.sep) AS row_no FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.page_no = s.page_no AND s.sep >= l.m GROUP BY ALL""")
def q_line_assign(spark, sf):
    """W-LINE-ASSIGN: a character's line is the number of separators at or above its middle."""
    l = lines(spark, sf)  # noqa: E741
    s = l.where("line % 3 = 0").select(F.col("doc_id").alias("d"), F.col("page_no").alias("p"), F.col("y").alias("sep"))
    return l.join(s, (F.col("doc_id") == F.col("d")) & (F.col("page_no") == F.col("p")) & (F.col("sep") >= (F.col("y") + F.col("y2")) / 2), "left").groupBy("doc_id", "line").agg(F.count("sep").alias("row_no"))


@query("""SELECT doc_id, line, word FROM (SELECT *, min(CASE WHEN trim(text) <> '' THEN word END) OVER l AS lo, max(CASE WHEN trim(text) <> '' THEN word END) OVER l AS hi FROM {words} WINDOW l AS (PARTITION BY doc_id, line)) WHERE word BETWEEN lo AND hi""")
def q_trim_lines(spark, sf):
    """W-TRIM-LINE: words between a line's first and last that are not blank; blank lines go."""
    own = Window.partitionBy("doc_id", "line")
    full = F.when(F.trim("text") != "", F.col("word"))
    return words(spark, sf).withColumns({"lo": F.min(full).over(own), "hi": F.max(full).over(own)}).where("word between lo and hi").select("doc_id", "line", "word")


@query("""SELECT doc_id, line, string_agg(CASE WHEN gap > 2 THEN ' ' || text ELSE text END, '' ORDER BY word) AS joined FROM (SELECT *, x - lag(x2) OVER (PARTITION BY doc_id, line ORDER BY word) AS gap FROM {words}) GROUP BY doc_id, line""")
def q_spaces(spark, sf):
    """W-SPACE, P-TEXT, P-LINE-SPACING-TEXT: a line's text rebuilt, with a space where the gap is wide."""
    gap = F.col("x") - F.lag("x2").over(Window.partitionBy("doc_id", "line").orderBy("word"))
    piece = F.when(gap > 2, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    each = words(spark, sf).withColumn("piece", piece)
    return each.groupBy("doc_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "piece"))), lambda s: s["piece"]), "").alias("joined"))


@query("""WITH m AS (SELECT *, median(x2 - x) OVER (PARTITION BY doc_id, page_no) AS med FROM {lines}), f AS (SELECT *, coalesce(lag(x2 - x < 0.8 * med OR regexp_matches(text, '\\.{20,}')) OVER p, false) OR (regexp_matches(text, '^[■•◦]') AND lag(line) OVER p IS NOT NULL) AS splits FROM m WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY line))
  SELECT doc_id, line, sum(splits::BIGINT) OVER (PARTITION BY doc_id, page_no ORDER BY line)::BIGINT AS paragraph FROM f""")
def q_short_line_split(spark, sf):
    """W-MEDIAN-SPLIT: a paragraph ends after a short line or dots, and before a bullet."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    med = lines(spark, sf).groupBy(*PAGE).agg(F.expr("percentile(x2 - x, 0.5)").alias("med"))
    each = lines(spark, sf).join(med, PAGE).withColumn("ends", (F.col("x2") - F.col("x") < 0.8 * F.col("med")) | t.dot_leader(F.col("text")))
    splits = F.coalesce(F.lag("ends").over(w), F.lit(False)) | (F.col("text").rlike("^[■•◦]") & F.lag("line").over(w).isNotNull())
    return ordered.runs(each.withColumn("splits", splits), PAGE, "line", F.col("splits"), "paragraph").select("doc_id", "line", "paragraph")


@query("""WITH f AS (SELECT *, regexp_matches(text, '^[ \\t]*[■▪•◦¡]') AS m FROM {lines}), i AS (SELECT *, sum(m::INT) OVER (PARTITION BY doc_id, page_no ORDER BY line) AS item, sum(m::INT) OVER (PARTITION BY doc_id, page_no) AS n FROM f)
  SELECT doc_id, page_no, min(line) AS first, max(line) AS last FROM i WHERE item > 0 AND n >= 2 GROUP BY doc_id, page_no, item""")
def q_bullet_items(spark, sf):
    """W-BULLET-RANGES."""
    return lists.marker_ranges(lines(spark, sf), PAGE, "line", F.col("text").rlike(t.MARKED))


@query(f"""WITH b AS (SELECT *, regexp_matches(text, '^[ \\t]*[■▪•◦¡]') AS m, {_re('text', t.APPENDIX)} AS a FROM {{lines}}), f AS (SELECT *, (m AND NOT coalesce(lag(a) OVER p, false)) OR (a AND coalesce(lead(m) OVER p, false)) AS s FROM b WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY line)),
  i AS (SELECT *, sum(s::INT) OVER (PARTITION BY doc_id, page_no ORDER BY line) AS item, sum(s::INT) OVER (PARTITION BY doc_id, page_no) AS n FROM f)
  SELECT doc_id, page_no, min(line) AS first, max(line) AS last FROM i WHERE item > 0 AND n >= 2 GROUP BY doc_id, page_no, item""")
def q_bullet_manning(spark, sf):
    """W-BULLET-MANNING."""
    return lists.manning_ranges(lines(spark, sf), PAGE, "line")


@query(f"""WITH f AS (SELECT *, {_re('text', t.TERMINAL_LABEL)}::INT AS e FROM {{lines}}), i AS (SELECT *, sum(e) OVER (PARTITION BY doc_id, page_no ORDER BY line) - e AS r, sum(e) OVER (PARTITION BY doc_id, page_no) AS n FROM f)
  SELECT doc_id, page_no, min(line) AS first, max(line) AS last FROM i WHERE r < n AND n >= 2 GROUP BY doc_id, page_no, r""")
def q_toc_oreilly(spark, sf):
    """W-TOC-OREILLY."""
    return lists.terminal_ranges(lines(spark, sf), PAGE, "line")


@query(f"""SELECT doc_id, page_no, line AS first, line AS last FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no) AS n FROM {{lines}} WHERE {_re('text', t.TRACTION)}) WHERE n >= 2""")
def q_traction(spark, sf):
    """W-TRACTION (two rows are enough here)."""
    return lists.single_rows(lines(spark, sf), PAGE, "line", F.col("text").rlike(t.TRACTION), 2)


@query(f"""WITH c AS (SELECT doc_id, page_no, line, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line) AS k FROM (SELECT *, '1.' || (line % 4) || ' ' || text || ' ' || line AS t2 FROM {{lines}}) WHERE line % 5 <> 4 AND {_re('t2', t.NUMBERED_START)} AND {_re('t2', t.PAGE_END)})
  SELECT doc_id, page_no, min(line) AS first, max(line) AS last FROM c GROUP BY doc_id, page_no, line - k HAVING count(*) >= 2""")
def q_toc_runs(spark, sf):
    """W-TOC-RUNS, on numbered rows whose right edges agree."""
    rows = lines(spark, sf).withColumn("text", F.expr("concat('1.', line % 4, ' ', text, ' ', line)")).where("line % 5 <> 4").withColumn("x2", F.lit(425.0))
    return lists.toc_runs(rows, PAGE, "line")


@query()
def q_list_generic(spark, sf):
    """W-LIST-GENERIC; the fold is tested against a model."""
    return lists.list_items(lines(spark, sf), PAGE, "line")


@query()
def q_toc_dispatch(spark, sf):
    """W-TOC-DISPATCH; tested against a model."""
    return lists.dispatch(lines(spark, sf), PAGE, "line")


@query("""WITH f AS (SELECT *, (length(text) % 3) AS tag, coalesce(length(text) % 3 <> lag(length(text) % 3) OVER p, true) AS new FROM {lines} WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY line)), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, page_no ORDER BY line) AS run FROM f)
  SELECT doc_id, page_no, run::BIGINT AS run, min(line) AS first, max(line) AS last, bool_or(line % 4 = 0) AS corner, count(*) AS n FROM r GROUP BY doc_id, page_no, run""")
def q_tag_runs(spark, sf):
    """W-RUN-TAG: runs of an equal tag with any(corner)."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    tag = F.length("text") % 3
    each = ordered.runs(lines(spark, sf).withColumn("new", F.coalesce(tag != F.lag(tag).over(w), F.lit(True))), PAGE, "line", F.col("new"))
    return each.groupBy(*PAGE, "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.bool_or(F.col("line") % 4 == 0).alias("corner"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT doc_id, line, {_re('text', t.TERMINAL_LABEL)} OR text LIKE '1.%' AS toc, lower(trim(text)) = 'table of contents' AS head, line // 10 AS part FROM {{lines}}), p AS (SELECT doc_id, part, bool_or(head) AS head, sum(toc::INT) >= 2 AS goes FROM r GROUP BY ALL),
  i AS (SELECT *, sum((head OR NOT goes)::INT) OVER (PARTITION BY doc_id ORDER BY part) AS isle FROM p) SELECT doc_id, part FROM (SELECT *, first(head) OVER (PARTITION BY doc_id, isle ORDER BY part) AS led FROM i) WHERE led""")
def q_contents_pages(spark, sf):
    """W-CONTENTS-CONT, A-CONTENTS: a heading starts a run of contents pages that lasts while rows look like contents."""
    c = F.col("text")
    parts = lines(spark, sf).groupBy("doc_id", F.expr("line div 10").alias("part")).agg(F.bool_or(F.lower(F.trim(c)) == "table of contents").alias("head"), (F.sum((c.rlike(t.TERMINAL_LABEL) | c.startswith("1.")).cast("int")) >= 2).alias("goes"))
    isles = ordered.runs(parts, ["doc_id"], "part", F.col("head") | ~F.col("goes"), "isle")
    return isles.withColumn("led", F.first("head").over(Window.partitionBy("doc_id", "isle").orderBy("part"))).where("led").select("doc_id", "part")


@query("""SELECT doc_id, line, last_value(CASE WHEN text LIKE 'Chapter%' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS recent, first_value(CASE WHEN text LIKE 'Chapter%' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM {lines}""")
def q_title_locf(spark, sf):
    """W-TITLE-LOCF, S-FIRST-TITLE, E-CONTEXT."""
    title = F.when(F.col("text").startswith("Chapter"), F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("line")
    return lines(spark, sf).select("doc_id", "line", F.last(title, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("recent"), F.first(title, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))


@query("""WITH h AS (SELECT doc_id, line, regexp_extract(text, '^([0-9]+)\\.([0-9]+) ', 1) AS chapter, text FROM {lines} WHERE regexp_matches(text, '^[0-9]+\\.[0-9]+ ')), f AS (SELECT doc_id, min(line) AS line, chapter FROM h GROUP BY doc_id, chapter),
  s AS (SELECT doc_id, min(line) AS line, text FROM h GROUP BY doc_id, text) SELECT doc_id, line, 1 AS level, 'Chapter ' || chapter AS title FROM f UNION ALL SELECT doc_id, line, 2, text FROM s""")
def q_outline(spark, sf):
    """W-OUTLINE, R-OUTLINE-BASIC: first place of each numbered heading, and a parent for each chapter."""
    heads = lines(spark, sf).where(F.col("text").rlike(r"^[0-9]+\.[0-9]+ ")).withColumn("chapter", F.regexp_extract("text", r"^([0-9]+)\.([0-9]+) ", 1))
    parent = ordered.first_of(heads, ["doc_id", "chapter"], ["line"]).select("doc_id", "line", F.lit(1).alias("level"), F.concat(F.lit("Chapter "), "chapter").alias("title"))
    return parent.unionByName(ordered.first_of(heads, ["doc_id", "text"], ["line"]).select("doc_id", "line", F.lit(2).alias("level"), F.col("text").alias("title")))


@query("""WITH f AS (SELECT doc_id, line, coalesce(y2 - lead(y2) OVER p > 10 AND length(text) % 2 = 0, false) AS fits FROM {lines} WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY line)), g AS (SELECT f.*, l.page_no FROM f JOIN {lines} l USING (doc_id, line)),
  i AS (SELECT *, sum((NOT b)::INT) OVER (PARTITION BY doc_id, page_no ORDER BY line) AS isle FROM (SELECT *, coalesce(lag(fits) OVER (PARTITION BY doc_id, page_no ORDER BY line), false) AS b FROM g)) SELECT doc_id, line, fits AND row_number() OVER (PARTITION BY doc_id, page_no, isle ORDER BY line) % 2 = 1 AS pair_start FROM i""")
def q_column_pairs(spark, sf):
    """J-PAIR-COL."""
    fits = (F.col("y2") - F.lead("y2").over(Window.partitionBy(*PAGE).orderBy("line")) > 10) & (F.length("text") % 2 == 0)
    return ordered.adjacent_pairs(lines(spark, sf), PAGE, "line", fits).select("doc_id", "line", "pair_start")


@query("""WITH p AS (SELECT doc_id, page_no, max(line) AS last, min(line) AS first FROM {lines} WHERE length(text) > 20 GROUP BY ALL) SELECT doc_id, page_no, last, nxt FROM (SELECT *, lead(first) OVER (PARTITION BY doc_id ORDER BY page_no) AS nxt, lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) AS np FROM p) WHERE np = page_no + 1""")
def q_cross_pairs(spark, sf):
    """J-PAIR-NEXT: a page's last body line with the next page's first."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    ends = lines(spark, sf).where(F.length("text") > 20).groupBy(*PAGE).agg(F.max("line").alias("last"), F.min("line").alias("first"))
    return ends.withColumns({"nxt": F.lead("first").over(w), "np": F.lead("page_no").over(w)}).where("np = page_no + 1").select(*PAGE, "last", "nxt")


@query("""SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY ro, so, line) AS at, row_number() OVER (PARTITION BY doc_id, ro ORDER BY line) AS sub_order FROM (SELECT doc_id, line, coalesce(nullif(length(text) % 5, 3), 100) AS ro, coalesce(nullif(line % 4, 2), 50) AS so FROM {lines})""")
def q_render_order(spark, sf):
    """S-RENDER, S-SUBORDER, S-CHAR: stable order with defaults where a value is missing."""
    each = lines(spark, sf).withColumns({"ro": F.expr("coalesce(nullif(length(text) % 5, 3), 100)"), "so": F.expr("coalesce(nullif(line % 4, 2), 50)")})
    return each.select("doc_id", "line", F.row_number().over(Window.partitionBy("doc_id").orderBy("ro", "so", "line")).cast("long").alias("at"), F.row_number().over(Window.partitionBy("doc_id", "ro").orderBy("line")).cast("long").alias("sub_order"))


@query("""SELECT doc_id, line FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {lines}) WHERE before < 600""")
def q_subset(spark, sf):
    """S-SUBSET, S-RANGE: lines until a budget of characters is reached."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines(spark, sf).where("true").withColumn("before", before).where("before < 600").select("doc_id", "line")


@query("""SELECT label, count(*) AS n, min(doc_id * 100000 + line) AS first FROM (SELECT doc_id, line, unnest(list_filter([CASE WHEN regexp_matches(text, '\\b(table of contents|contents)\\b', 'i') THEN 'toc-heading' END, CASE WHEN regexp_matches(text, 'this chapter (covers|cover)', 'i') THEN 'chapter-cover-list' END, CASE WHEN regexp_matches(text, '[■▪•◦]') THEN 'bullet-list' END,
  CASE WHEN len(regexp_extract_all(text, '[0-9]+\\.[0-9]+ ')) >= 3 THEN 'numbered-run' END, CASE WHEN length(text) >= 180 AND len(regexp_extract_all(text, '[ \\t]([0-9]{1,4}|[ivxlcdmIVXLCDM]{1,8})[ \\t]')) >= 3 THEN 'possible-collapsed-rows' END], lambda x: x IS NOT NULL)) AS label FROM {lines}) GROUP BY label""")
def q_audit_labels(spark, sf):
    """A-AUDIT: counts and first example of structural labels."""
    each = lines(spark, sf).select((F.col("doc_id") * 100000 + F.col("line")).alias("at"), F.explode(t.audit_labels(F.col("text"))).alias("label"))
    return each.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


@query("""SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z'']+')) AS w FROM documents) GROUP BY ALL""")
def q_vocabulary(spark, sf):
    """A-VOCAB."""
    return table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z][A-Za-z']+)"))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, unnest(string_split(regexp_replace('refs [1] ' || text, ' \\[', chr(1) || '[', 'g'), chr(1))) AS entry FROM {lines}""")
def q_ref_split(spark, sf):
    """W-REF-SPLIT: a bibliography cut before each [n]."""
    return lines(spark, sf).select("doc_id", F.explode(F.split(F.concat(F.lit("refs [1] "), "text"), r" (?=\[)")).alias("entry"))


@query("""SELECT doc_id, line, r.label, r.label IN ('text', 'plain text', 'paragraph_hybrid') AS body FROM {lines} l JOIN (SELECT doc_id, page_no, id, label FROM {regions}) r USING (doc_id, page_no) WHERE r.id = l.line % 15 AND length(trim(text)) >= 5 AND NOT regexp_matches(text, '^\\(cid:[0-9]+\\)$')
  AND NOT EXISTS (SELECT 1 FROM {lines} d WHERE d.line % 6 = 0 AND d.doc_id = l.doc_id AND d.line = l.line)""")
def q_translatable(spark, sf):
    """F-TRANSLATABLE, F-BODY, F-TEXT-LAYOUT, J-ANTI-DONE."""
    from ..operators.boxes import BODY_LABELS

    l, done = lines(spark, sf), lines(spark, sf).where("line % 6 = 0").select("doc_id", "line")  # noqa: E741
    r = regions(spark, sf).select("doc_id", "page_no", F.col("id"), "label")
    each = l.join(r, PAGE).where("id = line % 15").where((F.length(F.trim("text")) >= 5) & ~F.col("text").rlike(t.CID))
    return each.join(done, ["doc_id", "line"], "left_anti").select("doc_id", "line", "label", F.col("label").isin(*BODY_LABELS).alias("body"))
