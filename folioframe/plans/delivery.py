"""Queries over requests, progress events, write-back, boxes and descents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import Box, from_letterbox
from ..operators import requests as op
from ..operators import writing
from .registry import lines, query, regions, table, words

_AT = "epoch(ts)::DOUBLE"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("at", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) / 1e6"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_AT} AS tt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  s AS (SELECT user_id, event_id, k, tt AS start FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(e.tt, s.start + 5000.0) FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
  SELECT user_id, event_id, round(start, 3) AS start FROM s""")
def q_rate(spark, sf):
    """B-RATE: events as requests, one in 5,000 seconds a user."""
    return op.at_rate(_events(spark, sf), ["user_id"], ["ts", "event_id"], F.col("at"), 1 / 5000).select("user_id", "event_id", F.round("start", 3).alias("start"))


@query("""SELECT event_id, least(event_id % 130 + 1, 100)::INT AS attempts, list_sum([0.0::DOUBLE] || list_transform(range(1, least(event_id % 130 + 1, 100)), lambda k: CASE WHEN k > 4 THEN 15.0 ELSE 2.0 ** (k - 1) END))::DOUBLE AS waited, event_id % 130 >= 100 AS gave_up FROM events""")
def q_retries(spark, sf):
    """B-RETRY."""
    return op.retried(table(spark, sf, "events").select("event_id"), F.col("event_id") % 130)


_STAGE = "CASE event_type WHEN 'error' THEN 1 ELSE 2 + length(event_type) % 3 END"


@query(f"""WITH u AS (SELECT user_id, ({_STAGE})::BIGINT AS stage_no, row_number() OVER (PARTITION BY user_id, {_STAGE} ORDER BY ts, event_id) AS current, count(*) OVER (PARTITION BY user_id, {_STAGE}) + CASE WHEN user_id % 3 = 0 AND {_STAGE} = 2 THEN 1 ELSE 0 END AS total FROM events),
  l AS (SELECT user_id, stage_no, max(total) AS total, max(current) = max(total) AS whole FROM u GROUP BY ALL),
  b AS (SELECT l.*, (SELECT coalesce(sum(0.1 * p.stage_no), 0) FROM l p WHERE p.user_id = l.user_id AND p.stage_no < l.stage_no AND p.whole)::DOUBLE AS before FROM l),
  e AS (SELECT user_id, stage_no, 'progress_start' AS type, 0 AS current FROM l UNION ALL SELECT user_id, stage_no, 'progress_update', current FROM u UNION ALL SELECT user_id, stage_no, 'progress_end', total FROM l WHERE whole)
  SELECT e.user_id, e.stage_no, e.type, e.current::BIGINT AS current, b.total::BIGINT AS total, round(100.0 * e.current / b.total, 6)::DOUBLE AS stage_progress, round(100 * (b.before + 0.1 * e.stage_no * e.current / b.total), 6)::DOUBLE AS overall FROM e JOIN b USING (user_id, stage_no)""")
def q_stage_events(spark, sf):
    """ST-EVENTS: a user's events as updates of four stages; some runs leave a stage undone."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("stage_no", F.expr(_STAGE).cast("long"))
    own = Window.partitionBy("user_id", "stage_no")
    short = F.when((F.col("user_id") % 3 == 0) & (F.col("stage_no") == 2), 1).otherwise(0)
    u = e.select("user_id", "stage_no", F.concat(F.lit("stage "), "stage_no").alias("stage"), (F.col("stage_no") * 0.1).alias("weight"), F.row_number().over(own.orderBy("ts", "event_id")).cast("long").alias("seq"), (F.count(F.lit(1)).over(own) + short).alias("total")).withColumn("current", F.col("seq"))
    out = op.stage_events(u, ["user_id"])
    return out.select("user_id", "stage_no", "type", "current", "total", F.round("stage_progress", 6).alias("stage_progress"), F.round("overall", 6).alias("overall"))


@query(f"""WITH e AS (SELECT user_id, {_AT} AS tt, event_type AS type FROM events), c AS (SELECT user_id, min(tt) AS stop FROM e WHERE type = 'error' GROUP BY 1)
  SELECT user_id, tt AS "at", type FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = e.user_id AND c.stop <= e.tt) UNION ALL SELECT user_id, stop, 'error' FROM c""")
def q_cancelled(spark, sf):
    """ST-CANCEL, with a user's first error as the moment of cancelling."""
    e = _events(spark, sf).select("user_id", "at", F.col("event_type").alias("type"))
    return op.until_cancelled(e, e.where("type = 'error'").select("user_id", F.col("at").alias("cancelled_at")), ["user_id"])


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 AND text IS NULL THEN 'No translation results available' ELSE 'Translation results:' || chr(10) || concat_ws(chr(10), CASE WHEN source <> '' THEN chr(9) || 'Original PDF: ' || source END,
  CASE WHEN doc_id % 5 > 0 THEN chr(9) || 'Total time: ' || format('{:.2f}', (doc_id % 5) / 4.0) || ' seconds' END, CASE WHEN length(text) IS NOT NULL THEN chr(9) || 'Total valid character count: ' || length(text) END) END AS summary FROM documents""")
def q_summary(spark, sf):
    """R-RESULT, of documents as runs."""
    return table(spark, sf, "documents").select("doc_id", op.summary(original=F.col("source"), seconds=(F.col("doc_id") % 5) / 4, characters=F.length("text")).alias("summary"))


_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_BLOCKS = f"""SELECT doc_id, line // 3 AS segment, line, CASE line % 4 WHEN 0 THEN 'li' ELSE 'p' END AS tag, CASE WHEN line % 5 = 0 THEN 'c' ELSE '' END AS cls, CASE line % 8 WHEN 0 THEN 'ul' ELSE 'body' END AS parent, {_ESCAPED.format('text')} AS body, CASE WHEN (line // 3) % 7 < 6 THEN 'T<' || (line // 3) END AS translation FROM {{lines}}"""
_ELEMENT = "'<' || tag || CASE WHEN cls <> '' THEN ' class=\"' || cls || '\"' ELSE '' END || '>' || body || '</' || tag || '>'"


def _written(mode: str) -> str:
    own = "'<' || h.tag || CASE WHEN h.cls <> '' THEN ' class=\"' || h.cls || '\"' ELSE '' END || '>' || {} || '</' || h.tag || '>'"
    copy = "'<' || h.tag || ' class=\"' || trim(h.cls || ' bdoc-translation') || '\">' || {} || '</' || h.tag || '>'"
    said = _ESCAPED.format("h.translation")
    if mode == "replace":
        out = own.format(f"regexp_extract(h.body, '^\\s*') || {said}")
    elif mode == "bilingual":
        out = "source || " + copy.format(said)
    else:
        pair = "'<div class=\"bdoc-pair\"><div class=\"bdoc-src\">' || {} || '</div><div class=\"bdoc-dst\" lang=\"ko\">' || {} || '</div></div>'"
        inside = "'<' || h.tag || ' class=\"' || trim(h.cls || ' bdoc-paired') || '\">' || " + pair.format("h.body", said) + " || '</' || h.tag || '>' || coalesce(later, '')"
        out = f"CASE WHEN h.parent = 'ul' THEN {inside} ELSE " + pair.format("source", copy.format(said)) + " END"
    return f"""WITH b AS ({_BLOCKS}), s AS (SELECT doc_id, segment, string_agg({_ELEMENT}, '' ORDER BY line) AS source, string_agg({_ELEMENT}, '' ORDER BY line) FILTER (line % 3 > 0) AS later, bool_or(trim(body) <> '') AS worded, min(line) AS line FROM b GROUP BY ALL)
      SELECT s.doc_id, s.segment, CASE WHEN worded AND h.translation IS NOT NULL THEN {out} ELSE source END AS html FROM s JOIN b h ON h.doc_id = s.doc_id AND h.line = s.line"""


def _write_back(spark, sf, mode):
    b = lines(spark, sf).select(
        "doc_id", F.expr("line div 3").alias("segment"), "line", F.expr("case line % 4 when 0 then 'li' else 'p' end").alias("tag"), F.expr("case when line % 5 = 0 then 'c' end").alias("class"),
        F.expr("case line % 8 when 0 then 'ul' else 'body' end").alias("parent"), writing.escaped(F.col("text")).alias("inner"), F.expr("case when (line div 3) % 7 < 6 then concat('T<', line div 3) end").alias("translation"),
    )
    return writing.write_back(b, ["doc_id", "segment"], "line", mode, "ko")


@query(_written("replace"))
def q_write_replace(spark, sf):
    """E-WRITE, replacing: lines as blocks, three a segment."""
    return _write_back(spark, sf, "replace")


@query(_written("bilingual"))
def q_write_bilingual(spark, sf):
    """E-WRITE, the translation after its source."""
    return _write_back(spark, sf, "bilingual")


@query(_written("side_by_side"))
def q_write_pairs(spark, sf):
    """E-WRITE, side by side."""
    return _write_back(spark, sf, "side_by_side")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 's.css' WHEN 1 THEN '../s.css' WHEN 2 THEN '../OPS/s.css' ELSE 'OPS/s.css' END AS href,
  CASE WHEN position('</head>' IN lower(html)) = 0 THEN html ELSE substr(html, 1, position('</head>' IN lower(html)) - 1) || '<link rel="stylesheet" type="text/css" href="s.css"/>' || substr(html, position('</head>' IN lower(html))) END AS html FROM pages""")
def q_style_link(spark, sf):
    """E-STYLE-LINK, on raw pages."""
    href = writing.relative_href(F.expr("case page_id % 4 when 0 then 'OPS/n.html' when 1 then 'OPS/t/n.html' when 2 then 'x/n.html' else 'n.html' end"), F.lit("OPS"), "s.css")
    return table(spark, sf, "pages").select("page_id", href.alias("href"), writing.with_style_link(F.col("html"), F.lit("s.css")).alias("html"))


@query("""WITH RECURSIVE e AS (SELECT doc_id, line, length(text) // 40 + 1 AS size FROM {lines}), f AS (
  SELECT doc_id, line, CASE WHEN size > 30 THEN -1 ELSE 0 END AS box, size AS used FROM e WHERE line = 0 UNION ALL
  SELECT e.doc_id, e.line, CASE WHEN f.box < 0 OR e.size > 30 THEN -1 WHEN f.used + 1 + e.size <= 30 THEN f.box WHEN f.box = 3 THEN -1 ELSE f.box + 1 END, CASE WHEN f.used + 1 + e.size <= 30 THEN f.used + 1 + e.size ELSE e.size END FROM f JOIN e ON e.doc_id = f.doc_id AND e.line = f.line + 1)
  SELECT doc_id, line, box::BIGINT AS box FROM f""")
def q_fill_boxes(spark, sf):
    """R-REF-FILL: lines as entries, in four boxes of 30 rows."""
    e = lines(spark, sf).select("doc_id", "line", F.expr("length(text) div 40 + 1").alias("size"))
    return writing.fill_boxes(e, ["doc_id"], "line", "size", 30, 4).select("doc_id", "line", "box")



@query("""WITH c AS (SELECT doc_id, line, word, line % 5 = 0 AS vertical, CASE word % 4 WHEN 0 THEN -200.0 WHEN 1 THEN -220.0 WHEN 2 THEN 0.0 END::DOUBLE * (8 + line % 3) / 1000 AS d FROM {words}),
  m AS (SELECT doc_id, line, d, row_number() OVER (PARTITION BY doc_id, line ORDER BY count(*) DESC, min(word)) AS k, any_value(vertical) AS vertical FROM c WHERE d IS NOT NULL GROUP BY doc_id, line, d)
  SELECT doc_id, line, round(CASE WHEN vertical THEN d ELSE 0 END, 6)::DOUBLE AS shift_x, round(CASE WHEN vertical THEN 0 ELSE -d END, 6)::DOUBLE AS shift_y FROM m WHERE k = 1""")
def q_descent(spark, sf):
    """P-DESCENT of paragraphs: lines as paragraphs, words as characters."""
    fonts = spark.createDataFrame([(0, -200.0), (1, -220.0), (2, 0.0)], "font long, descent double")
    c = words(spark, sf).withColumns({"font": F.col("word") % 4, "size": F.expr("cast(8 + line % 3 as double)"), "vertical": F.expr("line % 5 = 0")})
    return writing.without_descent(c, fonts, ["doc_id", "line"], "word")[1].select("doc_id", "line", F.round("shift_x", 6).alias("shift_x"), F.round("shift_y", 6).alias("shift_y"))


@query("""SELECT doc_id, line, word, round(x + CASE WHEN line % 5 = 0 THEN d ELSE 0 END, 6) AS x, round(y - CASE WHEN line % 5 = 0 THEN 0 ELSE d END, 6) AS y FROM (SELECT *, coalesce(CASE word % 4 WHEN 0 THEN -200.0 WHEN 1 THEN -220.0 WHEN 2 THEN 0.0 END::DOUBLE, 0) * (8 + line % 3) / 1000 AS d FROM {words})""")
def q_char_descent(spark, sf):
    """P-DESCENT of characters."""
    fonts = spark.createDataFrame([(0, -200.0), (1, -220.0), (2, 0.0)], "font long, descent double")
    c = words(spark, sf).withColumns({"font": F.col("word") % 4, "size": F.expr("cast(8 + line % 3 as double)"), "vertical": F.expr("line % 5 = 0")})
    return writing.without_descent(c, fonts, ["doc_id", "line"], "word")[0].select("doc_id", "line", "word", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH r AS (SELECT *, least(1024.0 / (700 + id), 1024.0 / (500 + 40 * id))::DOUBLE AS g FROM {regions}), p AS (SELECT *, round_even((1024 - (500 + 40 * id) * g) / 2 - 0.1, 0) AS dx, round_even((1024 - (700 + id) * g) / 2 - 0.1, 0) AS dy FROM r)
  SELECT doc_id, page_no, id, round((x - dx) / g, 6) AS x, round((y - dy) / g, 6) AS y, round((x2 - dx) / g, 6) AS x2, round((y2 - dy) / g, 6) AS y2 FROM p""")
def q_scale_boxes(spark, sf):
    """P-SCALE-BOX: regions of 1,024 x 1,024 images on pages of many shapes."""
    r = regions(spark, sf)
    b = from_letterbox(Box(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")), (F.lit(1024.0), F.lit(1024.0)), (F.col("id") + 700, F.col("id") * 40 + 500))
    return r.select("doc_id", "page_no", "id", *(F.round(getattr(b, k), 6).alias(k) for k in ("x", "y", "x2", "y2")))
