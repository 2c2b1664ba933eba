"""Queries over glossaries, batches, replies and the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ordered, pages, replies, terms
from .registry import lines, query, table

_ENTRIES = """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE p_type END AS source, p_brand AS target, CASE p_partkey % 4 WHEN 0 THEN 'zh-CN' WHEN 1 THEN 'ko' WHEN 2 THEN 'zh_cn' END AS target_language FROM part"""
_TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ \t\n\r\f]'))"


def _entries(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey as id", "case when p_partkey % 3 = 0 then upper(p_type) else p_type end as source", "p_brand as target", "case p_partkey % 4 when 0 then 'zh-CN' when 1 then 'ko' when 2 then 'zh_cn' end as target_language"
    )


def _terms(spark, sf) -> DataFrame:
    """Words of the benchmark as a glossary, first place first."""
    each = table(spark, sf, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"))).alias("source"))
    return terms.glossary(each.groupBy("source").agg(F.min("item_id").alias("id")).withColumn("order", F.concat_ws(" ", F.lpad(F.col("id").cast("string"), 12, "0"), "source")), "order")


_TERMS = """SELECT key, source FROM (SELECT lower(source) AS key, source, row_number() OVER (PARTITION BY lower(source) ORDER BY id, source) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS source, min(item_id) AS id FROM benchmark GROUP BY 1)) WHERE n = 1"""


@query(f"""SELECT key, id, source, target FROM (SELECT lower(source) AS key, id, source, target, row_number() OVER (PARTITION BY lower(source) ORDER BY id) AS n FROM ({_ENTRIES}) WHERE target_language IS NULL OR replace(lower(target_language), '_', '-') = 'zh-cn') WHERE n = 1""")
def q_gloss_dedup(spark, sf):
    """U-DEDUP-KEEP-FIRST, SRC-GLOSS: the glossary of one language."""
    return terms.glossary(_entries(spark, sf), "id", "zh_CN").select("key", "id", "source", "target")


@query(f"""SELECT t.key, count(*) AS lines, count(DISTINCT l.doc_id) AS docs FROM {{lines}} l JOIN ({_TERMS}) t ON contains(translate(l.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(t.source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) GROUP BY t.key""")
def q_gloss_active(spark, sf):
    """J-GLOSS, S-GLOSS: in how many lines and documents each term is active."""
    return terms.active_terms(lines(spark, sf), _terms(spark, sf).select("key", "source")).groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("doc_id").alias("docs"))


@query(f"""SELECT t.key FROM (SELECT DISTINCT lower(w) AS key FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{3,}}')) AS w FROM documents)) t WHERE key IN (SELECT key FROM ({_TERMS}))""")
def q_gloss_known(spark, sf):
    """G-CONTAINS, J-GLOSS-CHOICE."""
    each = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"))).alias("w")).select(F.lower("w").alias("term")).distinct()
    return terms.known(each, terms.choose(_terms(spark, sf), None, True)).select(F.col("term").alias("key"))


@query("""SELECT source, target, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS k FROM (SELECT p_type AS source, p_brand AS target, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL)) WHERE k = 1""")
def q_term_vote(spark, sf):
    """A-TERM-VOTE, A-MODE-FIRST."""
    return terms.vote(table(spark, sf, "part").selectExpr("p_type as source", "p_brand as target", "p_partkey"), "p_partkey")


@query("""SELECT source, target FROM (SELECT trim(substr(p_type, 1, 1 + p_partkey % 20)) AS source, trim(CASE WHEN p_partkey % 2 = 0 THEN substr(p_type, 1, 1 + p_partkey % 20) ELSE p_brand END) AS target FROM part) WHERE length(source) BETWEEN 1 AND 99 AND length(target) > 0 AND NOT (source = target AND length(source) < 3)""")
def q_term_pairs(spark, sf):
    """L-TERM-PARSE."""
    return replies.term_pairs(table(spark, sf, "part").selectExpr("substr(p_type, 1, 1 + p_partkey % 20) as source", "case when p_partkey % 2 = 0 then substr(p_type, 1, 1 + p_partkey % 20) else p_brand end as target"))


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, page_no, line, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line) AS k, {_TOKENS.format('text')} AS s FROM {{lines}}),
  r AS (SELECT doc_id, page_no, line, k, s AS total, 1 AS n, 0 AS batch FROM t WHERE k = 1 UNION ALL SELECT t.doc_id, t.page_no, t.line, t.k, CASE WHEN r.total > 200 OR r.n > 5 THEN t.s ELSE r.total + t.s END, CASE WHEN r.total > 200 OR r.n > 5 THEN 1 ELSE r.n + 1 END, CASE WHEN r.total > 200 OR r.n > 5 THEN r.batch + 1 ELSE r.batch END
    FROM r JOIN t ON t.doc_id = r.doc_id AND t.page_no = r.page_no AND t.k = r.k + 1) SELECT doc_id, page_no, line, batch::BIGINT AS batch FROM r""")
def q_batches_llm(spark, sf):
    """B-LLM: a batch ends after the line that makes over 200 tokens or over 5 lines."""
    from ..functions.text import words_and_marks

    return ordered.batches(lines(spark, sf).withColumn("tokens", words_and_marks(F.col("text"))), ["doc_id", "page_no"], "line", "tokens", 200, 5)


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {_TOKENS.format('text')} AS s FROM conversations),
  r AS (SELECT conv_id, turn, k, s AS total, 1 AS n, 0 AS batch FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN r.total > 60 OR r.n > 12 THEN t.s ELSE r.total + t.s END, CASE WHEN r.total > 60 OR r.n > 12 THEN 1 ELSE r.n + 1 END, CASE WHEN r.total > 60 OR r.n > 12 THEN r.batch + 1 ELSE r.batch END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
  SELECT conv_id, turn, batch::BIGINT AS batch FROM r""")
def q_batches_term(spark, sf):
    """B-TERM, with a limit that these short texts reach."""
    from ..functions.text import words_and_marks

    return ordered.batches(table(spark, sf, "conversations").withColumn("tokens", words_and_marks(F.col("text"))), ["conv_id"], "turn", "tokens", 60, 12)


@query("""SELECT doc_id, line, ((row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1) // 6)::BIGINT AS batch, page_no // 2 AS part FROM {lines}""")
def q_batches_fixed(spark, sf):
    """B-EPUB, B-PARTS, chunks of a fixed size."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1
    return lines(spark, sf).select("doc_id", "line", F.floor(at / 6).cast("long").alias("batch"), pages.part(F.col("page_no"), 2).alias("part"))


_REPLIES = """SELECT conv_id, turn, text AS source, CASE (conv_id + turn) % 7 WHEN 0 THEN text WHEN 1 THEN text || '!' WHEN 2 THEN substr(text, 1, 5) WHEN 3 THEN NULL WHEN 4 THEN repeat(text || ' ', 4) WHEN 5 THEN reverse(text) ELSE upper(text) || ' ok' END AS output FROM conversations"""


def _replies(spark, sf) -> DataFrame:
    out = "case (conv_id + turn) % 7 when 0 then text when 1 then concat(text, '!') when 2 then substr(text, 1, 5) when 3 then null when 4 then repeat(concat(text, ' '), 4) when 5 then reverse(text) else concat(upper(text), ' ok') end as output"
    return table(spark, sf, "conversations").selectExpr("conv_id", "turn", "text as source", out)


_REASON = f"""CASE WHEN output IS NULL THEN 'no output' WHEN {_TOKENS.format('source')} = 0 THEN 'empty source' WHEN {_TOKENS.format('source')} > 10 AND trim(source) = trim(output) THEN 'same text'
  WHEN {_TOKENS.format('output')}::DOUBLE / {_TOKENS.format('source')} <= 0.3 OR {_TOKENS.format('output')}::DOUBLE / {_TOKENS.format('source')} >= 3 THEN 'length'
  WHEN {_TOKENS.format('source')} > 20 AND abs(length(source) - length(output)) < 5 AND levenshtein(source, output) < 5 THEN 'too few edits' END"""


@query(f"SELECT conv_id, turn, {_REASON} AS reason FROM ({_REPLIES})")
def q_validate_reply(spark, sf):
    """L-VALIDATE, edit distance."""
    return _replies(spark, sf).select("conv_id", "turn", replies.reject_reason(F.col("source"), F.col("output")).alias("reason"))


@query(f"SELECT reason IS NULL AS ok, step, count(*) AS n FROM (SELECT *, CASE WHEN reason IS NULL THEN 'batch' WHEN turn % 2 = 0 THEN 'single' ELSE 'source' END AS step FROM (SELECT *, {_REASON} AS reason FROM ({_REPLIES}))) GROUP BY ALL")
def q_fallback_counts(spark, sf):
    """L-FALLBACK, L-EPUB-DEGRADE."""
    each = _replies(spark, sf).withColumn("reason", replies.reject_reason(F.col("source"), F.col("output")))
    steps = replies.degrade(each.drop("output").withColumns({"batch_output": F.when(F.col("reason").isNull(), F.lit("x")), "single_output": F.when(F.col("turn") % 2 == 0, F.lit("y"))}))
    return steps.groupBy(F.col("reason").isNull().alias("ok"), "step").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, count(*) AS items, list_sort(list(turn)) = list_sort(list(turn + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END)) AS same FROM conversations GROUP BY conv_id""")
def q_reply_ids(spark, sf):
    """J-IDMATCH, U-ID-SET-EQ on parsed replies, L-PARSE: JSON is written, parsed and matched."""
    shift = F.when(F.col("conv_id") % 3 == 0, F.lit(1)).otherwise(F.lit(0))
    item = F.struct((F.col("turn") + shift).cast("string").alias("id"), F.lit("x").alias("output"))
    asked = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns"), F.concat(F.lit("Here: ```json "), F.to_json(F.collect_list(item)), F.lit(" ```")).alias("reply"))
    got = replies.parse(asked.withColumn("reply", F.regexp_replace("reply", "^Here: ", ""))).groupBy("conv_id").agg(F.collect_list("id").alias("ids"))
    return asked.join(got, "conv_id").select("conv_id", F.size("turns").cast("long").alias("items"), replies.ids_match(F.col("turns"), F.col("ids")).alias("same"))


_CACHE = "SELECT event_id AS id, user_id, event_type, value FROM events"


@query(f"SELECT user_id, event_type, id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY id DESC) AS n FROM ({_CACHE})) WHERE n = 1")
def q_cache_latest(spark, sf):
    """C-KEY, C-SET."""
    return terms.cache_latest(table(spark, sf, "events").selectExpr("event_id as id", "user_id", "event_type", "value"), ["user_id", "event_type"]).select("user_id", "event_type", "id", "value")


@query(f"SELECT hit, count(*) AS n FROM (SELECT e.value IS NOT NULL AS hit FROM customer c CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, value FROM ({_CACHE}) ORDER BY id DESC) e ON e.user_id = c.c_custkey AND e.event_type = t.event_type) GROUP BY hit")
def q_cache_hits(spark, sf):
    """C-GET, C-STATS."""
    types = table(spark, sf, "events").select("event_type").distinct()
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).crossJoin(F.broadcast(types))  # five types
    got = terms.cache_get(asked, table(spark, sf, "events").selectExpr("event_id as id", "user_id", "event_type", "value"), ["user_id", "event_type"], "value")
    return got.groupBy(F.col("value").isNotNull().alias("hit")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, user_id FROM ({_CACHE}) WHERE id > (SELECT max(id) FROM ({_CACHE})) - 500")
def q_cache_evict(spark, sf):
    """C-EVICT."""
    return terms.cache_evict(table(spark, sf, "events").selectExpr("event_id as id", "user_id"), 500)


@query("""SELECT doc_id, line, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x{00A0}]+', ' ', 'g')) AS key, regexp_replace(text, '[. 。…，]{20,}', '.', 'g') AS dots, regexp_replace('<b1>' || text || '</b1>', '</?b[0-9]+>', '', 'g') AS plain, trim(regexp_extract(text, '^[ \\t]*([•◦▪▫‣※]|\\(?[0-9ivxlcIVXLC]{1,4}[.)]|[a-zA-Z][.)])[ \\t]+')) AS marker FROM {lines}""")
def q_rewrites(spark, sf):
    """Scalar strings: normal key, collapsed dots, placeholders, list marker."""
    from ..functions import text as t

    c = F.col("text")
    return lines(spark, sf).select("doc_id", "line", t.normal_key(c).alias("key"), t.collapse_dots(c).alias("dots"), t.strip_placeholders(F.concat(F.lit("<b1>"), c, F.lit("</b1>"))).alias("plain"), t.marker_prefix(c).alias("marker"))


@query("""WITH e AS (SELECT c, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS b, doc_id FROM (SELECT doc_id, 0 AS side, unnest(string_split(replace(replace(text, '-', ''), ' ', ''), '')) AS c FROM documents UNION ALL
  SELECT doc_id, 1, unnest(string_split(replace(replace(text || ' x', '-', ''), ' ', ''), '')) FROM documents WHERE doc_id % 2 = 0) WHERE c <> '' GROUP BY c, doc_id) SELECT doc_id, sum(greatest(a - b, 0))::BIGINT AS missing, sum(greatest(b - a, 0))::BIGINT AS extra FROM e GROUP BY doc_id""")
def q_conserve(spark, sf):
    """A-CONSERVE, U-MISSING/DUP: characters lost and gained between two versions of a text."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    clean = lambda c: F.translate(c, "- ", "")
    side = lambda df, c, a, b: df.select("doc_id", F.explode(F.split(clean(c), "")).alias("c"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = side(d, F.col("text"), 1, 0).unionAll(side(d.where("doc_id % 2 = 0"), F.concat("text", F.lit(" x")), 0, 1)).where("c <> ''")
    per = both.groupBy("doc_id", "c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return per.groupBy("doc_id").agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra"))


@query("""WITH b AS (SELECT doc_id, line, trim(text) AS text FROM {lines} WHERE length(trim(text)) >= 40), n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line) AS nxt, count(*) OVER (PARTITION BY doc_id) AS k FROM b), f AS (SELECT *, NOT regexp_matches(text, '[.!?:;"''”’)\\]}][ \\t]*$') AS frag, regexp_matches(nxt, '^[ \\t]*([a-z]|[,;:)\\]}]|and\\b|or\\b|but\\b|the\\b|of\\b|to\\b|in\\b|a\\b)') AS cont FROM n WHERE nxt IS NOT NULL AND k >= 8)
  SELECT doc_id, round(avg((frag AND cont)::INT), 6) AS continuation, round(avg(frag::INT), 6) AS fragments, avg((frag AND cont)::INT) >= 0.1 AS reflow FROM f GROUP BY doc_id""")
def q_reflow(spark, sf):
    """A-REFLOW: shares of broken sentences and of lines that go on, for documents with 8 blocks or more."""
    from ..functions import text as t

    w = Window.partitionBy("doc_id")
    b = lines(spark, sf).select("doc_id", "line", F.trim("text").alias("text")).where(F.length("text") >= 40)
    n = b.withColumns({"nxt": F.lead("text").over(w.orderBy("line")), "k": F.count(F.lit(1)).over(w)}).where("nxt is not null and k >= 8")
    frag = ~F.col("text").rlike(t.SENTENCE_END)
    share = lambda c: F.avg(c.cast("int"))
    goes_on = share(frag & F.col("nxt").rlike(t.CONTINUES))
    return n.groupBy("doc_id").agg(F.round(goes_on, 6).alias("continuation"), F.round(share(frag), 6).alias("fragments"), (goes_on >= 0.1).alias("reflow"))


@query("""SELECT doc_id, count(*) >= 8 AND avg((length(text) < 60 AND NOT regexp_matches(rtrim(text), '[.!?:;”]$'))::INT) >= 0.6 AS labels FROM {lines} GROUP BY doc_id""")
def q_label_docs(spark, sf):
    """A-LABEL-DOC."""
    short = (F.length("text") < 60) & ~F.rtrim("text").rlike("[.!?:;”]$")
    return lines(spark, sf).groupBy("doc_id").agg(((F.count(F.lit(1)) >= 8) & (F.avg(short.cast("int")) >= 0.6)).alias("labels"))


@query("""SELECT doc_id, coalesce(n.t, raw) AS title FROM (SELECT doc_id, source AS raw FROM documents) LEFT JOIN (SELECT raw, 'T-' || raw AS t FROM (SELECT DISTINCT source AS raw FROM documents) WHERE length(raw) % 2 = 0) n USING (raw)""")
def q_outline_translate(spark, sf):
    """R-OUTLINE-TRANSLATE: distinct titles are translated and mapped back; missing ones stay."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("raw"))
    done = d.select("raw").distinct().where(F.length("raw") % 2 == 0).withColumn("t", F.concat(F.lit("T-"), "raw"))
    return d.join(done, "raw", "left").select("doc_id", F.coalesce("t", "raw").alias("title"))


@query("""WITH s AS (SELECT doc_id, line, x, y, list_distinct(string_split(lower(text), ' ')) AS t FROM {lines} WHERE line % 7 = 1), d AS (SELECT doc_id, line AS target, x AS dx, y AS dy, list_distinct(string_split(lower(text), ' ')) AS u FROM {lines} WHERE line % 7 = 2 AND x2 > 100)
  SELECT doc_id, line, target, score FROM (SELECT s.doc_id, line, target, abs(y - dy) - 8 * len(list_intersect(t, u)) AS score, row_number() OVER (PARTITION BY s.doc_id, line ORDER BY abs(y - dy) - 8 * len(list_intersect(t, u)), target) AS n FROM s JOIN d ON s.doc_id = d.doc_id AND abs(y - dy) <= 36 AND len(list_intersect(t, u)) > 0) WHERE n = 1""")
def q_links(spark, sf):
    """J-LINK, R-LINKS: the best target near a line that shares a word with it."""
    token = F.array_distinct(F.split(F.lower("text"), " "))
    l = lines(spark, sf)  # noqa: E741
    s = l.where("line % 7 = 1").select("doc_id", "line", "y", token.alias("t"))
    d = l.where("line % 7 = 2 and x2 > 100").select(F.col("doc_id").alias("d"), F.col("line").alias("target"), F.col("y").alias("dy"), token.alias("u"))
    shared = F.size(F.array_intersect("t", "u"))
    near = s.join(d, (F.col("doc_id") == F.col("d")) & (F.abs(F.col("y") - F.col("dy")) <= 36) & F.arrays_overlap("t", "u"))
    return ordered.first_of(near.withColumn("score", F.abs(F.col("y") - F.col("dy")) - 8 * shared), ["doc_id", "line"], ["score", "target"]).select("doc_id", "line", "target", "score")
