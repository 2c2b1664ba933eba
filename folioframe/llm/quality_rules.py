"""Quality rules whose thresholds come from the data, in DataFrame functions alone.

Each document's features are counted in its own row, without an exchange. Four of them, as whole
numbers, go into quantile sketches: histograms whose buckets keep the leading bits of a value, so that
a sketch is a set of (bucket, count) rows and merging is adding counts. There is a sketch for each
language and source and, merged from these, one for each language. A fence over the quartiles
of the sketch gives each group's thresholds, and the documents are joined with their group's. Constants decide
only where no sketch has enough documents; where the quartiles are equal, as for what most documents have
none of, a least spread stands for their distance.

A source with a third of all rows is counted in part in each task first; the sketch of a group has
at most a few hundred rows however large the group. The features are written once to the shared folder.

Null text counts as empty (no words: base rules fail). Null lang and source are values of their own. A
null id stays, repeated rows each get a row, an empty table gives an empty result, other columns
are ignored (`keep_fit` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Leading bits that a bucket keeps: its width is at most 1/64 of its values.
BITS = 7


@dataclass(frozen=True)
class Rules:
    """Parameters. A document fails a metric beyond its group's fence: the quartile plus (or minus)
    `reach` times the distance of the quartiles, or the metric's least spread if that is more.

    min_words, max_repeat: base rules (words; percent of words in repeated 3-word windows).
    least: documents from which a group has a sketch of its own; below, its language's counts, and
    below that the metric's constants.
    """

    min_words: int = 50
    max_repeat: int = 50
    reach: int = 8
    least: int = 100
    #: Metric -> (least spread, then the constants low and high), in the metric's unit; None: no fence on that side.
    metrics: tuple[tuple[str, int, int | None, int | None], ...] = (
        ("word_length", 10, 200, 1200),  # hundredths of a character
        ("symbols", 25, None, 500),  # per 10,000 characters in words
        ("dup_lines", 500, None, 5000),  # per 10,000 lines with a word
        ("repeats", 600, None, 4000),  # per 10,000 words
    )


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is evaluated once however often it is used."""
    return F.transform(F.array(value), then)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more; windows are told apart by 64-bit hashes.

    Only texts in which a window repeats have their windows sorted.
    """

    def covered(windows: Column) -> Column:
        def repeats(s: Column) -> Column:
            n = F.size(s)
            twice = lambda x, i: ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | ((i < n - 1) & (x["h"] == F.get(s, i + 1)["h"]))
            at = F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end"))
            return F.aggregate(at, start, step, lambda acc: acc["n"])

        one = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(one, repeats))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def features(docs: DataFrame, rules: Rules, id_col: str, text_col: str, lang_col: str, source_col: str, carry: bool = False) -> DataFrame:
    """Counts and metrics of each document; carry: with the whole row in _row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counts = F.transform(
        F.array(F.struct(words(text).alias("w"), lines.alias("l"))),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            repeated_words(x["w"]).alias("n_repeat_words"),
            F.size(x["l"]).cast("long").alias("n_lines"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
        ),
    )[0]
    out = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        counts.alias("c"),
        *([F.struct("*").alias("_row")] if carry else []),
    ).select("doc_id", "lang", "source", "n_symbols", "c.*", *(["_row"] if carry else []))
    share = lambda a, b, unit: F.expr(f"{a} * {unit} div greatest({b}, 1)")
    return out.withColumns(
        {
            "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat * F.col("n_words")),
            "word_length": share("word_chars", "n_words", 100),
            "symbols": share("n_symbols", "word_chars", 10_000),
            "dup_lines": share("n_dup_lines", "n_lines", 10_000),
            "repeats": share("n_repeat_words", "n_words", 10_000),
        }
    )


def sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bucket, n) of the metrics of documents that pass the base rules."""
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m, *_ in Rules.metrics]))
    low = f"greatest(length(bin(v)) - {BITS}, 0)"
    bucket = F.expr(f"shiftleft(shiftright(v, {low}), {low})").alias("bucket")
    return values.where(~F.col("base_failed")).select(*keys, metrics.alias("m")).select(*keys, "m.*").groupBy(*keys, "metric", bucket).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """keys, <metric>_min and <metric>_max of the groups of `least` documents or more."""
    group = Window.partitionBy(*keys, "metric")
    ranked = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("docs", F.sum("n").over(group))
    # A quartile lies in a bucket: its lower edge stands for the first, its upper edge for the third.
    upper = F.expr(f"bucket + shiftleft(1L, greatest(length(bin(bucket)) - {BITS}, 0)) - 1")
    quartile = lambda q, edge: F.min(F.when(4 * F.col("upto") >= q * F.col("docs"), edge))
    found = ranked.where(F.col("docs") >= rules.least).groupBy(*keys, "metric").agg(quartile(1, F.col("bucket")).alias("q1"), quartile(3, upper).alias("q3"))
    out = []
    for m, spread, low, high in rules.metrics:
        far = rules.reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(spread))
        sides = [("min", F.col("q1") - far)] * (low is not None) + [("max", F.col("q3") + far)] * (high is not None)
        out += [F.max(F.when(F.col("metric") == m, x)).alias(f"{m}_{side}") for side, x in sides]
    return found.groupBy(*keys).agg(*out)


def thresholds(sketches: DataFrame, rules: Rules) -> DataFrame:
    """lang, source, <metric>_min, <metric>_max for each group that has a sketch."""
    groups = sketches.select("lang", "source").distinct()
    tables = [fences(sketches, ["lang", "source"], rules), fences(merge(sketches, ["lang"]), ["lang"], rules)]
    limits = [c for c in tables[0].columns if c not in ("lang", "source")]
    joined = groups
    for k, (t, keys) in enumerate(zip(tables, (["lang", "source"], ["lang"]), strict=True)):
        t = t.withColumnsRenamed({c: f"{c}_{k}" for c in t.columns})
        joined = joined.join(t, [F.col(c).eqNullSafe(F.col(f"{c}_{k}")) for c in keys], "left")
    fixed = {f"{m}_{side}": x for m, _, low, high in rules.metrics for side, x in (("min", low), ("max", high))}
    return joined.select("lang", "source", *[F.coalesce(*[f"{c}_{k}" for k in range(2)], F.lit(fixed[c]).cast("long")).alias(c) for c in limits])


def judged(found: DataFrame, fence: DataFrame, rules: Rules) -> DataFrame:
    """The features with their group's thresholds and `kept`. (A group without a sketch has base failures alone.)"""
    fits = ~F.col("base_failed")
    for m, _, low, high in rules.metrics:
        if low is not None:
            fits &= F.col(m) >= F.col(f"{m}_min")
        if high is not None:
            fits &= F.col(m) <= F.col(f"{m}_max")
    t = fence.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return found.join(t, same, "left").withColumn("kept", F.coalesce(fits, F.lit(False))).drop("_lang", "_source")


def quality_rules(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, counts, base_failed, kept of every whole text; further columns: the metrics and thresholds."""
    rules = rules or Rules()
    found = Scratch(docs.sparkSession, "quality-rules").write(features(docs, rules, id_col, text_col, lang_col, source_col))
    fence = thresholds(sketch(found, ["lang", "source"]), rules)
    limits = [c for c in fence.columns if c not in ("lang", "source")]
    return judged(found, fence, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[m for m, *_ in rules.metrics], *limits)


#: Groups whose thresholds may be broadcast (about 100 bytes each).
BROADCAST_GROUPS = 20_000


def keep_fit(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents (all columns) that pass.

    Features are counted once and written beside the rows; thresholds and filter read them there. The
    thresholds are broadcast if they are few, else joined by key.
    """
    rules, scratch = rules or Rules(), Scratch(docs.sparkSession, "quality-filter")
    found = scratch.write(features(docs, rules, id_col, text_col, lang_col, source_col, carry=True))
    fence = scratch.write(thresholds(sketch(found, ["lang", "source"]), rules))
    if fence.count() <= BROADCAST_GROUPS:
        fence = F.broadcast(fence)
    return judged(found, fence, rules).where("kept").select("_row.*")


ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), listed AS (
  SELECT *, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l
  FROM texts
), numbered AS (SELECT *, row_number() OVER () AS row_no FROM listed),
windows AS (
  SELECT row_no, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT row_no, w, unnest(range(1, len(w) - 1)) AS i FROM numbered)
), repeated AS (
  SELECT row_no, i FROM (SELECT *, count(*) OVER (PARTITION BY row_no, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row_no, count(DISTINCT p) AS n FROM (SELECT row_no, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY row_no
), counts AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM numbered LEFT JOIN covered c USING (row_no)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    word_chars * 100 // greatest(n_words, 1) AS word_length, n_symbols * 10000 // greatest(word_chars, 1) AS symbols,
    n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_lines, n_repeat_words * 10000 // greatest(n_words, 1) AS repeats
  FROM counts
), long AS (
  SELECT lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS metric,
    unnest([word_length, symbols, dup_lines, repeats]) AS v
  FROM f WHERE NOT base_failed
), fine AS (
  SELECT lang, source, metric, (v >> s) << s AS bucket, count(*) AS n
  FROM (SELECT *, greatest(length(bin(v)) - 7, 0)::BIGINT AS s FROM long) GROUP BY ALL
), levels AS (
  SELECT 0 AS level, * FROM fine
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM fine GROUP BY lang, metric, bucket
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs FROM levels
), q AS (
  SELECT level, lang, source, metric, min(bucket) FILTER (4 * upto >= docs) AS q1,
    min(bucket + (1::BIGINT << greatest(length(bin(bucket)) - 7, 0)::BIGINT) - 1) FILTER (4 * upto >= 3 * docs) AS q3
  FROM ranked WHERE docs >= 100 GROUP BY ALL
), m AS (
  SELECT * FROM (VALUES ('word_length', 10, 200, 1200), ('symbols', 25, 0, 500), ('dup_lines', 500, 0, 5000), ('repeats', 600, 0, 4000)) m(metric, spread, low, high)
), fenced AS (
  SELECT level, lang, source, metric, q1 - 8 * greatest(q3 - q1, spread) AS lo, q3 + 8 * greatest(q3 - q1, spread) AS hi
  FROM q JOIN m USING (metric)
), chosen AS (
  SELECT g.lang, g.source, m.metric, coalesce(o.lo, w.lo, m.low)::BIGINT AS lo, coalesce(o.hi, w.hi, m.high)::BIGINT AS hi
  FROM (SELECT DISTINCT lang, source FROM fine) g CROSS JOIN m
  LEFT JOIN fenced o ON o.level = 0 AND o.metric = m.metric AND o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source
  LEFT JOIN fenced w ON w.level = 1 AND w.metric = m.metric AND w.lang IS NOT DISTINCT FROM g.lang
), t AS (
  SELECT lang, source, max(lo) FILTER (metric = 'word_length') AS word_length_min, max(hi) FILTER (metric = 'word_length') AS word_length_max,
    max(hi) FILTER (metric = 'symbols') AS symbols_max, max(hi) FILTER (metric = 'dup_lines') AS dup_lines_max,
    max(hi) FILTER (metric = 'repeats') AS repeats_max
  FROM chosen GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND word_length >= word_length_min AND word_length <= word_length_max
    AND symbols <= symbols_max AND dup_lines <= dup_lines_max AND repeats <= repeats_max, false) AS kept,
  word_length, symbols, dup_lines, repeats, word_length_min, word_length_max, symbols_max, dup_lines_max, repeats_max
FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""
