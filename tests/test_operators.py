"""Operators against the value vectors and small models."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.functions import text as t
from folioframe.functions.fonts import formula_font
from folioframe.operators import blocks, lists, ordered, pages, progress, prompts, replies, styles, terms
from folioframe.sources import tables
from folioframe.streaming import events


def frame(spark, texts, x2=425.0, x=40.0):
    rows = [(1, i, s, x, x2 if not isinstance(x2, list) else x2[i]) for i, s in enumerate(texts)]
    return spark.createDataFrame(rows, "page int, line long, text string, x double, x2 double")


def ranges(df):
    return sorted((r["first"], r["last"]) for r in df.collect())


def test_toc_runs(spark):
    rows = ["1 Introduction 204", "1.1 Perspectives on B-trees 204", "1.2 Purpose and Scope 206", "1.3 New Hardware 207"]
    assert ranges(lists.toc_runs(frame(spark, rows), ["page"], "line")) == [(0, 3)]
    assert ranges(lists.toc_runs(frame(spark, ["prose that ends in 2010", "1 Row 3", "2 Row 4"], [425.0, 425.0, 449.0]), ["page"], "line")) == []


def test_ranges(spark):
    assert ranges(lists.terminal_ranges(frame(spark, ["A title", "and its rest 12", "Next 14", "Last 20"]), ["page"], "line")) == [(0, 1), (2, 2), (3, 3)]
    for sign in "■¡":
        assert ranges(lists.marker_ranges(f := frame(spark, [f"{sign} a", f"{sign} b", f"{sign} c"]), ["page"], "line", F.col("text").rlike(t.MARKED))) == [(0, 0), (1, 1), (2, 2)], f
    assert ranges(lists.manning_ranges(frame(spark, ["■ one", "appendix A", "■ two", "appendix B", "■ three"]), ["page"], "line")) == [(0, 0), (1, 2), (3, 4)]
    rows = ["Prologue v", "Traction Channels 1 1 •", "The Bullseye Framework 9 2 •", "Traction Thinking 19 3 •", "Afterword 249 25 •"]
    assert ranges(lists.single_rows(frame(spark, rows), ["page"], "line", F.col("text").rlike(t.TRACTION))) == [(i, i) for i in range(5)]
    assert ranges(lists.list_items(frame(spark, ["- First item", "  continuation", "- Second item", "- Third item"]), ["page"], "line")) == [(0, 1), (2, 2), (3, 3)]
    assert ranges(lists.list_items(frame(spark, ["- only", "- two"]), ["page"], "line")) == []


def test_predicates(spark):
    c = F.col("text")
    one = lambda texts, f: [r[0] for r in frame(spark, texts).orderBy("line").select(f).collect()]
    assert one(["42", "xiv", "needed later", "100", ""], t.folio(c)) == [True, True, False, True, False]
    assert one(["iv 1 25 51 74 133 165 205", "Chapter 1 covers agents and tools."], t.page_list(c)) == [True, False]
    assert one(["3.1 Node Size", "3.1 Node Size 232"], t.numbered_row(c)) == [False, True]
    assert one(["txmiaX", "ABCDEF+CMMI10", "Arial", "TimesNewRoman", ""], formula_font(c)) == [True, True, False, False, False]


def test_pages():
    assert pages.parse_ranges("1-,2,-3,4") == [(1, pages.OPEN), (2, 2), (1, 3), (4, 4)]


def test_batches_and_pairs(spark):
    rows = [(1, i, s) for i, s in enumerate([150, 60, 10, 10, 10, 10, 10, 10, 10])]
    got = ordered.batches(spark.createDataFrame(rows, "k int, i long, s int"), ["k"], "i", "s", 200, 5).orderBy("i").collect()
    assert [r["batch"] for r in got] == [0, 0, 1, 1, 1, 1, 1, 1, 2]


def test_style_folds(spark):
    rows = [(1, i, "A", s, None, f) for i, (s, f) in enumerate([(10.0, False), (10.015, False), (10.03, False), (10.03, True), (10.03, False)])]
    runs = styles.style_runs(spark.createDataFrame(rows, "k int, i long, font string, size double, state string, formula boolean"), ["k"], "i").orderBy("i").collect()
    assert [r["run"] for r in runs] == [1, 1, 2, 3, 4]
    para = [(1, 0, "r", 1, False), (1, 1, None, None, True), (1, 2, "r", 1, False), (1, 3, "r", 1, False), (1, 4, "s", 1, False)]
    got = styles.merge_numbered(spark.createDataFrame(para, "k int, i long, region string, object int, number boolean"), ["k"], "i").orderBy("i").collect()
    assert [r["merged"] for r in got] == [0, 1, 0, 0, 4]
    parts = spark.range(1).select(styles.split_formula(F.lit("a,(b,c),d)e,f"))).first()[0]
    assert parts == ["a", "(b,c)", "d)e", "f"]


def test_boxes_of_a_page(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 10.0, 50.0, 30.0), (1, 2, 10.0, 0.0, 40.0, 14.0), (1, 3, 200.0, 0.0, 210.0, 5.0)], "k int, id long, x double, y double, x2 double, y2 double")
    got = {r["id"]: (r["y"], r["y2"]) for r in styles.spread_overlaps(boxes, ["k"]).collect()}
    assert got == {1: (13.0, 30.0), 2: (0.0, 11.0), 3: (0.0, 5.0)}
    merged = styles.merge_formulas(boxes, ["k"]).collect()
    assert sorted(r["n"] for r in merged) == [1, 2]


def test_glossary(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("﻿source,target,tgt_lng\nTransformer,变换器,zh-CN\n agent ,代理,zh-CN\nagent,에이전트,ko\n,x,\n", encoding="utf-8")
    entries = tables.read_glossary(spark, str(path))
    assert entries.count() == 3
    own = terms.glossary(entries.withColumn("o", F.col("source")), "o", "zh-CN")
    assert {r["source"] for r in own.collect()} == {"Transformer", "agent"}
    texts = spark.createDataFrame([("The agent runs here.",)], "text string")
    for most in (5_000, 0):
        e = spark.createDataFrame([("agent",), ("latency",), ("he",)], "source string")
        assert {r["source"] for r in terms.active_terms(texts, e, most=most).collect()} == {"agent", "he"}
    tables.write_glossary(own, str(tmp_path / "out"))
    assert tables.read_glossary(spark, str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize(("reply", "want"), [('{"translations":[{"id":0,"text":"a"}]}', [(0, "a")]), ('[{"id":"1","output":"b"}] tail', [(1, "b")]), ('```json\n[{"id":2,"text":"c"}]\n```', [(2, "c")]), ("", []), ("no json", []), ('[{"text":"x"}]', [])])
def test_replies(spark, reply, want):
    got = replies.parse(spark.createDataFrame([(reply,)], "reply string")).collect()
    assert [(r["id"], r["output"]) for r in got] == want


def test_placeholders():
    text, kept = prompts.with_placeholders([("plain", "see "), ("formula", "x+y"), ("plain", " and "), ("style", "bold")])
    assert text == "see <b1> and <b2>bold</b3>"
    assert prompts.restore("voir <b1> et <b2>gras</b3> <b9>", kept, text) == [("plain", "voir "), ("formula", "x+y"), ("plain", " et "), ("style", "gras"), ("plain", " ")]


def test_cache(spark):
    entries = spark.createDataFrame([(1, "k", "old"), (2, "k", "new"), (3, "m", "x")], "id long, key string, output string")
    asked = spark.createDataFrame([("k", "t1"), ("z", "t2")], "key string, text string")
    got = {r["key"]: r["output"] for r in prompts.translate(asked, entries, ["key"], lambda ts: [s.upper() for s in ts]).collect()}
    assert got == {"k": "new", "z": "T2"}
    assert terms.cache_evict(entries, 2).count() == 2


def test_blocks():
    html = "<html><head><title>T</title><style>p{}</style></head><body><p class='a'>One<br>two<p>Three <b>x</b></p><ul><li>L1<li>L2</ul><script>no()</script></body></html>"
    assert [(a, c) for a, _, c in blocks.blocks_of(html)] == [("title", "T"), ("p", "Onetwo"), ("p", "Three x"), ("li", "L1"), ("li", "L2")]


def test_roles(spark):
    row = lambda name, **k: dict({"class": name, "n": 6, "median_length": 50.0, "median_words": 8.0, "ends": 0.0, "folios": 0.0, "code": 0.0, "upper": 0.0, "size": None, "bold": False, "monospace": False, "right": False}, **k)
    stats = [row("h", size=1.8, bold=True, n=1), row("pn", median_length=3.0, folios=1.0, right=True), row("js", code=0.9), row("label", bold=True, median_words=1.0, ends=1.0), row("text", n=50)]
    schema = "class string, n long, median_length double, median_words double, ends double, folios double, code double, upper double, size double, bold boolean, monospace boolean, right boolean"
    got = {r["class"]: r["role"] for r in blocks.roles(spark.createDataFrame([tuple(s.values()) for s in stats], schema)).collect()}
    assert got == {"h": "heading", "pn": "page_number", "js": "code", "label": "body", "text": "body"}


def test_segments(spark):
    rows = [(1, i, r, s) for i, (r, s) in enumerate([("body", "a line that"), ("body", "goes on."), ("body", "Next one."), ("code", "x = 1"), ("code", "y = 2")])]
    got = blocks.segments(spark.createDataFrame(rows, "k int, i long, role string, text string"), ["k"], "i").orderBy("i").collect()
    assert [r["segment"] for r in got] == [1, 1, 2, 3, 3]


def test_epub(spark, tmp_path):
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.css" media-type="text/css"/></manifest><spine><itemref idref="b"/><itemref idref="a" linear="no"/></spine></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/x.opf"/></rootfiles></container>'
    data = tables.write_epub([("META-INF/container.xml", container.encode()), ("OEBPS/x.opf", opf.encode()), ("OEBPS/a.xhtml", b"<p>a</p>"), ("OEBPS/b.xhtml", b"<p>b</p>")])
    assert zipfile.ZipFile(io.BytesIO(data)).infolist()[0].filename == "mimetype"
    (tmp_path / "x.epub").write_bytes(data)
    items = tables.read_epub(spark, str(tmp_path))
    assert items.count() == 3
    assert [r["href"] for r in tables.epub_spine(items).collect()] == ["OEBPS/b.xhtml"]


def test_replay_gap(spark):
    log = spark.createDataFrame([(i,) for i in range(5, 9)], "sequence long")
    assert progress.replay(log, 6, 5).count() == 2
    with pytest.raises(ValueError, match="no longer kept"):
        progress.replay(log, 2, 5)


def test_stream(spark, tmp_path):
    from conftest import SMALL

    batch = spark.read.parquet(f"{SMALL}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = events.throttled(stream, 36_000.0).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    at = batch.withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    want = progress.throttle(at, ["user_id"], "event_id", F.col("at"), 36_000.0)
    assert {r["event_id"] for r in spark.table("kept").collect()} == {r["event_id"] for r in want.collect()}


def test_active_terms_without_pairs(spark):
    """Terms are looked up, not tested against each text; spaces, empty, null and repeated terms included."""
    lines = ["Alphabet soup", "the ALPHA beta", None, "", "alphabeta\talpha", "soup of the day", "x" * 100 + "soup" + "é" * 70, "É soup\x1fday"]
    names = ["alpha", "Alphabet", "beta", "soup", "of the", "", "É", "é", None, "alpha", "the"]
    texts = spark.createDataFrame(list(enumerate(lines)), "n int, text string")
    entries = spark.createDataFrame(list(enumerate(names)), "id int, source string")
    low = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    want = sorted((i, k) for i, x in enumerate(lines) for k, y in enumerate(names) if x is not None and y is not None and low(y) in low(x))
    for most in (5_000, 3):
        got = terms.active_terms(texts, entries, most=most)
        assert got.columns == ["n", "text", "id", "source"]
        if most > 3:
            assert sorted((r["n"], r["id"]) for r in got.collect()) == want
    plain = terms.active_terms(texts, entries.where("id in (0, 1, 2, 3)"))
    assert "NestedLoop" not in plain._jdf.queryExecution().executedPlan().toString()
