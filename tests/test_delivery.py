"""Rates, retries, write-back and boxes, by hand and against small models; nulls, ties and empty tables."""

import random

from pyspark.sql import functions as F

from folioframe.operators import requests, writing


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_rate_against_a_bucket(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([0.0, 1.0, 1.5, 7.0]) + i * rng.random()) for k in (1, 2) for i in range(60)]
    got = {(r["k"], r["i"]): r["start"] for r in requests.at_rate(spark.createDataFrame(rows, "k long, i long, t double"), ["k"], ["t", "i"], F.col("t"), 2.0).collect()}
    for k in (1, 2):
        free = 0.0
        for _, i, t in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            start = max(free, t)
            assert abs(got[k, i] - start) < 1e-9
            free = start + 0.5


def test_retries(spark):
    rows = requests.retried(spark.createDataFrame([(0,), (1,), (6,), (100,), (None,)], "f long"), F.col("f")).collect()
    assert [(r["attempts"], r["waited"], r["gave_up"]) for r in rows] == [(1, 0.0, False), (2, 1.0, False), (7, 45.0, False), (100, 15.0 + 95 * 15, True), (1, 0.0, False)]


def test_stage_without_work_and_undone_stage(spark):
    u = spark.createDataFrame([(1, 1, "a", 0.25, 1, 0, 0), (1, 2, "b", 0.5, 1, 1, 4), (1, 3, "c", 0.25, 1, 2, 2)], "run long, stage_no long, stage string, weight double, seq long, current long, total long")
    got = {(r["stage"], r["type"]): r["overall"] for r in requests.stage_events(u, ["run"]).collect()}
    assert got == {("a", "progress_start"): 25.0, ("a", "progress_update"): 25.0, ("a", "progress_end"): 25.0, ("b", "progress_start"): 25.0, ("b", "progress_update"): 37.5, ("c", "progress_start"): 25.0, ("c", "progress_update"): 50.0, ("c", "progress_end"): 50.0}
    assert requests.stage_events(u.limit(0), ["run"]).count() == 0


def test_summary(spark):
    assert one(spark, requests.summary(mono=F.lit(None).cast("string"), tokens=F.lit(0))) == "Translation results:\n\tTotal valid text token count (gpt-4o): 0"
    assert one(spark, requests.summary(seconds=F.lit(0.0), mono=F.lit(""))) == "No translation results available"


def test_write_back(spark):
    rows = [(1, 1, "p", None, "body", " a <b>x</b>", "A & B"), (1, 2, "p", "q", "body", "c", None), (2, 1, "li", "k", "ul", "d", "D"), (3, 1, "p", "", None, " ", "E"), (4, 1, "p", "", "body", "f", None)]
    b = spark.createDataFrame(rows, "s long, i long, tag string, class string, parent string, inner string, translation string")
    got = {m: {r["s"]: r["html"] for r in writing.write_back(b, ["s"], "i", m).collect()} for m in ("replace", "bilingual", "side_by_side")}
    assert got["replace"] == {1: "<p> A &amp; B</p>", 2: '<li class="k">D</li>', 3: "<p> </p>", 4: "<p>f</p>"}
    assert got["bilingual"][1] == '<p> a <b>x</b></p><p class="q">c</p><p class="bdoc-translation">A &amp; B</p>'
    assert got["side_by_side"][1] == '<div class="bdoc-pair"><div class="bdoc-src"><p> a <b>x</b></p><p class="q">c</p></div><div class="bdoc-dst"><p class="bdoc-translation">A &amp; B</p></div></div>'
    assert got["side_by_side"][2] == '<li class="k bdoc-paired"><div class="bdoc-pair"><div class="bdoc-src">d</div><div class="bdoc-dst">D</div></div></li>'


def test_style_links(spark):
    hrefs = [one(spark, writing.relative_href(F.lit(d), F.lit(f), "s.css")) for d, f in (("n.html", ""), ("a/b/n.html", "a"), ("a/n.html", "a/b"), ("a/n.html", ""))]
    assert hrefs == ["s.css", "../s.css", "b/s.css", "../s.css"]
    once = writing.with_style_link(F.lit("<html><HEAD></HEAD><body></body></html>"), F.lit("s.css"))
    assert one(spark, once) == '<html><HEAD><link rel="stylesheet" type="text/css" href="s.css"/></HEAD><body></body></html>' == one(spark, writing.with_style_link(once, F.lit("s.css")))
    assert one(spark, writing.with_style_link(F.lit("<p>"), F.lit("s.css"))) == "<p>"


def test_boxes_overflow(spark):
    rows = [(1, i, n) for i, n in enumerate([4, 4, 9, 10, 1, 1])] + [(2, 0, 11), (2, 1, 1)] + [(3, 0, None)]
    got = {(r["k"], r["i"]): r["box"] for r in writing.fill_boxes(spark.createDataFrame(rows, "k long, i long, n long"), ["k"], "i", "n", 10, 4).collect()}
    assert [got[1, i] for i in range(6)] == [0, 0, 1, 2, 3, 3]
    assert (got[2, 0], got[2, 1], got[3, 0]) == (-1, -1, 0)


def test_descent(spark):
    schema = "p long, i long, font string, size double, vertical boolean, x double, y double, x2 double, y2 double"
    chars = spark.createDataFrame([(1, 0, "a", 10.0, False, 0.0, 0.0, 1.0, 1.0), (1, 1, "b", 10.0, False, 0.0, 0.0, 1.0, 1.0), (2, 0, "a", 10.0, True, 0.0, 0.0, 1.0, 1.0), (3, 0, "?", 10.0, None, 0.0, 0.0, 1.0, 1.0)], schema)
    moved, shifts = writing.without_descent(chars, spark.createDataFrame([("a", -200.0), ("b", -100.0)], "font string, descent double"), ["p"], "i")
    assert {(r["p"], r["i"]): (r["x"], r["y"]) for r in moved.collect()} == {(1, 0): (0.0, 2.0), (1, 1): (0.0, 1.0), (2, 0): (-2.0, 0.0), (3, 0): (0.0, 0.0)}
    assert {r["p"]: (r["shift_x"], r["shift_y"]) for r in shifts.collect()} == {1: (0.0, 2.0), 2: (-2.0, 0.0)}


def test_settings(tmp_path):
    from folioframe.sources.settings import Settings, read_settings

    path = tmp_path / "run.toml"
    path.write_text('[tool]\nlang-out = "ko"\nqps = 0\nglossary-files = "a.csv, b.csv,"\n')
    assert read_settings(str(path), "tool", model="m", lang_in=None) == Settings(lang_out="ko", model="m", glossary_files=("a.csv", "b.csv"))
    path.write_text("")
    assert read_settings(str(path)) == Settings()
