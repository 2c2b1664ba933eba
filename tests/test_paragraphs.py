"""Fonts, merged boxes, folds and paragraph operators against vectors and plain models."""

import random

from pyspark.sql import functions as F

from folioframe.functions.fonts import formula_font
from folioframe.operators import boxes as joins
from folioframe.operators import ordered, paragraphs, styles


def test_fonts(spark):
    text = ["CMUSerif-Roman", "Code2000", "MSTT31", "MSReference", "txsys", "Arial", "ABC+TimesNewRoman", "CMR12", "Georgia", ""]
    formula = ["Asana-Math", "Logix", "NewCM10", "Erewhon", "Luciole", "CMMI10", "ABC+txmiaX", "FiraMono", "AdvP4C4E74", "BASE64:QUJDK0NNTUkxMA=="]
    got = {r["n"]: r["f"] for r in spark.createDataFrame([(x,) for x in text + formula], "n string").select("n", formula_font(F.col("n")).alias("f")).collect()}
    assert got == {x: False for x in text} | {x: True for x in formula}
    own = spark.createDataFrame([("CMMI10",), ("My1",), ("Arial",), ("Asana",)], "n string").select(formula_font(F.col("n"), "My|Ari")).collect()
    assert [r[0] for r in own] == [False, True, False, True]


def slow_union(boxes, slack):
    b = [[i, *box, 1] for i, *box in boxes]
    again = True
    while again:
        again = False
        for i in range(len(b)):
            for j in range(i + 1, len(b)):
                p, q = b[i], b[j]
                if p[1] - slack <= q[3] and q[1] - slack <= p[3] and p[2] < q[4] and q[2] < p[4]:
                    b[i] = [min(p[0], q[0]), min(p[1], q[1]), min(p[2], q[2]), max(p[3], q[3]), max(p[4], q[4]), p[5] + q[5]]
                    del b[j]
                    again = True
                    break
            if again:
                break
    return sorted(b)


def test_merged_boxes():
    rnd = random.Random(1)
    for _ in range(300):
        boxes = []
        for i in range(rnd.randint(1, 14)):
            x, y = rnd.randint(0, 90), rnd.randint(0, 60)
            boxes.append((i, x, y, x + rnd.randint(1, 15), y + rnd.randint(1, 20)))
        assert sorted(styles.united(sorted(boxes, key=lambda b: (b[1], b[0])), 5)) == slow_union(boxes, 5)


def test_folds_keep_to_their_groups(spark):
    rows = [(k, i, (7 * i + k) % 5) for k in range(40) for i in range(30)]
    got = ordered.batches(spark.createDataFrame(rows, "k int, i long, n long"), ["k"], "i", "n", 9, 4).collect()
    assert len(got) == len(rows)
    for k in range(40):
        number = total = n = 0
        for i in range(30):
            assert [r["batch"] for r in got if (r["k"], r["i"]) == (k, i)] == [number]
            total, n = total + (7 * i + k) % 5, n + 1
            if total > 9 or n > 4:
                number, total, n = number + 1, 0, 0


def test_folds(spark):
    y = [100.0, 98.5, 96.9, 90.0, 89.0, 80.0]
    lines = spark.createDataFrame([(1, v, 4.0) for v in y], "k int, y double, height double")
    got = {r["y"]: r["baseline"] for r in styles.stacked(lines, ["k"], "y").collect()}
    assert [got[v] for v in y] == [1, 1, 2, 3, 3, 4]
    chars = [(1, i, *c) for i, c in enumerate([("a", 10.0, False, False), ("2", 7.0, False, False), ("3", 7.5, False, False), ("b", 10.0, False, True), ("=", 10.0, True, True), ("c", 10.0, False, True), ("d", None, False, False)])]
    got = styles.classify(spark.createDataFrame(chars, "k int, i long, text string, size double, starts boolean, goes_on boolean"), ["k"], "i").orderBy("i").collect()
    assert [r["formula"] for r in got] == [False, True, True, True, True, True, False]
    rows = [(1, i, r, o, t, 10.0, 10.0) for i, (r, o, t) in enumerate([(1, 1, "a"), (2, 1, " "), (1, 1, "b"), (2, 1, "c"), (2, 2, "d"), (2, 2, None)])]
    got = styles.islands(spark.createDataFrame(rows, "k int, i long, region int, object int, text string, area double, median double"), ["k"], "i").orderBy("i").collect()
    assert [r["paragraph"] for r in got] == [1, 1, 1, 2, 3, 3]
    boxes = [(1, 0, 0.0, 0.0, 5.0, 10.0), (1, 1, 6.0, 1.0, 11.0, 11.0), (1, 2, 40.0, 0.0, 45.0, 10.0), (1, 3, 0.0, -20.0, 5.0, -10.0)]
    got = {r["id"]: r["line"] for r in styles.cluster_lines(spark.createDataFrame(boxes, "k int, id long, x double, y double, x2 double, y2 double"), ["k"]).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3}


def test_second_box(spark):
    chars = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0, 50.0, 50.0, 55.0, 55.0), (1, 2, 0.0, 0.0, 5.0, 5.0, 0.0, 0.0, 4.0, 4.0)], "p int, c int, x double, y double, x2 double, y2 double, bx double, by double, bx2 double, by2 double")
    regions = spark.createDataFrame([(1, 7, "formula", 49.0, 49.0, 60.0, 60.0), (1, 8, "isolate_formula", 0.0, 0.0, 9.0, 9.0)], "p int, id int, label string, x double, y double, x2 double, y2 double")
    got = joins.first_formula(chars, regions, ["p"], ["c"], second=("bx", "by", "bx2", "by2")).orderBy("c").collect()
    assert [r["formula"] for r in got] == [7, None]


def test_names_and_paths(spark):
    name = lambda *used: paragraphs.unique_name(spark.createDataFrame([(x,) for x in used], "name string"), "auto").first()
    assert name("other")["name"] == "auto" and name("auto")["name"] == "auto#1" and name("auto", "auto#1", "auto#3")["name"] == "auto#2" and name()["name"] == "auto"
    paths = spark.createDataFrame([("../x/./y.html#a", "OPS/t/n.html"), ("#a", "OPS/t/n.html"), ("/r.css", "OPS/t/n.html"), ("a+b%20c", "n.html"), ("../../../z", "OPS/n.html"), (None, "n.html")], "h string, b string")
    got = [tuple(r) for r in paths.select(paragraphs.resolve_path(F.col("h"), F.col("b")), paragraphs.split_fragment(F.col("h"))[1]).collect()]
    assert got[:5] == [("OPS/x/y.html", "a"), ("OPS/t/n.html", "a"), ("r.css", ""), ("a+b c", ""), ("../../z", "")] and got[5][0] is None


def test_css(spark):
    css = ".a, p.b {font-size: 1.5EM; color: red} @media x {.a {font-size: 3em} .z {top: 0}} .b{font-size:24px}.c{x:y} .d{} .e{font-size: 50%} .f{font-size: 18pt} .g{font-size: big}"
    got = paragraphs.css_sizes(spark.createDataFrame([(1, css), (2, None)], "k int, css string"), ["k"], F.col("css")).collect()
    assert {r["class"]: r["font_size"] for r in got} == {"a": 1.5, "b": 1.5, "c": None, "e": 0.5, "f": 1.5, "g": None}


def test_hyphens(spark):
    pairs = spark.createDataFrame([("multi", "agent"), ("consis", "tency"), ("state", "of"), ("re", "new")], "left string, right string")
    vocabulary = spark.createDataFrame([("Multi-agent",), ("consistency",), ("renew",), ("re-new",)], "word string")
    got = {r["left"]: (r["seam"], r["inline"]) for r in paragraphs.hyphen_choices(pairs, vocabulary).collect()}
    assert got == {"multi": ("-", "-"), "consis": ("", ""), "state": ("", "-"), "re": ("", "-")}
