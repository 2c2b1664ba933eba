"""License scans, quality rules, the classifier: against plain models."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from folioframe.llm import license_scan, quality_classifier, quality_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_license_base(spark, odd_docs, no_docs):
    texts = ["CC BY cc-by/CC BY", "The General Public License. All rights reserved? all rights", "cc all rights reserved by", "cc by " * 50]
    docs = odd_docs.unionByName(spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    want = {}
    for r in docs.collect():
        w = WORD.findall(lower(r["text"] or ""))
        at = [(i, label) for p, label in license_scan.BASE.items() for n in [len(p.split())] for i in range(len(w) - n + 1) if w[i : i + n] == p.split()]
        want[r["doc_id"]] = (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    got = license_scan.license_scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want[r["doc_id"]]
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.license_scan(no_docs).count() == 0


def test_matching_statistics():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        runs = {str(k): (" ".join(rnd.choice(list("abc"), rnd.integers(1, 9))),) for k in range(3)}
        a = license_scan.Automaton.build(runs, {})
        text = rnd.choice(list("abcx"), 30).tolist()
        ids = [a.vocabulary.get(w.encode(), 0) for w in text]
        has = lambda p: any(f" {' '.join(p)} " in f" {r} " for (r,) in runs.values())
        for i, (_, n) in enumerate(a.statistics(ids)):
            assert n == max((k for k in range(i + 2) if k == 0 or has(text[i + 1 - k : i + 1])), default=0)


def test_license_spans():
    a = license_scan.Automaton.build(license_scan.TEMPLATES, license_scan.BASE)
    t = license_scan.TEMPLATES["mit"][-1].split()
    found = license_scan.scan("Intro. " + " ".join(t[:20] + ["changed"] + t[21:]) + " end", a, 4, 12, 0.6)
    assert found["labels"] == "mit" and found["spans"][0]["start"] == 1 and found["score"] > 0.95
    assert license_scan.scan(" ".join(t[:10]), a, 4, 12, 0.6)["labels"] == ""


def test_license_notices():
    a = license_scan.Automaton.build(license_scan.TEMPLATES, license_scan.BASE)
    label = lambda t: (lambda r: (r["labels"], round(r["score"], 2)))(license_scan.scan(t, a, 4, 12, 0.6))
    assert label("Released under the MIT License.") == ("mit", 1)
    assert label("Licensed under the Apache License, Version 2.0.") == ("apache-2.0", 1)
    assert label("under the GNU General Public License") == ("gpl", 0.5)
    assert label("All rights reserved.") == ("reserved,reserved-notice", 0.75)
    assert label("the license under which the public may use it") == ("", 0)


def slow_scan(text, templates, base, shortest, gap, share):
    """Labels and score from all pairs of places of all templates, and all chains of their matches."""
    w, score, labels = WORD.findall(lower(text)), 0.0, set()
    hits = {i + len(p.split()) - 1: label for p, label in base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
    every = [t.split() for texts in templates.values() for t in texts] + [p.split() for p in base]
    longest = [max((n for n in range(1, i + 2) if any(w[i + 1 - n : i + 1] == t[k : k + n] for t in every for k in range(len(t) - n + 1))), default=0) for i in range(len(w))] + [0]
    for name, texts in templates.items():
        for t in (x.split() for x in texts):
            m = sorted({(i + 1 - longest[i], k, longest[i]) for i in range(len(w)) if longest[i] > 1 and (i in hits or longest[i] >= shortest and longest[i + 1] <= longest[i]) for k in range(len(t) - longest[i] + 1) if t[k : k + longest[i]] == w[i + 1 - longest[i] : i + 1]})
            best = []
            for at, u, n in m:
                own = n
                for (b, v, k), c in zip(m, best, strict=False):
                    over = max(0, b + k - at, v + k - u)
                    if b < at and v < u and over < n and at - b - k <= gap and u - v - k <= gap and at - b <= gap + len(t):
                        own = max(own, c + n - over)
                best.append(own)
            cover = min(1.0, max(best, default=0) / len(t))
            score, labels = max(score, cover), labels | ({name} if cover >= share else set())
    return ",".join(sorted(labels | set(hits.values()))), score if score or not hits else 1.0


def test_license_scan_is_brute_force():
    rnd = np.random.default_rng(13)
    templates = {"x": ("a b c d e f", "c d a b"), "y": ("f e d c b a a b",), "z": ("b b c a d",)}
    base = {"c d": "base", "a a": "twice", "e e": "alone"}
    a = license_scan.Automaton.build(templates, base)
    for _ in range(400):
        text = " ".join(rnd.choice(list("abcdefx"), rnd.integers(0, 30)))
        got = license_scan.scan(text, a, 3, 4, 0.6)
        assert (got["labels"], got["score"]) == slow_scan(text, templates, base, 3, 4, 0.6), text


def counts(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    rows = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(rows) - len(set(rows)), len(covered)


def test_quality_counts(spark, odd_docs, no_docs):
    texts = ["a b c a b c a b", "x x x x", "one\none\n \n \ntwo", " ".join(map(str, range(60))), "# * $ % & | < >", "p q r s p q r s " * 9]
    docs = odd_docs.unionByName(spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    want = sorted([(r["doc_id"], *counts(r["text"] or "")) for r in docs.collect()], key=repr)
    got = quality_rules.quality_rules(docs).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(no_docs).count() == 0
    kept = quality_rules.keep_fit(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_quality_fences_adapt(spark):
    plain = " ".join(f"w{i}" for i in range(80))
    noisy = " ".join(f"w{i}|#" for i in range(80))
    rows = [(i, plain, "en", "clean") for i in range(200)] + [(1000 + i, noisy, "en", "tables") for i in range(200)] + [(5000, noisy, "en", "clean")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0] and got[1000] and not got[5000]


def test_quality_rules_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    wanted = c.sql(quality_rules.ORACLE_SQL)
    got = quality_rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet")).select(*wanted.columns)
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


def test_thresholds_come_from_the_data(spark):
    """They differ between groups, none is the constant that stands in for a missing sketch, and they turn documents away."""
    got = quality_rules.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed").collect()
    assert len({(r["word_length_min"], r["word_length_max"]) for r in got}) > 1
    fixed = {f"{m}_{side}": x for m, _, low, high in quality_rules.Rules().metrics for side, x in (("min", low), ("max", high)) if x}
    common = max({r["word_length_max"] for r in got}, key=[r["word_length_max"] for r in got].count)
    assert common != fixed["word_length_max"]
    for m in ("word_length", "symbols"):
        assert any(r[m] > r[f"{m}_max"] and not r["kept"] for r in got)


def test_classifier_learns(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_classifier.quality_classifier(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    good, bad = np.array([r["score"] for r in got if r["quality"] == 1]), np.array([r["score"] for r in got if r["quality"] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (good < 0.3).mean() < 0.01


def test_classifier_edges(spark, odd_docs, no_docs):
    labels = odd_docs.where("text is not null and doc_id is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    got = quality_classifier.quality_classifier(odd_docs, labels)
    assert got.count() == odd_docs.count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_classifier.quality_classifier(no_docs, labels).count() == 0
    none = spark.createDataFrame([(None, None), (1, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.quality_classifier(odd_docs, none).collect()} == {0.5}
    kept = quality_classifier.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns


def test_whole_texts_are_scored():
    rng = np.random.default_rng(0)
    net = quality_classifier.Network.new(8, rng)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 7, 16, 17, 100, 3_000_000)]
    both = net.pooled(texts)
    for t, row in zip(texts, both, strict=True):
        data = t.ljust(max(16, -(-len(t) // 8) * 8), b"\0")
        rows = np.frombuffer(data, np.uint8).reshape(-1, 8)
        assert np.allclose(net.answers(rows).max(0), row, atol=1e-5)


def test_gradient():
    rng = np.random.default_rng(1)
    net, texts, y = quality_classifier.Network.new(4, rng), [b"hello world, hello", b"abc", b"$$$ ### %%%"], np.array([1, 0, 1], np.float32)
    loss = lambda: -np.mean([np.log(p if k else 1 - p) for p, k in zip(net.scores(texts), y, strict=True)])
    for p, g in zip(net.parameters(), net.gradient(texts, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = p[at], 1e-2
        p[at] = old + e
        up = loss()
        p[at] = old - e
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_held_out(spark):
    got = spark.range(50).select("id", quality_classifier.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
