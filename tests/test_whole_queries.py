"""Queries without SQL take all rows of their tables."""

import pytest

from folioframe.plans import QUERIES
from folioframe.plans.registry import regions, words


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("few"))
    rows = [(i, "\n".join(f"some words in line {k} and more" for k in range(5 + 55 * (i == 1)))) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_overlaps_are_fixed_among_all_regions(spark, few):
    pages = {}
    for r in QUERIES["q_overlap_fix"](spark, few).collect():
        pages.setdefault((r["doc_id"], r["page_no"]), []).append(r)
    want = {(r["doc_id"], r["page_no"], r["id"]) for r in regions(spark, few).collect()}
    assert {(*k, r["id"]) for k, b in pages.items() for r in b} == want
    for b in pages.values():
        for p in b:
            for q in b:
                across = p["id"] != q["id"] and p["x"] < q["x2"] and q["x"] < p["x2"] and p["y2"] >= q["y2"] > p["y"]
                inside = across and ((p["x"] <= q["x"] and p["x2"] >= q["x2"] and p["y"] <= q["y"]) or (q["x"] <= p["x"] and q["x2"] >= p["x2"] and q["y"] <= p["y"] and q["y2"] >= p["y2"]))
                middle = (p["y"] + q["y2"]) / 2
                assert not across or inside or middle + 1 >= p["y2"] or middle - 1 <= q["y"]


def test_formulas_are_merged_from_all_words(spark, few):
    got, each = {}, {}
    for r in QUERIES["q_formula_merge"](spark, few).collect():
        got.setdefault((r["doc_id"], r["line"], r["first"]), []).append((r["x"], r["x2"], r["n"]))
    for w in words(spark, few).collect():
        each.setdefault((w["doc_id"], w["line"], w["word"] % 3 == 0), []).append((w["x"], w["x2"]))
    for k, boxes in each.items():
        want = []
        for x, x2 in sorted(boxes):
            if want and x - 5 <= want[-1][1]:
                want[-1] = (want[-1][0], max(x2, want[-1][1]), want[-1][2] + 1)
            else:
                want.append((x, x2, 1))
        assert sorted(got[k]) == want
    assert len(got) == len(each)
