"""The pipeline's stages against what they should keep, and its registration."""

import random

from conftest import SMALL

import __spark_entry__ as entry
import corpus_pipeline
from folioframe.llm import queries


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(n in names for n in queries.QUERIES)
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, columns = docs.count(), docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns and 0 < docs.count() <= kept
        kept = docs.count()
    ids = {r["doc_id"] for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {p["doc_id"] for p in pieces} == ids
    for i in list(ids)[:20]:
        own = sorted((p["start"], p["length"], p["doc_tokens"]) for p in pieces if p["doc_id"] == i)
        assert sum(n for _, n, _ in own) == own[0][2]


def test_short_passages_go(spark):
    """A passage of over 50 words goes though it has fewer than 400 bytes; a shorter one stays."""
    rnd = random.Random(21)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 6))) for _ in range(n))
    long, short, own = words(51), words(42), [words(90) for _ in range(6)]
    assert 200 < len(short) < len(long) < 400
    texts = [f"{own[0]}\n{long}\n{own[1]}", f"{own[2]}\n\n{long} {own[3]}", f"{own[4]} {short}", f"{own[5]}\n{short}"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, docs, SMALL).collect()}
    for i in (0, 1):
        assert long not in got[i]["text"] and all(o in got[i]["text"] for o in own[2 * i : 2 * i + 2]) and got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (2, 3)] == texts[2:]
