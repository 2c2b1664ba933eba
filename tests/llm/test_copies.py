"""Near-duplicates and repeated passages: against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import xxhash
from conftest import SMALL

from folioframe.llm import bwt, components, embedding_dedup, simhash_dedup, suffix_dedup
from folioframe.llm.scratch import Scratch


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    nodes = np.array(edges, np.int64)
    hi, lo = components.forest(nodes[:, 0], nodes[:, 1])
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert dict(map(tuple, got)) == dict(zip(hi.tolist(), lo.tolist(), strict=True))
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def slow_print(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd_docs, no_docs):
    for r in simhash_dedup.fingerprints(odd_docs).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").limit(150).collect():
        assert r["print"][0] % (1 << 64) == slow_print(r["text"] or "")
    got = simhash_dedup.simhash_components(odd_docs)
    assert got.count() == odd_docs.count()
    empty = {r["component_id"] for r in got.where("fingerprint = '0000000000000000'").collect()}
    assert len(empty) == 1
    assert simhash_dedup.simhash_components(no_docs).count() == 0


def near_prints():
    rng, out = np.random.default_rng(5), []
    for base in rng.integers(0, 1 << 63, 30):
        for _ in range(50):
            x = int(base)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_no_link_is_lost(spark):
    u = near_prints()
    x, y = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    want = np.arange(len(u))
    h, low = components.forest(x, y)
    want[h] = low
    table = spark.createDataFrame([(int(v), [int(v)]) for v in u.view(np.int64)], "node long, print array<long>")
    for block, refine in ((2048, 1 << 16), (16, 40), (8, 5)):
        links = simhash_dedup.link_prints(table, 1, 3, 3, Scratch(spark, "t"), block, refine).collect()
        a, b = (np.searchsorted(u, np.array(c).view(np.uint64)) for c in zip(*links, strict=True))
        got = np.arange(len(u))
        h, low = components.forest(a, b)
        got[h] = low
        assert np.array_equal(got, want)


def test_thresholds():
    rng = np.random.default_rng(6)
    costs = rng.random((4, simhash_dedup.FAR + 2, 1 << 16)).astype(np.float32).cumsum(1)
    values = rng.integers(0, 1 << 16, (50, 4))
    for reach in (3, 5, 7):
        got = simhash_dedup.allocate(values, costs, reach)
        assert (got.sum(1) == reach - 3).all() and got.min() >= -1
        best = min(sum(costs[k, c[k] + 1, values[0, k]] for k in range(4)) for c in np.ndindex(4, 4, 4, 4) if sum(c) - 4 == reach - 3 for c in [[x - 1 for x in c]])
        assert abs(sum(costs[k, got[0, k] + 1, values[0, k]] for k in range(4)) - best) < 1e-5


def test_near_copies(spark, odd_docs):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(40):
        base = [rnd.choice(words) for _ in range(300)]
        rows.append((2 * i, " ".join(base)))
        base[150] = "changed"
        rows.append((2 * i + 1, " ".join(base)))
    kept = {r["doc_id"] for r in simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 80, 2))
    clash = odd_docs.withColumnRenamed("rid", "_row").withColumnRenamed("print", "row")
    assert simhash_dedup.keep_one(clash).columns == clash.columns


def pair_at(rnd, n, changed):
    """Two texts of n words, of which the second has so many changed, and the similarity of their 5-word shingles."""
    a = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    b = list(a)
    for k in rnd.sample(range(n), changed):
        b[k] = f"w{rnd.randrange(10**9)}"
    x, y = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (a, b))
    return " ".join(a), " ".join(b), len(x & y) / len(x | y)


def test_near_copies_are_those_at_the_similarity(spark):
    rnd, rows, want = random.Random(11), [], {}
    while len(want) < 240:
        a, b, s = pair_at(rnd, 300, rnd.randint(4, 12))
        if 0.74 <= s < 0.86 and sum((v >= 0.8) == (s >= 0.8) for v in want.values()) < 120:
            rows += [(2 * len(want), a), (2 * len(want) + 1, b)]
            want[2 * len(want) + 1] = s
    kept = {r["doc_id"] for r in simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(240))
    assert all(i in kept for i, s in want.items() if s < 0.8)
    assert sum(i not in kept for i, s in want.items() if s >= 0.8) >= 0.9 * 120


def test_one_row_of_a_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i}" for i in range(300))
    rows = [(7, text), (7, text), (None, text), (None, text), (9, text + " more"), (None, other), (None, other), (None, "alone"), (3, None), (None, "")]
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(7, text), (None, other), (None, "alone"), (3, None)], key=repr)


def test_equal_prints_are_not_enough(spark):
    common = " ".join(["the same five words again"] * 400)
    rows = [(i, common + " " + " ".join(f"u{i}x{k}" for k in range(60))) for i in range(6)]
    assert simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 6


def test_similar_links():
    rnd = random.Random(12)
    sets = [np.array(sorted(rnd.sample(range(14), rnd.randint(6, 12))), np.uint64) for _ in range(200)]
    got = np.arange(200)
    node, root = simhash_dedup.similar_links(np.zeros((200, 1), np.uint64), sets, 0.8, 64)
    got[node] = root
    x, y = zip(*[(i, j) for i in range(200) for j in range(200) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})], strict=True)
    want = np.arange(200)
    node, root = components.forest(np.array(x), np.array(y))
    want[node] = root
    assert np.array_equal(got, want)


def brute_repeats(texts, length):
    seen = Counter(d[s : s + length] for d in texts for s in range(len(d) - length + 1))
    for d in texts:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        yield len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()


def test_repeats(spark, odd_docs, no_docs):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ñ\n") for _ in range(n)) for n in (100, 500, 900, 500, 900, 700)]
    texts = []
    for _ in range(90):
        k = rnd.random()
        if k < 0.15:
            texts.append(rnd.choice(["ab", "x", "abc ", "é"]) * rnd.randint(1, 300))
        else:
            texts.append("".join(rnd.choice(base)[rnd.randint(0, 60) : rnd.choice([450, 600, 900])] if rnd.random() < 0.7 else "".join(rnd.choice("abcdefgh") for _ in range(200)) for _ in range(3)))
    texts += ["", None, texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = list(brute_repeats([(t or "").encode() for t in texts], 400))
    for most in (8192, 2):
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeat_digest(docs, most=most).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert suffix_dedup.repeat_digest(no_docs).count() == 0
    assert suffix_dedup.repeat_digest(odd_docs).count() == odd_docs.count()
    cut = suffix_dedup.remove_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "q" * 10 + "x" * 390), (1, "q" * 10 + "x" * 390), (2, "y" * 399)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffix_dedup.repeat_digest(docs).collect()) == [0, 400, 400]


def slow_digest(texts, length=400):
    """n_removed, n_spans, kept_sha256 of each text, from hashes of all strings of `length` bytes."""
    seen = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        runs = []
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        kept = b"".join(t[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(t)], strict=True))
        yield len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()


def test_repeats_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: x for r, x in zip(rows, slow_digest([(r["text"] or "").encode() for r in rows]), strict=True)}
    for most in (suffix_dedup.MOST, 2):
        assert {r["doc_id"]: tuple(r)[2:] for r in suffix_dedup.repeat_digest(docs, most=most).collect()} == want


def test_copies_of_whole_texts(spark):
    """Copies that go whole still witness what others share with them; helper names may clash."""
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    long, short = text(1500), text(399)
    other = text(200) + long[300:900] + text(200)
    rows = [(1, long), (2, long), (3, long), (4, other), (5, short), (6, short), (None, long)]
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, _spans int, _own int, spans string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["n_spans"]) for r in suffix_dedup.repeat_digest(docs).collect())
    assert got == [(0, 1500, 1), (1, 1500, 1), (2, 1500, 1), (3, 1500, 1), (4, 600, 1), (5, 0, 0), (6, 0, 0)]
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and {r["text"] for r in cut.where("doc_id < 4 or doc_id is null").collect()} == {""}
    assert cut.where("doc_id = 4").first()["text"] == other[:200] + other[800:]


def test_merged_transforms():
    rnd = random.Random(9)
    for _ in range(120):
        strings = [[rnd.choice([1, 2]) for _ in range(rnd.randint(0, 8))] for _ in range(rnd.randint(1, 9))]
        got = bwt.longest_elsewhere(strings, rnd.choice([1, 2, 3, 64]))
        suffixes = [(k, i, s[i:]) for k, s in enumerate(strings) for i in range(len(s) + 1)]
        for k, i, x in suffixes:
            alike = [next((j for j, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y))) for m, j, y in suffixes if (m, j) != (k, i)]
            assert got[k][i] == max(alike, default=0)


def test_embeddings(spark):
    rng = np.random.default_rng(10)
    centers = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = centers[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.25, 1.0])
        rows.append((i, v.tolist(), int(rng.integers(0, 3))))
    rows += [(500 + i, rows[0][1], rows[0][2]) for i in range(30)] + [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] + [1.0] * 15, 1), (603, [None] + [1.0] * 15, 1), (604, rows[1][1], None), (605, [1.0, 2.0], 1), (606, [2.0, 4.0], 1), (607, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sound = [(i, np.array(v), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, v, k in sound:
        for j, w, m in sound:
            if i != j and k == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i].add(j)
    least = {i: i for i in links}
    for _ in links:
        least = {i: min([least[i], *(least[j] for j in links[i])]) for i in links}
    want = sorted((i, len(links[i]), least[i], i == least[i]) for i in links)
    for options in ({}, {"lists": 5, "codes": 4, "block": 16, "sample": 100}):
        got = sorted(map(tuple, embedding_dedup.embedding_components(table, **options).select("vec_id", "n_links", "component_id", "kept").collect()))
        assert got == want
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted([tuple(r) for r in embedding_dedup.embedding_components(odd).collect()], key=repr) == [(1, 0, 1, True), (None, 0, None, False)]
    assert embedding_dedup.embedding_components(spark.createDataFrame([], table.schema)).count() == 0


def test_index_recall():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(800, 32)) + 4 * rng.normal(size=(20, 32))[rng.integers(0, 20, 800)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embedding_dedup.Index.fit(x[:300], 16, 4, 16)
    at, codes, left, far = index.encode(x)
    radius = np.array([far[at == k].max(initial=-1) for k in range(len(index.coarse))])
    reach = (2 - 2 * 0.93) ** 0.5
    look = index.probes(x, reach, radius)
    close = x @ x.T >= 0.93
    for i, j in zip(*np.nonzero(close), strict=True):
        assert look[i, at[j]]
        assert index.distances(x[i : i + 1], int(at[j]), codes[j : j + 1])[0, 0] - left[j] <= reach + embedding_dedup.SLACK


def test_memory_of_merged_transforms():
    strings = [[1 + (31 * i + j * j) % 97 for j in range(200)] for i in range(1000)]
    tracemalloc.start()
    bwt.longest_elsewhere(strings)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * sum(len(s) + 1 for s in strings)
