"""Token counts, token output, BPE codec, packing: against the libraries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folioframe.llm import bpe_codec, packing, token_counts, token_output


@pytest.fixture(scope="module")
def byte_bpe(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def ids_of(tok, docs):
    return [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.select("doc_id", "text").collect()]


def u32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(vocabulary, odd_docs, no_docs, name):
    path = vocabulary(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda t: len(sp.encode(t))
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        size = lambda t: len(tok.encode(t, add_special_tokens=False))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := size(r["text"] or ""), n > 4096) for r in odd_docs.collect()), key=repr)
    assert sorted(map(tuple, token_counts.token_counts(odd_docs, path).collect()), key=repr) == want
    assert token_counts.token_counts(no_docs, path).count() == 0


def test_token_output(spark, vocabulary, byte_bpe, odd_docs, no_docs):
    path = vocabulary("byte_bpe_50k.json")
    got = sorted(map(tuple, token_output.token_output(odd_docs, path).collect()), key=lambda r: r[1])
    want = [(i, len(x) + 1, zlib.crc32(u32([*x, 0]))) for i, x in ids_of(byte_bpe, odd_docs)]
    assert sorted([(i, n, c) for i, _, n, c in got], key=repr) == sorted(want, key=repr)
    assert [r[0] for r in got] == sorted((i for i, *_ in got), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert token_output.token_output(no_docs, path).count() == 0


def test_segment_access(tmp_path):
    rnd = np.random.default_rng(2)
    docs = [rnd.integers(0, 1 << rnd.integers(1, 31), rnd.integers(0, 3000)).astype(np.uint32) for _ in range(20)]
    file = tmp_path / "s"
    file.write_bytes(token_output.encode_segment([None, *range(19)], np.concatenate(docs), np.cumsum(list(map(len, docs))), 5))
    s, flat = token_output.Segment(np.memmap(file, np.uint8, "r")), np.concatenate(docs)
    assert (s.start, s.n_ids, s.doc_ids) == (5, len(flat), [None, *range(19)])
    assert s.ids(0, len(flat)).tolist() == flat.tolist()
    for _ in range(200):
        a, b = sorted(rnd.integers(0, len(flat), 2).tolist())
        assert s.ids(a, b).tolist() == flat[a:b].tolist()
        assert s.token(a) == flat[a]


def test_bpe_codec(vocabulary, byte_bpe, odd_docs, no_docs):
    path, sha = vocabulary("byte_bpe_50k.json"), lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(x), sha(",".join(map(str, x))), sha(byte_bpe.decode(x, skip_special_tokens=False))) for i, x in ids_of(byte_bpe, odd_docs)]
    for lexicon in (0, 40, 50_000):
        got = bpe_codec.round_trip(odd_docs, path, lexicon).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    coded = bpe_codec.encode(odd_docs, path)
    assert {r["text"] for r in bpe_codec.decode(coded, path).collect()} == {r["text"] or "" for r in odd_docs.collect()}
    assert bpe_codec.round_trip(no_docs, path).count() == 0


def test_transducer():
    words = sorted({w.encode() for w in "a ab abc b bc car cars scar scars ñ ñu the then there".split()})
    t = bpe_codec.Transducer.mapped(bpe_codec.Transducer.build(words, [np.array([i, i + 1]) for i in range(len(words))]).to_bytes())
    assert t.ranks(words).tolist() == list(range(len(words)))
    assert t.ranks([b"", b"x", b"ca", b"carsx", "ñu".encode()]).tolist() == [-1, -1, -1, -1, words.index("ñu".encode())]
    assert len(t.final) < 1 + sum(map(len, words))
    assert t.ids[t.first[3] : t.first[4]].tolist() == [3, 4]


def test_packing(spark, vocabulary, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(odd_docs, path, size=256).collect()
    full = defaultdict(list)
    for i, x in ids_of(tok, odd_docs):
        full[i].append([*x, 2])
    pieces, windows = defaultdict(list), defaultdict(list)
    for p in got:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        pieces[p["doc_id"]].append(p)
        assert any(zlib.crc32(u32(x[p["start"] : p["start"] + p["length"]])) == p["ids_crc32"] and len(x) == p["doc_tokens"] for x in full[p["doc_id"]])
    for i, texts in full.items():
        covered = sorted((p["start"], p["length"]) for p in pieces[i])
        assert sum(n for _, n in covered) == sum(map(len, texts))
        if len(texts) == 1:
            assert [a for a, _ in covered] == [0, *np.cumsum([n for _, n in covered])[:-1].tolist()]
    for spans in windows.values():
        spans.sort()
        size = sum(n for _, n in spans)
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
        assert size == 256 or size & (size - 1) == 0
    assert packing.pack(no_docs, path).count() == 0


def test_sum_of_squares():
    p = packing.Packer(10)
    for n in (3, 3, 7):
        p.add(n, np.zeros(n, "<u4"))
    # The second 3 goes on the first (0 more) rather than apart (3 more); 7 fits nowhere.
    assert p.level[6] == 1 and p.level[7] == 1 and not p.done
    # Filling the window of 7 takes 1 off the sum, going on that of 6 changes nothing.
    p.add(0, np.zeros(3, "<u4"))
    assert [len(w) for w in p.done] == [2] and p.level[7] == 0 and p.level[6] == 1


def test_bounded_open_windows():
    p = packing.Packer(100, most_open=8)
    for i in range(500):
        p.add(i, np.zeros(70, "<u4"))
        assert p.n_open <= 8
    p.finish()
    assert sum(len(x.ids) for w in p.done for x in w) == 35_000
