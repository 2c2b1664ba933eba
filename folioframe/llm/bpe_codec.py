"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus's most frequent words are compiled into a minimal acyclic transducer: equal suffixes
share states, and the numbers on a word's edges add up to its rank, which leads to its ids. The
transducer is memory-mapped by every worker and walked for many words at once; words it lacks are
merged exactly, many at once too. Decoding joins the bytes of ids.

The lexicon holds at most `lexicon` words (so the broadcast is bounded); it decides how words are
looked up, never the result. Null text counts as empty: no ids, empty text. Repeated rows each get a
row, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import tempfile
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import held, narrow, parts
from .scratch import Scratch
from .units import Memory, byte_bpe_units, byte_bpe_words, byte_signs, byte_words, special

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NEVER = np.iinfo(np.int32).max
#: Words of more bytes are merged one by one with a heap.
WIDE = 32


class Merges:
    """A byte-level BPE's vocabulary and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, signs = spec["model"]["vocab"], byte_signs()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(signs[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.array([vocabulary[c] for c, _ in sorted(signs.items(), key=lambda x: x[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = len(self.bytes_of)
        key = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made[order]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NEVER, id made) of pairs; an id below 0 merges with nothing."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        good = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.rank[at], NEVER), self.made[at]

    def _short(self, words: list[bytes], size: int) -> list[np.ndarray]:
        """Words of at most `size` bytes; each round merges the first best pair of every word."""
        n = np.array([len(w) for w in words])
        flat = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        a = np.full((len(words), size + 1), -1, np.int64)
        a[np.arange(size + 1) < n[:, None]] = flat
        rank, made = self._find(a[:, :-1], a[:, 1:])
        live, columns = np.flatnonzero(rank.min(1) < NEVER), np.arange(size + 1)
        while len(live):
            at = rank[live].argmin(1)
            shift = columns + (columns > at[:, None])
            own = np.take_along_axis(a[live], np.minimum(shift, size), 1)
            own[:, size] = -1
            own[np.arange(len(live)), at] = made[live, at]
            moved = np.minimum(shift[:, :-1], size - 1)
            r, m = np.take_along_axis(rank[live], moved, 1), np.take_along_axis(made[live], moved, 1)
            r[:, -1] = NEVER
            for side in (at - 1, at):
                rows = np.flatnonzero((side >= 0) & (side < size))
                k = side[rows]
                r[rows, k], m[rows, k] = self._find(own[rows, k], own[rows, k + 1])
            a[live], rank[live], made[live] = own, r, m
            live = live[r.min(1) < NEVER]
        return [row[row >= 0] for row in a]

    def _long(self, word: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before, alive = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], [True] * len(ids)
        rank, made = self._find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r < NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0:
                    (r,), (m,) = self._find(np.array([ids[k]]), np.array([ids[after[k]]]))
                    if r < NEVER:
                        heapq.heappush(heap, (int(r), k, ids[k], ids[after[k]], int(m)))
        return np.array([i for i, on in zip(ids, alive, strict=True) if on], np.int64)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words, exactly as merging lowest ranks first gives them."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > WIDE:
                out[i] = self._long(w)
            elif w:
                by_size.setdefault(-(-len(w) // 4) * 4, []).append(i)
        for size, places in by_size.items():
            for lo in range(0, len(places), 20_000):
                some = places[lo : lo + 20_000]
                for i, ids in zip(some, self._short([words[i] for i in some], size), strict=True):
                    out[i] = ids
        return out

    def ids(self, unit: str, merged) -> bytes:
        """Ids of a unit that may hold special strings; merged: the ids of a word."""
        parts_of = self.split_special.split(unit) if self.split_special else [unit]
        out = b""
        for k, s in enumerate(parts_of):
            out += np.array([self.special[s]], "<u4").tobytes() if k % 2 else b"".join(map(merged, byte_words(s)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def merges_of(path: str) -> Merges:
    return Merges(path)


@dataclass
class Transducer:
    """A minimal acyclic transducer as flat arrays, from words to lists of ids.

    edges: sorted state * 256 + byte; target and output of each edge; per state whether a word ends
    there; `first` and `ids`: the list of ids of each rank.
    """

    edges: np.ndarray
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    _KINDS = ("<i8", "<i4", "<i4", "u1", "<i8", "<u4")

    @classmethod
    def build(cls, words: list[bytes], ids: list[np.ndarray]) -> Transducer:
        """From distinct words in ascending order and their ids."""
        children: list[dict[int, int]] = [{}]
        final, count = [False], [0]
        register: dict[tuple, int] = {}
        path, free = [0], []  # states of the last word; states that were merged into others

        def settle(depth: int, last: bytes) -> None:
            """Make the last word's states below a depth final: reuse an equal state if there is one."""
            while len(path) - 1 > depth:
                s = path.pop()
                key = (final[s], *children[s].items())
                if (same := register.setdefault(key, s)) != s:
                    children[path[-1]][last[len(path) - 1]] = same
                    free.append(s)

        last = b""
        for w in words:
            common = 0
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
            settle(common, last)
            for c in w[common:]:
                if free:
                    s = free.pop()
                    children[s], final[s] = {}, False
                else:
                    s = len(children)
                    children.append({})
                    final.append(False)
                children[path[-1]][c] = s
                path.append(s)
            final[path[-1]] = True
            last = w
        settle(0, last)
        number, order, stack = {}, [], [(0, False)]
        count = {}
        while stack:
            s, done = stack.pop()
            if done:
                count[s] = final[s] + sum(count[t] for t in children[s].values())
            elif s not in number:
                number[s] = len(order)
                order.append(s)
                stack.append((s, True))
                stack += [(t, False) for t in children[s].values()]
        edges, target, output = [], [], []
        for k, s in enumerate(order):
            before = int(final[s])
            for c, t in children[s].items():
                edges.append(k * 256 + c)
                target.append(number[t])
                output.append(before)
                before += count[t]
        arrays = (edges, target, output, [final[s] for s in order], np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))), np.concatenate(ids) if ids else [])
        return cls(*(np.asarray(x).astype(kind) for x, kind in zip(arrays, cls._KINDS, strict=True)))

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, n) for n in ("edges", "target", "output", "final", "first", "ids")]
        return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def mapped(cls, data: bytes) -> Transducer:
        """The arrays in a memory-mapped file; it has no name, so nothing of it stays behind."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            whole = np.memmap(f, np.uint8, "r")
        sizes, at, arrays = whole[:48].view("<i8").tolist(), 48, []
        for n, kind in zip(sizes, cls._KINDS, strict=True):
            end = at + n * np.dtype(kind).itemsize
            arrays.append(np.frombuffer(whole, kind, n, at) if n else np.zeros(0, kind))
            at = end
        return cls(*arrays)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank, -1 for one that is not in the lexicon; all words walk at once."""
        n = np.array([len(w) for w in words], np.int64)
        if not len(self.edges) or not len(n):
            return np.full(len(words), -1)
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        text = np.frombuffer(b"".join(words), np.uint8)
        state, rank = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        live, depth = np.flatnonzero(n > 0), 0
        while len(live):
            key = state[live] * 256 + text[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            good = self.edges[at] == key
            state[live] = np.where(good, self.target[at], -1)
            rank[live] += np.where(good, self.output[at], 0)
            depth += 1
            live = live[good & (n[live] > depth)]
        return np.where((state >= 0) & (self.final[state] > 0) & (n > 0), rank, -1)


def frequent_words(docs: DataFrame, tokenizer: str, most: int) -> list[str]:
    """The most frequent words of all texts: those with at least the least count that leaves `most` at most.

    Counts are summed in each task before they are shuffled; the driver gets how many words have each
    count, then the words.
    """

    def run(batches):
        seen = Counter()

        def counted():
            words = Counter()
            for unit, n in seen.items():
                for w in byte_bpe_words(unit) or (unit,):
                    words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

        for _, texts in parts(batches):
            for t in texts:
                seen.update(byte_bpe_units(t))
            if len(seen) > 300_000:
                yield counted()
        yield counted()

    counts = Scratch(docs.sparkSession, "words").write(docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word").between(1, WIDE)))
    least, left = None, most
    for n, words in sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True):
        left -= words
        if left < 0:
            break
        least = n
    return [r["word"] for r in counts.where(F.col("n") >= least).select("word").collect()] if least else []


def compile_lexicon(words: list[str], tokenizer: str) -> Transducer:
    """A transducer of words with the ids that merging gives them."""
    m = merges_of(tokenizer)
    raw = sorted({w.encode() for w in words if w and not special(w)})
    return Transducer.build(raw, m.merge(raw))


class Codec:
    """Encodes units through the lexicon; a worker keeps one."""

    def __init__(self, tokenizer: str, lexicon: Transducer, most_bytes: int = 200_000_000):
        self.merges, self.lexicon = merges_of(tokenizer), lexicon
        self.memory = Memory(self._encode, most_bytes, split=byte_bpe_words)

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of words; of units with special strings, by their words."""
        odd = [i for i, w in enumerate(words) if special(w)]
        inner = {p for i in odd for k, s in enumerate(self.merges.split_special.split(words[i]) if self.merges.split_special else [words[i]]) if k % 2 == 0 for p in byte_words(s)}
        skip = set(odd)
        plain = [i for i in range(len(words)) if i not in skip]
        extra = list(inner)
        ids = self._words([words[i] for i in plain] + extra)
        out: list[bytes] = [b""] * len(words)
        for i, x in zip(plain, ids, strict=False):
            out[i] = x
        merged = dict(zip(extra, ids[len(plain) :], strict=True)).__getitem__
        for i in odd:
            out[i] = self.merges.ids(words[i], merged)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        rank = self.lexicon.ranks(raw)
        first, data = self.lexicon.first, memoryview(self.lexicon.ids.view(np.uint8))
        known = np.maximum(rank, 0) if len(first) > 1 else np.zeros(0, np.int64)
        begin, end = (4 * first[known]).tolist(), (4 * first[known + 1]).tolist()
        out = [bytes(data[a:b]) if r >= 0 else b"" for r, a, b in zip(rank.tolist(), begin, end, strict=True)] if len(known) else [b""] * len(raw)
        unseen = np.flatnonzero(rank < 0).tolist()
        for k, x in zip(unseen, self.merges.merge([raw[k] for k in unseen]), strict=True):
            out[k] = x.astype("<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(x), "<u4") for x in self.memory.look_up([byte_bpe_units(t) for t in texts])]

    def decode(self, ids: list[int]) -> str:
        return self.merges.decode(ids)


def _codec(tokenizer: str, key: str, broadcast) -> Codec:
    return held(("codec", tokenizer, key), lambda: Codec(tokenizer, Transducer.mapped(broadcast.value)))


def lexicon_codec(docs: DataFrame, tokenizer: str, lexicon: int = 50_000, id_col: str = "doc_id", text_col: str = "text"):
    """(narrowed documents, function that gives a worker's Codec): the lexicon comes from all texts."""
    narrowed = narrow(docs, id_col, text_col)
    data = compile_lexicon(frequent_words(narrowed, tokenizer, lexicon), tokenizer).to_bytes()
    key, broadcast = hashlib.sha256(data).hexdigest(), docs.sparkSession.sparkContext.broadcast(data)
    return narrowed, lambda: _codec(tokenizer, key, broadcast)


def encode(docs: DataFrame, tokenizer: str, lexicon: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of ints) of every whole text."""
    narrowed, codec = lexicon_codec(docs, tokenizer, lexicon, id_col, text_col)

    def run(batches):
        for doc_ids, texts in parts(batches):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([x.astype(np.int32) for x in codec().encode(texts)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return narrowed.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of lists of ids; a null list gives the empty text."""

    def run(batches):
        m = merges_of(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(ids or []) for ids in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, lexicon: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: number of ids, hash of the ids, hash of the text decoded from them (SCHEMA)."""
    narrowed, codec = lexicon_codec(docs, tokenizer, lexicon, id_col, text_col)

    def run(batches):
        c, digits = codec(), [str(i) for i in range(len(merges_of(tokenizer).bytes_of))]
        for doc_ids, texts in parts(batches):
            rows = [x.tolist() for x in c.encode(texts)]
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(map(len, rows), pa.int64()), pa.array([sha(",".join(map(digits.__getitem__, r))) for r in rows], pa.string()), pa.array([sha(c.decode(r)) for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return narrowed.mapInArrow(run, SCHEMA)
