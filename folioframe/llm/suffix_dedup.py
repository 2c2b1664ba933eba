"""Removal of repeated passages, found in merged Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes that covers it also starts elsewhere. To bring equal
strings together without sorting all suffixes of all texts in one place:

0. A text of `length` bytes or more that occurs twice goes whole; one row stands for it in what follows.
1. Each string of `length` bytes has an anchor, the least hashed 32-byte gram among its first `width`
   places; equal strings have it at the same distance a. An anchor's strings all hold its core, the
   length - width + 1 bytes from the anchor on. Only anchors whose core occurs twice go on.
2. Anchors with the same core form a group. An anchor's context is its core with the bytes around it
   that its strings reach; a context that occurs twice repeats whole.
3. Within a group, contexts are strings of symbols around one for what all of them share; a symbol is
   a run of bytes up to where contexts part, and bytes past the longest match with any other context
   can't repeat and are left out. Contexts are dealt to shards of 16, each shard is transformed, the
   transforms are merged (`bwt`), and the common prefixes say which strings repeat.

Groups are bounded: one with more than `most` contexts is split, exactly, by the distance a. A
narrower range of distances has a longer core and shorter contexts; a range of one distance has
nothing but the core. All exchanges are joins and sums by key: sums begin where the rows are, joins are of
written tables, whose hot keys adaptive execution deals to several tasks, and equal texts and equal contexts
are one row before they meet. Contexts of one core are told apart by 64-bit hashes.

Null text counts as empty. Texts shorter than `length` bytes keep everything. Repeated rows are
places of their own and lose their copies' bytes as others do; null ids stay. An empty table gives an
empty result; other columns are ignored (`remove_repeats` keeps them).
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import fresh
from .bwt import longest_elsewhere
from .scratch import Scratch
from .simhash_dedup import sorted_groups

GRAM = 32
LENGTH, WIDTH, MOST = 400, 192, 8192
#: Ranges of distances that a group with too many contexts is split into.
FINER = (16, 1)
KEY = ["hi", "lo"]


def _table() -> np.ndarray:
    return np.random.default_rng(20_011).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_GEAR = _table()


def anchors(data: bytes, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, least distance, greatest distance) of all strings of `length` bytes."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    h = _GEAR[np.frombuffer(data, np.uint8)]
    k = 1
    while k < GRAM:
        h = (h[:-k] << np.uint64(k)) + h[k:]
        k *= 2
    h *= np.uint64(0x9E3779B97F4A7C15)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    starts = n - length + 1
    key = key[: starts + width - 1]
    rows = -(-len(key) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [starts])) - 1
    return at[first], at[first] - last, at[first] - first


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def branches(flanks: list[bytes], number: int) -> tuple[list[tuple[list[int], list[int]]], int]:
    """Where each flank parts from others: (depths, branches) on its path in the flanks' trie, and the next
    free number. The last depth is the longest prefix that another flank has."""
    order = sorted(range(len(flanks)), key=flanks.__getitem__)
    near = [0, *(common(flanks[a], flanks[b]) for a, b in pairwise(order))]
    out: list[tuple[list[int], list[int]]] = [([], [])] * len(flanks)
    todo: list[tuple[int, int, list[int], list[int]]] = [(0, len(flanks), [], [])]
    while todo:
        lo, hi, depths, names = todo.pop()
        if hi - lo == 1:
            out[order[lo]] = depths, names
            continue
        depth = min(near[lo + 1 : hi])
        depths, names, number = [*depths, depth], [*names, number], number + 1
        cuts = [lo, *(k for k in range(lo + 1, hi) if near[k] == depth), hi]
        todo += [(x, y, depths, names) for x, y in pairwise(cuts)]
    return out, number


def repeated_ranges(groups: list[list[tuple[bytes, bytes, int, int]]], width: int) -> list[list[list[tuple[int, int]]]]:
    """Of each group's distinct contexts (left, right, least and greatest distance): ranges of distances of
    strings that another context of the group has too. Distances count from the core's first byte.

    A context becomes a string of symbols: the branches of its left bytes from the farthest inwards, one
    symbol for what all contexts of the group share, the branches of its right bytes outwards. Bytes
    between two branches are shared alike, so a string that ends among them needs the whole symbol.
    """
    number, made = 1, []
    for group in groups:
        left, number = branches([c[0][::-1] for c in group], number)
        right, number = branches([c[1] for c in group], number)
        core = number
        number += 1
        made.append(([[*x[1][:0:-1], core, *y[1][1:]] for x, y in zip(left, right, strict=True)], [(x[0], y[0]) for x, y in zip(left, right, strict=True)]))
    # Groups share no symbol, so that all can be merged together.
    found = longest_elsewhere([x for strings, _ in made for x in strings])
    shared = iter(zip([shape for _, shapes in made for shape in shapes], found, strict=True))
    out = []
    for group in groups:
        out.append([])
        for _, _, a, hi in group:
            (l_depths, r_depths), found = next(shared)
            ranges: list[list[int]] = []
            a = max(a, width - 1 - r_depths[-1])
            while a <= min(hi, l_depths[-1]):
                i, j = bisect_left(l_depths, a), bisect_left(r_depths, width - 1 - a)
                end = min(hi, l_depths[i], width - 2 - r_depths[j - 1] if j else hi)
                if found[len(l_depths) - 1 - i] >= i + 1 + j:
                    if ranges and ranges[-1][1] == a - 1:
                        ranges[-1][1] = end
                    else:
                        ranges.append([a, end])
                a = end + 1
            out[-1].append([(x, y) for x, y in ranges])
    return out


def _texts(batches):
    """(rows before the last column, bytes of the text) of each row."""
    for b in batches:
        column = b.column("text")
        for i in range(b.num_rows):
            yield b, i, column[i].as_buffer().to_pybytes() if column[i].is_valid else b""


def _in_batches(rows, schema: pa.Schema, most: int = 8_192):
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def packed(at, near, far):
    """A byte and its least and greatest distance (below 512) as one number."""
    return at * (1 << 18) + near * (1 << 9) + far


def unpacked(place: int) -> tuple[int, int, int]:
    return place >> 18, place >> 9 & 511, place & 511


def core_key(core: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(core)
    return _signed(x >> 64), _signed(x & ((1 << 64) - 1))


def context_key(left: bytes, right: bytes, near: int, far: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(struct.pack("<III", len(left), near, far) + left + right))


def find_anchors(texts: DataFrame, length: int, width: int) -> DataFrame:
    """core (hash), rid, place (see `packed`) of the anchors of texts (rid, text)."""

    def run(batches):
        for b in batches:
            rid, text = b.column("rid").to_pylist(), b.column("text")
            core, row, columns, size = [], [], [], 0
            for i in range(b.num_rows):
                data = text[i].as_buffer().to_pybytes() if text[i].is_valid else b""
                found = anchors(data, length, width)
                core += [xxhash.xxh3_64_intdigest(data[c : c + length - width + 1]) for c in found[0].tolist()]
                row += [rid[i]] * len(found[0])
                columns.append(found)
                size += len(found[0])
                if size > 100_000 or i == b.num_rows - 1 and size:
                    at, near, far = (np.concatenate(x) for x in zip(*columns, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(core, np.uint64).view(np.int64)), pa.array(row, pa.int64()), pa.array(packed(at, near, far))], names=["core", "rid", "place"])
                    core, row, columns, size = [], [], [], 0

    return texts.mapInArrow(run, "core long, rid long, place long")


_CONTEXT = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("context", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("near", pa.int32()), ("far", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])


def contexts(texts: DataFrame, lists: DataFrame, length: int, width: int) -> DataFrame:
    """Each place of lists (rid, items) with its core's 128-bit and its context's 64-bit hash; at: the core's first byte,
    which distances count from. A task gives the bytes around the core with a context's first item alone."""

    def run(batches):
        seen: set[tuple] = set()

        def rows():
            for b, i, data in _texts(batches):
                rid = b.column("rid")[i].as_py()
                for at, near, far in map(unpacked, b.column("items")[i].as_py()):
                    end = at + length - width + 1
                    left, right = data[max(0, at - width + 1) : at], data[end : end + width - 1]
                    key = (*core_key(data[at:end]), context_key(left, right, near, far))
                    new = key not in seen
                    if new:
                        if len(seen) > 300_000:
                            seen.clear()
                        seen.add(key)
                    yield (*key, rid, at, near, far, left if new else None, right if new else None)

        yield from _in_batches(rows(), _CONTEXT)

    return texts.join(lists, "rid").select("rid", "text", "items").mapInArrow(run, "hi long, lo long, context long, rid long, at long, near int, far int, left binary, right binary")


_INNER = pa.schema([*((n, pa.int64()) for n in ("hi", "lo", "context")), ("near", pa.int32()), ("far", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), *((n, pa.int64()) for n in ("of_hi", "of_lo", "of_context")), ("shift", pa.int32())])


def inner(rows: DataFrame, outer: int, width: int) -> DataFrame:
    """Contexts (of distances 0 to outer - 1) as contexts of ranges of `width` distances, with longer cores.

    No text is read again: what a longer core takes in stands in the context's own bytes. of_*, shift: the
    context that a row comes from, and the distance that its own distances count from.
    """

    def run(batches):
        def made():
            for b in batches:
                for hi, lo, context, least, most, left, right in zip(*(b.column(n).to_pylist() for n in ("hi", "lo", "context", "near", "far", "left", "right")), strict=True):
                    for p in range(least // width * width, most + 1, width):
                        near, far, cut, end = max(least - p, 0), min(most - p, width - 1), len(left) - p, outer - p - width
                        before, after = left[max(0, cut - width + 1) : cut], right[end : end + width - 1]
                        core = struct.pack("<qqI", hi, lo, p) + left[cut:] + right[:end]
                        yield (*core_key(core), context_key(before, after, near, far), near, far, before, after, hi, lo, context, p)

        yield from _in_batches(made(), _INNER)

    return rows.mapInArrow(run, "hi long, lo long, context long, near int, far int, left binary, right binary, of_hi long, of_lo long, of_context long, shift int")


_RANGE = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("context", pa.int64()), ("near", pa.int32()), ("far", pa.int32())])


def merged_ranges(rows: DataFrame, width: int, most: int = 4096) -> DataFrame:
    """hi, lo, context, near, far: distances whose strings two contexts of a group share.

    Groups are merged together up to `most` contexts; a larger group is merged alone.
    """

    def run(batches):
        def answers(groups: list[tuple[list[tuple], list[tuple]]]):
            for (keys, _), ranges in zip(groups, repeated_ranges([g for _, g in groups], width), strict=True):
                for key, some in zip(keys, ranges, strict=True):
                    for x, y in some:
                        yield (*key, x, y)

        def found():
            groups, size = [], 0
            for cols, starts in sorted_groups(batches, 2):
                hi, lo, context, near, far, left, right = (c.tolist() for c in cols)
                for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(hi)], strict=True):
                    first = {context[i]: i for i in range(a, b)}
                    if groups and size + len(first) > most:
                        yield from answers(groups)
                        groups, size = [], 0
                    if len(first) > 1:
                        groups.append(([(hi[i], lo[i], c) for c, i in first.items()], [(left[i], right[i], near[i], far[i]) for i in first.values()]))
                        size += len(first)
            yield from answers(groups)

        yield from _in_batches(found(), _RANGE)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*KEY, "context", "near", "far", "left", "right").repartition(n, *KEY).sortWithinPartitions(*KEY).mapInArrow(run, "hi long, lo long, context long, near int, far int")


def repeated_contexts(rows: DataFrame, scratch: Scratch, width: int, most: int, finer: tuple[int, ...]) -> DataFrame:
    """hi, lo, context, near, far: distances whose strings occur twice, among contexts of `width` distances.

    rows: a row for each place of a context (left and right may be null but in one row of a context).
    """
    keys = [*KEY, "context"]
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("near"), F.max("far").alias("far"))
    again, shown = per.where("n > 1").select(*keys, "near", "far"), rows.where("left is not null")
    if not finer:
        return again  # a context of one distance is its core
    large = scratch.write(per.groupBy(*KEY).agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > most).select(*KEY))
    if large.isEmpty():
        return merged_ranges(shown, width).unionByName(again)
    out = merged_ranges(shown.join(large, KEY, "left_anti"), width).unionByName(again)
    split = scratch.write(inner(shown.join(large, KEY, "left_semi").select(*keys, "near", "far", "left", "right").dropDuplicates(keys), width, finer[0]))
    found = scratch.write(repeated_contexts(split, scratch, finer[0], most, finer[1:])).withColumnsRenamed({"near": "_near", "far": "_far"})
    back = split.select(*keys, "of_hi", "of_lo", "of_context", "shift").join(found, keys)
    return out.unionByName(back.select(F.col("of_hi").alias("hi"), F.col("of_lo").alias("lo"), F.col("of_context").alias("context"), (F.col("_near") + F.col("shift")).alias("near"), (F.col("_far") + F.col("shift")).alias("far")))


def equal_texts(texts: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """rid, bytes and other (whether another row stands for it) of the texts of `length` bytes or more that occur
    twice. Texts are told apart by 128-bit hashes; one row stands for each group from its smallest rid."""
    same = ["same_1", "same_2"]
    sized = texts.select("rid", F.xxhash64("text").alias("same_1"), F.xxhash64(F.lit(1), "text").alias("same_2"), F.octet_length("text").cast("long").alias("bytes")).where(F.col("bytes") >= length)
    groups = scratch.write(sized.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first")).where("n > 1").drop("n"))
    return scratch.write(sized.join(groups, same).select("rid", "bytes", (F.col("rid") != F.col("first")).alias("other")))


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """rid, begin, end of strings of `length` bytes that also start elsewhere, as overlapping spans."""
    if width > 512:
        raise ValueError("distances are packed in nine bits")
    copies = equal_texts(texts, scratch, length)
    found = scratch.write(find_anchors(texts, length, width))
    # Written, so that the join reads two plain exchanges and can deal a hot core's rows to several tasks.
    twice = scratch.write(found.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    lists = found.join(twice, "core").groupBy("rid").agg(F.collect_set("place").alias("items")).join(copies.where("other").select("rid").distinct(), "rid", "left_anti")
    rows = scratch.write(contexts(texts, lists, length, width))
    scratch.drop(found, twice)
    scratch.release()
    ranges, keys = scratch.write(repeated_contexts(rows, scratch, width, most, FINER)), [*KEY, "context"]
    scratch.release()
    spans = rows.select(*keys, "rid", "at").join(ranges, keys).select("rid", (F.col("at") - F.col("far")).alias("begin"), (F.col("at") - F.col("near") + length).alias("end"))
    out = scratch.write(spans.unionByName(copies.select("rid", F.lit(0).cast("long").alias("begin"), F.col("bytes").alias("end"))))
    scratch.drop(rows, ranges, copies)
    scratch.release()
    return out


def united(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def passages(data: bytes, runs: list[list[int]], words: int, size: int) -> list[list[int]]:
    """The runs that have `words` words or `size` bytes at least; a part of a word at either end counts as one."""
    return [r for r in runs if r[1] - r[0] >= size or len(data[r[0] : r[1]].split()) >= words]


def remaining(data: bytes, runs: list[list[int]]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)], strict=True))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, length: int, width: int, most: int) -> tuple[DataFrame, str]:
    """(the documents with a column of spans, its name)."""
    scratch, spans, own = Scratch(docs.sparkSession, "repeats"), fresh(docs, "_spans"), fresh(docs, "_own")
    rid = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    texts = docs.select(rid.alias("rid"), F.col(text_col).cast("string").alias("text"))
    found = repeated_spans(texts, scratch, length, width, most)
    lists = found.groupBy(F.col("rid").alias(own)).agg(F.collect_set(F.struct("begin", "end")).alias(spans))
    return docs.withColumn(own, rid).join(lists, own, "left").drop(own), spans


def repeat_digest(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text."""
    found, spans = _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", length, width, most)
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        def rows():
            for b, i, data in _texts(batches):
                runs = united([(s["begin"], s["end"]) for s in b.column("spans")[i].as_py() or ()])
                kept = remaining(data, runs)
                yield b.column("doc_id")[i].as_py(), len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()

        yield from _in_batches(rows(), kind)

    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(spans).alias("spans")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", words: int = 0, size: int = 0) -> DataFrame:
    """The documents, all columns, with repeated passages cut out of the text.

    Maximal runs of repeated bytes with fewer than `words` words and fewer than `size` bytes stay. Bytes of a character that a cut leaves incomplete go too. A null text stays null.
    """
    found, own = _with_spans(docs, id_col, text_col, length, width, most)

    def cut(column: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(column, spans, strict=True):
            if t.is_valid and s.is_valid and len(s):
                data = t.as_buffer().to_pybytes()
                out.append(remaining(data, passages(data, united([(x["begin"], x["end"]) for x in s.as_py()]), words, size)).decode("utf-8", "ignore"))
            else:
                out.append(t.as_py())
        return pa.array(out, pa.string())

    names = docs.columns

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([cut(b.column(n), b.column(own)) if n == text_col else b.column(n) for n in names], names=names)

    return found.select(*names, own).mapInArrow(run, docs.schema)
