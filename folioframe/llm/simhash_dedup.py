"""SimHash near-duplicates: fingerprints linked by the generalised pigeonhole principle.

Fingerprints of 64 bits (or several words of 64) are cut into m partitions of 16 bits, correlated
bits together. If two fingerprints differ in at most r bits and thresholds t of the partitions (-1: not
looked at) sum to r - m + 1, they differ in at most t bits within some partition. Each fingerprint
gets thresholds of its own: dynamic programming takes those with the fewest estimated candidates, from
histograms of the partitions' values (m x 65,536 numbers, whatever the input). It probes all values
within its thresholds; what it meets there is verified over all bits.

`simhash_components` links one-word fingerprints within 3 bits, for which the principle finds every
link. `keep_one` wants texts whose shingles are similar to 0.8, and such texts differ in a seventh of
their bits, beyond what any index of exact keys covers. It takes fingerprints of twelve words over the
distinct shingles: texts meet if one of 48 partitions is equal (a pair at 0.8 does with a probability
of 0.97), and those met whose first six words differ in at most 79 bits (three deviations above the
mean of 58) are candidates. Texts of a group of candidates are compared by the shingles
themselves; only a similarity of 0.8 or more links them.

Large groups. Equal fingerprints are one row. A value with more than `refine` fingerprints is no
key; the other bits are cut into as many parts as could differ and one more, of which one must be
equal, for longer keys. What is still more than `block` fingerprints is cut into blocks that meet
pairwise, in tasks of bounded size. A task gives the links of a spanning forest of what it compared,
never all pairs, and components are found by joins (`components`).

Null text counts as empty, and empty texts (fingerprint 0) are linked like others. A null id takes
part and never names a component (null if there is no other id). Repeated rows each get a row, an
empty table gives an empty result, other columns are ignored (`keep_one` keeps them, and one row of
each group, whatever its ids).
"""

from __future__ import annotations

import functools
import itertools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import fresh, held, narrow, parts
from .components import components, forest
from .scratch import Scratch

SEED = 42
WIDTH = 16
#: The farthest that a partition is probed: 1 + 16 + 120 values.
FAR = 2


def spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """[hash, word]: the hash itself, then further words mixed from it."""
    out = [hashes]
    for k in range(1, words):
        x = hashes + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, 1)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles in order; a text of fewer words is one shingle, one without words has none."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    whole, hash_of = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= shingle:
        return np.array([hash_of(whole, SEED)], np.uint64)
    end = np.cumsum([len(w) + 1 for w in tokens])
    start = np.concatenate(([0], end[:-1]))[: len(tokens) - shingle + 1].tolist()
    return np.array([hash_of(whole[a:b], SEED) for a, b in zip(start, (end[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: str, shingle: int = 3, words: int = 1) -> np.ndarray:
    """Bits set in over half the shingles' hashes, as 64-bit words; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle), words)


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """Bits set in over half the hashes, spread to 64-bit words."""
    ones = np.zeros(64 * words, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        some = spread(hashes[lo : lo + (1 << 14)], words)
        ones += np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def as_lists(prints: np.ndarray) -> pa.Array:
    """[print, word] as lists of signed longs."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1) * prints.shape[1], pa.int32()), pa.array(np.ascontiguousarray(prints).view(np.int64).ravel()))


def as_words(column: pa.Array, words: int) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, words)


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and print (the fingerprint's words as signed longs) of every whole text."""

    def run(batches):
        for ids, texts in parts(batches):
            yield pa.RecordBatch.from_arrays([ids, as_lists(np.stack([fingerprint(t, shingle, words) for t in texts]))], names=["doc_id", "print"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, print array<long>")


def bits_of(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")


def bit_counts(prints: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """(fingerprints, how often two bits are set together): sums of bits squared, added up by the executors."""
    n_bits = 64 * words

    def run(batches):
        both, n = np.zeros((n_bits, n_bits)), 0
        for b in batches:
            x = bits_of(as_words(b.column(0), words)).astype(np.float32)
            both += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_bits**2 + 1)), pa.array([*both.ravel().astype(np.int64), n], pa.int64())], names=["i", "n"])

    sums = np.zeros(n_bits**2 + 1)
    counted = prints.select("print").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    sums[counted["i"].to_numpy()] = counted["n"].to_numpy()
    return int(sums[-1]), sums[:-1].reshape(n_bits, n_bits)


def group_bits(n: int, both: np.ndarray) -> np.ndarray:
    """Rows of WIDTH bits: the most correlated pairs of bits are put together first."""
    n_bits = len(both)
    p = np.diag(both) / max(n, 1)
    spread_of = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread_of, spread_of)
    groups = [{i} for i in range(n_bits)]
    of = list(range(n_bits))
    left, right = np.triu_indices(n_bits, 1)
    for k in np.argsort(-tie[left, right], kind="stable").tolist():
        a, b = of[left[k]], of[right[k]]
        if a != b and len(groups[a]) + len(groups[b]) <= WIDTH:
            for i in groups[b]:
                of[i] = a
            groups[a] |= groups[b]
            groups[b] = set()
    out: list[list[int]] = [[] for _ in range(n_bits // WIDTH)]
    loose = []
    for k, g in enumerate(sorted((sorted(g) for g in groups if g), key=lambda g: (-len(g), g))):
        if k < len(out):
            out[k] += g
        else:
            loose += g
    for bit in loose:
        min(out, key=len).append(bit)
    return np.array([sorted(g) for g in out])


def project(bits: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """[fingerprint, partition] values."""
    return np.stack([bits[:, g].astype(np.int64) @ (1 << np.arange(len(g))) for g in groups], 1)


@functools.lru_cache(maxsize=1)
def flips() -> list[np.ndarray]:
    """Masks that change exactly 0, 1, ... FAR bits of a partition."""
    return [np.array([sum(1 << b for b in c) for c in itertools.combinations(range(WIDTH), k)]) for k in range(FAR + 1)]


def candidate_costs(histogram: np.ndarray) -> np.ndarray:
    """[partition, threshold + 1, value]: fingerprints within the threshold, and the probes made."""
    values = np.arange(1 << WIDTH)
    out = np.zeros((len(histogram), FAR + 2, 1 << WIDTH), np.float32)
    for k in range(len(histogram)):
        for t, masks in enumerate(flips()):
            out[k, t + 1] = out[k, t] + sum(histogram[k][values ^ m] for m in masks) + len(masks)
    return out


def costs_of(run: str, histogram: np.ndarray) -> np.ndarray:
    """candidate_costs of a run's histograms, computed once per worker."""
    return held(("costs", run), lambda: candidate_costs(histogram))


def allocate(values: np.ndarray, costs: np.ndarray, reach: int) -> np.ndarray:
    """[fingerprint, partition] thresholds that sum to reach - partitions + 1 with the least cost.

    Dynamic programming over partitions; a state is the sum of (threshold + 1) so far.
    """
    total, n, m = reach + 1, len(values), values.shape[1]
    best = np.full((n, total + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for k in range(m):
        new, pick = np.full((n, total + 1), np.inf), np.zeros((n, total + 1), np.int8)
        for s in range(total + 1):
            for j in range(min(s, FAR + 1) + 1):
                cost = best[:, s - j] + costs[k, j][values[:, k]]
                better = cost < new[:, s]
                new[better, s], pick[better, s] = cost[better], j
        best = new
        picks.append(pick)
    out, s, rows = np.zeros((n, m), np.int64), np.full(n, total), np.arange(n)
    for k in range(m - 1, -1, -1):
        j = picks[k][rows, s]
        out[:, k], s = j.astype(np.int64) - 1, s - j
    return out


def keyed(prints: np.ndarray, groups: np.ndarray, histogram: np.ndarray, costs: np.ndarray, reach: int, refine: int) -> tuple[np.ndarray, ...]:
    """(row, key, data, probe, load): where each fingerprint lies and looks.

    key: partition, value, part (0: not refined) and the part's bits, at most 16. load: fingerprints at
    an unrefined key, -1 at a refined one.
    """
    bits = bits_of(prints)
    values = project(bits, groups)
    limits = allocate(values, costs, reach)
    rows, keys, data, probe, load = [], [], [], [], []
    for k in range(len(groups)):
        rest = np.array_split(np.delete(groups, k, 0).ravel(), reach + 1)
        for t, masks in enumerate(flips()):
            for mask in masks:
                at = np.flatnonzero((limits[:, k] >= t) | (t == 0))
                v = values[at, k] ^ mask
                n = histogram[k][v]
                at, v, n = at[n > 0], v[n > 0], n[n > 0]
                big = n > refine
                head = ((k << WIDTH) + v) << 24
                own, looks = np.full(len(at), t == 0), limits[at, k] >= t
                for part in range(len(rest) + 1):
                    take = big if part else ~big
                    if not take.any():
                        continue
                    key = head[take]
                    if part:
                        key = key + (part << WIDTH) + bits[np.ix_(at[take], rest[part - 1])].astype(np.int64) @ (1 << np.arange(len(rest[part - 1])))
                    rows.append(at[take])
                    keys.append(key)
                    data.append(own[take])
                    probe.append(looks[take])
                    load.append(np.where(big[take], -1, n[take]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, keys, data, probe, load))


def match(data: np.ndarray, probes: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(probe, fingerprint) positions that differ in at most `within` bits, a block at a time."""
    a, b = [], []
    step = max(1, (1 << 20) // max(1, len(data)))
    for lo in range(0, len(probes), step):
        some = probes[lo : lo + step]
        far = np.bitwise_count(some[:, None, 0] ^ data[None, :, 0]).astype(np.uint16)
        for k in range(1, data.shape[1]):
            far += np.bitwise_count(some[:, None, k] ^ data[None, :, k])
        i, j = np.nonzero(far <= within)
        a.append(i + lo)
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def sorted_groups(batches, n_keys: int):
    """Groups of rows with equal first columns from sorted batches, each a list of arrays.

    Yields (lists of arrays of several whole groups, starts of the groups).
    """
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in held[:n_keys]], axis=0)) + 1
        if len(change):
            last = change[-1]
            yield [x[:last] for x in held], np.concatenate(([0], change[:-1]))
            held = [x[last:] for x in held]
    if held is not None:
        yield held, np.array([0])


def link_prints(prints: DataFrame, words: int, reach: int, within: int, scratch: Scratch, block: int = 2048, refine: int = 1 << 16, compared: int | None = None) -> DataFrame:
    """Links (a, b) of a spanning forest of distinct fingerprints (columns node, print).

    reach: bits up to which every pair is met. within: bits up to which a pair that is met is linked,
    of the first `compared` words (all).
    """
    compared = compared or words
    spark, m = prints.sparkSession, 64 * words // WIDTH
    if reach + 1 > m * (FAR + 1):
        raise ValueError("the partitions are too few for this distance")
    groups = group_bits(*bit_counts(prints, words))

    def values(batches):
        for b in batches:
            v = project(bits_of(as_words(b.column(0), words)), groups)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(m), len(v))), pa.array(v.ravel())], names=["part", "v"])

    histogram = np.zeros((m, 1 << WIDTH), np.int64)
    counted = prints.select("print").mapInArrow(values, "part long, v long").groupBy("part", "v").agg(F.count(F.lit(1)).alias("n")).toArrow()
    histogram[counted["part"].to_numpy(), counted["v"].to_numpy()] = counted["n"].to_numpy()
    table = spark.sparkContext.broadcast(histogram.astype(np.int32 if histogram.max(initial=0) < 1 << 31 else np.int64))

    run = uuid.uuid4().hex

    def expand(batches):
        for b in batches:
            costs = costs_of(run, table.value)
            node, column = b.column(0).to_numpy(), as_words(b.column(1), words)
            for lo in range(0, len(column), 4096):
                some = column[lo : lo + 4096]
                row, key, data, probe, load = keyed(some, groups, table.value, costs, reach, refine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[lo : lo + 4096][row]), as_lists(some[row, :compared]), pa.array(key, pa.int64()), pa.array(data.astype(bool)), pa.array(probe.astype(bool)), pa.array(load.astype(np.int64))],
                    names=["node", "print", "key", "data", "probe", "load"],
                )

    rows = prints.select("node", "print").mapInArrow(expand, "node long, print array<long>, key long, data boolean, probe boolean, load long")
    if (histogram > refine).any():
        rows = scratch.write(rows)
        big = rows.where("load < 0 and data").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        rows = rows.join(big, "key", "left").withColumn("load", F.when(F.col("load") >= 0, F.col("load")).otherwise(F.coalesce("n", F.lit(0))))
    blocks = F.greatest(F.ceil(F.col("load") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = lambda x, y, d, p: F.struct(x.alias("x"), y.alias("y"), d.alias("data"), p.alias("probe"))
    cells = F.when(F.col("blocks") == 1, F.array(cell(F.lit(0), F.lit(0), F.col("data"), F.col("probe")))).otherwise(
        F.concat(
            F.when(F.col("data"), F.transform(every, lambda y: cell(own, y, F.lit(True), F.lit(False)))).otherwise(F.array()),
            F.when(F.col("probe"), F.transform(every, lambda x: cell(x, own, F.lit(False), F.lit(True)))).otherwise(F.array()),
        )
    )
    dealt = rows.withColumn("blocks", blocks).select("node", "print", "key", F.explode(cells).alias("c")).select(
        "key", (F.col("c.x").cast("long") * (1 << 20) + F.col("c.y")).alias("cell"), "node", "c.data", "c.probe", *[F.col("print")[k].alias(f"w{k}") for k in range(compared)]
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "cell"]

    def compare(batches):
        for (_, _, node, data, probe, *w), starts in sorted_groups(batches, 2):
            a, b, p = [], [], np.stack(w, 1).view(np.uint64)
            for lo, hi in zip(starts, [*starts[1:], len(p)], strict=True):
                if hi - lo > 1:
                    d, q = np.flatnonzero(data[lo:hi]) + lo, np.flatnonzero(probe[lo:hi]) + lo
                    if len(d) and len(q):
                        i, j = match(p[d], p[q], within)
                        u, v = node[q[i]], node[d[j]]
                        if (other := u != v).any():
                            u, v = forest(u[other], v[other])
                            a.append(u)
                            b.append(v)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return dealt.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")


def named_prints(found: DataFrame, words: int, reach: int, within: int, scratch: Scratch) -> DataFrame:
    """print and component_id (smallest doc_id reachable) of the distinct fingerprints of doc_id, print."""
    node = F.col("print")[0] if words == 1 else F.xxhash64("print")
    prints = scratch.write(found.groupBy("print").agg(F.min("doc_id").alias("least")).withColumn("node", node))
    linked = components(link_prints(prints, words, reach, within, scratch), scratch).withColumnRenamed("node", "_node")
    nodes = prints.join(linked, prints["node"] == linked["_node"], "left").select("print", "least", F.coalesce("component", "node").alias("root"))
    return nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("print", "component_id")


def simhash_components(docs: DataFrame, reach: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.write(fingerprints(docs, shingle, 1, id_col, text_col))
    named = named_prints(found, 1, reach, reach, scratch)
    return found.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex(F.col("print")[0]), 16, "0")).alias("fingerprint"), "component_id")


def bits_apart(similarity: float, words: int, deviations: int = 3) -> int:
    """Bits in which texts of this similarity (shared shingles / all shingles) differ at most, but for one in 740."""
    p = float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    n = 64 * words
    return round(n * p + deviations * (n * p * (1 - p)) ** 0.5)


def shingle_sets(rows: DataFrame, shingle: int, words: int) -> DataFrame:
    """row, print and node (a hash of the set) of every text's distinct shingles; rows: row, text."""

    def run(batches):
        for keys, texts in parts(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([keys, as_lists(np.stack([majority(x, words) for x in sets])), pa.array(node)], names=["row", "print", "node"])

    return rows.mapInArrow(run, "row long, print array<long>, node long")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets share that part of all their members."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1) >= similarity


def similar_links(prints: np.ndarray, sets: list[np.ndarray], similarity: float, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) positions of the components of similar sets whose prints differ in at most `within` bits.

    Pairs that are connected by others already are not compared.
    """
    i, j = match(prints, prints, within)
    i, j = i[i < j], j[i < j]
    root, a, b = np.arange(len(sets)), [], []
    while len(i):
        _, first = np.unique(i, return_index=True)
        for k in first.tolist():
            if similar(sets[i[k]], sets[j[k]], similarity):
                a.append(i[k])
                b.append(j[k])
        if a:
            node, low = forest(np.array(a), np.array(b))
            root[node] = low
            a, b = node.tolist(), low.tolist()
        left = root[i] != root[j]
        left[first] = False
        i, j = i[left], j[left]
    return np.array(a, np.int64), np.array(b, np.int64)


def verified(candidates: DataFrame, shingle: int, words: int, similarity: float, within: int, block: int = 1024) -> DataFrame:
    """Links (a, b) of texts (node, component, text) of a component whose shingles are similar, as spanning forests."""
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches):
        for b in batches:
            for keys, texts in parts([pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(3)], names=["i", "text"])]):
                sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
                some = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                own = as_lists(np.stack([majority(x, words) for x in sets]))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(keys) for k in range(3)), own, some], names=["component", "node", "blocks", "print", "shingles"])

    sized = candidates.join(candidates.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "component")
    sets = sized.select("component", "node", "blocks", "text").mapInArrow(cut, "component long, node long, blocks int, print array<long>, shingles array<long>")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.least(own, y).cast("long") * (1 << 20) + F.greatest(own, y))
    order = ["component", "cell"]

    def compare(batches):
        for (_, _, node, prints, shingles), starts in sorted_groups(batches, 2):
            for lo, hi in zip(starts, [*starts[1:], len(node)], strict=True):
                if hi - lo > 1:
                    own = np.stack(prints[lo:hi]).view(np.uint64)
                    a, b = similar_links(own, [x.view(np.uint64) for x in shingles[lo:hi]], similarity, within)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][a]), pa.array(node[lo:hi][b])], names=["a", "b"])

    dealt = sets.select("component", F.explode(cells).alias("cell"), "node", "print", "shingles")
    return dealt.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 12, compared: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows (all columns) that are the first of their group of near copies.

    Exactly one row of a group stays: that of the least id (null last), and of the rows of one id the first.
    Values of a partition that many texts share are compared by block pairs alone.
    """
    scratch, within, row = Scratch(docs.sparkSession, "near-copies"), bits_apart(similarity, compared), fresh(docs, "_row")
    rows = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = rows.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = scratch.write(shingle_sets(texts, shingle, words))
    sets = scratch.write(found.groupBy("node", "print").agg(F.min("row").alias("row")))
    met = components(link_prints(sets, words, 64 * words // WIDTH - 1, within, scratch, refine=1 << 62, compared=compared), scratch)
    members = met.unionAll(met.select(F.col("component").alias("node"), "component").distinct())
    linked = components(verified(members.join(sets.select("node", "row"), "node").join(texts, "row").select("component", "node", "text"), shingle, compared, similarity, within), scratch)
    named = found.select("node", "row").join(linked, "node", "left").select("row", F.coalesce("component", "node").alias("root"))
    named = named.join(rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id")), "row")
    stays = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias(row)).select(row)
    return rows.join(stays, row, "left_semi").drop(row)
