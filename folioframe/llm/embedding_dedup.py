"""Embedding near-duplicates by product quantisation that loses no link.

Vectors are scaled to length 1, so that a cosine of at least c is a distance of at most
d = sqrt(2 - 2c). A coarse centroid's inverted list holds the vectors nearest to it as residual
codes, one per subspace, with the length of what the codes leave out.

Sufficient probes: a vector within d of x that is nearest to centroid j lies on j's side of the plane
between j and x's own centroid i, so j is probed unless (|x-j|^2 - |x-i|^2) / 2|i-j| > d, and unless
|x-j| > d + the list's radius. In a list, the asymmetric distance (table look-ups of x against the
codes) less the left-out length bounds the true distance from below; whatever the bound leaves is
reranked by the exact cosine. So the index finds what brute force finds.

Centroids and codebooks are fitted on a bounded sample (`sample` rows, by hash of the id); every row is
indexed. Equal vectors are one row with a count. A list of more than `block` rows of one label is cut
into blocks that meet pairwise; tasks give sums of links and a spanning forest, never pairs.

Null, zero and non-finite vectors, null labels and null ids link with nothing (n_links 0, component: own
id). Vectors of different lengths don't link. Repeated rows count as vectors of their own, rows of one id as one
node of the graph. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .scratch import Scratch
from .simhash_dedup import sorted_groups

#: Slack for rounding in bounds; the rerank alone decides.
SLACK = 1e-4


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids (fewer points: the points)."""
    if len(x) <= k:
        return x.copy()
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1)[None, :] - 2 * x @ centers.T).argmin(1)


@dataclass
class Index:
    """Coarse centroids [lists, dim] and codebooks [subspace, code, dim / subspaces] for one dimension."""

    coarse: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int, codes: int, seed: int = 42) -> Index:
        rng = np.random.default_rng(seed)
        coarse = k_means(x, lists, 8, rng)
        rest = x - coarse[nearest(x, coarse)]
        cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        return cls(coarse, [k_means(rest[:, a:b], codes, 6, rng) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, left-out length, distance to the centroid) of each row."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(zip(self.cuts, self.cuts[1:], strict=False), self.books, strict=True)], 1).astype(np.uint8)
        left = rest - np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return at, codes, np.sqrt((left**2).sum(1)), np.sqrt((rest**2).sum(1))

    def probes(self, x: np.ndarray, reach: float, radius: np.ndarray) -> np.ndarray:
        """[row, list]: lists that may hold a vector within reach. radius: of each list, below 0 if empty."""
        square = np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1)[None, :], 0)
        own = square.argmin(1)
        apart = np.sqrt(np.maximum(((self.coarse[:, None] - self.coarse[None, :]) ** 2).sum(2), 0))[own]
        plane = square - square[np.arange(len(x)), own][:, None] <= 2 * apart * (reach + SLACK) + SLACK
        return plane & (np.sqrt(square) <= radius[None, :] + reach + SLACK) & (radius[None, :] >= 0)

    def distances(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """[query, coded row] asymmetric distances in a list, from one table per query and subspace."""
        rest, total = x - self.coarse[which], np.zeros((len(x), len(codes)))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            table = ((rest[:, a:b, None] - book.T[None, :, :]) ** 2).sum(1)
            total += table[:, codes[:, m]]
        return np.sqrt(total)


def unit(batch: pa.Array, dim: int) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def by_dimension(batch: pa.RecordBatch, column: int):
    """(dimension, rows of the batch that have it)."""
    sizes = pc.list_value_length(batch.column(column)).to_numpy()
    for dim in np.unique(sizes):
        yield int(dim), batch.take(pa.array(np.flatnonzero(sizes == dim)))


def link_vectors(nodes: DataFrame, cosine: float, scratch: Scratch, sample: int, lists: int, subspaces: int, codes: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(links a-b, node and number of other vectors linked) of distinct vectors: node, label, vector, n."""
    spark, reach = nodes.sparkSession, math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = nodes.select("node", "vector").orderBy(F.xxhash64("node")).limit(sample).toArrow().combine_chunks().to_batches()
    index = {dim: Index.fit(unit(b.column(1), dim), lists, subspaces, codes) for whole in rows[:1] for dim, b in by_dimension(whole, 1)}

    def coded(batches):
        for batch in batches:
            for dim, b in by_dimension(batch, 2):
                x = unit(b.column(2), dim)
                at, code, left, far = index[dim].encode(x) if dim in index else (np.zeros(len(x), int), np.zeros((len(x), 1), np.uint8), np.full(len(x), 9.0), np.full(len(x), 9.0))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in range(4)), pa.array(np.full(len(x), dim), pa.int32()), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(left), pa.array(far)],
                    names=["node", "label", "vector", "n", "dim", "list", "code", "left_out", "far"],
                )

    kept = scratch.write(nodes.select("node", F.col("label").cast("long").alias("label"), "vector", "n").mapInArrow(coded, "node long, label long, vector array<double>, n long, dim int, list int, code binary, left_out double, far double"))
    radius = {dim: np.full(len(i.coarse), -1.0) for dim, i in index.items()}
    for dim, at, far in kept.where(F.col("dim").isin(list(index))).groupBy("dim", "list").agg(F.max("far")).collect() if index else []:
        radius[dim][at] = far

    def probed(batches):
        for batch in batches:
            for dim, b in by_dimension(batch, 2):
                x = unit(b.column(2), dim)
                row, at = np.nonzero(index[dim].probes(x, reach, radius[dim])) if dim in index else (np.arange(len(x)), np.zeros(len(x), int))
                some = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(3)), pa.array(np.full(len(row), dim), pa.int32()), pa.array(at, pa.int32())], names=["node", "label", "vector", "dim", "list"])

    lists_of = ["label", "dim", "list"]
    sizes = kept.groupBy(*lists_of).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    salt = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    queries = kept.select("node", "label", "vector").mapInArrow(probed, "node long, label long, vector array<double>, dim int, list int")
    shape = [*lists_of, "cell", "query", "node", "vector", "n", "code", "left_out"]
    data = kept.join(sizes, lists_of).select("*", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: y + (1 << 20) * salt.cast("long"))).alias("cell"), F.lit(False).alias("query")).select(*shape)
    asked = queries.join(sizes, lists_of).select(
        "*", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x.cast("long") * (1 << 20) + salt)).alias("cell"), F.lit(True).alias("query"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("left_out")
    ).select(*shape)
    order = [*lists_of, "cell"]
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rerank(batches):
        for cols, starts in sorted_groups(batches, 4):
            _, dims, at, _, query, node, vector, n, code, left_out = cols
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(starts, [*starts[1:], len(node)], strict=True):
                q, d = np.flatnonzero(query[lo:hi]) + lo, np.flatnonzero(~query[lo:hi].astype(bool)) + lo
                if not len(q) or not len(d):
                    continue
                x, y = (np.stack(vector[r]).astype(np.float64) for r in (q, d))
                dim, which = int(dims[lo]), int(at[lo])
                ux, uy = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
                ux, uy = (v / np.sqrt((v**2).sum(1, keepdims=True)) for v in (ux, uy))
                codes_of = np.stack([np.frombuffer(c, np.uint8) for c in code[d]])
                u, v = [], []
                for a in range(0, len(q), step := max(1, (1 << 19) // len(d))):
                    near = index[dim].distances(ux[a : a + step], which, codes_of) - left_out[d][None, :] <= reach + SLACK if dim in index else np.ones((len(ux[a : a + step]), len(d)), bool)
                    i, j = np.nonzero(near)
                    for b in range(0, len(i), 1 << 16):
                        e, f = i[b : b + (1 << 16)] + a, j[b : b + (1 << 16)]
                        good = (np.einsum("ij,ij->i", ux[e], uy[f]) >= cosine) & (node[q][e] != node[d][f])
                        u.append(e[good])
                        v.append(f[good])
                u, v = np.concatenate(u), np.concatenate(v)
                if len(u):
                    sums = np.bincount(u, weights=n[d][v].astype(float), minlength=len(q)).astype(np.int64)
                    hit = np.flatnonzero(sums)
                    out.append((node[q][hit], node[q][hit], sums[hit]))
                    p, r = forest(node[q][u], node[d][v])
                    out.append((p, r, np.zeros(len(p), np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64), pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "n"])

    found = scratch.write(data.unionByName(asked).repartition(n_parts, *order).sortWithinPartitions(*order).mapInArrow(rerank, "a long, b long, n long"))
    return found.where("a <> b").select("a", "b"), found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))


def embedding_components(
    embeddings: DataFrame, cosine: float = 0.93, sample: int = 20_000, lists: int = 64, subspaces: int = 8, codes: int = 64, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector, linked within its label."""
    scratch = Scratch(embeddings.sparkSession, "embeddings")
    vector = F.col(vector_col).cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), F.col(label_col).cast("long").alias("label")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    nodes = scratch.write(rows.where("sound").groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")))
    links, counts = link_vectors(nodes, cosine, scratch, sample, lists, subspaces, codes, block)
    linked = components(links, scratch)
    rooted = nodes.join(linked, "node", "left").select("node", "label", "vector", "n", F.coalesce("component", "node").alias("component_id"))
    named = rooted.join(counts, "node", "left").select("label", "vector", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    good = rows.where("sound").join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM v
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v LEFT JOIN least l ON l.node = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
"""
