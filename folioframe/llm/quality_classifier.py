"""A byte-level convolutional network in numpy that scores text quality.

Every byte has a learned vector. Learned filters look at chunks of 16 bytes, one every 8 bytes, so that
chunks overlap and cover the whole document; each filter's greatest answer over all chunks is kept
(max-pooling), and a logistic layer makes one probability of them. Training needs gradients at the
chunks that answered most alone.

The network is fitted on the driver on a bounded sample of labelled rows (`Training`: rows of each
class by hash of the id; of a text longer than `chars` so many characters, in stretches spread over the whole of it);
the share of each class comes from all labelled rows that may be used. Scoring reads whole texts, a slice of about `SLICE` bytes at a time; a longer text is scored
in stretches whose maxima are joined. No shuffle but for the labels' join.

Null text counts as empty, and empty texts are scored. Null labels are not used, repeated rows of labels count as
often as they stand; a label table without both classes gives every text the same score. A null id is never held out; repeated rows
each get a score; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import narrow, parts

STRIDE, DEPTH = 8, 6
SLICE = 1 << 20


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit."""

    rows: int = 500  # of each class
    chars: int = 16_384  # of a text
    stretches: int = 16  # that a longer text's characters are taken in
    filters: int = 24
    rounds: int = 10
    batch: int = 32
    rate: float = 0.01
    seed: int = 42


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in rows of STRIDE, first row of each text): two rows at least, the last padded with 0."""
    rows = [max(2, -(-len(t) // STRIDE)) for t in texts]
    first = np.concatenate(([0], np.cumsum(rows)))
    data = np.frombuffer(b"".join(t.ljust(n * STRIDE, b"\0") for t, n in zip(texts, rows, strict=True)), np.uint8)
    return data.reshape(-1, STRIDE), first


@dataclass
class Network:
    """table: vector of each byte; near, far: filters over a chunk's first and second half."""

    table: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    shift: np.ndarray

    @classmethod
    def new(cls, filters: int, rng: np.random.Generator) -> Network:
        f = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        size = STRIDE * DEPTH
        return cls(0.5 * f(256, DEPTH), f(size, filters) / size**0.5, f(size, filters) / size**0.5, np.zeros(filters, np.float32), 0.3 * f(filters), np.zeros(1, np.float32))

    def answers(self, data: np.ndarray) -> np.ndarray:
        """[chunk, filter]; chunk k is rows k and k + 1."""
        x = self.table[data].reshape(len(data), -1)
        return x[:-1] @ self.near + x[1:] @ self.far

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """[text, filter] maxima over all chunks of whole texts."""
        out = np.empty((len(texts), len(self.bias)), np.float32)
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) <= SLICE:
                size += len(texts[hi])
                hi += 1
            data, first = blocks(texts[lo:hi])
            if hi - lo == 1:
                step = SLICE // STRIDE
                out[lo] = np.max([self.answers(data[a : a + step + 1]).max(0) for a in range(0, len(data) - 1, step)], 0)
            else:
                a = self.answers(data)
                a[first[1:-1] - 1] = -np.inf  # a chunk that would reach into the next text
                out[lo:hi] = np.maximum.reduceat(a, first[:-1])
            lo = hi
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        hidden = np.maximum(self.pooled(texts) + self.bias, 0)
        return 1 / (1 + np.exp(-(hidden @ self.weight + self.shift).astype(np.float64)))

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of the fields."""
        data, first = blocks(texts)
        a = self.answers(data)
        at = np.stack([a[x : y - 1].argmax(0) + x for x, y in zip(first, first[1:], strict=False)])
        top = np.take_along_axis(a, at, 0) + self.bias
        hidden = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-(hidden @ self.weight + self.shift)))
        error = ((p - labels) / len(labels)).astype(np.float32)
        back = error[:, None] * self.weight * (top > 0)
        near, far = self.table[data[at]].reshape(*at.shape, -1), self.table[data[at + 1]].reshape(*at.shape, -1)
        table = np.zeros_like(self.table)
        for rows, kernel in ((at, self.near), (at + 1, self.far)):
            np.add.at(table, data[rows].reshape(-1), (back[..., None] * kernel.T).reshape(-1, DEPTH))
        return [table, np.einsum("tf,tfk->kf", back, near), np.einsum("tf,tfk->kf", back, far), back.sum(0), hidden.T @ error, error.sum(keepdims=True)]

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.near, self.far, self.bias, self.weight, self.shift]


def fit(texts: list[bytes], labels: list[int], share: float, how: Training) -> Network:
    """Adam on balanced batches; `share` of label 1 then moves the last layer from balance to the truth."""
    rng = np.random.default_rng(how.seed)
    net, y = Network.new(how.filters, rng), np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.weight[:] = 0
    else:
        mean, square, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
        for _ in range(how.rounds):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), how.batch):
                some = order[lo : lo + how.batch]
                step += 1
                for p, g, m, v in zip(net.parameters(), net.gradient([texts[i] for i in some], y[some]), mean, square, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        net.shift += np.float32(np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(y.mean() / (1 - y.mean())))
        return net
    net.shift[:] = np.float32(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return net


def train(docs: DataFrame, labels: DataFrame, how: Training | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network from labelled rows that are not held out."""
    how = how or Training()
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    counts = dict(map(tuple, usable.groupBy("label").count().collect()))
    text, piece = F.coalesce("text", F.lit("")), how.chars // how.stretches
    starts = [(F.length(text) - piece).cast("long") * k / (how.stretches - 1) for k in range(how.stretches)]
    spread = F.concat(*[F.substring(text, (x + 1).cast("int"), F.lit(piece)) for x in starts])
    texts = narrow(docs, id_col, text_col).withColumn("text", F.when(F.length(text) <= how.chars, text).otherwise(spread))
    # Twice the rows, as some ids have no text; both limits are parameters.
    some = [usable.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(2 * how.rows) for k in (0, 1)]
    found = texts.join(F.broadcast(some[0].unionByName(some[1])), F.col("doc_id") == F.col("id")).select("id", "label", "text")
    rows = [r for k in (0, 1) for r in found.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id", "text").limit(how.rows).collect()]
    n = sum(counts.values())
    return fit([r["text"].encode() for r in rows], [r["label"] for r in rows], counts.get(1, 0) / n if n else 0.5, how)


def quality_scores(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""

    def run(batches):
        for ids, texts in parts(batches, SLICE):
            yield pa.RecordBatch.from_arrays([ids, pa.array(net.scores([t.encode() for t in texts]), pa.float64())], names=["doc_id", "score"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, how: Training | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = quality_scores(docs, train(docs, labels, how))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, how: Training | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose score reaches the threshold. Only texts go to Python, only scores come back."""
    net = train(docs, labels, how, id_col, text_col)

    def scores(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column, column], names=["i", "text"])
        return pa.array(np.concatenate([net.scores([t.encode() for t in texts]) for _, texts in parts([batch], SLICE)] or [np.zeros(0)]), pa.float64())

    return docs.where(F.arrow_udf(scores, "double")(F.col(text_col).cast("string")) >= threshold)
