"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 has every id's lowest chunk, level k the k-th chunks of
the ids that are that long; a bitmap per level says which ids go on, and a rank directory (ones before
each block of 512 bits) turns a place in one level into the place in the next. Any token or range
of tokens can be read without decoding what stands before it.

Documents are dealt by ranges of doc_id, one range a shard; a shard is a run of segments, each a
self-contained byte string (`encode_segment`) of whole documents. Spark writes them as rows of
Parquet files, so that any store serves and a lost task is simply run again; `Segment` reads
one from bytes or from a memory-mapped file.

Null text counts as empty (the end id alone), null ids come first, rows of one id stay apart in
the order of their token ids, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import held, narrow, parts
from .scratch import Scratch
from .units import Memory, byte_bpe_units, byte_bpe_words, library_ids, load_tokenizer, special

MAGIC = b"DACS0001"
#: Bits of a chunk, and bits of a block of the rank directory.
CHUNK, BLOCK = 8, 512
SEGMENTS = "shard int, segment int, start long, n_ids long, data binary"


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap of those that go on, rank directory) of each level."""
    levels, rest = [], ids
    while True:
        chunk = rest.astype(np.uint8)  # the lowest CHUNK bits
        rest = rest >> CHUNK
        more = rest > 0
        blocks = -(-len(more) // BLOCK)
        bitmap = np.zeros(blocks * BLOCK // 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bitmap[: len(packed)] = packed
        ones = np.bitwise_count(bitmap).reshape(blocks, BLOCK // 8).sum(1, dtype=np.int64)
        levels.append((chunk, bitmap, np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4") if blocks else np.zeros(0, "<u4")))
        if not more.any():
            return levels
        rest = rest[more]


def encode_segment(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, start: int) -> bytes:
    """A segment: header, documents' ids, null marks and ends, then each level.

    ids: of all documents, one after another, up to `ends`. start: ids of the shard's documents before it.
    """
    levels = encode_levels(ids)
    out = [MAGIC, struct.pack("<QQQQ", start, len(ids), len(doc_ids), len(levels))]
    out.append(np.array([i or 0 for i in doc_ids], "<i8").tobytes())
    out.append(np.array([i is None for i in doc_ids], np.uint8).tobytes())
    out.append(ends.astype("<u8").tobytes())
    for chunk, bitmap, directory in levels:
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bitmap.tobytes(), directory.tobytes()]
    return b"".join(out)


class Segment:
    """Reads a segment's bytes (or a memory map of them) in place."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a segment")
        self.start, self.n_ids, n_docs, n_levels = struct.unpack_from("<QQQQ", view, 8)
        at = 40

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(view, kind, n, at)
            at += out.nbytes
            return out

        self._ids, self._null = take("<i8", n_docs), take(np.uint8, n_docs)
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append((take(np.uint8, n), take(np.uint8, blocks * BLOCK // 8), take("<u4", blocks)))

    @property
    def doc_ids(self) -> list[int | None]:
        return [None if null else int(i) for i, null in zip(self._ids, self._null, strict=True)]

    def _rank(self, level: int, at: int) -> int:
        """Ones of a level's bitmap before a place."""
        chunk, bitmap, directory = self.levels[level]
        if at >= len(chunk):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        block = at // BLOCK
        ones = int(directory[block])
        lo, hi = block * BLOCK // 8, at // 8
        ones += int(np.bitwise_count(bitmap[lo:hi]).sum())
        return ones + (int(bitmap[hi]) & ((1 << at % 8) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The id at a place, from one chunk a level."""
        value = 0
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            value |= int(chunk[i]) << CHUNK * level
            if not bitmap[i // 8] >> i % 8 & 1:
                return value
            i = self._rank(level, i)
        raise ValueError("an id goes on after the last level")

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The ids at places lo to hi, hi excluded."""
        spans = []
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            bits = np.unpackbits(bitmap[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].view(bool)
            spans.append((chunk[lo:hi].astype(np.uint32), bits))
            if not bits.any():
                break
            lo, hi = self._rank(level, lo), self._rank(level, hi)
        value = spans[-1][0]
        for chunk, bits in spans[-2::-1]:
            chunk[bits] |= value << np.uint32(CHUNK)
            value = chunk
        return value


def _encoder(path: str) -> Memory:
    return held(("byte_ids", path), lambda: Memory(library_ids(load_tokenizer(path), special), split=byte_bpe_words))


def byte_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts by a byte-level BPE, as little-endian unsigned 32-bit integers."""
    return [b"".join(x) for x in _encoder(path).look_up([byte_bpe_units(t) for t in texts])]


def shard_bounds(docs: DataFrame, shards: int) -> np.ndarray:
    """Least doc_id of each shard but the first, so that shards have about as many documents: only ids are read."""
    shares = [k / shards for k in range(1, shards)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * shards))).first()[0] if shares else None
    return np.array(found or [], np.int64)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, segment_ids: int = 500_000, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append end_id to each, and write segments in ascending order of doc_id.

    Texts are encoded where they are read; ids alone are dealt to shards, two bytes each if the vocabulary
    allows. segment_ids: a segment ends with the document that brings it to so many ids.
    """
    narrowed = narrow(docs, id_col, text_col)
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = shard_bounds(narrowed, n)
    kind = "<u2" if max(load_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        for doc_ids, texts in parts(batches):
            own = pa.array(np.searchsorted(bounds, pc.fill_null(doc_ids, np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32))
            data = byte_ids(texts, tokenizer)
            size = np.array([len(x) // 4 + 1 for x in data], np.int64)
            flat = np.frombuffer(end.join([*data, b""]), "<u4").astype(kind)
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size * flat.itemsize)))), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([own, doc_ids, ids.cast(pa.binary())], names=["shard", "doc_id", "ids"])

    def write(batches):
        shard, k, start, ids, held_ids, ends, size = None, 0, 0, [], [], [], 0

        def segment():
            data = encode_segment(ids, np.concatenate(held_ids), np.array(ends), start)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["shard", "segment", "start", "n_ids", "data"]
            )

        for batch in batches:
            for own, i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != shard:
                    if ends:
                        yield segment()
                    shard, k, start, ids, held_ids, ends, size = own, 0, 0, [], [], [], 0
                ids.append(i)
                held_ids.append(np.frombuffer(data.as_buffer(), kind))
                size += len(held_ids[-1])
                ends.append(size)
                if size >= segment_ids:
                    yield segment()
                    k, start, ids, held_ids, ends, size = k + 1, start + size, [], [], [], 0
        if ends:
            yield segment()

    order = ["shard", F.col("doc_id").asc_nulls_first(), "ids"]
    encoded = narrowed.mapInArrow(encode, "shard int, doc_id long, ids binary")
    encoded.repartitionById(n, F.col("shard")).sortWithinPartitions(*order).mapInArrow(write, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files.

    The driver gets one number a shard; their count is the writer's number of partitions.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    before, total = {}, 0
    for shard, n in sorted(map(tuple, segments.groupBy("shard").agg(F.sum("n_ids")).collect())):
        before[shard], total = total, total + n

    def run(batches):
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(data.as_buffer())
                lo = np.concatenate(([0], s.ends[:-1])).astype(np.int64)
                ids = s.ids(0, s.n_ids).astype("<u4", copy=False)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(lo.tolist(), s.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array(lo + s.start + before[shard], pa.int64()), pa.array(s.ends - lo, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return segments.select("shard", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids to the shared folder and read them back (see `read_tokens`)."""
    path = Scratch(docs.sparkSession, "tokens").path
    write_tokens(docs, tokenizer, path, end_id, id_col=id_col, text_col=text_col)
    return read_tokens(docs.sparkSession, path)
