"""Sum-of-squares packing of documents into windows.

Each task packs its own documents online. A level array counts the open windows at each fill level;
a document goes where the sum of the squared counts grows least. A document longer than a window
fills whole windows and only its rest is placed. What is still open at the end (or when more
than `most_open` windows are open, which bounds the memory) is cut: the emptiest windows' pieces
fill the fullest, and the last, partly filled one is cut at powers of two, where no padding is due.

No shuffle and no state beyond a task; a task that is run again on the same split gives the same
sequences. Null text counts as empty (the end id alone), repeated rows are each packed, an empty
table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrow import held, narrow, parts
from .units import Memory, library_ids, load_tokenizer, plain_units, plain_words, special_or_uneven

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids and the others."""
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


@dataclass
class Packer:
    """Online packer of pieces into windows of `size` ids."""

    size: int
    most_open: int = 1024
    #: Open windows at each fill level.
    level: np.ndarray = field(init=False)
    open: dict[int, list[list[Piece]]] = field(default_factory=dict)
    n_open: int = 0
    done: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self):
        self.level = np.zeros(self.size + 1, np.int64)

    def choose(self, n: int) -> int:
        """The level (0: a new window) whose use raises the sum of squares least; ties: the fullest.

        A window that leaves level h takes 2 N(h) - 1 off the sum, one that comes to level h + n
        adds 2 N(h + n) + 1; full windows don't count.
        """
        at = np.flatnonzero(self.level[: self.size - n + 1])
        apart = 2 * int(self.level[n]) + 1 if n < self.size else 0
        if not len(at):
            return 0
        growth = 2 * (self.level[at + n] - self.level[at]) + 2
        if at[-1] + n == self.size:
            growth[-1] = 1 - 2 * self.level[at[-1]]
        least = growth.min()
        return int(at[np.flatnonzero(growth == least)[-1]]) if least <= apart else 0

    def _close(self, window: list[Piece], fill: int) -> None:
        if fill == self.size:
            self.done.append(window)
        else:
            self.open.setdefault(fill, []).append(window)
            self.level[fill] += 1
            self.n_open += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        piece = Piece(doc_id, 0, ids, len(ids))
        while len(piece.ids) > self.size:
            full, piece = piece.cut(self.size)
            self.done.append([full])
        n = len(piece.ids)
        if not n:
            return
        h, window = self.choose(n) if n < self.size else 0, []
        if h:
            window = self.open[h].pop()
            self.level[h] -= 1
            self.n_open -= 1
        self._close([*window, piece], h + n)
        if self.n_open > self.most_open:
            self.drain()

    def drain(self) -> None:
        """Cut the pieces of the emptiest windows to fill the fullest, until one window is open at most."""
        windows = [(h, w) for h in sorted(self.open) for w in self.open[h]]
        self.level[:], self.open, self.n_open = 0, {}, 0
        source: list[Piece] = []
        lo, hi = 0, len(windows) - 1
        while lo <= hi:
            fill, window = windows[hi]
            hi -= 1
            while fill < self.size and (source or lo <= hi):
                if not source:
                    source = windows[lo][1]
                    lo += 1
                piece = source.pop()
                if len(piece.ids) > self.size - fill:
                    piece, rest = piece.cut(self.size - fill)
                    source.append(rest)
                window.append(piece)
                fill += len(piece.ids)
            self._close(window, fill)
        if source:
            self._close(source, sum(len(p.ids) for p in source))

    def finish(self) -> None:
        """Close everything: what one window can't hold alone ends at a power of two."""
        while self.n_open > 1:
            self.drain()
        for fill, windows in self.open.items():
            for pieces in windows:
                for n in (1 << k for k in range(fill.bit_length() - 1, -1, -1) if fill >> k & 1):
                    window = []
                    while n:
                        piece = pieces.pop(0)
                        if len(piece.ids) > n:
                            piece, rest = piece.cut(n)
                            pieces.insert(0, rest)
                        window.append(piece)
                        n -= len(piece.ids)
                    self.done.append(window)
        self.open, self.n_open = {}, 0
        self.level[:] = 0


def _encoder(path: str) -> Memory:
    return held(("word_ids", path), lambda: Memory(library_ids(load_tokenizer(path), special_or_uneven), split=plain_words))


def word_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of whole texts by a tokenizer that drops white space."""
    return [np.frombuffer(b"".join(x), "<u4") for x in _encoder(path).look_up([plain_units(t) for t in texts])]


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, most_open: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences of at most `size` ids: each id of each document lies in exactly one.

    Sequences hold `size` ids or a power of two, so that none is padded. sequence_id: the task's
    number, shifted by 33 bits, plus the sequence's number in it.
    """

    def rows(windows, first):
        columns = [[] for _ in _FIELDS]
        for k, window in enumerate(windows, first):
            at = 0
            for p in window:
                for c, x in zip(columns, (p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids), p.doc_tokens, k, at), strict=True):
                    c.append(x)
                at += len(p.ids)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FIELDS)

    def run(batches):
        packer, at = Packer(size, most_open), TaskContext.get().partitionId() << 33
        for doc_ids, texts in parts(batches):
            for i, ids in zip(doc_ids.to_pylist(), word_ids(texts, tokenizer), strict=True):
                packer.add(i, np.append(ids, np.uint32(end_id)).astype("<u4", copy=False))
            yield rows(packer.done, at)
            at += len(packer.done)
            packer.done = []
        packer.finish()
        yield rows(packer.done, at)

    return narrow(docs, id_col, text_col).mapInArrow(run, SCHEMA)
