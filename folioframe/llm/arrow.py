"""Helpers shared by the Arrow functions of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """What a worker keeps from task to task under a key: one thing, so that an operator's memory is given back
    when the next operator's stage begins."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def whole_texts(column: pa.Array) -> list[str]:
    """The texts of a string column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def n_bytes(text: str) -> int:
    """Size in UTF-8."""
    return len(text) if text.isascii() else len(text.encode())


def by_bytes(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` bytes; a longer text stands alone."""
    lo = size = 0
    for i, n in enumerate(map(n_bytes, texts)):
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def parts(batches: Iterable[pa.RecordBatch], limit: int = 4_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of slices of about `limit` bytes; column 0 holds ids, column 1 texts.

    A batch may hold long texts, so that its Python strings must not exist all at once.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        lo = size = 0
        for i, n in enumerate([*sizes, limit + 1]):
            if i > lo and (size + n > limit or i == len(sizes)):
                part = batch.slice(lo, i - lo)
                yield part.column(0), whole_texts(part.column(1))
                lo, size = i, 0
            size += n


def narrow(df, id_col: str, text_col: str):
    """Only the two columns that an operator reads, whatever else the table has."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def fresh(df, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
