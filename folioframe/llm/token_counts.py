"""Token counts: Arrow functions that return lengths only.

Texts are cut at safe boundaries (`units`), the distinct unseen pieces are encoded in batches of
equal bytes, and only the number of ids of each piece is kept. No shuffle; memory per worker is one
slice of a batch and a bounded memory of pieces.

Null text counts as empty; empty: 0 tokens. A null id stays null, repeated rows each count, an empty
table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import by_bytes, held, n_bytes, narrow, parts
from .units import Memory, byte_bpe_units, load_tokenizer, sentencepiece_units

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes given to the library at once.
BATCH = 1_000_000


def _counter(path: str):
    return held(("lengths", path), lambda: _new_counter(path))


def _new_counter(path: str):
    """(cut, memory, whole): how to cut a text, the lengths of pieces, the length of an uncut text."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())):
            raise ValueError(f"{path} has pieces that cross a space; its texts cannot be cut there")

        def lengths(units: list[str]) -> list[int]:
            out = []
            for lo, hi in by_bytes(units, BATCH):
                out += map(len, sp.encode(units[lo:hi], num_threads=1))
            return out

        return sentencepiece_units, Memory(lengths), lambda t: len(sp.encode(t))
    tok = load_tokenizer(path)

    def lengths(units: list[str]) -> list[int]:
        out = []
        for lo, hi in by_bytes(units, BATCH):
            out += [len(e) for e in tok.encode_batch_fast(units[lo:hi], add_special_tokens=False)]
        return out

    return byte_bpe_units, Memory(lengths), lambda t: len(tok.encode(t, add_special_tokens=False))


def count_texts(texts: list[str], path: str) -> list[int]:
    cut, memory, whole = _counter(path)
    units = [cut(t) if t else [] for t in texts]
    sizes = memory.look_up([u or [] for u in units])
    return [whole(t) if u is None else sum(n) for t, u, n in zip(texts, units, sizes, strict=True)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_tokens > limit for every whole text, as the tokenizer's library gives them.

    tokenizer: path of a SentencePiece .model or of a byte-level BPE .json.
    """

    def count(batches):
        for ids, texts in parts(batches):
            n = count_texts(texts, tokenizer)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(list(map(n_bytes, texts)), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return narrow(docs, id_col, text_col).mapInArrow(count, SCHEMA)
