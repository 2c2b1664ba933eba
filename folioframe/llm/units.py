"""Cutting texts where no token can cross, and a bounded memory of the pieces' encodings.

A tokenizer's result for a text is the concatenation of its results for the units given here, so
that each distinct unit has to be encoded once per worker and every other place is a look-up.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

import regex

#: A mark between a letter or number and white space.
_MARK = re.compile(r"[.,](?=[ \n])(?<=[^\W_].)")


def byte_bpe_units(text: str) -> list[str]:
    """Units for a byte-level BPE whose words may begin with one space.

    A word begins at each space that a non-space follows, whatever stands before it. Without white space
    beside white space a line feed is a word, and so is a mark between a letter or number and white space.
    """
    flat = text.replace("\n", " ")
    if flat.isprintable() and "  " not in flat and flat[-1:] != " ":
        return _MARK.sub("\0\\g<0>", text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    pieces = text.split(" ")
    units = [pieces[0]]
    for p in pieces[1:]:
        if p and not p[0].isspace():
            units.append(" " + p)
        else:
            units[-1] += " " + p
    return units


def plain_units(text: str) -> list[str]:
    """Units for a tokenizer that composes characters, lower-cases and drops white space: space and line feed
    part them, and so do marks before these. Lower case already, unless that depends on neighbours."""
    if special_or_uneven(text):
        return text.replace("\n", " ").split(" ")
    return _MARK.sub(" \\g<0>", text.lower().replace("\n", " ")).split(" ")


def sentencepiece_units(text: str) -> list[str] | None:
    """Units for a SentencePiece model that puts a dummy prefix and keeps every space.

    No piece of such a model has its space sign after another character, so that a space after a
    non-space is a boundary, and the dummy prefix of the next unit stands for that space. None: the
    text holds the space sign itself and has to be encoded whole.
    """
    if "▁" in text:
        return None
    pieces = text.split(" ")
    if "" not in pieces:
        return pieces
    units, spaces = [], ""
    for p in pieces:
        if p:
            units.append(spaces + p)
            spaces = ""
        else:
            spaces += " "
    if spaces and not units:
        return [text]
    if spaces:
        units[-1] += spaces
    return units


#: How the two public tokenizers tell words apart.
BYTE_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PLAIN_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
_MARKS = tuple(".,;:!?")
_BYTE_WORD, _PLAIN_WORD = regex.compile(BYTE_WORD), regex.compile(PLAIN_WORD)


def special(unit: str) -> bool:
    """Whether a unit may hold a special token's string."""
    return "<|" in unit


def special_or_uneven(unit: str) -> bool:
    """Whether a unit may hold a special token's string or characters whose composition or lower case depends
    on their neighbours."""
    return "<|" in unit or not unit.isascii() and ("Σ" in unit or not unicodedata.is_normalized("NFC", unit))


def byte_words(text: str) -> list[str]:
    """Words of any text without special tokens."""
    return _BYTE_WORD.findall(text)


def byte_bpe_words(unit: str) -> list[str] | None:
    """Words of a unit; None: it is one word, or odd and stays whole."""
    body = unit[1:] if unit[:1] == " " else unit
    if body.isalpha():
        return None
    if unit[-1:] in _MARKS and body[:-1].isalpha():
        return [unit[:-1], unit[-1]]
    return None if special(unit) else _BYTE_WORD.findall(unit)


def plain_words(unit: str) -> list[str] | None:
    """Words of a unit for a tokenizer that composes characters, lower-cases and drops white space; None: it is
    one word, or odd and stays whole."""
    if special_or_uneven(unit):
        return None
    low = unit.lower()
    if low.isalpha():
        return None if low == unit else [low]
    if low[-1:] in _MARKS and low[:-1].isalpha():
        return [low[:-1], low[-1]]
    return _PLAIN_WORD.findall(low)


def byte_signs() -> dict[str, int]:
    """Sign -> byte: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


#: Bytes that a remembered unit takes beside its characters and its ids: two objects and a place in a dictionary.
_OVERHEAD = 180


class Memory:
    """Encodings of units, of at most about `most_bytes` in a worker.

    A unit is on probation when it is first met and stays once it is met again; when either kind has a
    third of the bytes, the older third goes. So rare units, most of all distinct ones, don't push out others.
    """

    def __init__(self, encode: Callable[[list[str]], list], most_bytes: int = 200_000_000, longest: int = 200, split: Callable[[str], list[str] | None] | None = None):
        """split: cuts a unit further, where encodings concatenate too (None: not to be cut); fewer pieces are distinct than units.
        Units of more than `longest` characters are not kept."""
        self.encode, self.most, self.longest, self.split = encode, most_bytes // 3, longest, split
        self.known: dict[str, object] = {}
        self.before: dict[str, object] = {}
        self.young: dict[str, object] = {}
        self.size = self.young_size = 0

    def _recall(self, units: Iterable[str], got: dict[str, object]) -> list[str]:
        """Put what is remembered of units into got and keep it on; the others."""
        known, before, young, new = self.known, self.before, self.young, []
        for u in units:
            if (v := young.get(u)) is None and (v := before.get(u)) is None:
                new.append(u)
            else:
                got[u] = v
                if u not in known:
                    known[u] = v
                    self.size += _cost(u, v)
        return new

    def _remember(self, units: list[str], values: list) -> None:
        if len(units) and max(map(len, units)) > self.longest:
            units, values = zip(*[(u, v) for u, v in zip(units, values, strict=True) if len(u) <= self.longest] or [((), ())], strict=True)
        self.young.update(zip(units, values, strict=True))
        self.young_size += sum(map(_cost, units, values))

    def _learn(self, units: set[str]) -> dict[str, object]:
        """The encodings of units that `known` has not."""
        got: dict[str, object] = {}
        todo = self._recall(units, got)
        if todo and self.split:
            cut = list(map(self.split, todo))
            whole = [u for u, c in zip(todo, cut, strict=True) if c is None]
            pieces = set(chain.from_iterable(filter(None, cut))).difference(whole)
            found = {p: v for p in pieces if (v := self.known.get(p)) is not None}
            words = self._recall(pieces.difference(found), found) + whole
            ids = self.encode(words)
            found.update(zip(words, ids, strict=True))
            self._remember(words, ids)
            got.update(found)
            todo = [u for u, c in zip(todo, cut, strict=True) if c is not None]
            values = [b"".join([got[p] for p in c]) for c in cut if c is not None]
        else:
            values = self.encode(todo)
        got.update(zip(todo, values, strict=True))
        self._remember(todo, values)
        if self.size > self.most:
            self.known, self.before, self.size = {}, self.known, 0
        if self.young_size > self.most:
            self.young, self.young_size = {}, 0
        return got

    def look_up(self, texts: list[list[str]]) -> list[list]:
        """The encodings of each text's units; unseen units of all texts are encoded together."""
        collects = gc.isenabled()
        gc.disable()  # nothing here has cycles, and the many short lists would set off searches for them
        try:
            units = list(chain.from_iterable(texts))
            found = list(map(self.known.get, units))
            unseen = [i for i, v in enumerate(found) if v is None]
            if unseen:
                got = self._learn({units[i] for i in unseen})
                for i in unseen:
                    found[i] = got[units[i]]
        finally:
            if collects:
                gc.enable()
        out, lo = [], 0
        for t in texts:
            out.append(found[lo : lo + len(t)])
            lo += len(t)
        return out


def _cost(unit: str, value: object) -> int:
    return _OVERHEAD + 2 * len(unit) + (len(value) if type(value) is bytes else 0)


def load_tokenizer(path: str):
    """A tokenizer of the tokenizers library, without truncation, padding or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def library_ids(tokenizer, odd: Callable[[str], bool]) -> Callable[[list[str]], list[bytes]]:
    """A function that encodes words with the library, as little-endian unsigned 32-bit ids.

    A word goes to the library's model at once; what is `odd` goes through all of its steps.
    """
    signs, merge = {b: c for c, b in byte_signs().items()}, tokenizer.model.tokenize

    def run(words: list[str]) -> list[bytes]:
        out = []
        for w in words:
            if w.isalnum() and w.isascii():  # its bytes are their own signs
                ids = [t.id for t in merge(w)]
            elif odd(w):
                ids = tokenizer.encode(w, add_special_tokens=False).ids
            else:
                ids = [t.id for t in merge(w.encode().decode("latin-1").translate(signs))]
            out.append(array("I", ids).tobytes())
        return out

    return run
