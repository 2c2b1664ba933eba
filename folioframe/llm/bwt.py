"""Burrows-Wheeler transforms of string sets, merged by iterative interleave refinement.

Strings are dealt to shards, and a shard's transform comes from its sorted suffixes. Shards are merged
without sorting suffixes again: an interleave lists places of the shards' transforms in merged order, as far
as it is known; passing it once through the transforms (each place's symbol leads to the suffix one symbol
longer, in its shard) makes it right for one more symbol. Places whose block has no other place are settled and
leave the interleave, so that a suffix takes part in as many rounds as it has symbols in common with
another: the round in which it leaves is its common prefix, and the blocks that stay are the repeated intervals.

Strings are lists of positive numbers; 0 stands for an end.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np


@dataclass
class Shards:
    """Transforms one after another. bwt: the symbol before each sorted suffix, 0 before a string's first;
    string, offset: of the suffix; longer: place of the suffix with that symbol before it (of no use where it is 0);
    shard: of each place."""

    bwt: np.ndarray
    string: np.ndarray
    offset: np.ndarray
    longer: np.ndarray
    shard: np.ndarray


def transform(strings: list[list[int]], per_shard: int) -> Shards:
    """The transforms of shards of `per_shard` strings each. Ends sort first, by string.

    Suffixes are sorted by doubling the symbols that their ranks stand for, all shards in the same steps.
    """
    sizes = np.array([len(s) + 1 for s in strings], np.int32)
    string, last = np.repeat(np.arange(len(strings), dtype=np.int32), sizes), np.repeat(np.cumsum(sizes, dtype=np.int32) - 1, sizes)
    n = int(sizes.sum())
    symbols = np.fromiter((x for s in strings for x in chain(s, (0,))), np.int32, n)
    at = np.arange(n, dtype=np.int32)
    shard = string // per_shard
    end, k = symbols == 0, 1
    # An end's rank is its string's: no two ends are equal, so each suffix differs from all others at its end.
    order = np.lexsort((np.where(end, string, 0), symbols, shard)).astype(np.int32)
    while True:
        same = (shard[order][1:] == shard[order][:-1]) & (symbols[order][1:] == symbols[order][:-1]) & ~end[order][1:] if k == 1 else key[order][1:] == key[order][:-1]
        if not same.any():
            break
        rank = np.zeros(n, np.int32)
        rank[order[1:]] = np.cumsum(~same, dtype=np.int32)
        key = rank.astype(np.int64)
        key *= n + 1
        key += np.where(at + k <= last, rank[np.minimum(at + k, n - 1)] + 1, 0)
        order, k = np.argsort(key, kind="stable").astype(np.int32), 2 * k
    before = np.concatenate((symbols[:0], [0], symbols[:-1]), dtype=np.int32)[order]
    longer = np.empty(n, np.int32)
    longer[np.lexsort((before, shard[order]))] = at
    return Shards(before, string[order], order - (last[order] + 1 - sizes[string[order]]), longer, shard[order])


def merge(shards: Shards) -> np.ndarray:
    """The longest prefix that each suffix shares with another, of its shard or any other."""
    _, symbols = np.unique(np.concatenate(([0], shards.bwt)), return_inverse=True)
    symbols = symbols[1:].astype(np.uint16 if symbols.max() < 1 << 16 else np.uint32)
    common, longer = np.zeros(len(symbols), np.int32), shards.longer
    places, block, h = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32), 0
    while True:
        symbol = symbols[places]
        inner = np.flatnonzero(symbol)
        if not len(inner):
            return common
        h += 1
        moved = inner[np.argsort(symbol[inner], kind="stable")]
        symbol, block = symbol[moved], block[moved]
        parts = np.ones(len(moved) + 1, bool)
        np.not_equal(symbol[1:], symbol[:-1], out=parts[1:-1])
        parts[1:-1] |= block[1:] != block[:-1]
        stay = np.flatnonzero(~(parts[:-1] & parts[1:]))
        block, places = np.cumsum(parts[:-1], dtype=np.int32)[stay], longer[places[moved[stay]]]
        common[places] = h


def longest_elsewhere(strings: list[list[int]], per_shard: int = 16) -> list[np.ndarray]:
    """For each string and offset the longest prefix shared with another suffix."""
    if not strings:
        return []
    shards = transform(strings, per_shard)
    first = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])))
    flat = np.zeros(first[-1], np.int32)
    flat[first[shards.string] + shards.offset] = merge(shards)
    return [flat[a:b] for a, b in zip(first, first[1:], strict=False)]
