"""Page selections and parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN = 999_999_999


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """F-PAGES: "1-,2,-3,4" as inclusive ranges; a blank start is 1, a blank end is open."""
    out = []
    for part in filter(None, map(str.strip, text.split(","))):
        lo, dash, hi = part.partition("-")
        out.append((int(lo or 1), int(hi or OPEN) if dash else int(lo)))
    return out


def in_ranges(page: Column, text: str | None) -> Column:
    """F-PAGE-IN: true for no selection, false for an empty one."""
    if text is None:
        return F.lit(True)
    out = F.lit(False)
    for lo, hi in parse_ranges(text):
        out |= page.between(lo, hi)
    return out


def part(page: Column, size: int) -> Column:
    """B-PARTS: number of the part of `size` pages that a page (from 0) is in."""
    return F.floor(page / size).cast("long")
