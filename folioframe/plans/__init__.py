"""Queries of the operators, with the SQL that checks them."""

from . import books, boxes, delivery, events, lines, paragraphs, units  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
