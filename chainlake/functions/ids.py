"""Canonical forms of identifiers and unordered pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Surrounding whitespace in any script, and control characters that count as such.
_EDGE = r"(?U)^[\s\u001c-\u001f﻿​]+|[\s\u001c-\u001f﻿​]+$"


def protein_id(col: Column | str) -> Column:
    """Trimmed and upper-cased; null for null and for blank."""
    col = F.col(col) if isinstance(col, str) else col
    bare = F.upper(F.regexp_replace(col, _EDGE, ""))
    return F.when(bare != "", bare)


def pair_low(a: Column, b: Column) -> Column:
    """The smaller of two IDs; null if either is null (least() would skip it)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def pair_high(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def sorted_pair(a: Column, b: Column) -> Column:
    """PRJ-1: canonical unordered pair as a two-element array."""
    return F.array_sort(F.array(a, b))
