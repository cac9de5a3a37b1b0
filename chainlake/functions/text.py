"""Text helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in a domain description.
STOP_WORDS = ("a", "an", "and", "of", "the", "in", "to", "for", "with", "by", "on", "or", "like", "type", "protein", "domain", "family", "superfamily", "containing", "related", "terminal")


def normal_words(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """PRJ-14: lower-case words without parentheses, stop words, single characters and anything that isn't letters."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[()]", ""), r"[_\-/\s]+", " ")
    return F.filter(F.split(F.trim(plain), " "), lambda w: (F.length(w) > 1) & w.rlike("^[a-z]+$") & ~w.isin(*stop))


def ngrams(words: Column, least: int = 1, most: int = 4) -> Column:
    """PRJ-15: all runs of least..most words, joined by blanks."""

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.flatten(F.array(*(of(n) for n in range(least, most + 1))))


def occurrences(text: Column, part: str) -> Column:
    """PRJ-16: all 0-based places of a part in a text, overlapping ones too; empty for an empty part."""
    if not part:
        return F.when(text.isNotNull(), F.array().cast("array<int>"))
    pieces = F.split(F.concat(F.lit("\u0001"), text), F.lit("(?=" + re.escape(part) + ")"))
    ends = F.aggregate(pieces, F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(F.length(x) + F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(F.lit(-1)))))
    return F.slice(ends, F.lit(1), F.size(ends) - 1)


def longest_between(text: Column, mark: str) -> Column:
    """PRJ-16: the longest stretch between two marks (first of equals); null if there is none."""
    parts = F.split(text, F.lit(f"\\Q{mark}\\E"))
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    best = F.aggregate(inner, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))
    return best


def strip_tags(text: Column) -> Column:
    """PRJ-16: a text without markup tags."""
    return F.regexp_replace(text, r"<[^>]+>", "")


def line_lengths(text: Column) -> Column:
    """PRJ-16: visible length of each line."""
    return F.transform(F.split(strip_tags(text), "\n"), F.length)


def centred(text: Column, width: int, fill: str = "-") -> Column:
    """PRJ-16: a text amid fill characters; longer texts stay."""
    room = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    left = F.floor(room / 2).cast("int")
    return F.concat(F.repeat(F.lit(fill), left), text, F.repeat(F.lit(fill), room - left))


def json_name(name: Column) -> Column:
    """SRC-15: a job name in the form in which two writings are compared."""
    return F.regexp_replace(F.lower(name), r"[_\-]", "")
