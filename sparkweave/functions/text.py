"""Text helpers (whole values, no truncation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_newlines(c: Column) -> Column:
    """Replace every LF and CR by a space (one character each)."""
    return F.translate(c, "\n\r", "  ")


def long_words_joined(c: Column, min_length: int = 9, sep: str = ", ") -> Column:
    """Words (split on single spaces) of at least ``min_length`` characters,
    joined with ``sep`` in their original order."""
    words = F.split(c, " ")
    return F.array_join(F.filter(words, lambda w: F.length(w) >= min_length), sep)


def contains_term(c: Column, term: str | Column) -> Column:
    """Case-insensitive substring test."""
    t = term if isinstance(term, Column) else F.lit(term)
    return F.lower(c).contains(F.lower(t))


def new_id() -> Column:
    """Random 32-hex-digit key (a UUID without dashes); differs per run."""
    return F.regexp_replace(F.expr("uuid()"), "-", "")


def content_id(*cols: Column | str) -> Column:
    """Repeatable 64-hex-digit key from the row content (SHA-256 of the
    JSON of the given columns): replays produce the same key."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)
