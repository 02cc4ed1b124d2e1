"""Value masks.

Every mask maps a Column to a Column and keeps NULL as NULL.  Values are
first cast to string (except ``null``), so numbers and booleans follow
Spark's cast rules (``true`` -> ``tr*****``).

Fixed values that must equal the reference's behaviour:
  * the partial mask keeps the first 2 characters and appends the suffix
    ``*****`` (five asterisks), for values of any length;
  * the default label written by the mock classifier is ``Not Implemented``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (see module docstring).
FIRST2_KEEP = 2
FIRST2_SUFFIX = "*****"


def _s(c: Column) -> Column:
    return c.cast("string")


def first2(c: Column) -> Column:
    """First two characters (code points) + ``*****``."""
    return F.concat(F.substring(_s(c), 1, FIRST2_KEEP), F.lit(FIRST2_SUFFIX))


def last4(c: Column) -> Column:
    """Stars for all but the last four characters.

    Values of four characters or fewer are fully starred (a mask that shows
    a whole short value would not mask anything).
    """
    s = _s(c)
    n = F.length(s)
    return (F.when(n <= 4, F.repeat(F.lit("*"), n))
             .otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(s, F.lit(4)))))


def redact(c: Column) -> Column:
    """One star per character."""
    s = _s(c)
    return F.repeat(F.lit("*"), F.length(s))


def sha256(c: Column) -> Column:
    """Hex SHA-256 of the string value (stable pseudonym, joinable)."""
    return F.sha2(_s(c), 256)


def nullify(c: Column) -> Column:
    return F.lit(None).cast("string")


MASKS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "first2": ("Show the first 2 characters, then *****", first2),
    "last4": ("Show only the last 4 characters", last4),
    "redact": ("Replace every character by *", redact),
    "hash": ("SHA-256 hex digest of the value", sha256),
    "null": ("Return NULL", nullify),
}


def mask_names() -> list[str]:
    return list(MASKS)


def apply_mask(name: str, c: Column) -> Column:
    try:
        return MASKS[name][1](c)
    except KeyError:
        raise ValueError(f"unknown mask {name!r}; known: {', '.join(MASKS)}") from None
