"""Repair of values that arrive as text.

Source columns are read as strings and converted here, once, explicitly. The strict
functions turn text they cannot read into NULL instead of failing the job; the lenient
ones keep the reading of a dynamically typed engine (longest numeric prefix, else 0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_DECIMAL = r"^\s*([+-]?\d+)\.\d*\s*$"
_INT_PREFIX = r"^\s*([+-]?\d+)"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_literal(c: Column | str, text: str) -> Column:
    """Remove every occurrence of a literal (not a pattern)."""
    return F.replace(as_col(c), F.lit(text), F.lit(""))


def strip_chars(c: Column | str, chars: str) -> Column:
    return F.translate(as_col(c), chars, "")


def prefix_int(c: Column | str, strict: bool = False) -> Column:
    """Leading integer of a text. ``'9:'`` is 9, text without one is 0, NULL stays NULL.

    With ``strict`` a text that does not start with an integer is NULL. The plain cast is
    tried first, so the pattern only runs on the rows that need it.
    """
    c = as_col(c).cast("string")
    found = F.coalesce(c.try_cast("bigint"), F.regexp_extract(c, _INT_PREFIX, 1).try_cast("bigint"))
    return found if strict else F.when(c.isNotNull(), F.coalesce(found, F.lit(0).cast("bigint")))


def clean_int(c: Column | str, lenient: bool = False) -> Column:
    """``'1,008'`` -> 1008 and ``'5.0'`` -> 5; a fraction is cut off.

    Unreadable text is NULL, or its integer prefix when lenient. ``profiling.unreadable``
    counts what became NULL.
    """
    bare = strip_literal(as_col(c).cast("string"), ",")
    if lenient:
        return prefix_int(bare)
    return F.coalesce(bare.try_cast("bigint"), F.regexp_extract(bare, _DECIMAL, 1).try_cast("bigint"))


def to_double(c: Column | str) -> Column:
    """Number or NULL; unlike a bare cast, suffixes such as ``'1d'`` are not numbers."""
    c = as_col(c).cast("string")
    return F.when(c.rlike(_PLAIN_NUMBER), c.try_cast("double"))


def is_topcoded(c: Column | str) -> Column:
    """True for open-ended values such as ``'250,000+'``; NULL counts as False."""
    return F.coalesce(as_col(c).rlike(r"\+$"), F.lit(False))


def attribute_value(c: Column | str) -> Column:
    """Numeric part of an attribute text: separators and the open-end mark removed."""
    return to_double(strip_chars(as_col(c).cast("string"), ",+"))


def stored_type(c: Column | str) -> Column:
    """What a raw text value really holds: integer, real, text or null."""
    c = as_col(c).cast("string")
    return (
        F.when(c.isNull(), "null")
        .when(c.try_cast("bigint").isNotNull(), "integer")
        .when(to_double(c).isNotNull(), "real")
        .otherwise("text")
    )


def label(*parts: Column | str, sep: str = " - ") -> Column:
    """Join labels with a separator; NULL if any part is NULL."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(as_col(part).cast("string"))
    return F.concat(*pieces)
