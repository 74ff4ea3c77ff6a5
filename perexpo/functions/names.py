"""Normalisation of entity names so two sources without a shared key can be compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perexpo.functions.cleaning import as_col

# Spellings that must be expanded the same way for names to agree.
STREET = ("ST", "STREET", ("-",))
AVENUE = ("AV", "AVENUE", ("-", "/"))
DOTTED_ABBREVIATIONS = (
    ("ST.", "STREET"),
    ("AVE.", "AVENUE"),
    ("BLVD.", "BLVD"),
    ("PKWY.", "PKWY"),
)
# Names that start with this keep every occurrence of it ("Saint", not "Street").
PROTECTED_PREFIX = "ST."
ADMIN_PATTERN = "DISTRICT % OFFICE"


def base_name(c: Column | str) -> Column:
    """Upper-cased text before the first parenthesis; empty when there is none."""
    c = as_col(c)
    return F.upper(F.trim(F.substring(c, F.lit(1), F.instr(c, "(") - 1)))


def expand_suffix(c: Column | str, short: str, full: str, separators: Sequence[str]) -> Column:
    """Spell out a trailing word, or else the word before any of the separators.

    The two cases exclude each other: a name that ends in the short form keeps its
    interior occurrences.
    """
    c = as_col(c)
    tail = " " + short
    interior = c
    for sep in separators:
        interior = F.replace(interior, F.lit(tail + sep), F.lit(f" {full}{sep}"))
    trailing = F.concat(F.substring(c, F.lit(1), F.length(c) - len(tail)), F.lit(" " + full))
    return F.when(c.endswith(tail), trailing).otherwise(interior)


def expand_street(c: Column | str) -> Column:
    return expand_suffix(c, *STREET)


def expand_avenue(c: Column | str) -> Column:
    return expand_suffix(c, *AVENUE)


def with_site_key(df: DataFrame, name: str, out: str) -> DataFrame:
    """Comparable form of a site name: base name, streets, then avenues spelled out.

    One projection per step: each step uses its input several times, and as one nested
    expression the text of the plan would grow with the product.
    """
    return (
        df.withColumn(out, base_name(name))
        .withColumn(out, expand_street(out))
        .withColumn(out, expand_avenue(out))
    )


def expand_abbrev(
    c: Column | str,
    rules: Sequence[tuple[str, str]] = DOTTED_ABBREVIATIONS,
    protect_prefix: str | None = PROTECTED_PREFIX,
) -> Column:
    """Spell out dotted abbreviations, in rule order.

    A name that starts with ``protect_prefix`` keeps that abbreviation everywhere.
    """
    c = as_col(c)
    out = c
    for short, full in rules:
        expanded = F.replace(out, F.lit(short), F.lit(full))
        if short == protect_prefix:
            out = F.when(c.startswith(short), out).otherwise(expanded)
        else:
            out = expanded
    return out


def is_admin(c: Column | str, pattern: str = ADMIN_PATTERN) -> Column:
    """Names of offices rather than places; letter case does not matter."""
    return as_col(c).ilike(pattern)
