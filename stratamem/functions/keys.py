"""Normal forms of entity keys and values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Characters removed, with whitespace, at the two ends of a key.
_ENDS = r"[\s\x1c-\x1f.:,;?!]+"


def collapse(c: Column) -> Column:
    """Each run of whitespace made one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def normalize_key(c: Column) -> Column:
    """Lower-cased, whitespace collapsed, whitespace and ``. : , ; ? !`` removed at both ends; may be empty."""
    return F.regexp_replace(collapse(F.lower(c)), rf"(?U)^{_ENDS}|{_ENDS}$", "")


def canonical_value(c: Column) -> Column:
    return collapse(F.lower(c))


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (F.length(collapse(c)) > 0)
