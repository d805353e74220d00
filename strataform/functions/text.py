"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value, in lower case.
PLACEHOLDERS = ("", "-", "--", "---", ".", "?", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "undefined", "not available", "tbd")
#: Texts that stand for a missing strong id, besides the placeholders.
ID_PLACEHOLDERS = ("0", "0x0", "0x0:0x0", "-1")


def clean_text(c: Column) -> Column:
    """Trimmed of any white space; null where empty."""
    t = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    return F.when(t != "", t)


def no_placeholder(c: Column) -> Column:
    """Trimmed; null where it only stands for a missing value."""
    t = clean_text(c)
    return F.when(~F.lower(t).isin(*PLACEHOLDERS), t)


def strong_id(c: Column) -> Column:
    t = no_placeholder(c)
    return F.when(~F.lower(t).isin(*ID_PLACEHOLDERS), t)
