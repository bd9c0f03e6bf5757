"""Entity arrays: one reading of their entries for every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character with the Unicode property White_Space.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def entries(c: Column) -> Column:
    """Distinct entries, trimmed and lower-cased; null and blank ones don't count; a null array is empty."""
    read = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(strip_blanks(x)))
    return F.array_distinct(F.filter(read, lambda x: x.isNotNull() & (x != "")))


def plain_entries(c: Column) -> Column:
    """Entries as stored, without null and empty ones; a null array is empty."""
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
