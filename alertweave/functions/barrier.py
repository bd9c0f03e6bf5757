"""Evaluate expensive expressions once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` added through a generator of one row.

    Filters on derived columns are pushed below projections by substituting the expressions, so a costly one
    (a long pattern, a time-zone lookup) would run once for each mention.  Predicates don't pass a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))
