"""Deduplication of a stream of alerts: the batch operator's counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(alerts: DataFrame, ts: str, late: str = "5 minutes", seconds: int = 60) -> DataFrame:
    """Rows for each key and window once the watermark has passed it; alerts later than ``late`` are dropped.

    Null times belong to no window: route them with :func:`untimed`.  State is one row for each open key.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    keys = [blank(c) for c in ("decoder_name", "rule_id", "source_address", "destination_address")]
    user = F.coalesce(F.array_min("entity_users"), F.lit("")).alias("user_key")
    return (
        alerts.where(F.col(ts).isNotNull())
        .withWatermark(ts, late)
        .groupBy(F.window(ts, f"{seconds} seconds"), *keys, user)
        .agg(F.count("*").alias("count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
        .withColumn("bucket", (F.unix_seconds("window.start") / seconds).cast("bigint"))
        .drop("window")
    )


def untimed(alerts: DataFrame, ts: str) -> DataFrame:
    return alerts.where(F.col(ts).isNull())
