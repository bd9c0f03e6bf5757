"""Deduplication of alerts into rows by a composite key and a tumbling bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions.temporal import bucket

FIRST = ("rule_level", "rule_description", "rule_groups", "mitre_tactic", "mitre_technique", "mitre_id")


def user_key(users: Column) -> Column:
    """The smallest user, or empty."""
    return F.coalesce(F.array_min(users), F.lit(""))


def deduplicate(alerts: DataFrame, ts: str, seq: str, seconds: int = 60, users: str = "entity_users", arrays: Sequence[str] = ("entity_users", "entity_ips", "entity_hosts"), first: Sequence[str] = FIRST) -> DataFrame:
    """One row for each (decoder_name, rule_id, source_address, destination_address, user_key, bucket).

    Missing key parts are empty texts; a null time falls into bucket 0.  count is the number of alerts; first_seen and
    last_seen skip null times; the columns of ``first`` come from the first arrival (smallest time, then ``seq``);
    arrays are sorted unions.  One shuffle on the key, combined before it.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    keys = [blank(c) for c in ("decoder_name", "rule_id", "source_address", "destination_address")]
    distinct = {c: F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())) for c in arrays}
    return (
        alerts.withColumns(distinct)
        .groupBy(*keys, user_key(F.col(users)).alias("user_key"), bucket(F.col(ts), seconds).alias("bucket"))
        .agg(
            F.count("*").alias("count"),
            F.min(ts).alias("first_seen"),
            F.max(ts).alias("last_seen"),
            F.min_by(F.struct(seq, *first), F.struct(F.col(ts), F.col(seq))).alias("head"),
            *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in arrays),
        )
        .select(*("decoder_name", "rule_id", "source_address", "destination_address", "user_key", "bucket", "count", "first_seen", "last_seen"), "head.*", *arrays)
    )


def repetition(alerts: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """One row: keys, single ones, repeated ones, redundant alerts and their share."""
    per = alerts.groupBy(*(F.coalesce(k.cast("string"), F.lit("")).alias(f"k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("n"))
    out = per.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") == 1).alias("n_single"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))
    return out.select("n_keys", "n_single", "n_repeated", (F.col("n_all") - F.col("n_keys")).alias("n_redundant"), F.round(F.try_divide(F.col("n_all") - F.col("n_keys"), F.col("n_all")), 6).alias("redundant_ratio"))


def hash_sample(df: DataFrame, key: str, n: int, total: int, excess: float = 1.0) -> DataFrame:
    """About ``n`` of ``total`` rows, the same ones whatever the partitions: a row stays by its key's hash."""
    share = min(1.0, excess * n / max(1, total))
    return df.where(F.pmod(F.col(key) * 2654435761, F.lit(1_000_000)) < round(share * 1_000_000))
