"""Eager aggregation through joins: per-key results while a few keys hold most records.

Both inputs are reduced to one compact state for each key before they meet, so the join moves states, not
rows, and a key with a third of all rows costs its task one row from each map task.  Counts of the joined
rows come out algebraically: ``n_left * n_right`` pairs, and a sum over the joined rows is the sum of one
side times the count of the other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions.arrays import entries


def key_states(df: DataFrame, keys: Sequence[str], count: str, sums: Mapping[str, Column]) -> DataFrame:
    """One row for each key: ``count`` and the named sums (null counts as 0); map-side combined."""
    return df.groupBy(*keys).agg(
        F.count("*").alias(count), *(F.sum(F.coalesce(c, F.lit(0))).alias(name) for name, c in sums.items())
    )


def eager_join(left: DataFrame, right: DataFrame, keys: Sequence[str], n_left: str, n_right: str, how: str = "left") -> DataFrame:
    """Join two tables of :func:`key_states` on ``keys``; adds n_pairs, the joined rows of the raw inputs.

    ``how="left"``: a key without partner has n_right 0 and n_pairs 0.  Null keys meet no partner.
    """
    joined = left.join(right, list(keys), how)
    return joined.withColumn(n_right, F.coalesce(n_right, F.lit(0))).withColumn("n_pairs", F.col(n_left) * F.coalesce(n_right, F.lit(0)))


def rolled_up(joined: DataFrame, keys: Sequence[str], sums: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """The joined states of finer keys added up by ``keys``; ``same`` columns have one value for each of them."""
    return joined.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in same))


def entity_listings(alerts: DataFrame, arrays: Mapping[str, str], *keep: str) -> DataFrame:
    """kind, entity, count and the kept columns: one row for each distinct entry of each array (``kind`` -> column) of each alert row."""

    def tag(kind: str, column: str) -> Column:
        return F.transform(entries(F.col(column)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("entity")))

    tagged = F.flatten(F.array(*(tag(k, c) for k, c in arrays.items())))
    return alerts.select("count", *keep, F.explode(tagged).alias("e")).select("e.kind", "e.entity", "count", *keep)


def entity_load(alerts: DataFrame, logons: DataFrame) -> DataFrame:
    """Rows, alerts and joined logons of every host and address of ``alerts``, and the shares of all rows.

    ``alerts``: entity_ips, entity_hosts, count, decoder_name; ``logons``: client_ip.  Three eager states meet: listings by
    (kind, entity, decoder), logons by address, and the totals of all rows by kind.  Counts are multiplied where the states
    join, decoder by decoder, and then rolled up to the entity.  Null arrays, null, blank and repeated entries count as
    :func:`alertweave.functions.arrays.entries` says; a null count is 0 alerts, a null decoder is one of its own; an empty
    table gives no rows.
    """
    keys = ["kind", "entity"]
    listed = key_states(entity_listings(alerts, {"host": "entity_hosts", "ip": "entity_ips"}, "decoder_name"), [*keys, "decoder_name"], "n_rows", {"n_alerts": F.col("count")})
    address = F.get(entries(F.array("client_ip")), F.lit(0))
    seen = key_states(logons.select(F.lit("ip").alias("kind"), address.alias("entity")).where("entity is not null"), keys, "n_logons", {})
    totals = alerts.agg(F.count("*").alias("all_rows"), F.sum(F.coalesce("count", F.lit(0))).alias("all_alerts"))
    totals = totals.select(F.explode(F.array(F.lit("host"), F.lit("ip"))).alias("kind"), "all_rows", "all_alerts")  # two rows
    joined = eager_join(listed, seen, keys, "n_rows", "n_logons")
    joined = joined.withColumns({"n_alert_logons": F.col("n_alerts") * F.col("n_logons"), "n_decoders": F.lit(1).cast("bigint")})
    load = rolled_up(joined, keys, ["n_rows", "n_alerts", "n_pairs", "n_alert_logons", "n_decoders"], ["n_logons"])
    return load.join(F.broadcast(totals), "kind").withColumn("row_share", F.col("n_rows") / F.col("all_rows"))
