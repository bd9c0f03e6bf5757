"""Queries of the general training-data problems (1 and 6) and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.operators import instants
from alertweave.operators.eager import entity_load
from alertweave.session import table


def p1_entity_load(spark: SparkSession, d: str) -> DataFrame:
    load = entity_load(table(spark, d, "real_alerts_clustered"), table(spark, d, "user_logged_in"))
    return load.select("kind", "entity", "n_rows", "n_alerts", "n_decoders", "n_logons", "n_pairs", "n_alert_logons")


def p1_found(spark: SparkSession, d: str, share: float = 0.02) -> DataFrame:
    load = entity_load(table(spark, d, "real_alerts_clustered"), table(spark, d, "user_logged_in"))
    return load.where(F.col("n_rows") >= share * F.col("all_rows")).select("kind", "entity")


def stamped_values(spark: SparkSession, d: str) -> DataFrame:
    """table_name, rec_id, field_name, written, agent: every timestamp as written."""
    alerts, logons = table(spark, d, "real_alerts_clustered"), table(spark, d, "user_logged_in")
    fields = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("written")) for c in ("first_seen", "last_seen")))
    a = alerts.select(F.lit("real_alerts_clustered").alias("table_name"), F.col("row_id").alias("rec_id"), F.inline(fields), F.col("agent_name").alias("agent"))
    b = logons.select(
        F.lit("user_logged_in").alias("table_name"), F.col("event_id").alias("rec_id"), F.lit("creation_time").alias("field_name"), F.col("creation_time").alias("written"), F.col("collector").alias("agent")
    )
    return a.unionByName(b)


def p6_normalised(spark: SparkSession, d: str) -> DataFrame:
    zones = instants.zone_table(table(spark, d, "agent_zones"))
    out = instants.normalise(stamped_values(spark, d), "written", "agent", zones)
    return out.select("table_name", "rec_id", "field_name", "utc_us", "status", F.round("confidence", 6).alias("confidence"), "order")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_normalised(spark, d).where((F.col("status") == "exact") & F.col("utc_us").isNotNull()).select("table_name", "rec_id", "field_name", "utc_us")


QUERIES = {f.__name__: f for f in (p1_found, p1_entity_load, p6_found, p6_normalised)}

#: Every character with the Unicode property White_Space, as chr() calls for DuckDB.
_BLANKS = "||".join(f"chr({i})" for i in (32, 9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


def _entries(c: str) -> str:
    return f"list_distinct(list_filter([lower(trim(x, {_BLANKS})) for x in coalesce({c}, [])], lambda x: x is not null and x <> ''))"


_LISTED = f"""
listed AS (SELECT kind, entity, count(*) AS n_rows, CAST(sum(coalesce("count", 0)) AS BIGINT) AS n_alerts, count(DISTINCT coalesce(decoder_name, '')) AS n_decoders FROM (
    SELECT 'host' AS kind, unnest({_entries('entity_hosts')}) AS entity, "count", decoder_name FROM real_alerts_clustered UNION ALL
    SELECT 'ip', unnest({_entries('entity_ips')}), "count", decoder_name FROM real_alerts_clustered) GROUP BY ALL)"""

SQL = {
    "p1_found": f"""WITH {_LISTED} SELECT kind, entity FROM listed WHERE n_rows >= 0.02 * (SELECT count(*) FROM real_alerts_clustered)""",
    "p1_entity_load": f"""WITH {_LISTED}, seen AS (SELECT lower(trim(client_ip, {_BLANKS})) AS entity, count(*) AS n FROM user_logged_in GROUP BY 1)
        SELECT kind, l.entity, n_rows, n_alerts, n_decoders, coalesce(n, 0) AS n_logons, n_rows * coalesce(n, 0) AS n_pairs, n_alerts * coalesce(n, 0) AS n_alert_logons
        FROM listed l LEFT JOIN seen s ON l.kind = 'ip' AND l.entity = s.entity""",
}
