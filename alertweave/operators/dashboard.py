"""Panels of the dashboards, as aggregations over incident documents and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertweave.operators.flatten import safe_items


def from_summary(docs: DataFrame, column: str, out: str) -> DataFrame:
    """The summary document's figure (total alerts, rows, factor)."""
    return docs.where("is_summary").agg(F.max(column).alias(out))


def total_alerts(docs: DataFrame) -> DataFrame:
    """Variant: the sum over all documents."""
    return docs.agg(F.sum("n_alerts").alias("n_alerts"))


def communities(docs: DataFrame) -> DataFrame:
    return docs.where("not is_summary").agg(F.count_distinct("community_id").alias("n_communities"))


def by_rule(rows: DataFrame, k: int = 30) -> DataFrame:
    g = rows.where("rule_id is not null").groupBy("rule_id").agg(F.sum("count").alias("n_alerts"), F.count("*").alias("n_rows"), F.count_distinct("community_id").alias("n_communities"), F.max("rule_level").alias("max_level"))
    return g.orderBy(F.desc("n_alerts"), "rule_id").limit(k)


def community_table(docs: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` communities of most alerts, with the lists of their largest document."""
    head = F.max_by(F.struct(*(F.array_join(F.array_sort(safe_items(F.col(c))), ",").alias(c) for c in ("top_ips", "top_users", "rules"))), F.struct("n_alerts", "community_id"))
    g = docs.where("not is_summary").groupBy("community_id").agg(F.sum("n_alerts").alias("n_alerts"), F.max("n_clusters").alias("n_clusters"), F.max("duration_seconds").alias("duration_seconds"), head.alias("h"))
    return g.orderBy(F.desc("n_alerts"), "community_id").limit(k).select("community_id", "n_alerts", "n_clusters", "duration_seconds", "h.top_ips", "h.top_users", "h.rules")


def size_ranges(docs: DataFrame, bounds: tuple[int, ...] = (1, 10, 50, 100, 500)) -> DataFrame:
    """size_range (its lower bound), n: documents by number of alerts."""
    label = F.lit(0)
    for b in bounds:
        label = F.when(F.col("n_alerts") >= b, b).otherwise(label)
    return docs.where("not is_summary").groupBy(label.cast("bigint").alias("size_range")).agg(F.count("*").alias("n"))


def rules_by_decoder(rows: DataFrame, rules: int = 15, decoders: int = 5) -> DataFrame:
    """rule_id, decoder_name, n_alerts: the largest decoders of the largest rules."""
    g = rows.where("rule_id is not null and decoder_name is not null").groupBy("rule_id", "decoder_name").agg(F.sum("count").alias("n_alerts"))
    top = g.groupBy("rule_id").agg(F.sum("n_alerts").alias("t")).orderBy(F.desc("t"), "rule_id").limit(rules)
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("n_alerts"), "decoder_name"))
    return g.join(F.broadcast(top), "rule_id").withColumn("rnk", rank).where(F.col("rnk") <= decoders).select("rule_id", "decoder_name", "n_alerts")


def tactics(docs: DataFrame) -> DataFrame:
    return docs.where("not is_summary").select("community_id", F.explode(safe_items(F.col("mitre_tactics"))).alias("tactic")).groupBy("tactic").agg(F.count_distinct("community_id").alias("n_communities"))


def alert_timeline(rows: DataFrame, ts: str, k: int = 10, unit: str = "day") -> DataFrame:
    """start_us, community_id, n_alerts of the ``k`` communities of most alerts."""
    top = rows.where("community_id >= 0").groupBy("community_id").agg(F.sum("count").alias("t")).orderBy(F.desc("t"), "community_id").limit(k).select("community_id")
    return rows.join(F.broadcast(top), "community_id", "left_semi").groupBy(F.unix_micros(F.date_trunc(unit, ts)).alias("start_us"), "community_id").agg(F.sum("count").alias("n_alerts"))


def decoder_share(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.where("decoder_name is not null").groupBy("decoder_name").agg(F.sum("count").alias("n_alerts")).orderBy(F.desc("n_alerts"), "decoder_name").limit(k)
