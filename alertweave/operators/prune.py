"""Entities that would join everything: statistics and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.functions.temporal import share_threshold
from alertweave.operators.predicates import is_infrastructure


def entity_stats(listed: DataFrame, n_rows: int, share: float = 0.10, max_decoders: int = 4) -> DataFrame:
    """entity, n_rows, n_decoders, dropped of ``listed`` (row_id, entity, decoder_name; distinct per row; or entity, decoder_name, n rows).

    Dropped: on at least ``max(3, round(n * share))`` rows, or with more than ``max_decoders`` decoders.  Distinct
    decoders are counted in two levels, so one entity on a third of all rows is a few rows after the first.
    """
    two = listed.groupBy("entity", "decoder_name").agg((F.sum("n") if "n" in listed.columns else F.count("*")).alias("n"))
    out = two.groupBy("entity").agg(F.sum("n").alias("n_rows"), F.count("decoder_name").alias("n_decoders"))
    limit = share_threshold(F.lit(n_rows), share, 3)
    return out.withColumn("dropped", (F.col("n_rows") >= limit) | (F.col("n_decoders") > max_decoders))


def discriminating(listed: DataFrame, stats: DataFrame) -> DataFrame:
    """The listings whose entity isn't dropped; the dropped ones are the few, so they are what is joined."""
    return listed.join(stats.where("dropped").select("entity"), "entity", "left_anti")


def bridge_filter(members: DataFrame, n_clusters: int, total_alerts: int, cluster_share: float = 0.5, alert_share: float = 0.3, max_decoders: int = 4, max_same: int = 2) -> DataFrame:
    """entity with one flag for each criterion; ``members``: cluster_id, entity, n_alerts, decoder_name.

    Infrastructure is judged by nothing else.  Thresholds on shares include the limit, those on decoders don't.
    """
    per = members.groupBy("entity", "decoder_name").agg(F.count("*").alias("k"), F.sum("n_alerts").alias("a"))
    e = per.groupBy("entity").agg(F.sum("k").alias("n_clusters"), F.sum("a").alias("n_alerts"), F.count("decoder_name").alias("n_decoders"), F.max(F.when(F.col("decoder_name").isNotNull(), F.col("k"))).alias("most"))
    infra = is_infrastructure(F.col("entity"))
    flag = lambda c: ~infra & F.coalesce(c, F.lit(False))
    return e.select(
        "entity",
        infra.alias("by_blocklist"),
        flag(F.col("n_clusters") >= share_threshold(F.lit(n_clusters), cluster_share, 2)).alias("by_clusters"),
        flag(F.lit(total_alerts > 0) & (F.col("n_alerts") >= total_alerts * alert_share)).alias("by_volume"),
        flag(F.col("n_decoders") > max_decoders).alias("by_decoders"),
        flag(F.col("most") > max_same).alias("by_same_decoder"),
    )
