"""From alert rows to communities: entities resolved and pruned, the row graph, communities, consolidation; sweeps over settings.

The steps take and give DataFrames; only settings, a handful, are looped over.  Entities and candidate pairs don't depend
on the decay, so a sweep computes them once.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.functions.temporal import DECAYS, share_threshold
from alertweave.operators import community, evaluate, graph, identity, prune
from alertweave.operators.predicates import is_infrastructure
from alertweave.operators.skew import hot_rows, join_states
from alertweave.session import materialise, release


@dataclass(frozen=True)
class Settings:
    """Of a run: decay, least weight, promiscuity limits, consolidation (``min_size`` 0: none)."""

    kind: str = "exponential"
    tau: float | None = 300.0
    cutoff: float | None = None
    min_shared: int = 1
    min_weight: float = 0.0
    max_rows_share: float = 0.10
    max_decoders: int = 4
    min_size: int = 3

    def __post_init__(self) -> None:
        if self.kind not in DECAYS:
            raise ValueError(f"no decay named {self.kind}; there are {', '.join(DECAYS)}")


def row_entities(listed: DataFrame, amap: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """``listed`` (row_id, entity, more columns) with entities resolved by the asset map, without infrastructure, each once a row.

    An entity that the maps don't name stays.  A third of all rows may list one entity: rows meet its resolved name
    without moving (:func:`alertweave.operators.skew.join_states`).
    """
    if amap is not None:
        counts = listed.groupBy("entity").agg(F.count("*").alias("n_listed"))
        states = counts.join(identity.resolve(counts.select("entity"), amap, aliases), "entity")
        total = states.agg(F.coalesce(F.sum("n_listed"), F.lit(0))).first()[0]
        listed = join_states(listed, states, ["entity"], "n_listed", total).select(*(F.col("resolved").alias("entity") if c == "entity" else c for c in listed.columns))
    return listed.where(~is_infrastructure(F.col("entity"))).distinct()


def pruned(listed: DataFrame, n_rows: int, settings: Settings = Settings()) -> DataFrame:
    """``listed`` (row_id, entity, decoder_name, ...) without the promiscuous entities; a row may lose all of them."""
    return prune.discriminating(listed, prune.entity_stats(listed, n_rows, settings.max_rows_share, settings.max_decoders))


def linked(pairs: DataFrame, settings: Settings) -> DataFrame:
    """a, b, shared, dt, w: the edges of the row graph from candidate ``pairs`` (a, b, shared, dt) under a decay."""
    return graph.weighted(pairs, settings.kind, settings.tau, settings.cutoff, settings.min_shared, settings.min_weight)


def partition(rows: DataFrame, listed: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """node, community of all ``rows`` (row_id): communities of the graph, small ones joined, numbered from 0; -1: noise.

    ``listed``: row_id, entity and the row's lo, hi.
    """
    nodes = listed.select(F.col("row_id").alias("node")).distinct().withColumn("has_entity", F.lit(True))
    labels = materialise(community.detect_communities(nodes, edges))
    if settings.min_size:  # rows without entities are noise and join nothing
        placed = labels.join(listed.select(F.col("row_id").alias("node"), "lo", "hi", "entity"), "node")
        labels = community.consolidate(placed, settings.min_size)
    found = rows.select(F.col("row_id").alias("node")).join(community.relabelled(labels), "node", "left")
    return materialise(found.select("node", F.coalesce("community", F.lit(-1)).cast("bigint").alias("community")))


def kept_listings(listed: DataFrame, n_rows: int, amap: DataFrame | None = None, aliases: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """:func:`pruned` of :func:`row_entities`, without decoder_name: what goes is decided on counts of entities, before listings move.

    An asset's rows are at most the sum over its names, which a row may list together; where only that sum reaches the
    limit, its rows are told apart and counted.
    """
    per = listed.groupBy("entity", "decoder_name").agg(F.count("*").alias("n"))
    counts = per.groupBy("entity").agg(F.sum("n").alias("n_listed"), F.collect_list(F.struct("decoder_name", "n")).alias("each"))
    if amap is None:
        named = counts.withColumn("resolved", F.col("entity"))
    else:
        counts = materialise(counts)
        named = counts.join(identity.resolve(counts.select("entity"), amap, aliases), "entity")
    named = materialise(named.where(~is_infrastructure(F.col("resolved")) | (F.col("n_listed") >= hot_rows(n_rows))))
    total = named.agg(F.coalesce(F.sum("n_listed"), F.lit(0))).first()[0]
    shared = named.groupBy("resolved").agg(F.count("*").alias("k"), F.sum("n_listed").alias("n"))
    unsure = materialise(shared.where((F.col("k") > 1) & (F.col("n") >= share_threshold(F.lit(n_rows), settings.max_rows_share, 3))).select("resolved"))
    each = named.join(unsure, "resolved", "left_anti").select(F.col("resolved").alias("entity"), F.inline("each"))
    if not unsure.isEmpty():
        of = named.join(unsure, "resolved", "left_semi").select("entity", "resolved", "n_listed")
        rows = join_states(listed.select("row_id", "entity", "decoder_name"), of, ["entity"], "n_listed", total).select(F.col("resolved").alias("entity"), "row_id", "decoder_name").distinct()
        each = each.unionByName(rows.groupBy("entity", "decoder_name").agg(F.count("*").alias("n")))
    gone = prune.entity_stats(each, n_rows, settings.max_rows_share, settings.max_decoders).where("dropped").select(F.col("entity").alias("resolved"), F.lit(True).alias("gone"))
    states = named.select("entity", "resolved", "n_listed").join(gone, "resolved", "left").withColumn("stays", F.col("gone").isNull() & ~is_infrastructure(F.col("resolved")))
    states = materialise(states.select("entity", "resolved", "n_listed", "stays").where(F.col("stays") | (F.col("n_listed") >= hot_rows(total))))  # rows of hot ones that go don't move
    kept = join_states(listed, states, ["entity"], "n_listed", total).where("stays")
    return kept.select(*(F.col("resolved").alias("entity") if c == "entity" else c for c in listed.columns if c != "decoder_name")).distinct()


def prepared(rows: DataFrame, listed: DataFrame, amap: DataFrame | None = None, aliases: DataFrame | None = None, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """What all settings of a decay share: listings (row_id, entity, lo, hi) and candidate pairs (a, b, shared, dt)."""
    n_rows = rows.count()
    kept = materialise(kept_listings(listed, n_rows, amap, aliases, settings))
    pairs = materialise(graph.timed_pairs(kept))
    if n_rows >= community.MANY:
        release(rows.sparkSession)
    return kept, pairs


def run(rows: DataFrame, listed: DataFrame, amap: DataFrame | None = None, aliases: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """node, community of one run over ``rows`` (row_id, lo, hi) and ``listed`` (row_id, entity, decoder_name, lo, hi).

    A row without entities is noise; one whose entities no other row shares keeps a community of its own unless
    consolidation joins it; null bounds are infinitely far from others; empty tables give no rows.
    """
    kept, pairs = prepared(rows, listed, amap, aliases, settings)
    return partition(rows, kept, linked(pairs, settings), settings)


def scored(rows: DataFrame, labels: DataFrame, hits: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario, n_rows, main_comm, recall, purity, is_cross, verdict under ``labels`` (node, community)."""
    placed = rows.select("row_id", "decoder_name").join(labels.select(F.col("node").alias("row_id"), F.col("community").alias("community_id")), "row_id")
    return evaluate.recall_purity(hits, placed, scenarios)


def sweep(rows: DataFrame, listed: DataFrame, hits: DataFrame, scenarios: DataFrame, configs: Sequence[tuple[str, Settings]], amap: DataFrame | None = None) -> DataFrame:
    """config, tau, n_edges, n_communities, n_alerts, factor, scenario, n_rows, main_comm, recall, purity, verdict, n_ok, n_shared.

    One row for each configuration and scenario.  ``rows``: row_id, lo, hi, count, decoder_name.  n_ok counts the
    scenarios with verdict OK, n_shared the main communities that several scenarios share.
    """
    kept, pairs = prepared(rows, listed, amap)
    hits = materialise(hits)  # else they are found anew for each configuration
    n_alerts = rows.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    out = []
    for name, s in configs:
        edges = materialise(linked(pairs, s))
        labels = partition(rows, kept, edges, s)
        n_edges = edges.count()
        n = labels.where("community >= 0").agg(F.count_distinct("community")).first()[0]
        each = scored(rows, labels, hits, scenarios).drop("is_cross")
        ok, shared = F.count_if(F.col("verdict") == "OK"), F.col("main_comm")
        many = each.groupBy(shared).agg(F.count("main_comm").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_shared"))
        whole = each.agg(ok.alias("n_ok")).join(many)  # one row each
        consts = {"config": F.lit(name), "tau": F.lit(s.tau if s.kind != "none" else None).cast("double"), "n_edges": F.lit(n_edges).cast("bigint"), "n_communities": F.lit(n).cast("bigint"), "n_alerts": F.lit(n_alerts).cast("bigint"), "factor": F.round(F.try_divide(F.lit(n_alerts), F.lit(n)), 4)}
        out.append(materialise(each.join(F.broadcast(whole)).withColumns(consts)))
        if n_edges >= community.BATCH:
            del edges, labels, each, whole, many
            release(rows.sparkSession)
    return functools.reduce(DataFrame.unionByName, out).select("config", "tau", "n_edges", "n_communities", "n_alerts", "factor", "scenario", "n_rows", "main_comm", "recall", "purity", "verdict", "n_ok", "n_shared")


def tau_configs(taus: Sequence[float], kind: str = "exponential", min_weight: float = 1.0) -> list[tuple[str, Settings]]:
    """Configurations of a sweep: without decay first, then each tau."""
    base = Settings(kind=kind, min_weight=min_weight)
    return [("none", replace(base, kind="none", tau=None)), *((f"tau {t:g}", replace(base, tau=t)) for t in taus)]


#: The two configurations that are compared.
AB = (("A", Settings(kind="none", tau=None, min_weight=1.0)), ("B", Settings(kind="exponential", tau=60.0, min_weight=0.0)))


def compared(swept: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """scenario, recall and purity under two configurations of :func:`sweep`, and what changed, purity before recall."""
    return evaluate.compare(swept.where(F.col("config") == a), swept.where(F.col("config") == b))


def decay_proof(rows: DataFrame, listed: DataFrame, phases: DataFrame, settings: Settings) -> DataFrame:
    """config, together: whether some community holds both phases without decay, and with it.

    ``phases``: row_id, phase.  The decay is proven to act where it is true for none and false for decay.
    """
    out = []
    for name, s in (("none", replace(settings, kind="none", tau=None)), ("decay", settings)):
        labels = partition(rows, listed, linked(graph.timed_pairs(listed), s), s)
        placed = labels.select(F.col("node").alias("row_id"), F.col("community").alias("community_id")).join(phases, "row_id")
        out.append(evaluate.phases_together(placed).select(F.lit(name).alias("config"), "together"))
    return functools.reduce(DataFrame.unionByName, out)
