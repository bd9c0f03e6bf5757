"""Incident documents, summaries and breakdowns of communities."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions.normalize import TRIAGE
from alertweave.functions.temporal import duration_seconds
from alertweave.operators.flatten import safe_items


def heavy(df: DataFrame, group: Sequence[str], item: Column, k: int, weight: Column | None = None) -> DataFrame:
    """group, item, n, rnk: the ``k`` heaviest items of each group, ties to the smaller item.

    Items are counted before they are ranked, and Spark limits groups before the shuffle of the ranking.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.groupBy(*group, item.alias("item")).agg(n.alias("n")).where(F.col("item").isNotNull() & (F.col("item") != ""))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), "item") if group else Window.orderBy(F.desc("n"), "item")
    return counts.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


def heavy_list(df: DataFrame, group: str, items: Column, k: int, name: str) -> DataFrame:
    """group, name: the ``k`` heaviest entries of an array column as one ordered text."""
    top = heavy(df.select(group, F.explode(items).alias("x")), [group], F.col("x"), k)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "item"))), lambda s: s["item"]), ",").alias(name))


def summaries(rows: DataFrame, group: str, ts: str, limit: int | None = None) -> DataFrame:
    """group, size, n_alerts, decoders, rules (first five), n_clusters, first_us, last_us, without noise; the largest first."""
    out = (
        rows.where(F.col(group) >= 0)
        .groupBy(group)
        .agg(
            F.count("*").alias("size"),
            F.sum("count").alias("n_alerts"),
            F.array_join(F.array_sort(F.collect_set("decoder_name")), ",").alias("decoders"),
            F.array_join(F.slice(F.array_sort(F.collect_set("rule_id")), 1, 5), ",").alias("rules"),
            F.count_distinct("cluster_id").alias("n_clusters"),
            F.unix_micros(F.min(ts)).alias("first_us"),
            F.unix_micros(F.max(ts)).alias("last_us"),
        )
    )
    return out.orderBy(F.desc("n_alerts"), group).limit(limit) if limit else out


DOCUMENT = ("community_id", "run_id", "is_summary", "first_us", "last_us", "duration_seconds", "n_alerts", "n_clusters", "n_rows", "reduction_factor", "decoders", "rules", "rule_descriptions", "top_ips", "top_users", "top_hosts", "mitre_tactics", "mitre_techniques", "has_replay", "severity_score", "incident_summary", "incident_category")


def parts(c: Column) -> Column:
    """Items of a comma list as written, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def _span(first: str, last: str) -> list[Column]:
    lo, hi = F.min(first), F.max(last)
    return [F.unix_micros(lo).alias("first_us"), F.unix_micros(hi).alias("last_us"), duration_seconds(lo, hi).alias("duration_seconds")]


def _names(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def first_distinct(rows: DataFrame, group: str, c: str, order: str, k: int, name: str) -> DataFrame:
    """group, name: the first ``k`` different values of ``c`` in order of arrival, joined by bars."""
    seen = rows.where(F.col(c).isNotNull()).groupBy(group, c).agg(F.min(order).alias("at"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("at", c))
    few = seen.withColumn("rnk", rank).where(F.col("rnk") <= k)
    return few.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rnk", F.col(c).alias("x")))), lambda s: s["x"]), " | ").alias(name))


def incident_documents(rows: DataFrame, first: str, last: str, run_id: str, order: str = "row_id") -> DataFrame:
    """One document (DOCUMENT) for each community: sums, times, factor, and the heaviest entities and tactics.

    Times reach from the least ``first`` to the largest ``last``; a null duration is 0; reduction_factor is alerts per row;
    rule_descriptions are the first five in order of arrival.  Severity, summary and category stay null for the triage.
    Every list is counted on its own and joined by community, so no community's rows are collected.
    """
    rows = rows.where("community_id >= 0")
    base = rows.groupBy("community_id").agg(
        *_span(first, last),
        F.sum("count").alias("n_alerts"),
        F.count_distinct("cluster_id").alias("n_clusters"),
        F.count("*").alias("n_rows"),
        F.round(F.try_divide(F.sum("count"), F.count("*")), 2).alias("reduction_factor"),
        _names("decoder_name").alias("decoders"),
        _names("rule_id").alias("rules"),
        F.coalesce(F.bool_or("is_replay"), F.lit(False)).alias("has_replay"),
    )
    lists = {"top_ips": safe_items(F.col("entity_ips")), "top_users": safe_items(F.col("entity_users")), "top_hosts": safe_items(F.col("entity_hosts")), "mitre_tactics": parts(F.col("mitre_tactic")), "mitre_techniques": parts(F.col("mitre_technique"))}
    sides = [heavy_list(rows, "community_id", items, 10, name) for name, items in lists.items()]
    for side in [*sides, first_distinct(rows, "community_id", "rule_description", order, 5, "rule_descriptions")]:
        base = base.join(side, "community_id", "left")
    empty = {name: F.coalesce(name, F.lit("")) for name in (*lists, "rule_descriptions")}
    none = F.lit(None).cast("string")
    return base.withColumns(empty | {"run_id": F.lit(run_id), "is_summary": F.lit(False), "severity_score": F.lit(None).cast("double"), "incident_summary": none, "incident_category": none}).select(*DOCUMENT)


def run_summary(rows: DataFrame, first: str, last: str, run_id: str) -> DataFrame:
    """The summary document (DOCUMENT) of a run, community_id -1: totals of all rows; the factor is alerts per community."""
    n_communities = F.count_distinct(F.when(F.col("community_id") >= 0, F.col("community_id")))
    out = rows.agg(
        *_span(first, last),
        F.coalesce(F.sum("count"), F.lit(0)).alias("n_alerts"),
        F.count_distinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("n_clusters"),
        F.count("*").alias("n_rows"),
        F.coalesce(F.round(F.try_divide(F.sum("count"), n_communities), 2), F.lit(0.0)).alias("reduction_factor"),
        _names("decoder_name").alias("decoders"),
        _names("rule_id").alias("rules"),
    )
    text = {c: F.lit("") for c in ("top_ips", "top_users", "top_hosts", "mitre_tactics", "mitre_techniques")}
    none = F.lit(None).cast("string")
    rest = {"community_id": F.lit(-1).cast("bigint"), "run_id": F.lit(run_id), "is_summary": F.lit(True), "has_replay": F.lit(False), "rule_descriptions": F.lit("Resumen del run"), "severity_score": F.lit(None).cast("double"), "incident_summary": none, "incident_category": F.lit("__summary__")}
    return out.withColumns(text | rest).select(*DOCUMENT)


def reduction(rows: DataFrame) -> DataFrame:
    """One row: alerts, rows, clusters, communities and the two reductions."""
    different = lambda c: F.count_distinct(F.when(F.col(c) >= 0, F.col(c)))
    s = rows.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_alerts"), F.count("*").alias("n_rows"), different("cluster_id").alias("n_clusters"), different("community_id").alias("n_communities"))
    return s.select(
        "n_alerts", "n_rows", "n_clusters", "n_communities", F.round(1 - F.try_divide("n_rows", "n_alerts"), 6).alias("dedup_reduction"), F.round(1 - F.try_divide("n_communities", "n_alerts"), 6).alias("total_reduction"), F.round(F.try_divide("n_alerts", "n_communities"), 4).alias("factor")
    )


def cross_source(rows: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` communities of more than one decoder with most alerts."""
    out = rows.where("community_id >= 0").groupBy("community_id").agg(F.count_distinct("decoder_name").alias("n_decoders"), F.sum("count").alias("n_alerts"), F.count("*").alias("n_rows")).where("n_decoders > 1")
    return out.orderBy(F.desc("n_alerts"), "community_id").limit(k)


def bridge_entities(rows: DataFrame, entities: Column, k: int = 15) -> DataFrame:
    """community_id, entity, n_clusters, n_rows, pct, label: entities in two or more clusters of a community, the ``k`` widest."""
    e = rows.where("community_id >= 0").select("community_id", "cluster_id", "row_id", F.explode(F.array_distinct(entities)).alias("entity"))
    per = e.groupBy("community_id", "entity", "cluster_id").agg(F.count("*").alias("r")).groupBy("community_id", "entity").agg(F.count("*").alias("n_clusters"), F.sum("r").alias("n_rows"))
    total = rows.where("community_id >= 0").groupBy("community_id").agg(F.count_distinct("cluster_id").alias("total"))
    pct = F.col("n_clusters") / F.col("total")
    out = per.where("n_clusters >= 2").join(total, "community_id").withColumn("pct", F.round(pct, 6)).withColumn("label", F.when(pct > 0.5, "very generic").when(pct > 0.3, "generic").otherwise("discriminating"))
    order = Window.partitionBy("community_id").orderBy(F.desc("n_clusters"), F.desc("n_rows"), "entity")
    return out.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k).select("community_id", "entity", "n_clusters", "n_rows", "pct", "label")


def cluster_breakdown(rows: DataFrame, entities: Column, k: int = 10) -> DataFrame:
    """community_id, cluster_id, n_rows, n_alerts, decoders, rules (three), n_bridge, n_unique, bridges, uniques.

    Entities shared with another cluster of the community, and not; the first ``k`` of each by name are shown.
    """
    rows = rows.where("community_id >= 0")
    base = rows.groupBy("community_id", "cluster_id").agg(
        F.count("*").alias("n_rows"), F.sum("count").alias("n_alerts"), _names("decoder_name").alias("decoders"), F.array_join(F.slice(F.array_sort(F.collect_set("rule_id")), 1, 3), ",").alias("rules")
    )
    e = rows.select("community_id", "cluster_id", F.explode(entities).alias("entity")).distinct()
    width = e.groupBy("community_id", "entity").agg((F.count("*") > 1).alias("bridge"))
    keys = ["community_id", "cluster_id"]
    met = e.join(width, ["community_id", "entity"])
    counts = met.groupBy(*keys).agg(F.count_if("bridge").alias("n_bridge"), F.count_if(~F.col("bridge")).alias("n_unique"))
    few = met.withColumn("rnk", F.row_number().over(Window.partitionBy(*keys, "bridge").orderBy("entity"))).where(F.col("rnk") <= k)
    shown = lambda on: F.array_join(F.array_sort(F.collect_list(F.when(on, F.col("entity")))), ",")
    lists = few.groupBy(*keys).agg(shown(F.col("bridge")).alias("bridges"), shown(~F.col("bridge")).alias("uniques"))
    return base.join(counts, keys, "left").join(lists, keys, "left").fillna(0, ["n_bridge", "n_unique"]).fillna("", ["bridges", "uniques"])


CONTEXT_LISTS = {"rules": 8, "descriptions": 6, "users": 10, "ips": 10, "hosts": 10, "tactics": None, "techniques": None, "decoders": None}


def triage_context(rows: DataFrame, first: str, last: str) -> DataFrame:
    """What a triage is told of each community: sums, window, highest level (null if none), whether sources cross, and lists.

    Lists hold the heaviest items first, joined by bars: rules as id:n; tactics, techniques and decoders whole.  A null rule or
    decoder counts as one named None.
    """
    rows = rows.where("community_id >= 0").withColumns({c: F.coalesce(c, F.lit("None")) for c in ("rule_id", "decoder_name")})
    base = rows.groupBy("community_id").agg(
        F.count("*").alias("n_rows"), F.sum("count").alias("n_alerts"), F.count_distinct("cluster_id").alias("n_clusters"), *_span(first, last), F.max("rule_level").alias("max_level"), (F.count_distinct("decoder_name") > 1).alias("is_cross")
    )
    items = {"rules": F.array("rule_id"), "descriptions": F.array("rule_description"), "users": safe_items(F.col("entity_users")), "ips": safe_items(F.col("entity_ips")), "hosts": safe_items(F.col("entity_hosts")), "tactics": parts(F.col("mitre_tactic")), "techniques": parts(F.col("mitre_technique")), "decoders": F.array("decoder_name")}
    # one pass over the rows for all lists
    tag = lambda k: lambda x: F.struct(F.lit(k).alias("list"), x.alias("item"))
    tagged = F.flatten(F.array(*(F.transform(c, tag(k)) for k, c in items.items())))
    counts = rows.select("community_id", F.explode(tagged).alias("t")).select("community_id", "t.list", "t.item").where("item is not null and item <> ''").groupBy("community_id", "list", "item").agg(F.count("*").alias("n"))
    most = functools.reduce(lambda c, kv: c.when(F.col("list") == kv[0], kv[1]), ((k, n) for k, n in CONTEXT_LISTS.items() if n), F)
    ranked = counts.withColumn("rnk", F.row_number().over(Window.partitionBy("community_id", "list").orderBy(F.desc("n"), "item"))).where((F.col("rnk") <= most) | most.isNull())
    shown = F.when(F.col("list") == "rules", F.concat("item", F.lit(":"), F.col("n").cast("string"))).otherwise(F.col("item"))
    ordered = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == k, F.struct("rnk", shown.alias("x"))))), lambda s: s["x"]), "|").alias(k)
    return base.join(ranked.groupBy("community_id").agg(*(ordered(k) for k in CONTEXT_LISTS)), "community_id", "left").fillna("", list(CONTEXT_LISTS))


#: The words of a triage's severity and confidence.
SEVERITY = {"info": "informativa", "low": "baja", "medium": "media", "high": "alta"}
CONFIDENCE = "baja"


def triage(ctx: DataFrame) -> DataFrame:
    """Heuristic answer to a context (the simulated mode of triage, no language model).

    Service accounts (svc- or user:svc-) of a single source are benign; crossing sources are medium, from level 10 on high.
    """
    users, ips = (F.filter(F.split(c, r"\|"), lambda x: x != "") for c in ("users", "ips"))
    svc = F.exists(users, lambda u: F.lower(u).startswith("svc-") | F.lower(u).startswith("user:svc-")) & ~F.col("is_cross")
    level = F.coalesce("max_level", F.lit(0))
    cross = F.col("is_cross")
    pick = lambda a, b, c, d: F.when(svc, a).when(cross & (level >= 10), b).when(cross, c).otherwise(d)
    doubts = F.array_compact(F.array(F.when(F.size(users) > 4, "many users without a visible relation: the grouping may be an artefact"), F.when(~cross, "a single source: little evidence")))
    return ctx.select(
        "community_id",
        pick("service accounts, probably maintenance", "several sources with rules of high level", "correlated activity of several sources", "activity of a single source").alias("incident_type"),
        pick(*(F.lit(SEVERITY[k]) for k in ("info", "high", "medium", "low"))).alias("severity"),
        svc.alias("benign"),
        F.array_join(F.concat(F.slice(users, 1, 3), F.slice(ips, 1, 3)), "|").alias("key_entities"),
        F.array_join(doubts, "|").alias("doubts"),
        F.lit("review the original alerts of the community|check whether the entities are expected to do this").alias("actions"),
        F.lit(CONFIDENCE).alias("confidence"),
        F.concat(F.lit("Community of "), F.col("n_rows"), F.lit(" rows and "), F.col("n_alerts"), F.lit(" alerts, "), F.when(cross, "several sources").otherwise("one source"), F.lit(" ("), F.regexp_replace("decoders", r"\|", ", "), F.lit(").")).alias("narrative"),
    )


PROMPT = (
    "You are given the summary of one community of security alerts, grouped by shared entities and closeness in time. Judge it carefully: "
    "a grouping alone is no attack, and a high severity needs high rule levels or several sources. Answer in Spanish with one JSON object and nothing else, of these fields: "
)


def triage_prompts(ctx: DataFrame) -> DataFrame:
    """community_id, prompt: the text that would be sent to a language model; sending it is not part of this package."""
    fields = ", ".join(f.split(" ")[0] for f in TRIAGE.split(", "))
    return ctx.select("community_id", F.concat(F.lit(PROMPT + fields + ".\n\n"), F.to_json(F.struct(*ctx.columns))).alias("prompt"))


def triage_index(answers: DataFrame) -> DataFrame:
    """community_id, severity, file: the index beside the documents written for each community, in order."""
    return answers.select("community_id", "severity", F.format_string("community_%d.json", F.col("community_id")).alias("file")).orderBy("community_id")


def coverage(rows: DataFrame) -> DataFrame:
    """Share of rows with at least one user, address, host, any."""
    some = lambda c: F.size(safe_items(F.col(c))) > 0
    u, i, h = some("entity_users"), some("entity_ips"), some("entity_hosts")
    share = lambda p: F.round(F.avg(p.cast("double")), 6)
    return rows.agg(share(u).alias("users"), share(i).alias("ips"), share(h).alias("hosts"), share(u | i | h).alias("any_entity"))
