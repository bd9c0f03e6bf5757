"""Queries of the alert-correlation operators over the test tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.functions import normalize as N
from alertweave.functions import temporal as T
from alertweave.functions.arrays import entries
from alertweave.operators import cluster, community, dashboard, dedup, eda, evaluate, features, graph, identity, pipeline, predicates, prune, report
from alertweave.operators.flatten import safe_items
from alertweave.session import table

DOMAINS = (*N.ORG_DOMAINS, "nexlab.example")
SUFFIXES = (*N.ORG_SUFFIXES, ".nexlab.example")


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alert rows with community_id, a coarse grouping of their clusters."""
    a = table(spark, d, "real_alerts_clustered")
    return a.withColumn("community_id", F.when(F.col("cluster_id") < 0, -1).otherwise(F.col("cluster_id") % 61).cast("bigint"))


def _entities() -> Column:
    """user:, ip: and host: entities of a row."""
    tag = lambda k, c: F.transform(entries(F.col(c)), lambda x: F.concat(F.lit(f"{k}:"), x))
    return F.concat(tag("user", "entity_users"), tag("ip", "entity_ips"), tag("host", "entity_hosts"))


def _raw(spark: SparkSession, d: str, c: str) -> DataFrame:
    return table(spark, d, "real_alerts_clustered").select(F.explode(c).alias("raw")).where("raw is not null").distinct()


def dedup_hourly(spark, d):
    rows = dedup.deduplicate(table(spark, d, "real_alerts_clustered"), "alert_ts", "row_id", 3600)
    lists = [F.array_join(c, "|").alias(c) for c in ("entity_users", "entity_ips", "entity_hosts")]
    return rows.select("decoder_name", "rule_id", "source_address", "destination_address", "user_key", "bucket", F.col("count").alias("n_alerts"), F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), F.col("row_id").alias("first_row_id"), "rule_level", "rule_description", *lists)


def reduction_kpis(spark, d):
    return report.reduction(_alerts(spark, d))


def repetition_analysis(spark, d):
    users = F.get(safe_items(F.col("entity_users")), F.lit(0))
    return dedup.repetition(table(spark, d, "real_alerts_clustered"), [F.col("decoder_name"), F.col("rule_id"), F.col("source_address"), F.col("destination_address"), users])


def freq_tables(spark, d):
    one = lambda c: F.array(c)
    rule = F.concat_ws("|", "rule_id", F.substring("rule_description", 1, 80))
    dims = {
        "decoder": (one(F.col("decoder_name")), 20),
        "level": (one(F.col("rule_level").cast("string")), 20),
        "rule": (one(rule), 30),
        "group": (N.csv_items(F.col("rule_groups")), 25),
        "tactic": (N.csv_items(F.col("mitre_tactic")), 15),
        "agent": (one(F.col("agent_name")), 15),
    }
    return eda.frequencies(table(spark, d, "real_alerts_clustered"), dims).select("dimension", "item", "n", "rnk")


_FIELDS = ("rule_level", "rule_groups", "mitre_id", "source_address", "destination_address", "agent_name", "first_seen", "last_seen")


def field_coverage(spark, d):
    fields = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in _FIELDS)))
    return eda.field_coverage(table(spark, d, "real_alerts_clustered"), "decoder_name", fields)


def entity_cardinality(spark, d):
    kinds = {"user": entries(F.col("entity_users")), "ip": entries(F.col("entity_ips")), "host": entries(F.col("entity_hosts"))}
    return eda.cardinality(table(spark, d, "real_alerts_clustered"), "decoder_name", kinds)


def stratum_share(spark, d):
    return eda.stratum_share(table(spark, d, "real_alerts_clustered"), ["decoder_name", "rule_id"])


def hash_sample(spark, d):
    a = table(spark, d, "real_alerts_clustered")
    return eda.sample_share(dedup.hash_sample(a, "row_id", 1, 10), a, "decoder_name")


def time_reassign(spark, d):
    return eda.respaced(table(spark, d, "real_alerts_clustered"), "alert_ts", "row_id", 3600.0)


def predicates_null_semantics(spark, d):
    a = table(spark, d, "real_alerts_clustered")
    lvl, rule, dec, rules = F.col("rule_level"), F.col("rule_id"), F.col("decoder_name"), ["41000", "42000"]
    since, until = "2025-10-05 00:00:00", "2025-10-20 00:00:00"
    kinds = {
        "search": predicates.search(F.col("alert_ts"), since, until, lvl, 5, rule, rules, dec, ["web-proxy"]),
        "file": predicates.least_level(lvl, 5),
        "sample": predicates.sampled(lvl, 5, rule, rules, dec, ["web-proxy"]),
        "sentinel": predicates.mentions(dec, "EDGE"),
        "noise": predicates.is_noise(F.col("cluster_id")),
    }
    counts = a.agg(*(F.count_if(p).alias(k) for k, p in kinds.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("variant"), F.col(k).alias("n_kept")) for k in kinds))))


def user_norm(spark, d):
    raw = _raw(spark, d, "entity_users")
    return raw.select("raw", N.norm_user(F.col("raw"), "strict", DOMAINS).alias("strict_name"), N.norm_user(F.col("raw"), "simple").alias("simple_name"), N.clean_user(F.col("raw")).alias("clean_name"), N.identity_key(F.col("raw")).alias("identity"))


def ip_norm(spark, d):
    raw = _raw(spark, d, "entity_ips")
    return raw.select("raw", N.norm_ip(F.col("raw"), "strict").alias("strict_ip"), N.norm_ip(F.col("raw"), "simple").alias("simple_ip"), N.clean_ip(F.col("raw")).alias("clean_ip"))


def host_norm(spark, d):
    raw = _raw(spark, d, "entity_hosts")
    return raw.select("raw", N.norm_host(F.col("raw"), "strict", SUFFIXES).alias("strict_host"), N.norm_host(F.col("raw"), "simple").alias("simple_host"), N.clean_host(F.col("raw")).alias("clean_host"))


def ip_extract_docs(spark, d):
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("@")))
    return docs.select("doc_id", N.ip_after_at(F.col("text")).alias("first_ip"), F.array_join(N.ips_after_at(F.col("text")), ",").alias("all_ips"))


def match_forms(spark, d):
    return _raw(spark, d, "entity_users").select("raw", F.array_join(F.array_sort(N.match_variants(F.col("raw"))), "|").alias("variants"), N.incident_base(F.col("raw")).alias("base"), N.fingerprint(F.col("raw")).alias("shape"))


def alias_assign(spark, d):
    u = table(spark, d, "real_alerts_clustered").select(F.explode(entries(F.col("entity_users"))).alias("canonical"), F.unix_micros("alert_ts").alias("first_us"))
    return identity.assign_aliases(u).select("canonical", "id", "alias")


def pseudonymised_users(spark, d):
    a = table(spark, d, "real_alerts_clustered")
    users = a.select("row_id", F.explode(entries(F.col("entity_users"))).alias("canonical"))
    names = identity.assign_aliases(a.select(F.explode(entries(F.col("entity_users"))).alias("canonical"), F.unix_micros("alert_ts").alias("first_us")))
    return identity.pseudonymise(users, "canonical", names, a.count()).select("row_id", F.col("canonical").alias("alias"))


def _pairs(spark, d):
    a = table(spark, d, "real_alerts_clustered").select("decoder_name", "row_id", entries(F.col("entity_ips")).alias("ips"), entries(F.col("entity_hosts")).alias("hosts"))
    p = (F.size("ips") == 1) & (F.size("hosts") == 1)
    return a.where(p).select(F.get("ips", F.lit(0)).alias("ip"), F.get("hosts", F.lit(0)).alias("host"), F.col("decoder_name").alias("source"), F.when(predicates.mentions(F.col("decoder_name"), "edr"), 0).otherwise(1).alias("priority"), F.col("row_id").alias("seq"))


def asset_map(spark, d):
    return identity.asset_map(_pairs(spark, d))


def asset_stats(spark, d):
    return identity.asset_stats(asset_map(spark, d))


def asset_resolve(spark, d):
    e = _alerts(spark, d).select(F.explode(_entities()).alias("entity")).distinct()
    return identity.resolve(e, asset_map(spark, d))


def user_alias_groups(spark, d):
    named = _raw(spark, d, "entity_users").select(N.identity_key(F.col("raw")).alias("k"), "raw")
    return identity.alias_groups(named.where("k is not null"), "k", "raw")


def _listed(spark, d):
    return graph.listings(_alerts(spark, d), _entities(), "decoder_name")


def promiscuous_entities(spark, d):
    return prune.entity_stats(_listed(spark, d), table(spark, d, "real_alerts_clustered").count(), 0.10, 4)


def bridge_filter(spark, d):
    a = _alerts(spark, d).where("cluster_id >= 0")
    per = a.groupBy("cluster_id").agg(F.sum("count").alias("n_alerts"), F.min("decoder_name").alias("decoder_name"))
    size = per.agg(F.count("*").alias("n"), F.sum("n_alerts").alias("t")).first()
    members = a.select("cluster_id", F.explode(_entities()).alias("entity")).distinct().join(per, "cluster_id")
    return prune.bridge_filter(members, size["n"], size["t"] or 0)


def entity_pairs(spark, d):
    return graph.entity_pairs(_listed(spark, d).select("row_id", "entity"))


def _seen(spark, d):
    """Alert rows with first_ts and last_ts: arrival, and the end of the alerts that a row stands for (one a second, ten minutes at most)."""
    return _alerts(spark, d).withColumns({"first_ts": F.col("alert_ts"), "last_ts": F.timestamp_micros(F.unix_micros("alert_ts") + F.least("count", F.lit(600)) * 1_000_000)})


def _spans(spark, d):
    """row_id, lo, hi, count, decoder_name: the rows as intervals in seconds."""
    return _seen(spark, d).select("row_id", T.epoch_seconds(F.col("first_ts")).alias("lo"), T.epoch_seconds(F.col("last_ts")).alias("hi"), "count", "decoder_name")


def _named(spark, d):
    """row_id, entity, decoder_name, lo, hi: the listings of a run."""
    bounds = {"lo": T.epoch_seconds(F.col("first_ts")), "hi": T.epoch_seconds(F.col("last_ts"))}
    return graph.listings(_seen(spark, d).withColumns(bounds), _entities(), "decoder_name", "lo", "hi")


def _edges(spark, d):
    return graph.timed_pairs(_named(spark, d))


def row_entities(spark, d):
    """Entities of each row, resolved by the asset map, without infrastructure and promiscuous ones."""
    kept = pipeline.row_entities(_named(spark, d), asset_map(spark, d))
    return pipeline.pruned(kept, _alerts(spark, d).count()).select("row_id", "entity")


def pipeline_edges(spark, d):
    kept, pairs = pipeline.prepared(_spans(spark, d), _named(spark, d), asset_map(spark, d))
    w = pipeline.linked(pairs, pipeline.Settings())
    return w.select("a", "b", "shared", F.round("dt", 3).alias("dt"), F.round("w", 6).alias("w"))


def _run(spark, d):
    return pipeline.run(_spans(spark, d), _named(spark, d), asset_map(spark, d))


def pipeline_communities(spark, d):
    """The communities of a whole run: entities, graph, communities, consolidation."""
    return _run(spark, d)


def pipeline_documents(spark, d):
    """The incident documents and the summary of a whole run."""
    labels = _run(spark, d).select(F.col("node").alias("row_id"), F.col("community").alias("community_id"))
    rows = _seen(spark, d).drop("community_id").join(labels, "row_id")
    return report.incident_documents(rows, "first_ts", "last_ts", "run-1").unionByName(report.run_summary(rows, "first_ts", "last_ts", "run-1"))


def _swept(spark, d, configs):
    scenarios = spark.createDataFrame([(k,) for k in SCENARIOS], "scenario string")
    return pipeline.sweep(_spans(spark, d), _named(spark, d), _hits(spark, d), scenarios, configs, asset_map(spark, d))


def tau_sweep(spark, d):
    """Edges, communities, factor and the scenarios' scores without decay and for each tau, at the least weight 1."""
    return _swept(spark, d, pipeline.tau_configs([60.0, 3600.0]))


def ab_decay(spark, d):
    """The scenarios' scores under two decays, and what changed."""
    return pipeline.compared(_swept(spark, d, pipeline.AB))


def _weights(kind: str, cutoff: float | None = None):
    def run(spark, d):
        w = graph.weighted(_edges(spark, d), kind, 3600.0, cutoff, min_weight=0.001)
        return w.select("a", "b", "shared", F.round("dt", 3).alias("dt"), F.round("w", 6).alias("w"))

    return run


def edge_stats(spark, d):
    return graph.edge_stats(graph.weighted(_edges(spark, d), "exponential", 3600.0, min_weight=0.001), table(spark, d, "real_alerts_clustered").count())


def dt_quantiles(spark, d):
    return eda.quantiles(_edges(spark, d).select(F.round("dt", 3).alias("dt")), "dt", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p995": 0.995})


TAUS = [None, 10.0, 60.0, 300.0, 3600.0, 86400.0]


def tau_sweep_edges(spark, d):
    return graph.tau_sweep(_edges(spark, d), TAUS, min_weight=0.1)


def _strong(spark, d):
    return graph.weighted(_edges(spark, d), "exponential", 3600.0, min_weight=1.0)


def connected_components(spark, d):
    nodes = _alerts(spark, d).select(F.col("row_id").alias("node"))
    return community.connected_components(nodes, _strong(spark, d))


def connected_components_linked(spark, d):
    nodes = _alerts(spark, d).select(F.col("row_id").alias("node"))
    return community.joined_components(nodes, graph.runs(_named(spark, d), lambda dt: T.decay(dt, "exponential", 3600.0) > 0))


def _placed(spark, d):
    a = _alerts(spark, d)
    lo = T.epoch_seconds(F.col("alert_ts"))
    return a.select(F.col("row_id").alias("node"), F.col("cluster_id").cast("bigint").alias("community"), lo.alias("lo"), (lo + F.least("count", F.lit(600))).alias("hi"), F.explode_outer(F.transform(entries(F.col("entity_users")), lambda x: F.concat(F.lit("user:"), x))).alias("entity"))


def overlapping_communities(spark, d):
    return community.overlapping(_placed(spark, d), 30)


def consolidate_small(spark, d):
    return community.relabelled(community.consolidate(_placed(spark, d), 30))


def _communities(spark, d, edges):
    nodes = _alerts(spark, d).select(F.col("row_id").alias("node"), (F.size(_entities()) > 0).alias("has_entity"))
    return community.detect_communities(nodes, edges)


def louvain_communities(spark, d):
    """The reference's graph: one shared entity is enough, no least weight; edges that weigh less than the least gain of a move all together aren't made."""
    near = graph.weighty_pairs(_named(spark, d), 3600.0, community.LEAST_GAIN)
    return _communities(spark, d, graph.weighted(near, "exponential", 3600.0))


def louvain_strong(spark, d):
    return _communities(spark, d, _strong(spark, d))


def cluster_summary(spark, d):
    return report.summaries(_alerts(spark, d), "cluster_id", "alert_ts", 20)


def community_summary(spark, d):
    return report.summaries(_alerts(spark, d), "community_id", "alert_ts", 15)


def heavy_entities(spark, d):
    a = _alerts(spark, d).select("decoder_name", F.explode(entries(F.col("entity_hosts"))).alias("x"))
    return report.heavy(a, ["decoder_name"], F.col("x"), 5).select("decoder_name", "item", "n", "rnk")


def community_docs(spark, d):
    return report.incident_documents(_seen(spark, d), "first_ts", "last_ts", "run-1")


def run_summary(spark, d):
    return report.run_summary(_seen(spark, d), "first_ts", "last_ts", "run-1")


def bridge_entities(spark, d):
    return report.bridge_entities(_alerts(spark, d), _entities())


def cluster_breakdown(spark, d):
    return report.cluster_breakdown(_alerts(spark, d), _entities())


def cross_source(spark, d):
    return report.cross_source(_alerts(spark, d))


def entity_coverage(spark, d):
    return report.coverage(_alerts(spark, d))


def volume_timeline(spark, d):
    return eda.timeline(_alerts(spark, d), "alert_ts", "minute")


def size_histogram(spark, d):
    sizes = _alerts(spark, d).where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("size"))
    return eda.histogram(sizes, "size", 1, 201, 20)


def log_histogram(spark, d):
    return eda.log_histogram(_alerts(spark, d), "count")


def triage_context(spark, d):
    return report.triage_context(_seen(spark, d), "first_ts", "last_ts")


def triage_heuristic(spark, d):
    return report.triage(triage_context(spark, d))


def triage_prompts(spark, d):
    return report.triage_prompts(triage_context(spark, d))


SCENARIOS = {"s1": "xenia", "s2": "zoe", "s3": "kira", "s4": "nobody"}


def _hits(spark, d):
    users = _listed(spark, d).select("row_id", "entity").where("entity like 'user:%'")
    name = F.substring_index(F.substring("entity", 6, 200), ".", 1)
    wanted = users.select("entity", name.alias("first")).distinct()
    pos = F.coalesce(*(F.when(F.col("first") == v, F.lit(k)) for k, v in SCENARIOS.items()))
    return evaluate.scenario_rows(users, wanted.select(pos.alias("scenario"), "entity").where("scenario is not null"))


def _scores(spark, d, c):
    scenarios = spark.createDataFrame([(k,) for k in SCENARIOS], "scenario string")
    rows = _alerts(spark, d).select("row_id", F.col(c).cast("bigint").alias("community_id"), "decoder_name")
    return evaluate.recall_purity(_hits(spark, d), rows, scenarios)


def scenario_verdict(spark, d):
    return _scores(spark, d, "community_id")


def scenario_dispersion(spark, d):
    return evaluate.dispersion(_hits(spark, d), _alerts(spark, d).select("row_id", "community_id"))


def first_scenario(spark, d):
    order = spark.createDataFrame([(k, i) for i, k in enumerate(SCENARIOS)], "scenario string, pos int")
    return evaluate.first_scenario(_hits(spark, d), order)


def ab_compare(spark, d):
    return evaluate.compare(_scores(spark, d, "community_id"), _scores(spark, d, "cluster_id"))


def ari_vmeasure(spark, d):
    return evaluate.agreement(evaluate.contingency(_alerts(spark, d), "decoder_name", "cluster_id"))


def cohesion_purity(spark, d):
    return evaluate.cohesion(_alerts(spark, d), "decoder_name", "cluster_id")


def ami_score(spark, d):
    cells = evaluate.contingency(_alerts(spark, d), "decoder_name", "community_id").toPandas()  # decoders times 62 communities
    return spark.createDataFrame([(round(evaluate.adjusted_mutual_information(cells), 6),)], "ami double")


def level_over_repetitions(spark, d):
    return evaluate.over_repetitions(_alerts(spark, d).withColumn("x", F.coalesce("rule_level", F.lit(0)).cast("double")), "decoder_name", "x")


def phase_pivot(spark, d):
    a = _alerts(spark, d).select("community_id", predicates.phase(safe_items(F.col("entity_hosts")), ["nx-gate"], ["ad-core", "mail-hub"]).alias("phase"))
    return evaluate.phase_table(a)


_LISTS = {"users": "entity_users", "ips": "entity_ips", "hosts": "entity_hosts"}


def _items():
    named = {k: entries(F.col(c)) for k, c in _LISTS.items()}
    return named | {k: N.csv_items(F.col(c)) for k, c in (("groups", "rule_groups"), ("tactics", "mitre_tactic"), ("techniques", "mitre_technique"))}


def coverage_topk(spark, d):
    """The vocabularies of all six lists: thirty items, and more up to 200 until they cover 70 %."""
    a = _alerts(spark, d)
    words = [features.vocabulary(a, items, 30).withColumn("list", F.lit(k)) for k, items in _items().items()]
    return functools.reduce(DataFrame.unionByName, words)


def feature_matrix(spark, d):
    f = features.build_features(_alerts(spark, d))
    text = lambda c, how: F.array_join(F.transform(c, how), ",").alias(c)
    return f.select("row_id", text("indices", lambda x: x.cast("string")), text("values", lambda x: F.round(x, 4).cast("string")))


def text_anonymize(spark, d):
    """Rule descriptions and notes with the names of users replaced by their aliases."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return identity.anonymise_documents(docs, "doc_id", "text", alias_assign(spark, d))


def alias_lookup(spark, d):
    """Names of the logons in the map of aliases, and back."""
    u = table(spark, d, "user_logged_in").select(N.clean_user(F.col("user_id")).alias("name")).where("name is not null").distinct()
    names = alias_assign(spark, d)
    found = identity.lookup(u, "name", names).withColumnRenamed("found", "alias")
    return identity.lookup(found, "alias", names, reverse=True).select("name", "alias", F.col("found").alias("back"))


def alias_bounce(spark, d):
    """Each alias by the alias of the name that its user's names share."""
    groups = user_alias_groups(spark, d)
    names = alias_assign(spark, d)
    return identity.bounced(names.select(F.col("alias").alias("was"), F.col("alias").alias("user")), "user", names, groups)


def multi_hot(spark, d):
    a = _alerts(spark, d)
    hot = features.multi_hot(a, "row_id", entries(F.col("entity_hosts")), features.vocabulary(a, entries(F.col("entity_hosts")), 30))
    return hot.select("row_id", F.array_join(F.transform("hot", lambda x: x.cast("string")), ",").alias("hot"))


def one_hot_topk(spark, d):
    return features.one_hot(_alerts(spark, d), "rule_id", 10).groupBy("rule_id_hot").agg(F.count("*").alias("n"))


def zscore_features(spark, d):
    a = features.seconds_since_first(_alerts(spark, d).drop("t_seconds"), "alert_ts")
    a = a.select("row_id", "t_seconds", F.coalesce("rule_level", F.lit(0)).alias("level"), F.log1p("count").alias("log_count"))
    z = features.z_scores(a, ["t_seconds", "level", "log_count"], {"t_seconds": 2.0})
    return z.select("row_id", *(F.round(f"z_{c}", 5).alias(f"z_{c}") for c in ("t_seconds", "level", "log_count")))


def dbscan_embeddings(spark, d):
    return cluster.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", 1.15, 5)


def kmeans_embeddings(spark, d):
    return cluster.k_means(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


def agglomerative_embeddings(spark, d):
    return cluster.ward(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


def hdbscan_embeddings(spark, d):
    return cluster.density_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 5)


def pca_features(spark, d):
    p = features.projected(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return p.select("vec_id", F.transform("features", lambda x: F.round(x, 4)).alias("features"))


def dash_total_alerts(spark, d):
    return dashboard.from_summary(table(spark, d, "communities"), "n_alerts", "total_alerts")


def dash_total_alerts_variant(spark, d):
    return dashboard.total_alerts(table(spark, d, "communities"))


def dash_communities(spark, d):
    return dashboard.communities(table(spark, d, "communities"))


def dash_rows(spark, d):
    return dashboard.from_summary(table(spark, d, "communities"), "n_rows", "n_rows")


def dash_factor(spark, d):
    f = dashboard.from_summary(table(spark, d, "communities"), "reduction_factor", "factor")
    return f.select(F.round(F.col("factor").cast("double"), 3).alias("factor"))


def dash_rules(spark, d):
    return dashboard.by_rule(_alerts(spark, d))


def dash_community_table(spark, d):
    return dashboard.community_table(table(spark, d, "communities"))


def dash_sizes(spark, d):
    return dashboard.size_ranges(table(spark, d, "communities"))


def dash_rules_decoders(spark, d):
    return dashboard.rules_by_decoder(_alerts(spark, d))


def dash_tactics(spark, d):
    return dashboard.tactics(table(spark, d, "communities"))


def dash_timeline(spark, d):
    return dashboard.alert_timeline(_alerts(spark, d), "alert_ts")


def dash_decoders(spark, d):
    return dashboard.decoder_share(_alerts(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        dedup_hourly, reduction_kpis, repetition_analysis, freq_tables, field_coverage, entity_cardinality, stratum_share, hash_sample, time_reassign, predicates_null_semantics,
        user_norm, ip_norm, host_norm, ip_extract_docs, match_forms, alias_assign, pseudonymised_users, asset_map, asset_stats, asset_resolve, user_alias_groups,
        promiscuous_entities, bridge_filter, entity_pairs, edge_stats, dt_quantiles, tau_sweep_edges, row_entities, pipeline_edges, pipeline_communities, pipeline_documents, tau_sweep, ab_decay, connected_components, connected_components_linked, overlapping_communities, consolidate_small,
        louvain_communities, louvain_strong, cluster_summary, community_summary, heavy_entities, community_docs, run_summary, bridge_entities, cluster_breakdown, cross_source, entity_coverage,
        volume_timeline, size_histogram, log_histogram, triage_context, triage_heuristic, triage_prompts, scenario_verdict, scenario_dispersion, first_scenario, ab_compare, ari_vmeasure,
        cohesion_purity, ami_score, level_over_repetitions, phase_pivot, coverage_topk, feature_matrix, text_anonymize, alias_lookup, alias_bounce, multi_hot, one_hot_topk, zscore_features, dbscan_embeddings, kmeans_embeddings,
        agglomerative_embeddings, hdbscan_embeddings, pca_features, dash_total_alerts, dash_total_alerts_variant, dash_communities, dash_rows, dash_factor, dash_rules,
        dash_community_table, dash_sizes, dash_rules_decoders, dash_tactics, dash_timeline, dash_decoders,
    )
}
QUERIES |= {f"edge_weights_{k}": _weights(k) for k in T.DECAYS} | {"edge_weights_cutoff": _weights("none", 60.0)}
