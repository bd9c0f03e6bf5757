import datetime as dt
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertweave.operators import cluster, community, dedup, eda, evaluate, features, graph, identity, prune, report
from alertweave.sources import readers, sinks
from alertweave.streaming import dedup as stream

T0 = dt.datetime(2025, 10, 1, tzinfo=dt.UTC)
sec = lambda s: T0 + dt.timedelta(seconds=s)


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_dedup_keeps_first_arrival_and_null_times(alerts):
    base = {"decoder_name": "d", "rule_id": "1", "count": 1}
    df = alerts(
        base | {"alert_ts": sec(30), "rule_level": 9, "entity_users": ["b", "a", None], "rule_description": "late"},
        base | {"alert_ts": sec(10), "rule_level": None, "entity_users": ["a"], "rule_description": "first"},
        base | {"alert_ts": sec(70), "entity_users": ["a"]},
        base | {"alert_ts": None, "entity_users": None},
        base | {"decoder_name": None, "alert_ts": sec(10), "entity_users": ["a"]},
    )
    for c in ("rule_groups", "mitre_tactic", "mitre_technique", "mitre_id"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    got = dedup.deduplicate(df, "alert_ts", "row_id", 60).collect()
    by = {(r.decoder_name, r.user_key, r.bucket): r for r in got}
    start = int(T0.timestamp()) // 60
    assert set(by) == {("d", "a", start), ("d", "a", start + 1), ("d", "", 0), ("", "a", start)}
    r = by["d", "a", start]
    assert r["count"] == 2 and r.rule_description == "first" and r.rule_level is None and r.entity_users == ["a", "b"]
    assert by["d", "", 0].first_seen is None


def test_promiscuity_limits(spark):
    listed = [(i, "wide", f"d{i % 4}") for i in range(20)] + [(i, "five", f"d{i}") for i in range(5)] + [(i, "ok", "d0") for i in range(2)]
    got = rows(prune.entity_stats(spark.createDataFrame(listed, "row_id int, entity string, decoder_name string"), 200), "entity", "n_rows", "n_decoders", "dropped")
    assert got == {("wide", 20, 4, True), ("five", 5, 5, True), ("ok", 2, 1, False)}


def test_posting_cap_contributes_all_or_nothing(spark):
    at = lambda n: spark.range(n).select(F.col("id").alias("row_id"), F.lit("e").alias("entity"))
    assert graph.entity_pairs(at(40), cap=40).count() == 780
    assert graph.entity_pairs(at(41), cap=40).count() == 0
    assert graph.entity_pairs(at(0)).count() == 0


GOLDEN = [(0, 0, "user:a"), (80, 140, "user:b"), (180, 180, "user:c"), (260, 260, "user:d"), (340, 340, "user:e"), (3600, 3600, None), (3620, 3715, "ip:c2a"), (3750, 3750, None), (3770, 3806, "ip:c2b")]


@pytest.fixture(scope="module")
def golden(spark):
    listed = [(i, e, float(lo), float(hi)) for i, (lo, hi, x) in enumerate(GOLDEN) for e in ["ip:X", x] if e]
    return graph.timed_pairs(spark.createDataFrame(listed, "row_id bigint, entity string, lo double, hi double"))


@pytest.mark.parametrize(("kind", "tau", "edges", "weight"), [("none", None, 36, 36.0), ("exponential", 60, 36, 4.142920), ("exponential", 300, 36, 11.001982), ("gaussian", 300, 36, 12.917236), ("linear", 300, 15, 9.5), ("power", 300, 36, 13.347848)])
def test_golden_weights(golden, kind, tau, edges, weight):
    w = graph.weighted(golden, kind, tau)
    r = w.agg(F.count("*").alias("n"), F.sum("w").alias("s")).first()
    assert r.n == edges and abs(r.s - weight) < 1e-5


@pytest.mark.parametrize(("tau", "best"), [(60.0, 0.475302), (300.0, 0.491091), (900.0, 0.450577)])
def test_golden_communities(spark, golden, tau, best):
    w = graph.weighted(golden, "exponential", tau)
    nodes = spark.range(9).select(F.col("id").alias("node"), F.lit(True).alias("has_entity"))
    labels = community.detect_communities(nodes, w)
    assert rows(labels, "node", "community") == {(i, 0) for i in range(5)} | {(i, 5) for i in range(5, 9)}
    assert abs(community.modularity(labels, w) - best) < 1e-5


def test_isolated_rows(spark):
    nodes = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "node bigint, has_entity boolean")
    edges = spark.createDataFrame([(3, 4, 1.0)], "a bigint, b bigint, w double")
    assert rows(community.detect_communities(nodes, edges), "node", "community") == {(1, 1), (2, -1), (3, 3), (4, 3)}
    assert rows(community.detect_communities(nodes, edges.limit(0)), "node", "community") == {(1, 1), (2, -1), (3, 3), (4, 4)}


def test_runs_join_what_pairs_join(spark):
    """Gaps above the reach, reversed and null bounds, an entity above the cap; the runs' components are those of the pairs."""
    rnd = random.Random(5)
    spans = [(i, rnd.uniform(0, 400), rnd.choice([0.0, 3.0, 30.0, -1.0, -9.0, None])) for i in range(300)]
    listed = [(i, f"e{rnd.randrange(150)}", None if rnd.random() < 0.02 else lo, None if d is None else lo + d) for i, lo, d in spans for _ in range(2)] + [(i, "wide", lo, lo) for i, lo, _ in spans[:9]]
    df = spark.createDataFrame(sorted({(i, e): (i, e, lo, hi) for i, e, lo, hi in listed}.values(), key=str), "row_id bigint, entity string, lo double, hi double")
    nodes = spark.range(300).withColumnRenamed("id", "node")
    want = community.connected_components(nodes, graph.timed_pairs(df, 8).where("dt <= 6"))
    got = rows(community.joined_components(nodes, graph.runs(df, lambda dt: dt <= 6, 8)), "node", "component")
    assert got == rows(want, "node", "component") and 20 < len({c for _, c in got}) < 290
    assert graph.runs(df, lambda dt: dt <= 6, 8).count() <= df.count() < 700


def test_pairs_travel_as_listings(spark):
    """Each pair once with all that it shares, though no shuffle has more rows than there are listings."""
    listed = [(i, f"e{k}", float(i), float(i)) for i in range(60) for k in {0, 1 + i % 2, 3 + i % 3}]
    df = spark.createDataFrame(listed, "row_id bigint, entity string, lo double, hi double")
    pairs = graph.timed_pairs(df)
    assert rows(pairs, "a", "b", "shared", "dt") == {(a, b, 1 + (a % 2 == b % 2) + (a % 3 == b % 3), float(b - a)) for a in range(60) for b in range(a + 1, 60)}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.index("Aggregate")  # from the top: nothing is grouped after pairs are made


def test_pairs_without_weight_are_not_made(spark):
    """What isn't made weighs less than the least gain of a move all together, and communities are those of all pairs."""
    rnd = random.Random(7)
    spans = [(i, 40.0 * (i // 4) + rnd.uniform(0, 4), rnd.choice([0.0, 2.0, -1.0, None])) for i in range(80)]
    listed = [(i, e, lo, None if d is None else lo + d) for i, lo, d in spans for e in (f"e{i % 3}", f"u{i // 8}", "all")]
    df = spark.createDataFrame(listed, "row_id bigint, entity string, lo double, hi double")
    every, near = (graph.weighted(x, "exponential", 5.0) for x in (graph.timed_pairs(df), graph.weighty_pairs(df, 5.0, community.LEAST_GAIN)))
    got, want = (rows(x, "a", "b", "shared", "dt", "w") for x in (near, every))
    assert got < want and 300 < len(got) < len(want) / 2 and sum(r[-1] for r in want - got) < community.LEAST_GAIN
    nodes = spark.range(80).select(F.col("id").alias("node"), F.lit(True).alias("has_entity"))
    assert rows(community.detect_communities(nodes, near), "node", "community") == rows(community.detect_communities(nodes, every), "node", "community")


@pytest.mark.parametrize("batch", [community.BATCH, 0])  # in one task, and in rounds
def test_components_of_a_long_path_and_two_cliques(spark, monkeypatch, batch):
    monkeypatch.setattr(community, "BATCH", batch)
    path = [(i, i + 1) for i in range(60)] + [(a, b) for a, b in itertools.combinations(range(100, 104), 2)] + [(200, 200)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), *range(100, 104), 200]], "node bigint")
    got = dict(rows(community.connected_components(nodes, spark.createDataFrame(path, "a bigint, b bigint")), "node", "component"))
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 104)) and got[200] == 200


def placed(spark, sizes, bridges):
    out, node = [], 0
    for c, n in enumerate(sizes):
        for _ in range(n):
            out += [(node, c, 0.0, 10.0, e) for e in bridges.get(c, [None])]
            node += 1
    return spark.createDataFrame(out, "node bigint, community bigint, lo double, hi double, entity string")


def test_consolidation_is_transitive(spark):
    df = placed(spark, [5, 1, 5], {0: ["x"], 1: ["x", "y"], 2: ["y"]})
    assert {c for _, c in rows(community.consolidate(df), "node", "community")} == {0}
    df = placed(spark, [5, 5], {0: ["x"], 1: ["x"]})
    assert {c for _, c in rows(community.consolidate(df), "node", "community")} == {0, 1}
    once = community.consolidate(placed(spark, [5, 1, 5], {0: ["x"], 1: ["x", "y"], 2: ["y"]}))
    assert rows(community.relabelled(once), "node", "community") == rows(once, "node", "community")


def test_aliases_extend_a_map_and_stay_a_bijection(spark):
    users = spark.createDataFrame([("b", 2), ("a", 1), ("a", 9), ("c", 1), ("user_0001_anonymized", 0), (None, 0)], "canonical string, first_us bigint")
    assert rows(identity.assign_aliases(users), "canonical", "alias") == {("a", "user_0001_anonymized"), ("c", "user_0002_anonymized"), ("b", "user_0003_anonymized")}
    known = spark.createDataFrame([("c", 7)], "canonical string, id bigint")
    again = identity.assign_aliases(users, known)
    assert rows(again, "canonical", "id") == {("c", 7), ("a", 8), ("b", 9)}
    named = identity.pseudonymise(spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "id int, u string"), "u", again, 3)
    assert rows(named, "id", "u") == {(1, "user_0008_anonymized"), (2, None), (3, "zz")}


def test_text_is_pseudonymised_longest_name_first(spark):
    names = [("ann", "user_0001_anonymized"), ("ann.lee", "user_0002_anonymized")]
    text = r"DOM\ann met ANN.LEE@x.org, joann and ann."
    got = spark.range(1).select(identity.anonymise_text(F.lit(text), names).alias("x")).first().x
    assert got == "user_0001_anonymized met user_0002_anonymized, joann and ann." or got == "user_0001_anonymized met user_0002_anonymized, joann and user_0001_anonymized."


def test_asset_map_and_pairing(spark):
    pairs = spark.createDataFrame([("1", "h2", "yaml", 1, 0), ("1", "h1", "seed", 0, 5), ("2", None, "seed", 0, 1)], "ip string, host string, source string, priority int, seq int")
    amap = identity.asset_map(pairs)
    assert rows(amap, "ip", "host", "source") == {("1", "h1", "seed")}
    e = spark.createDataFrame([("ip:1",), ("host:h1",), ("ip:9",)], "entity string")
    assert rows(identity.resolve(e, amap), "entity", "resolved") == {("ip:1", "asset:h1"), ("host:h1", "asset:h1"), ("ip:9", "ip:9")}
    keys = spark.createDataFrame([("d", "host", "victim_host1", 0, "H1"), ("d", "ip", "c2_ip1", 1, "X"), ("d", "ip", "victim_ip1", 2, "I1"), ("e", "host", "h", 0, "H"), ("e", "ip", "i", 1, "I")], "doc string, kind string, key string, pos int, value string")
    assert rows(identity.paired_keys(keys), "doc", "host", "ip") == {("d", "H1", "X"), ("e", "H", "I")}
    assert spark.range(1).select(identity.key_root(F.lit("victim1_o365"))).first()[0] == "victim1"


def test_agreement_of_labelings(spark):
    def score(pairs):
        cells = evaluate.contingency(spark.createDataFrame(pairs, "t string, c int"), "t", "c")
        return cells

    same = score([("a", 1), ("a", 1), ("b", 2), ("b", 2), (None, 3)])
    r = evaluate.agreement(same).first()
    assert (r.ari, r.homogeneity, r.completeness, r.v) == (1, 1, 1, 1)
    assert abs(evaluate.adjusted_mutual_information(same.toPandas()) - 1) < 1e-9
    one = evaluate.agreement(score([("a", 1), ("a", 1), ("b", 1), ("b", 1)])).first()
    assert one.ari == 0 and one.homogeneity == 0 and one.completeness == 1
    assert rows(evaluate.cohesion(spark.createDataFrame([("a", -1), ("a", -1), ("b", 1), ("b", -1)], "t string, c int"), "t", "c"), "scenario", "cohesion", "purity") == {("a", 0.0, 0.0), ("b", 0.5, 1.0)}


def test_verdicts(spark):
    placed = {"ok": [(1, 1)] * 3, "nocomm": [(2, -1)], "share1": [(3, 3)], "share2": [(4, 3)], "impure": [(5, 5)], "weak": [(6, 6)] + [(7, -1)] * 9}
    hits, table, n = [], [], 0
    for s, members in placed.items():
        for _, c in members:
            hits.append((n, s))
            table.append((n, c, "d"))
            n += 1
    table += [(1000 + i, 5, "d") for i in range(5)]
    got = evaluate.recall_purity(spark.createDataFrame(hits, "row_id int, scenario string"), spark.createDataFrame(table, "row_id int, community_id bigint, decoder_name string"), spark.createDataFrame([(s,) for s in [*placed, "none"]], "scenario string"))
    assert dict(rows(got, "scenario", "verdict")) == {"ok": "OK", "nocomm": "NO COMMUNITY", "share1": "FAIL shared", "share2": "FAIL shared", "impure": "WEAK purity", "weak": "WEAK recall", "none": "NOT DETECTED"}


def test_vocabulary_by_coverage(spark):
    items = [x for x, n in zip("abcdef", (50, 20, 10, 10, 5, 5), strict=True) for _ in range(n)]
    df = spark.createDataFrame([([x],) for x in items], "v array<string>")
    assert [features.vocabulary(df, F.col("v"), k, c).count() for k, c in ((1, 0.7), (3, 0.7), (2, 0.0))] == [2, 3, 2]


def test_clusterings_find_blobs(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(c, 0.05, (30, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [[[9.0, 9.0]]])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id bigint, v array<double>")
    truth = [i // 30 for i in range(90)]
    for name in ("hdbscan", "dbscan", "kmeans", "agglomerative"):
        labels = dict(rows(cluster.run(name, df.where("id < 90") if name in ("kmeans", "agglomerative") else df, "id", "v", k=3, eps=0.5), "id", "cluster_id"))
        assert len({labels[i] for i in range(90)}) == 3 and all(labels[i] == labels[30 * truth[i]] for i in range(90)), name
        assert name in ("kmeans", "agglomerative") or labels[90] == -1
    with pytest.raises(ValueError):
        cluster.run("other", df, "id", "v")


def test_reports(spark, alerts):
    df = alerts(*({"community_id": c, "cluster_id": k, "count": n, "decoder_name": d, "rule_id": "1", "rule_level": 12, "entity_users": u, "alert_ts": sec(n)} for c, k, n, d, u in ((1, 1, 5, "a", ["svc-x", "u"]), (1, 2, 3, "b", ["u"]), (2, -1, 1, "a", ["svc-y"]), (-1, -1, 9, "a", None))))
    df = df.withColumns({"mitre_tactic": F.lit("T 10, T 2"), "mitre_technique": F.lit(""), "is_replay": F.lit(None).cast("boolean"), "rule_description": F.concat(F.lit("d"), 9 - F.col("row_id"))})
    ctx = report.triage_context(df, "alert_ts", "alert_ts")
    assert rows(ctx, "community_id", "rules", "users", "tactics", "techniques", "duration_seconds") == {(1, "1:2", "u|svc-x", "T 10|T 2", "", 2), (2, "1:1", "svc-y", "T 10|T 2", "", 0)}
    answers = report.triage(ctx)
    assert rows(answers, "community_id", "severity", "benign", "key_entities") == {(1, "alta", False, "u|svc-x"), (2, "informativa", True, "svc-y")}
    assert rows(report.triage(ctx.withColumn("users", F.lit("user:SVC-x"))), "community_id", "severity") == {(1, "alta"), (2, "informativa")}
    assert rows(report.triage_index(answers), "community_id", "file") == {(1, "community_1.json"), (2, "community_2.json")}
    assert all('"users":' in r.prompt and "severidad" in r.prompt for r in report.triage_prompts(ctx).collect())
    docs = report.incident_documents(df, "alert_ts", "alert_ts", "r")
    assert rows(docs, "community_id", "rule_descriptions", "n_alerts", "has_replay", "severity_score") == {(1, "d8 | d7", 8, False, None), (2, "d6", 1, False, None)}
    total = report.run_summary(df, "alert_ts", "alert_ts", "r")
    assert total.columns == docs.columns and total.first().reduction_factor == 9.0 and total.first().decoders == "a,b"
    assert report.run_summary(df.limit(0), "alert_ts", "alert_ts", "r").first().n_alerts == 0
    assert rows(report.cross_source(df), "community_id", "n_decoders") == {(1, 2)}
    got = report.heavy(df.select("decoder_name", F.explode("entity_users").alias("u")), ["decoder_name"], F.col("u"), 1)
    assert rows(got, "decoder_name", "item") == {("a", "svc-x"), ("b", "u")}


def test_quantiles_histograms_and_places(spark):
    df = spark.createDataFrame([(i, float(x), sec(i)) for i, x in enumerate([1, 1, 2, 10, 1000])], "id bigint, x double, ts timestamp")
    assert eda.quantiles(df, "x", {"m": 0.5}).first().m == 2
    assert rows(eda.log_histogram(df, "x"), "bin", "n") == {(0, 3), (1, 1), (3, 1)}
    assert rows(eda.respaced(df, "ts", "id", 8.0), "id", "offset_s") == {(i, 2.0 * i) for i in range(5)}


@pytest.mark.parametrize(("sketch", "most"), [(4, 20_000), (2_000, 500)])  # brackets of all values, and of a few
def test_quantiles_tell_few_values_apart(spark, monkeypatch, sketch, most):
    kept, write = [], eda.materialise
    monkeypatch.setattr(eda, "SKETCH", sketch)
    monkeypatch.setattr(eda, "materialise", lambda df: kept.append(write(df)) or kept[-1])
    many = spark.range(40_001).select(F.when(F.col("id") < 101, float("nan")).when(F.col("id") < 20_000, 0.0).otherwise(F.col("id") / 7).alias("x"))
    got = eda.quantiles(many, "x", {"lo": 0.0, "m": 0.6, "p": 0.99633, "hi": 1.0}).first()
    want = many.agg(*(F.round(F.percentile("x", F.lit(q)), 6) for q in (0.0, 0.6, 0.99633))).first()
    assert list(got)[:3] == list(want) and got.hi != got.hi  # the largest is no number
    assert kept[-1].count() <= most + 20
    assert list(eda.quantiles(many.limit(0), "x", {"a": 0.5, "b": 0.9}).first()) == [None, None]


def test_ndjson_counts_bad_lines(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'{"a":1}\n\n{bad\n"\xff"\n{"a":"\xc3\xa9"}\n')
    lines = readers.ndjson(spark, str(tmp_path / "a.json"))
    assert readers.ndjson_counts(lines).first().asDict() == {"n_lines": 4, "n_ok": 2, "n_undecodable": 1, "n_bad": 1}
    assert readers.ndjson_lenient(spark, str(tmp_path / "a.json"), "a string").count() >= 2
    assert readers.ndjson(spark, str(tmp_path / "a.json"), 2).count() == 2


def test_truth_and_scenarios(spark, tmp_path):
    event = {"incident_id": "s1-0a1b2c3d", "scenario": "s1", "is_benign": False, "entities": {"u": "kira", "bad": "unknown"}, "vars": {"n": "42", "host": "pc1"}}
    (tmp_path / "t.json").write_text(json.dumps(event) + "\n")
    assert rows(readers.truth_entities(readers.ground_truth(spark, str(tmp_path / "t.json"))), "scenario", "entity") == {("s1", "kira"), ("s1", "pc1")}
    (tmp_path / "a.yaml").write_text("incident_id: I\nname: N\nentities: {u: kira}\nevents:\n - {t_offset: 80, source: s, type: t, repeat: 4, repeat_interval: 20}\n - {t_offset: 3600, source: s, type: t}\n")
    (tmp_path / "b.yaml").write_text("a: [")
    s = readers.scenarios(spark, str(tmp_path))
    assert rows(readers.scenario_rows(s), "lo", "hi", "count", "phase") == {(80.0, 140.0, 4, "A"), (3600.0, 3600.0, 1, "B")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, v string")
    path = str(tmp_path / "m.csv")
    sinks.append_csv(spark, df, path)
    sinks.append_csv(spark, df.withColumn("w", F.lit(2)), path)
    sinks.append_csv(spark, df, path)
    assert sorted((r.id, r.w or "") for r in sinks.appended_csv(spark, path).collect()) == [("1", ""), ("1", ""), ("1", "2")]
    sinks.documents(df, str(tmp_path / "docs"), "id", df.select(F.lit("f").alias("file")))
    assert spark.read.json(str(tmp_path / "docs" / "id=1")).count() == 1 and spark.read.json(str(tmp_path / "docs" / "_index")).first().file == "f"
    lines = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "source string, line string")
    for _ in range(2):
        sinks.log_append(lines, {"a": str(tmp_path / "la"), "b": str(tmp_path / "lb")})
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "la")).collect()) == ["x", "x", "z", "z"]
    with pytest.raises(KeyError):
        sinks.log_append(lines, {"a": str(tmp_path / "la")})
    assert sinks.report(df, str(tmp_path / "report")) == "id\tv\n1\tx" and spark.read.text(str(tmp_path / "report")).count() == 2
    sinks.declared_table(df, "alertweave_t", "id bigint, v string, w double", recreate=True)
    assert spark.table("alertweave_t").dtypes == [("id", "bigint"), ("v", "string"), ("w", "double")]
    assert sinks.bulk(spark.range(10), lambda batch: [r["id"] != 3 for r in batch], 4).first().asDict() == {"n_ok": 9, "n_failed": 1}
    sinks.persist_private("x", str(tmp_path / "p"))
    assert (tmp_path / "p").stat().st_mode & 0o777 == 0o600
    (tmp_path / "alias.json").write_text('{"canonical": "a", "id": null}\n')
    with pytest.raises(ValueError):
        readers.alias_map(spark, str(tmp_path / "alias.json"))


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    data = [("d", "1", "", "", ["a"], sec(s)) for s in (0, 10, 59, 60, 200, 4000)] + [("d", "1", "", "", ["a"], None)]
    df = spark.createDataFrame(data, "decoder_name string, rule_id string, source_address string, destination_address string, entity_users array<string>, alert_ts timestamp")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    q = stream.deduplicated(spark.readStream.schema(df.schema).parquet(src), "alert_ts").writeStream.format("memory").queryName("rows_").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    start = int(T0.timestamp()) // 60
    assert rows(spark.table("rows_"), "bucket", "count") == {(start, 3), (start + 1, 1), (start + 3, 1)}
    assert stream.untimed(df, "alert_ts").count() == 1


def test_louvain_on_bridged_cliques():
    e = list(itertools.combinations(range(4), 2)) + list(itertools.combinations(range(4, 8), 2)) + [(3, 4)]
    a, b = (np.array(x) for x in zip(*e, strict=True))
    w = np.ones(len(e))
    w[-1] = 0.1
    label = community.louvain(np.arange(8), a, b, w, w.sum())
    assert len(set(label[:4])) == 1 and len(set(label[4:])) == 1 and label[0] != label[7]


def test_every_two_blocks_meet(spark):
    for n in (2, 3, 5, 6):
        met = set()
        for turn in range(1, n + n % 2):
            groups: dict[int, list[int]] = {}
            for r in spark.range(n).select("id", community.paired(F.col("id").cast("int"), n, turn).alias("g")).collect():
                groups.setdefault(r.g, []).append(r.id)
            assert all(len(g) <= 2 for g in groups.values())
            met |= {tuple(sorted(g)) for g in groups.values() if len(g) == 2}
        assert met == set(itertools.combinations(range(n), 2))


def test_blocks_meet_where_edges_join_them(spark, monkeypatch):
    """A chain of cliques cut into 12 blocks: each meets its neighbours only, not all others; no move is left."""
    n, k = 36, 5
    chain = [(k * i + x, k * i + y, 1.0) for i in range(n) for x, y in itertools.combinations(range(k), 2)] + [(k * i + k - 1, k * i + k, 0.3) for i in range(n - 1)]
    edges = spark.createDataFrame(chain, "a bigint, b bigint, w double")
    turns, optimised = [], community.materialise
    monkeypatch.setattr(community, "materialise", lambda df: (turns.append(df.columns), optimised(df))[1])
    got = rows(community.in_blocks(edges, sum(w for *_, w in chain), len(chain) // 12), "node", "community")
    assert got == {(v, v - v % k) for v in range(n * k)} and sum(c == ["node", "community"] for c in turns) <= 9
    assert community.met_in_turn([(0, 0), (0, 1), (1, 2), (2, 3), (4, 4)], 5) == [0, 0, 2, 2, 4]
    monkeypatch.setattr(community, "MOST_PAIRS", 0)
    assert rows(community.in_blocks(edges, sum(w for *_, w in chain), len(chain) // 3), "node", "community") == got


def test_large_components_get_louvain_too(spark, monkeypatch):
    """Cliques in a ring, with members far apart by id: more edges than a task takes, the same communities."""
    n, k = 12, 6
    ring = [(i + n * x, i + n * y, 1.0) for i in range(n) for x, y in itertools.combinations(range(k), 2)] + [(min(i, (i + 1) % n), max(i, (i + 1) % n), 0.4) for i in range(n)]
    edges = spark.createDataFrame(ring, "a bigint, b bigint, w double")
    nodes = spark.range(n * k).select(F.col("id").alias("node"), F.lit(True).alias("has_entity"))
    one = rows(community.detect_communities(nodes, edges), "node", "community")
    monkeypatch.setattr(community, "LARGEST", 60)
    many = community.detect_communities(nodes, edges)
    assert rows(many, "node", "community") == {(v, v % n) for v in range(n * k)} == one
    assert abs(community.modularity(many, edges) - (sum(w for *_, w in ring[:-n]) / sum(w for *_, w in ring) - 1 / n)) < 1e-9


def test_decayed_edges_join_communities(spark, tmp_path):
    """Two rows that share an entity half an hour apart are one community and one component; not so at min_weight 1."""
    from alertweave.plans import reference

    data = [(i, "d", ["u"], [], [], 1, sec(s), 0) for i, s in enumerate((0, 1800))]
    spark.createDataFrame(data, "row_id bigint, decoder_name string, entity_users array<string>, entity_ips array<string>, entity_hosts array<string>, count bigint, alert_ts timestamp, cluster_id int").write.parquet(str(tmp_path / "real_alerts_clustered.parquet"))
    q = reference.QUERIES
    for name, label, n in (("louvain_communities", "community", 1), ("louvain_strong", "community", 2), ("connected_components_linked", "component", 1), ("connected_components", "component", 2)):
        assert q[name](spark, str(tmp_path)).select(label).distinct().count() == n, name


def test_ward_is_ward_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(cluster, "WARD_ROWS", 10, raising=False)
    x = np.random.default_rng(3).random((60, 2))
    want = [[i] for i in range(len(x))]
    cost = lambda p, q: len(p) * len(q) / (len(p) + len(q)) * ((x[p].mean(0) - x[q].mean(0)) ** 2).sum()
    while len(want) > 7:
        p, q = min(itertools.combinations(want, 2), key=lambda pq: cost(*pq))
        want = [c for c in want if c is not p and c is not q] + [p + q]
    got: dict[int, set[int]] = {}
    for i, c in rows(cluster.ward(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id bigint, v array<double>"), "id", "v", 7), "id", "cluster_id"):
        got.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
