"""The composed run, its sweeps, the feature matrix, identities, generators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from alertweave.functions import normalize as N
from alertweave.functions import temporal as T
from alertweave.operators import cluster, evaluate, features, graph, identity, pipeline, predicates
from alertweave.sources import generate, readers


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def listed(spark, data):
    """(row, lo, hi, decoder, entities)"""
    flat = [(i, e, d, float(lo), float(hi)) for i, lo, hi, d, es in data for e in es]
    return spark.createDataFrame(flat, "row_id bigint, entity string, decoder_name string, lo double, hi double")


def spans(spark, data):
    return spark.createDataFrame([(i, float(lo), float(hi), 2, d) for i, lo, hi, d, _ in data], "row_id bigint, lo double, hi double, count bigint, decoder_name string")


def test_entities_are_resolved_and_pruned(spark):
    data = [(i, 0, 0, "d", [f"ip:10.0.0.{i}", "host:pc1" if i < 2 else f"host:x{i}", "user:svc-backup", "ip:all"]) for i in range(40)]
    amap = spark.createDataFrame([("10.0.0.5", "pc1", "s")], "ip string, host string, source string")
    kept = pipeline.row_entities(listed(spark, data), amap)
    assert {(5, "asset:pc1"), (0, "asset:pc1"), (1, "asset:pc1")} <= rows(kept, "row_id", "entity")
    assert "user:svc-backup" not in {e for _, e in rows(kept, "row_id", "entity")}
    left = {e for _, e in rows(pipeline.pruned(kept, 40), "row_id", "entity")}
    assert "asset:pc1" in left and "ip:all" not in left
    assert pipeline.row_entities(listed(spark, data).limit(0), amap).count() == 0


def test_listings_are_pruned_before_they_are_written(spark, monkeypatch):
    """Names of one asset in one row count once, decoders over all its names; what goes is never written."""
    names = {i: ["ip:a", "host:pca"] for i in (0, 3, 6)} | {10: ["ip:b"], 11: ["ip:b"], 12: ["host:pcb"], 13: ["host:pcb"], 20: ["ip:c", "user:m"], 21: ["host:pcc", "user:m"], 22: ["ip:c", "user:m"]}
    data = [(i, i, i, f"d{i % 3}" if i < 30 else None, ["ip:all", "user:svc-backup", f"host:x{i // 2}", *names.get(i, [])]) for i in range(40)]
    amap = spark.createDataFrame([("a", "pca", "s"), ("b", "pcb", "s"), ("c", "pcc", "s")], "ip string, host string, source string")
    written = []
    real = pipeline.materialise
    monkeypatch.setattr(pipeline, "materialise", lambda df: (written.append(df), real(df))[1])
    s = pipeline.Settings(max_decoders=2)
    for m in (amap, None):
        want = rows(pipeline.pruned(pipeline.row_entities(listed(spark, data), m), 40, s).drop("decoder_name"), "row_id", "entity", "lo", "hi")
        written.clear()
        kept, pairs = pipeline.prepared(spans(spark, data), listed(spark, data), m, settings=s)
        assert rows(kept, "row_id", "entity", "lo", "hi") == want and kept.count() == len(want)
        assert max(df.count() for df in written if "row_id" in df.columns) == len(want) < 60 and pairs.count() >= 20
    assert rows(pipeline.prepared(spans(spark, data), listed(spark, data), amap, settings=s)[0].where("entity like 'asset%'"), "entity") == {("asset:pca",)}


INCIDENTS = [
    *((i, 10 * i, 10 * i, "ab"[i % 2], ["user:eve", f"ip:{i}"]) for i in range(5)),
    *((10 + i, 50_000 + 10 * i, 50_000 + 10 * i, "a", ["user:eve", "ip:c2"]) for i in range(5)),
    (30, 0, 0, "a", []),
    (31, 0, 0, "a", ["user:alone"]),
]


def test_a_run_parts_incidents_by_time(spark):
    s = pipeline.Settings(tau=300.0, max_rows_share=1.0)
    got = dict(rows(pipeline.run(spans(spark, INCIDENTS), listed(spark, INCIDENTS), settings=s), "node", "community"))
    assert len({got[i] for i in range(5)}) == 1 and len({got[10 + i] for i in range(5)}) == 1 and got[0] != got[10]
    assert got[30] == -1 and got[31] not in (got[0], got[10], -1) and set(got.values()) == {-1, 0, 1, 2}
    none = pipeline.Settings(kind="none", tau=None, max_rows_share=1.0)
    got = dict(rows(pipeline.run(spans(spark, INCIDENTS), listed(spark, INCIDENTS), settings=none), "node", "community"))
    assert got[0] == got[1] or got[0] != got[10]  # one graph: modularity decides
    empty = pipeline.run(spans(spark, INCIDENTS).limit(0), listed(spark, INCIDENTS).limit(0))
    assert empty.count() == 0
    with pytest.raises(ValueError):
        pipeline.Settings(kind="cubic")


def test_sweep_and_comparison(spark, monkeypatch):
    monkeypatch.setattr(pipeline.prune, "entity_stats", lambda listed, *_: listed.select("entity").distinct().withColumn("dropped", F.lit(False)))
    hits = spark.createDataFrame([(i, "one") for i in range(5)] + [(10 + i, "two") for i in range(5)], "row_id bigint, scenario string")
    scenarios = spark.createDataFrame([("one",), ("two",), ("three",)], "scenario string")
    configs = [("A", pipeline.Settings(kind="none", tau=None)), ("B", pipeline.Settings(tau=300.0))]
    out = pipeline.sweep(spans(spark, INCIDENTS), listed(spark, INCIDENTS), hits, scenarios, configs)
    b = {r.scenario: r for r in out.where("config = 'B'").collect()}
    assert (b["one"].recall, b["one"].purity, b["one"].verdict) == (1.0, 1.0, "OK") and b["two"].verdict == "OK" and b["three"].verdict == "NOT DETECTED"
    assert {(r.n_ok, r.n_shared, r.n_alerts, r.tau) for r in b.values()} == {(2, 0, 24, 300.0)} and b["one"].factor == 8.0
    assert {r.tau for r in out.where("config = 'A'").collect()} == {None}
    assert {r.scenario for r in pipeline.compared(out).collect()} == {"one", "two", "three"}
    assert [n for n, _ in pipeline.tau_configs([10.0, 60.0])] == ["none", "tau 10", "tau 60"]


def test_decay_parts_the_phases_of_the_golden_scenario(spark, tmp_path):
    """Rows made from a scenario: without decay some community holds both phases, with it none does."""
    events = [(0, 1, 0), (80, 4, 20), (180, 1, 0), (260, 1, 0), (340, 1, 0), (3600, 1, 0), (3620, 20, 5), (3750, 1, 0), (3770, 10, 4)]
    text = "incident_id: S10\nname: s10\nentities: {bridge_ip: 10.9.9.9, victim_user: eve}\nevents:\n" + "".join(f" - {{t_offset: {o}, source: palo_alto, type: traffic, repeat: {n}, repeat_interval: {k}}}\n" for o, n, k in events)
    (tmp_path / "s10.yaml").write_text(text)
    made = generate.dedup_rows(readers.scenarios(spark, str(tmp_path)))
    assert sorted((r.lo, r.hi, r["count"], r.phase) for r in made.collect())[1] == (80.0, 140.0, 4, "A")
    assert {tuple(r.entities) for r in made.collect()} == {("ip:10.9.9.9", "user:eve")} and {r.decoder_name for r in made.collect()} == {"paloalto-syslog"}
    names = made.select("row_id", F.explode("entities").alias("entity"), "decoder_name", "lo", "hi")
    proof = dict(rows(pipeline.decay_proof(made, names, made.select("row_id", "phase"), pipeline.Settings(tau=300.0)), "config", "together"))
    assert proof == {"none": True, "decay": False}


def test_emissions_truth_and_noise(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("incident_id: I\nname: N\nentities: {user: eve}\nevents:\n - {t_offset: 10, source: vcenter, type: login, repeat: 3, repeat_interval: 20}\n - {t_offset: 5, source: office365, type: mail}\n")
    s = readers.scenarios(spark, str(tmp_path))
    e = [(r.source, r.k, r.emit_us) for r in generate.emissions(s, 1_000_000).collect()]
    assert e == [("office365", 0, 6_000_000), ("vcenter", 0, 11_000_000), ("vcenter", 1, 31_000_000), ("vcenter", 2, 51_000_000)]
    late = [r.emit_us for r in generate.emissions(s, 1_000_000, jitter=2.0).collect()]
    assert all(0 <= x - y <= 2_000_000 for x, (_, _, y) in zip(late, e, strict=True)) and late != [y for _, _, y in e]
    spans_ = evaluate.scenario_spans(generate.truth(generate.emissions(s, 1_000_000)))
    assert rows(spans_, "scenario", "seconds") == {("N", 45.0)}
    n = generate.noise(spark, 0, 4000.0, {"a": 2.0, "b": 0.02})
    count = dict(rows(n.groupBy("source").agg(F.count("*").alias("n")), "source", "n"))
    assert abs(count["a"] - 8000) < 6 * math.sqrt(8000) and abs(count["b"] - 80) < 6 * math.sqrt(80)
    per = [r.n for r in n.where("source = 'a'").groupBy(F.floor(F.col("emit_us") / 1_000_000)).agg(F.count("*").alias("n")).collect()]
    mean = sum(per) / 4000
    assert abs((sum(x * x for x in per) / 4000 - mean**2) / mean - 1) < 0.15  # a Poisson's variance is its mean
    assert n.where("emit_us < 0 or emit_us >= 4000000000").count() == 0 and generate.noise(spark, 0, 0.0).count() == 0


def test_feature_matrix_against_plain_python(spark, alerts):
    data = [{"alert_ts": None, "rule_level": i % 4 or None, "count": i + 1, "decoder_name": "abc"[i % 3], "rule_id": str(i % 5) if i else None, "entity_users": [f"U{i % 2}", None, ""], "entity_hosts": ["h"] if i % 2 else None} for i in range(12)]
    df = alerts(*data).withColumns({"t_seconds": F.lit(0.0), "rule_groups": F.lit("g1, G2,"), "mitre_tactic": F.lit(None).cast("string"), "mitre_technique": F.lit("x")})
    out = features.build_features(df, top_k=3)
    width = features.feature_width(3)
    dense = {r.row_id: r.features for r in features.dense(out, width).collect()}
    assert {len(x) for x in dense.values()} == {width}
    levels = [d["rule_level"] or 0 for d in data]
    m, sd = sum(levels) / 12, math.sqrt(sum(x * x for x in levels) / 12 - (sum(levels) / 12) ** 2)
    top = sorted({str(i % 5) for i in range(1, 12)}, key=lambda r: (-sum(d["rule_id"] == r for d in data), r))[:3]
    for i, d in enumerate(data):
        x = dense[i + 1]
        assert x[0] == 0 and abs(x[1] - (levels[i] - m) / sd) < 1e-9
        assert [k for k in range(11) if x[3 + k]] == ["abc".index(d["decoder_name"])]
        assert [k for k in range(4) if x[14 + k]] == [top.index(d["rule_id"]) if d["rule_id"] in top else 3]
        assert [k for k in range(200) if x[18 + k]] == [i % 2] and [k for k in range(200) if x[18 + 400 + k]] == ([0] if i % 2 else [])
        assert sum(x[18 + 600 : 18 + 800]) == 2 and sum(x[18 + 800 : 18 + 1000]) == 0 and sum(x[18 + 1000 :]) == 1
    labels = spark.createDataFrame([(1, 0), (2, 3), (3, -1), (4, 5)], "k int, cluster_id int")
    assert cluster.transferred_k(labels) == 3 and cluster.transferred_k(labels.limit(0)) == 2


def test_identities(spark):
    names = spark.createDataFrame([("ann.lee", 1, "user_0001_anonymized"), ("lee.ann", 2, "user_0002_anonymized"), ("bob", 3, "user_0003_anonymized")], "canonical string, id bigint, alias string")
    heads = spark.createDataFrame([("lee.ann", "ann.lee"), ("ann.lee", "ann.lee")], "variant string, canonical string")
    users = spark.createDataFrame([("user_0002_anonymized",), ("user_0003_anonymized",), ("carl",), (None,)], "u string")
    assert rows(identity.bounced(users, "u", names, heads), "u") == {("user_0001_anonymized",), ("user_0003_anonymized",), ("carl",), (None,)}
    asked = spark.createDataFrame([("bob",), ("zed",)], "canonical string")
    assert rows(identity.lookup(asked, "canonical", names), "canonical", "found") == {("bob", "user_0003_anonymized"), ("zed", None)}
    assert rows(identity.lookup(users, "u", names, reverse=True).where("found is not null"), "found") == {("lee.ann",), ("bob",)}
    seed = spark.createDataFrame([("10.0.0.1", "A.corp.local", 5)], "ip string, host string, seq int")
    other = spark.createDataFrame([("ip:10.0.0.1", "b", 1), ("10.0.0.2", "host:C", 1), ("999.1.1.1", "d", 1)], "ip string, host string, seq int")
    assert rows(identity.built_map(("seed", seed), ("edr", other)), "ip", "host", "source") == {("10.0.0.1", "a", "seed"), ("10.0.0.2", "c", "edr")}
    assert readers.next_id(names.select("canonical", "id")) == 4 and readers.next_id(names.limit(0), 7) == 7
    texts = [(1, "CORP\\\\Ann.Lee and ann.lee@corp.local, (bob) told bobby; x-bob."), (2, None), (3, ""), (4, "bob"), (5, "bob.")]
    docs = spark.createDataFrame([(i, t.replace("\\\\", "\\") if t else t) for i, t in texts], "k int, t string")
    got = {r.k: r.t for r in identity.anonymise_documents(docs, "k", "t", names).collect()}
    assert got == {1: "user_0001_anonymized and user_0001_anonymized, (user_0003_anonymized) told bobby; x-bob.", 2: None, 3: "", 4: "user_0003_anonymized", 5: "user_0003_anonymized."}


def test_scalars_that_were_wrong(spark):
    df = spark.createDataFrame([("bob@12:30 root@::1 eve@2001:DB8:0:0:0:0:0:1 x@10.0.0.1",)], "t string")
    assert df.select(N.ips_after_at(F.col("t"))).first()[0] == ["ip:2001:db8::1", "ip:10.0.0.1"]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(N.norm_entity(F.lit("zz:qq"), F.lit("ip"))) is None and one(N.norm_ip(F.lit("FE80::0:1"))) == "ip:fe80::1"
    t = lambda x: F.to_timestamp(F.lit(x))
    assert one(T.duration_seconds(t("2025-01-01 00:00:00.9"), t("2025-01-01 00:00:02.1"))) == 1
    assert one(predicates.phase(F.array(F.lit("user:a.b(c")), ["a.b("], [])) == "A" and one(predicates.phase(F.array(F.lit("user:axb")), ["a.b"], [])) is None
    assert one(T.relative_time("now-60m", t("2025-01-01 01:00:00"))).hour == 0 and one(T.relative_time("2025-01-01T05:00:00Z")).hour == 5
    assert one(F.size(N.match_variants(F.lit("Corp\\Ann"), F.create_map(F.lit("ann"), F.lit("user_0001_anonymized"))))) == 4
    assert set(one(N.with_prefix_forms(F.array(F.lit("user:a")), F.lit("1.2.3.4"), F.lit(None).cast("string")))) == {"user:a", "a", "1.2.3.4"}
    drawn = one(N.resolve_template(F.lit("x {{ u }} {{ randint(3, 5) }}"), {"u": "eve"}))
    assert drawn.startswith("x eve ") and 3 <= int(drawn.split()[-1]) <= 5
    answer = one(N.fenced_json(F.lit("```json\n" + json.dumps({"severidad": "alta", "entidades_clave": ["x"]}) + "\n```")))
    assert answer.severidad == "alta" and answer.entidades_clave == ["x"] and one(N.fenced_json(F.lit("no json"))) is None
    assert [r.k for r in evaluate.in_order(spark.createDataFrame([("b",), ("a",), ("z",)], "k string"), "k", ["a", "b", "c"]).collect()] == ["a", "b"]
    assert readers.counted(spark.range(3)) == 3 and readers.counted(spark.range(1).where(F.col("id") == F.raise_error(F.lit("x")).cast("bigint"))) == -1
    assert rows(evaluate.phase_table(spark.createDataFrame([(1, "A"), (1, "B"), (2, None)], "community_id int, phase string")), "community_id", "a", "b", "other", "both") == {(1, 1, 1, 0, True), (2, 0, 0, 1, False)}
    assert graph.POSTINGS == 400
