import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertweave.llm import forest, overlaps, waves


def sets(seed, n=160):
    rng = random.Random(seed)
    out = []
    for g in range(n // 4):
        base = {f"u{g}_{i}" for i in range(rng.randint(3, 6))} | ({"everywhere"} if g % 3 else set())
        for _ in range(4):
            s = set(base)
            for _ in range(rng.randint(0, 2)):
                s.discard(rng.choice(sorted(s)))
                s.add(f"x{rng.randint(0, 40)}")
            out.append(sorted(s))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("full", [512, 4])
def test_forest_against_brute_force(spark, monkeypatch, full):
    monkeypatch.setattr(forest, "FULL", full)
    data = {i: s for i, s in enumerate({tuple(s) for s in sets(1)})}
    df = spark.createDataFrame([(i, list(s)) for i, s in data.items()], "cid bigint, s array<string>").select("cid", F.array_sort(F.transform("s", lambda x: F.xxhash64(x))).alias("toks"))
    got = {(r.a, r.b) for r in forest.similar_classes(df, 0.5, 2).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(data), 2) if jaccard(set(data[a]), set(data[b])) >= 0.5}
    assert want and got == want


def test_forest_of_nothing(spark):
    empty = spark.createDataFrame([], "cid bigint, toks array<bigint>")
    assert forest.similar_classes(empty, 0.7, 3).count() == 0
    assert forest.similar_classes(spark.createDataFrame([(1, []), (2, None), (3, [5])], "cid bigint, toks array<bigint>"), 0.7, 3).count() == 0
    assert forest.signatures(pd.Series([], dtype=object), 3, 5) == []


def test_sketches_collide_as_often_as_sets_overlap():
    a, b = np.arange(100), np.arange(30, 130)  # 70 of 130
    x, y = forest.signatures(pd.Series([a, b]), 1, 4000)
    assert abs((x == y).mean() - 70 / 130) < 0.04


def test_signatures_sort_by_their_values_and_deepen():
    rng = np.random.default_rng(1)
    data = pd.Series([rng.integers(0, 40, 8) for _ in range(300)])
    three, four = (np.array([x[0] for x in forest.signatures(data, d, 1)]) for d in (3, 4))
    values = lambda sig, d: [tuple(int(v >> (64 - 64 // d * (j + 1))) & ((1 << 64 // d) - 1) for j in range(d)) for v in (int(x) + 2**63 for x in sig)]
    v3, v4 = values(three, 3), values(four, 4)
    assert sorted(range(300), key=lambda i: (three[i], i)) == sorted(range(300), key=lambda i: (v3[i], i))
    assert all(tuple(x >> 5 for x in a) == b[:3] for a, b in zip(v3, v4, strict=True))  # a deeper prefix goes on with the same values


def test_measured_recall_at_the_threshold(spark):
    """Pairs just at 0.7: seven of ten shared."""
    rows = [(2 * i + k, [1000 * i + j for j in range(7)] + [1000 * i + 100 * (k + 1) + j for j in range(k, k + 1 + (k == 0))]) for i in range(2000) for k in (0, 1)]
    df = spark.createDataFrame(rows, "cid bigint, toks array<bigint>").select("cid", F.array_sort(F.transform("toks", lambda x: F.xxhash64(x))).alias("toks"))
    assert {len(set(rows[0][1]) & set(rows[1][1])) / len(set(rows[0][1]) | set(rows[1][1]))} == {0.7}
    assert forest.similar_classes(df, 0.7, 3).count() == 2000


def overlap_rows(alerts):
    data = [{"entity_users": s[: len(s) // 2], "entity_hosts": [h.upper() + " " for h in s[len(s) // 2 :]], "entity_ips": ["", None]} for s in sets(2)]
    data += [{"entity_users": ["a", "b", "c", "d", "e"]}] * 7 + [{"entity_hosts": ["a", "b", "c", "d", "e"]}, {"entity_users": ["a", "b", "c", "d"]}, {"entity_users": None}]
    return alerts(*data), data


def norm(r):
    return {(k, x.strip().lower()) for k in ("entity_users", "entity_ips", "entity_hosts") for x in r.get(k) or [] if x and x.strip()}


@pytest.mark.parametrize("chunk", [256, 2])
def test_all_pairs_of_rows(alerts, monkeypatch, chunk):
    monkeypatch.setattr(overlaps, "CHUNK", chunk)
    df, data = overlap_rows(alerts)
    s = {i + 1: norm(r) for i, r in enumerate(data) if len(norm(r)) >= 5}
    want = {(a, b) for a, b in itertools.combinations(sorted(s), 2) if jaccard(s[a], s[b]) >= 0.7}
    got = [(r.row_id_a, r.row_id_b) for r in overlaps.all_pairs(df.withColumn("toks", F.lit("clash"))).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {r.row_id: r.n_links for r in overlaps.link_counts(df).collect()}
    assert links == {i: sum(i in p for p in want) for i in s}
    assert overlaps.all_pairs(df.limit(0)).count() == 0


def test_many_copies_are_linked_to_their_representative(alerts):
    df = alerts(*([{"entity_users": list("abcdef")}] * 8 + [{"entity_users": list("abcdefg")}] * 2))
    pairs = lambda large: {(r.row_id_a, r.row_id_b) for r in overlaps.all_pairs(df, large=large).collect()}
    assert pairs(5) == {(1, i) for i in range(2, 11)} | {(9, 10)}
    assert pairs(None) == pairs(8) == set(itertools.combinations(range(1, 11), 2))
    links = {r.row_id: r.n_links for r in overlaps.link_counts(df).collect()}
    assert sum(links.values()) == 2 * len(pairs(None))


def wave_rows():
    t = lambda m: f"2025-10-01T{m // 60:02d}:{m % 60:02d}:00Z"
    w = lambda users, minute, **k: {"entity_users": users, "first_seen": t(minute), "entity_ips": ["10.0.0.1"]} | k
    five = ["a", "b", "c", "d", "e"]
    return [
        *(w(five, m) for m in (0, 0, 100, 350)),  # a wave across two slots, a copy in it
        w(["f", "g", "h", "i"], 0), w(["f", "g", "h", "i"], 10),  # two only
        *(w([f"p{i}" for i in range(6)], m) for m in (10, 200, 390)),  # the ends are more than six hours apart
        *(w([f"q{i}" for i in range(6)], m) for m in (700, 710, 720)),
        w([f"q{i}" for i in range(3, 9)], 730),  # shares 4 of 10: not alike
        *(w([f"r{i}" for i in range(k, k + 6)], 30) for k in (0, 1, 3)),  # a chain
        w(five, 0, first_seen="unknown"),
        w(["z"], 0),
        {"first_seen": t(0)},
    ]


def test_closed_waves(alerts, zones):
    df = alerts(*wave_rows())
    got = {(r.cluster_row_id, r.row_id) for r in waves.found(df.withColumn("label", F.lit(1)), zones).collect()}
    assert got == {(1, i) for i in (1, 2, 3, 4)} | {(10, i) for i in (10, 11, 12)}
    assert waves.found(df.limit(0), zones).count() == 0


def test_waves_are_described(alerts, zones):
    got = waves.described(alerts(*wave_rows()), zones).collect()
    # equal sets within a slot are one node, and it stands for its rows
    assert [(r.row_id, r["size"], r.n_nodes, r["rank"], r.affinity) for r in got if r.cluster_row_id == 1] == [(1, 4, 1, 1, 3.0)]
    chain = sorted((r["rank"], r.row_id, r.affinity) for r in got if r.cluster_row_id == 14)
    assert [x[0] for x in chain] == list(range(1, len(chain) + 1)) and [x[2] for x in chain] == sorted((x[2] for x in chain), reverse=True)


def test_waves_of_copies_against_brute_force(alerts, zones):
    rng = random.Random(5)
    data = [{"entity_users": s, "first_seen": f"2025-10-0{rng.randint(1, 2)}T{rng.randint(0, 23):02d}:00:00Z"} for s in sets(3, 120) for _ in range(rng.randint(1, 2))]
    s = {i + 1: (norm(r), int(r["first_seen"][9]) * 24 + int(r["first_seen"][11:13])) for i, r in enumerate(data) if len(norm(r)) >= 5}
    near = {i: {j for j in s if j != i and abs(s[i][1] - s[j][1]) <= 6 and jaccard(s[i][0], s[j][0]) >= 0.5} for i in s}
    want = {(min(near[i] | {i}), i) for i in s if len(near[i]) >= 2 and all(near[j] | {j} == near[i] | {i} for j in near[i])}
    got = {(r.cluster_row_id, r.row_id) for r in waves.found(alerts(*data), zones).collect()}
    assert want and got == want


@pytest.mark.parametrize("places", ["random", "one"])
def test_waves_come_from_the_embedding(alerts, zones, monkeypatch, places):
    """Without the iterated affinities no wave of several nodes is found."""
    df = alerts(*wave_rows(), *({"entity_users": [*"klmno", f"k{i}"], "first_seen": "2025-10-05T00:00:00Z"} for i in range(4)))
    assert {(r.cluster_row_id, r.row_id) for r in waves.found(df, zones).collect()} >= {(20, i) for i in range(20, 24)}

    def fake(nodes, edges, *_):
        return nodes.select("node", "n", *((F.rand(i) if places == "random" else F.lit(0.5)).alias(f"x{i}") for i in range(waves.VECTORS)), F.lit(0.0).alias("spread"))

    monkeypatch.setattr(waves, "embedding", fake)
    assert not [r for r in waves.found(df, zones).collect() if r.cluster_row_id == 20]


def test_a_bridge_ends_a_wave_but_not_a_group(alerts, zones):
    """Two dense groups joined by one row: neither is closed; the embedding tells the groups apart."""
    t = "2025-10-01T00:00:00Z"
    left = [{"entity_users": [*"abcdef", f"l{i}"], "first_seen": t} for i in range(6)]
    right = [{"entity_users": [*"uvwxyz", f"r{i}"], "first_seen": t} for i in range(6)]
    bridge = [{"entity_users": [*"abcdefuvw"], "first_seen": t}, {"entity_users": [*"abcuvwxyz"], "first_seen": t}]
    apart = alerts(*left, *right)
    assert {r.cluster_row_id for r in waves.found(apart, zones).collect()} == {1, 7}
    joined = alerts(*left, *right, *bridge)
    assert waves.found(joined, zones).count() == 0
    groups = {r.cluster_row_id: r["size"] for r in waves.described(joined, zones).collect()}
    assert set(groups) == {1, 7} and sum(groups.values()) == 14
