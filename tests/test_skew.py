from collections import Counter

from pyspark.sql import functions as F

from alertweave.operators.eager import eager_join, entity_load, key_states
from alertweave.operators.skew import hot_rows, join_states


def test_eager_join_counts_the_joined_rows(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", None)], "k string, x int")
    right = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,)], "k string")
    got = eager_join(key_states(left, ["k"], "n", {"s": F.col("x")}), key_states(right, ["k"], "m", {}), ["k"], "n", "m")
    assert {(r.k, r.n, r.s, r.m, r.n_pairs) for r in got.collect()} == {("a", 2, 3, 3, 6), ("b", 1, 3, 1, 1), (None, 1, 4, 0, 0), ("c", 1, 0, 0, 0)}


def test_entity_load_reads_entries_once_a_row(spark, alerts):
    a = alerts(
        {"entity_ips": [" 10.0.0.1 ", "10.0.0.1", None, "", " "], "entity_hosts": ["H", "h"], "count": 5},
        {"entity_ips": ["10.0.0.1\t"], "entity_hosts": None, "count": None},
        {"entity_ips": [], "entity_hosts": ["h"], "count": 2},
    ).withColumn("kind", F.lit("clash")).withColumn("n_rows", F.lit(0))
    logons = spark.createDataFrame([("10.0.0.1 ",), ("10.0.0.1",), (None,), ("",)], "client_ip string")
    got = {(r.kind, r.entity): (r.n_rows, r.n_alerts, r.n_logons, r.n_pairs) for r in entity_load(a, logons).collect()}
    assert got == {("ip", "10.0.0.1"): (2, 5, 2, 4), ("host", "h"): (2, 7, 0, 0)}
    assert entity_load(a.limit(0), logons.limit(0)).count() == 0


def test_join_states_with_a_key_of_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id bigint"))
    states = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = Counter((r.k, r.least) for r in join_states(rows, states, ["k"], "n", 3001, least=100).collect())
    want = Counter((r.k, r.least) for r in rows.join(states, "k").collect())
    assert got == want
    assert hot_rows(10**9) == 10**6
