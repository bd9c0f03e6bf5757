import pytest
from pyspark.sql import functions as F

from alertweave.llm import copies


def found(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


BASE = {"decoder_name": "d", "rule_id": "1", "count": 2, "first_seen": "2025-10-01T00:00:00Z", "last_seen": None, "rule_description": "Account locked-out", "entity_users": ["a.b", "c"], "entity_ips": ["x", "y"], "entity_hosts": None, "agent_name": "hub"}


def test_writing_order_and_nulls_dont_matter(alerts, zones):
    df = alerts(
        BASE,
        BASE | {"rule_description": " ACCOUNT  (locked out)", "entity_users": ["<C>", None, "A_B", ""], "entity_ips": ["y", None, "x", ""], "last_seen": "", "entity_hosts": []},
        BASE | {"entity_users": ["a.b", "c", "c"]},  # an entry more
        BASE | {"entity_ips": ["X", "y"]},  # addresses count as stored
        BASE | {"count": 3},
        BASE | {"first_seen": "unknown"},
        BASE | {"first_seen": "unknown"},
        BASE | {"entity_users": None},
        BASE | {"entity_users": [" ", None]},
    ).withColumn("k1", F.lit(0)).withColumn("group_id", F.lit("clash"))
    assert found(copies.alert_copies(df, zones), "group_id", "rec_id", "n_copies") == {(1, 1, 2), (1, 2, 2)}
    assert copies.alert_copies(df.limit(0), zones).count() == 0


LINES = [
    '{"rule_id":"7","decoder":"web-proxy","description":"Tunnel over proxy","src":"10.0.0.1","dst":"2001:db8::1","entity_users":["a.b","c\\t"],"count":"1,234","first_seen":"2025-10-01T00:00:00Z"}',
    "[FIRST_SEEN = 20251001T000000Z] [COUNT =  1234] [ENTITY_USERS = C , <A.B>] [DST = 2001:0DB8:0:0::1] [SRC = 10.0.0.1 ] [DESCRIPTION = (Tunnel\tover proxy)] [DECODER = web proxy] [RULE_ID = 7]",
    "src: ::ffff:10.0.0.1 | dst: 2001:db8:0:0:0:0:0:1 | count: 1.234 | rule_id: 7 | decoder: WEB_PROXY | description: tunnel over proxy | first_seen: 2025-10-01t00:00:00z | entity_users: c,a.b",
    "src=10.0.0.1; dst=2001:db8::1; count=1235; rule_id=7; decoder=web-proxy; description=Tunnel over proxy; first_seen=2025-10-01T00:00:00Z; entity_users=a.b,c",
    "src=100.0.0.1; dst=2001:db8::1; count=1234; rule_id=7; decoder=web-proxy; description=Tunnel over proxy; first_seen=2025-10-01T00:00:00Z; entity_users=a.b,c",
    "no fields",
    "",
    None,
    "x" * 50_000,
]


def test_lines_in_all_layouts(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "line_id bigint, line_text string")
    assert found(copies.line_copies(df), "group_id", "rec_id") == {(0, 0), (0, 1), (0, 2)}


@pytest.mark.parametrize("least_hot", [5, 10_000])
def test_a_third_of_all_rows_in_one_group(spark, least_hot):
    keyed = spark.range(300).select(F.col("id").alias("rec_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - F.col("id") % 2 * (F.col("id") % 5 == 0).cast("int")).cast("bigint").alias("k1"), F.lit(1).cast("bigint").alias("k2"))
    want = {}
    for r in keyed.collect():
        want.setdefault(r.k1, []).append(r.rec_id)
    want = {(min(v), i, len(v)) for v in want.values() if len(v) > 1 for i in v}
    assert found(copies.copy_groups(keyed, 300, least_hot), "group_id", "rec_id", "n_copies") == want
    states = copies.group_states(keyed, 300, least_hot).collect()
    assert sum(r.n_copies for r in states) == 300 and len(states) == len({(r.k1, r.k2) for r in states})


def test_one_record_each_comes_out(alerts, zones, spark):
    df = alerts(BASE, BASE | {"rule_description": "ACCOUNT locked out"}, BASE | {"count": 3}, BASE | {"first_seen": "unknown"}, BASE | {"entity_users": None})
    assert found(copies.collapsed_alerts(df, zones), "rec_id", "n_copies") == {(1, 2), (3, 1)}
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_id bigint, line_text string")
    assert found(copies.collapsed_lines(lines), "rec_id", "n_copies") == {(0, 3), (3, 1), (4, 1)}


def test_a_cold_group_of_many_rows_builds_no_list(spark):
    """A key just below the bound of hot ones, with as many rows as a list couldn't hold; its plan collects nothing."""
    n = 1_000_000
    keyed = spark.range(n + 1000).select(F.col("id").alias("rec_id"), F.when(F.col("id") < n, 0).otherwise(F.col("id")).alias("k1"), F.lit(1).cast("bigint").alias("k2"))
    out = copies.copy_groups(keyed, n * 2000)
    assert out.groupBy("group_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m")).collect() == [(0, n, n)]
    assert "collect_list" not in out._jdf.queryExecution().toString()
