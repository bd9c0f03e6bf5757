import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertweave.functions import normalize as N
from alertweave.functions import temporal as T
from alertweave.operators import flatten, predicates

USERS = [("LABCORP\\lab.user1", "user:lab.user1", "lab.user1"), ("lab.user1@labcorp.local", "user:lab.user1", "lab.user1"), ("x@evil.tld", "user:x@evil.tld", "x"), ("lab.user1(uid=1002)", "user:lab.user1", "lab.user1(uid=1002)"), ("root", "user:root", None), ("Bob (admin)", "user:bob", "bob"), ("  ", None, None), (None, None, None), ("a\\ ", None, None)]
IPS = [("::ffff:10.0.0.1", "ip:10.0.0.1", "10.0.0.1"), ("10.0.0.1/32", "ip:10.0.0.1", "10.0.0.1"), ("127.0.0.1", None, None), ("0.0.0.0", None, None), ("not-an-ip", None, None), ("255.255.255.255", None, "255.255.255.255"), ("224.0.0.1", "ip:224.0.0.1", None), ("2001:0DB8::0001", "ip:2001:db8::1", "2001:db8::1"), ("::1", None, None), ("010.0.0.1", None, None), (None, None, None)]
HOSTS = [("SRV-FILE01.labcorp.local", "host:srv-file01", "srv-file01"), ("localhost", None, None), ("10.0.0.1", None, None), ("n/a", None, "n/a"), ("fe80::1", None, "fe80::1"), ("", None, None), (None, None, None)]


@pytest.mark.parametrize(("cases", "f"), [(USERS, N.norm_user), (IPS, N.norm_ip), (HOSTS, N.norm_host)])
def test_dialects(spark, cases, f):
    df = spark.createDataFrame([(v,) for v, *_ in cases], "v string").select("v", f(F.col("v"), "strict").alias("a"), f(F.col("v"), "simple").alias("b"))
    assert {(r.v, r.a, r.b) for r in df.collect()} == set(cases)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_small_functions(spark):
    lit = F.lit
    assert one(spark, N.incident_base(lit("inc-7-0a1b2c3d"))) == "inc-7"
    assert one(spark, N.identity_key(lit("user:lab-s08_ann@x"))) == "lab s08 ann"
    assert one(spark, N.strip_fence(lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert [one(spark, N.tau_label(lit(x))) for x in (7200.0, 5400.0, 300.0, 10.0)] == ["2 h", "1.5 h", "5 min", "10 s"]
    assert one(spark, N.ips_after_at(lit("a@10.0.0.1 b@999.1.1.1 c@127.0.0.1"))) == ["ip:10.0.0.1"]
    assert one(spark, N.csv_items(lit(" A, b ,,"))) == ["a", "b"]
    assert one(spark, N.resolve_template(lit("from {{ ip }}"), {"ip": "10.0.0.1"})) == "from 10.0.0.1"
    assert one(spark, N.norm_entity(lit("Root"), lit("user"))) == "user:root"
    assert one(spark, T.share_threshold(lit(25), 0.1, 1)) == 2 and one(spark, T.share_threshold(lit(35), 0.1, 1)) == 4
    assert one(spark, T.bucket(lit(None).cast("timestamp"))) == 0
    assert one(spark, predicates.is_infrastructure(lit("host:dc2"))) and not one(spark, predicates.is_infrastructure(lit("host:pc2")))
    assert not one(spark, predicates.is_discriminating(lit("2025-10-01"))) and one(spark, predicates.is_discriminating(lit("kira")))
    assert one(spark, predicates.phase(F.array(lit("user:u1"), lit("ip:c2")), ["u1"], ["c2"])) == "A"


def test_flattening(spark):
    doc = '{"rule":{"id":"7"},"data":{"a":"x","n":3,"texts":["p","q"],"empty":[],"objects":[{"k":1}],"b":{"c":"y","list":["z"],"d":{"e":"w","f":{"g":"deep"}}}}}'
    got = one(spark, flatten.flattened(F.lit(doc)))
    assert got["data.a"] == "x" and got["data.n"] == "3" and got["data.texts"] == "p,q" and got["data.empty"] is None
    assert got["data.objects"] == '[{"k":1}]' and got["data.b.c"] == "y" and got["data.b.d.e"] == "w"
    assert "data.b.list" not in got and not any("g" in k for k in got)


def test_extraction(spark):
    doc = '{"data":{"srcuser":"LABCORP\\\\ann","srcip":"10.0.0.9","description":"login bob@10.0.0.7 done"},"predecoder":{"hostname":"PC1.corp.local"}}'
    e = flatten.extracted(F.lit(doc))
    assert one(spark, e["users"]) == ["user:ann"] and one(spark, e["ips"]) == ["ip:10.0.0.7", "ip:10.0.0.9"] and one(spark, e["hosts"]) == ["host:pc1"]


def weight(spark, dt, kind, tau, cutoff=None):
    return one(spark, T.decay(F.lit(float(dt)), kind, tau, cutoff))


def test_decay(spark):
    assert math.isclose(weight(spark, 3260, "exponential", 300), math.exp(-3260 / 300))
    assert weight(spark, 10, "exponential", 0) == 0 and weight(spark, 0, "exponential", 0) == 1
    assert weight(spark, 61, "none", None, 60) == 0 and weight(spark, 150, "linear", 300) == 0.5 and weight(spark, 300, "power", 300) == 0.5
    with pytest.raises(ValueError):
        T.decay(F.lit(1.0), "cubic")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1e5), min_size=2, max_size=20), st.sampled_from(T.DECAYS), st.floats(1, 1e4))
def test_decay_falls_and_stays_in_range(spark, gaps, kind, tau):
    gaps = sorted(gaps)
    w = one(spark, F.array(*(T.decay(F.lit(g), kind, tau) for g in gaps)))
    assert all(0 <= x <= 1 for x in w) and all(x >= y for x, y in zip(w, w[1:], strict=False))

