import datetime as dt
import zoneinfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alertweave.operators import instants as I

US = 1_000_000
at = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp()) * US

CASES = [
    ("2025-10-01T10:00:00Z", None, at(2025, 10, 1, 10)),
    (" 2025-10-01t10:00:00.5z ", None, at(2025, 10, 1, 10) + 500_000),
    ("2025-10-01T10:00:00.123456789Z", None, at(2025, 10, 1, 10) + 123_456),
    ("2025-10-01T10:00:00+02:00[Europe/Madrid]", "nyk", at(2025, 10, 1, 8)),
    ("2025-10-01T10:00:00.000-05", None, at(2025, 10, 1, 15)),
    ("20251001T100000Z", None, at(2025, 10, 1, 10)),
    ("1759312800", None, at(2025, 10, 1, 10)),
    ("1759312800123", None, at(2025, 10, 1, 10) + 123_000),
    ("1759312800.25", None, at(2025, 10, 1, 10) + 250_000),
    ("1759312800123456", None, at(2025, 10, 1, 10) + 123_456),
    ("01/10/2025 12:00:00", "mad", at(2025, 10, 1, 10)),
    ("10/1/2025 9:00:00 PM", "nyk", at(2025, 10, 2, 1)),
    ("Oct 1, 2025 12:05:00 AM", "nyk", at(2025, 10, 1, 4, 5)),
    ("Oct  1 12:00:00", "mad", at(2025, 10, 1, 10)),
    ("01.10.2025 12:00", "mad", at(2025, 10, 1, 10)),
    ("01-Oct-2025 15:30:00", "del", at(2025, 10, 1, 10)),
    ("Wed, 01 Oct 2025 12:00:00 +0200", None, at(2025, 10, 1, 10)),
    ("Thu, 01 Oct 2025 12:00:00 +0200", None, None),  # no Thursday
    ("2025-10-01 15:30:00 IST", "del", at(2025, 10, 1, 10)),
    ("2025-10-01 15:30:00 IST", "mad", None),  # no name of that zone
    ("2025-10-01 07:00:00 GMT-03:00", None, at(2025, 10, 1, 10)),
    ("2025-10-26 02:30:00", "mad", None),  # repeated
    ("2025-10-26 02:30:00 CEST", "mad", at(2025, 10, 26, 0, 30)),
    ("2025-10-26 02:30:00 CET", "mad", at(2025, 10, 26, 1, 30)),
    ("2025-10-05 02:30:00", "syd", None),  # skipped
    ("2025-10-05 03:00:00", "syd", at(2025, 10, 4, 16)),
    ("2025-10-01 10:00:00", None, None),
    ("2025-10-01 10:00:00", "stranger", None),
    ("2025-10-01 10:00:00", "bad", None),
    ("2025-10-01", "mad", None),
    ("2025-13-01T10:00:00Z", None, None),
    ("2025-10-01T24:00:00Z", None, None),
    ("Oct 41 11:02:09", "mad", None),
    ("0000-00-00 00:00:00", "mad", None),
    ("1970-01-01T00:00:00Z", None, None),
    ("2024-12-31T23:59:59Z", None, None),
    ("2024-12-31T23:59:59-01:00", None, at(2025, 1, 1, 0, 59, 59)),
    ("0", "mad", None),
    ("", "mad", None),
    ("2025/10/01 12:00:00,25", "mad", at(2025, 10, 1, 10) + 250_000),
    ("2025/10-01 12:00:00", "mad", None),
    ("2025-10-01T10:00:00+19:00", None, None),
    ("2025-10-01T10:00:00+01:60", None, None),
    ("2025-10-01T10:00:00-0330", "mad", at(2025, 10, 1, 13, 30)),
    ("2025-02-29 10:00:00", "mad", None),
    ("2025-10-01T10:60:00Z", None, None),
    ("2025-04-06 01:45:00", "lhi", None),  # set back by half an hour
    ("2025-04-06 02:15:00", "lhi", at(2025, 4, 5, 15, 45)),
    ("2025-10-05 02:10:00", "lhi", None),  # skipped
    ("2025-04-06 02:30:00", "syd", None),
    ("x" * 100_000, "mad", None),
    (None, "mad", None),
]


def test_values_by_text_and_declared_zone(spark, zones):
    df = spark.createDataFrame([(i, v, a, a) for i, (v, a, _) in enumerate(CASES)], "id int, v string, a string, agent_name string")
    got = {r.id: r.us for r in I.sole_instant(df, "v", "a", zones, "us").collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, _, w in CASES]
    full = {r.id: (r.utc_us if r.status == "exact" else None) for r in I.normalise(df, "v", "a", zones).collect()}
    assert full == got


def test_em_infers_the_order_of_a_source_from_its_clear_dates(spark, zones):
    dates = [("x", f"{d:02d}/10/2025 10:00:00+00:00".replace("+00:00", "")) for d in range(13, 29)] + [("x", "03/04/2025 10:00:00")]
    mixed = [("y", "25/10/2025 10:00:00"), ("y", "10/25/2025 10:00:00"), ("y", "03/04/2025 10:00:00")]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(dates + mixed)], "id int, a string, v string")
    got = {(r.a, r.v): r for r in I.normalise(df, "v", "a", zones).collect()}
    assert got["x", "03/04/2025 10:00:00"].order == "dmy" and got["x", "03/04/2025 10:00:00"].confidence > 0.95
    assert got["x", "03/04/2025 10:00:00"].status == "zoneless"  # no zone, so no instant
    assert abs(got["y", "03/04/2025 10:00:00"].confidence - 0.5) < 1e-6


def test_em_over_undeclared_sources(spark, zones):
    """Sources with a zone but no order: posteriors settle what a source's own clear dates settle, the rest is marked."""
    from alertweave.operators.instants import zone_table

    z = zone_table(spark.createDataFrame([("d", "UTC", None), ("m", "UTC", None), ("u", "UTC", None), ("fixed", "UTC", "mdy")], "agent_name string, zone_name string, date_order string"))
    rows = [(s, f"{a}/{b}/2025 10:00:00") for s, a, b in [*(("d", f"{i}", "09") for i in range(13, 29)), *(("m", "09", f"{i}") for i in range(13, 29)), *((s, "03", "04") for s in ("d", "m", "u", "fixed"))]]
    rows += [("d", "2025-09-01T00:00:00Z")] * 40 + [("u", "1759312800"), ("u", "05/05/2025 10:00:00")]
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(rows)], "id int, a string, v string")
    got = {r.a: r for r in I.normalise(df, "v", "a", z).where("v like '03/04%'").collect()}
    assert (got["d"].status, got["d"].utc_us) == ("inferred", at(2025, 4, 3, 10)) and (got["m"].status, got["m"].utc_us) == ("inferred", at(2025, 3, 4, 10))
    assert (got["u"].status, got["u"].utc_us) == ("ambiguous", None) and (got["fixed"].status, got["fixed"].utc_us) == ("exact", at(2025, 3, 4, 10))
    w = {r.i_source: r for r in I.fit_notations(I.notation_signatures(df, "v", "a")).collect()}
    assert w["d"].w_ymd > w["d"].w_dmy > 10 * w["d"].w_mdy and w["m"].w_mdy > 10 * w["m"].w_dmy


def test_built_in_reading_equals_the_other(spark, zones):
    """ISO 8601 and epoch numbers by built-in functions give what the batches give."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    base = rng.integers(at(2024, 12, 30), at(2026, 1, 2), 3000) // US * US
    texts = []
    for k, u in enumerate(base):
        t = dt.datetime.fromtimestamp(int(u) // US, dt.UTC).strftime(("%Y-%m-%dT%H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y-%m-%d %H:%M:%S")[k % 3])
        texts.append((t + ("", ".5", ",123456789")[k // 3 % 3] + ("", "Z", "+05:30", "-0330", "+01")[k // 9 % 5]) if k % 50 else str(u // US))
    names = ["mad", "nyk", "syd", "del", "lhi", "bad", "stranger", None]
    df = spark.createDataFrame([(i, t, names[i // 7 % 8]) for i, t in enumerate(texts)], "id int, v string, a string")
    z = {r.z_source: r for r in zones.collect()}
    zone = lambda a: (z[a].z_zone, z[a].z_order) if a in z else (None, None)
    want = I.read_batch(pd.Series(texts), pd.Series([zone(names[i // 7 % 8])[1] for i in range(len(texts))]), pd.Series([zone(names[i // 7 % 8])[0] for i in range(len(texts))]), 2025)
    got = {r.id: (r.i.state, r.i.order1, r.i.n1, r.i.us1) for r in I.read(df, "v", "a", zones).select("id", "i").collect()}
    for i, w in enumerate(want.itertuples(index=False)):
        if w.n1 == 1 or texts[i][:4] == "2025":
            assert got[i] == (w.state, w.order1, w.n1, w.us1), texts[i]


def test_statuses_and_clashing_columns(spark, zones):
    values = [(None, "missing"), ("", "unreadable"), ("2025-10-01", "dateonly"), ("2025-02-30 10:00:00", "impossible"), ("2025-10-26 02:30:00", "ambiguous"), ("2025-03-30 02:30:00", "skipped"), ("2025-10-01 10:00:00", "exact")]
    df = spark.createDataFrame([(v, "mad", s) for v, s in values], "v string, a string, want string")
    assert all(r.status == r.want for r in I.normalise(df, "v", "a", zones).collect())
    assert I.normalise(df.limit(0), "v", "a", zones).count() == 0
    with pytest.raises(ValueError):
        I.normalise(df.withColumnRenamed("want", "status"), "v", "a", zones)


@settings(max_examples=200, deadline=None)
@given(st.integers(at(2025, 1, 2), at(2025, 12, 30)), st.sampled_from(["Europe/Madrid", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Australia/Lord_Howe"]))
def test_local_times_against_the_zone_database(us, zone):
    us -= us % US
    local = dt.datetime.fromtimestamp(us // US, zoneinfo.ZoneInfo(zone))
    naive = local.replace(tzinfo=None)
    both = {naive.replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=f).timestamp() for f in (0, 1)}
    import numpy as np

    n, first = I._local(np.array([int((naive - dt.datetime(1970, 1, 1)).total_seconds()) * US]), zone, 2025)
    assert n[0] == len(both) and int(first[0]) == int(min(both)) * US
