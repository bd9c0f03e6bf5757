"""Timestamps in many notations and zones -> one instant in UTC.

Each value is read under every notation it fits; notations are mixture components of its source
(sensor, collector).  Expectation-maximisation over per-source counts of "which notations are valid"
gives every source its mixture weights, and the posterior of a value chooses its reading.  A source
whose date order is declared has all weight on that order, so EM decides only where nothing is declared.

Values in digits (ISO 8601 and epoch numbers) are read by built-in functions, the other notations in Arrow batches;
each value is read once.

What a value alone, with the declared zone of its source, cannot settle is marked, never guessed:

``status``
    ``exact``        one reading, one instant
    ``inferred``     several readings; EM's posterior chose one (see ``confidence``)
    ``ambiguous``    several readings, none reaches the asked posterior, or a repeated local time
    ``skipped``      a local time that a clock change leaves out
    ``zoneless``     no offset in the text and no known zone of the source
    ``dateonly``     a date without a time of day
    ``impossible``   no such date or time
    ``unreadable``   another text
    ``missing``      null
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions.arrays import BLANKS, strip_blanks
from alertweave.functions.barrier import settle
from alertweave.session import materialise

US = 1_000_000

#: Month and weekday names.
MONTHS = {m: i + 1 for i, m in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"])}
WEEKDAYS = {d: i for i, d in enumerate(["mon", "tue", "wed", "thu", "fri", "sat", "sun"])}

_DATES = (
    r"(?P<y1>\d{4})(?P<sep>[-/])(?P<m1>\d{2})(?P=sep)(?P<d1>\d{2})",
    r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y2>\d{4})",
    r"(?P<d3>\d{1,2})\.(?P<m3>\d{1,2})\.(?P<y3>\d{4})",
    r"(?:(?P<wd>[A-Za-z]{3}), )?(?P<d4>\d{1,2})[ -](?P<n4>[A-Za-z]{3})[ -](?P<y4>\d{4})",
    r"(?P<n5>[A-Za-z]{3})\s+(?P<d5>\d{1,2})(?:,?\s+(?P<y5>\d{4}))?",
    r"(?P<y6>\d{4})(?P<m6>\d{2})(?P<d6>\d{2})",
)
_TIME = r"(?:(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<fr>\d{1,9}))?)?|(?P<h2>\d{2})(?P<mi2>\d{2})(?P<s2>\d{2}))(?: ?(?P<half>[AaPp][Mm]))?"
_ZONE = r" ?(?P<short>[A-Za-z]{1,5})?(?P<off>[+-]\d{2}:?(?:\d{2})?)?(?:\[(?P<region>[A-Za-z]+(?:/[A-Za-z_+0-9-]+)*)\])?"
#: One pattern for each notation of the date; time, zone and offset are written alike in all.
PATTERNS = [re.compile(rf"{d}(?:[Tt ]|, )\s*{_TIME}{_ZONE}", re.ASCII) for d in _DATES]
EPOCH = re.compile(r"(\d{10})(?:\.(\d{1,9}))?|(\d{13})|(\d{16})|(\d{19})", re.ASCII)
DATE_ONLY = re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{8}", re.ASCII)
READ = "state string, order1 string, n1 int, us1 bigint, order2 string, n2 int, us2 bigint"


def _notations(text: str) -> tuple[int, ...]:
    """The notations worth trying, told by the characters in the first places."""
    if text[4:5] in ("-", "/") and text[:4].isdigit():
        return (0,)
    if text[:1].isdigit():
        head = text[1:3]
        return (1,) if "/" in head else (2,) if "." in head else (3,) if "-" in head or " " in head else (5,)
    return (3,) if text[3:4] == "," else (4,)


@functools.cache
def _zone(name: str, year: int) -> tuple[np.ndarray, np.ndarray, dict[str, int]] | None:
    """Clock changes of a zone around ``year``: instants, offsets from each on (microseconds), short names -> minutes."""
    try:
        z = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None

    def at(t: int) -> tuple[int, str]:
        x = dt.datetime.fromtimestamp(t, z)
        return int(x.utcoffset().total_seconds()), x.tzname()

    lo, hi = (int(dt.datetime(y, 1, 1, tzinfo=dt.UTC).timestamp()) for y in (year - 1, year + 2))
    starts, offsets, names = [lo], [at(lo)[0]], {}
    step = 7 * 86_400
    for t in range(lo, hi, step):
        off, short = at(t)
        if lo + 330 * 86_400 < t < hi - 330 * 86_400 and short[:1] not in "+-":
            names[short] = off // 60
        if off != offsets[-1]:
            a, b = t - step, t
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if at(mid)[0] == offsets[-1] else (a, mid)
            starts.append(b)
            offsets.append(off)
    return np.array(starts) * US, np.array(offsets) * US, names


def _local(us: np.ndarray, zone: str, year: int) -> tuple[np.ndarray, np.ndarray]:
    """For local times of one zone: how many instants each stands for (0, 1, 2) and the first of them."""
    starts, offsets, _ = _zone(zone, year)
    n, first = np.zeros(len(us), dtype=np.int32), np.zeros(len(us), dtype=np.int64)
    for o in np.unique(offsets)[::-1]:  # a larger offset is the earlier instant
        u = us - o
        hit = offsets[np.clip(np.searchsorted(starts, u, side="right") - 1, 0, None)] == o
        first = np.where(hit & (n == 0), u, first)
        n += hit
    return n, first


_EPOCH_DAY = dt.date(1970, 1, 1).toordinal()


def _day(y: int, m: int, d: int, wd: int | None = None) -> int | None:
    try:
        n = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    return n - _EPOCH_DAY if wd is None or (n - 1) % 7 == wd else None


def read_one(text: str | None, order: str | None, zone: str | None, year: int) -> tuple:
    """state, [(order, microseconds)], zone to apply or None: the microseconds are local where a zone is named."""
    if text is None:
        return "missing", [], None
    if (m := EPOCH.fullmatch(text)) is not None:
        sec, frac, ms, us, ns = m.groups()
        value = int(sec) * US + int(((frac or "") + "000000")[:6]) if sec else int(ms) * 1000 if ms else int(us) if us else int(ns) // 1000
        return "read", [("fixed", value)], None
    for k in _notations(text):
        if (m := PATTERNS[k].fullmatch(text)) is not None:
            break
    else:
        return ("dateonly" if DATE_ONLY.fullmatch(text) else "unreadable"), [], None
    g = m.group
    if k == 0:
        days = [("fixed", _day(int(g("y1")), int(g("m1")), int(g("d1"))))]
    elif k == 1:
        y, a, b = int(g("y2")), int(g("a")), int(g("b"))
        days = ([] if order == "mdy" else [("dmy", _day(y, b, a))]) + ([("mdy", _day(y, a, b))] if order in (None, "mdy") else [])
        if len(days) == 2 and days[0][1] == days[1][1]:
            days = days[:1]
    elif k == 2:
        days = [("fixed", _day(int(g("y3")), int(g("m3")), int(g("d3"))))]
    elif k == 3:
        wd = WEEKDAYS.get(g("wd").lower(), 9) if g("wd") else None
        days = [("fixed", _day(int(g("y4")), MONTHS.get(g("n4").lower(), 0), int(g("d4")), wd))]
    elif k == 4:
        days = [("fixed", _day(int(g("y5") or year), MONTHS.get(g("n5").lower(), 0), int(g("d5"))))]
    else:
        days = [("fixed", _day(int(g("y6")), int(g("m6")), int(g("d6"))))]
    h, mi, s = int(g("h") or g("h2")), int(g("mi") or g("mi2")), int(g("s") or g("s2") or 0)
    if half := g("half"):
        h = (h % 12 + 12 * (half in ("PM", "pm", "Pm", "pM"))) if 1 <= h <= 12 else 99
    days = [x for x in days if x[1] is not None]
    if not days or h > 23 or mi > 59 or s > 59:
        return "impossible", [], None
    tod = (h * 3600 + mi * 60 + s) * US + int(((g("fr") or "") + "000000")[:6])
    local = [(o, n * 86_400 * US + tod) for o, n in days]
    short, off = (g("short") or "").upper(), (g("off") or "").replace(":", "")
    if off:
        hours, minutes = int(off[1:3]), int(off[3:] or 0)
        if hours > 18 or minutes > 59 or short not in ("", "UTC", "GMT"):
            return "impossible", [], None
        minutes = (hours * 60 + minutes) * (-1 if off[0] == "-" else 1)
    elif short in ("Z", "UTC", "GMT"):
        minutes = 0
    elif short:
        known = zone and _zone(zone, year)
        if not known or short not in known[2]:
            return "zoneless", local, None
        minutes = known[2][short]
    else:
        zone = g("region") or zone
        return ("read", local, zone) if zone and _zone(zone, year) else ("zoneless", local, None)
    return "read", [(o, u - minutes * 60 * US) for o, u in local], None


def read_batch(texts: pd.Series, orders: pd.Series, zones: pd.Series, year: int) -> pd.DataFrame:
    """The columns of READ for a batch; clock changes are looked up for all its values of a zone at once."""
    none = lambda s: [None if x is None or x != x else x for x in s]
    missing = read_one(None, None, None, year)
    got = [missing if t is None else read_one(t, o, z, year) for t, o, z in zip(none(texts), none(orders), none(zones), strict=True)]
    out = {"state": [x[0] for x in got]}
    for i in (0, 1):
        there = [len(x[1]) > i for x in got]
        us = np.array([x[1][i][1] if y else 0 for x, y in zip(got, there, strict=True)], dtype=np.int64)
        n = np.array([int(y and x[0] == "read") for x, y in zip(got, there, strict=True)], dtype=np.int32)
        where: dict[str, list[int]] = {}
        for k, x in enumerate(got):
            if there[k] and x[2]:
                where.setdefault(x[2], []).append(k)
        for zone, ks in where.items():
            n[ks], us[ks] = _local(us[ks], zone, year)
        out |= {f"order{i + 1}": [x[1][i][0] if y else None for x, y in zip(got, there, strict=True)], f"n{i + 1}": n, f"us{i + 1}": us}
    return pd.DataFrame(out)


def zone_table(zones: DataFrame) -> DataFrame:
    """Columns z_source, z_zone, z_order, z_plain, one row for each source.

    ``zones`` needs agent_name, zone_name, date_order.  A null name is no source; a source listed twice counts
    with its first zone by name; an order that isn't known counts as none.  z_plain: the zone is one that Spark's
    own functions know under the same name.
    """
    known = set(zones.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())

    @F.pandas_udf("boolean")
    def plain(names: pd.Series) -> pd.Series:
        return names.map(lambda x: isinstance(x, str) and x in known and _zone(x, 2025) is not None)

    one = zones.where(F.col("agent_name").isNotNull()).groupBy("agent_name").agg(F.min(F.struct("zone_name", "date_order")).alias("z"))
    order = F.lower("z.date_order")
    return one.select(F.col("agent_name").alias("z_source"), F.col("z.zone_name").alias("z_zone"), F.when(order.isin("dmy", "mdy", "ymd"), order).alias("z_order"), plain("z.zone_name").alias("z_plain"))


_ISO = r"^\d{4}([-/])\d{2}\1\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:[Zz]|[+-]\d{2}(?::?\d{2})?)?$"
_NUMBER = r"^(?:\d{10}(?:\.\d{1,9})?|\d{13}|\d{16})$"
#: Minutes that clocks are set back by, all that occur in the zone database for this century.
SETBACKS = (20, 30, 60, 120, 180)


def _digits(df: DataFrame) -> DataFrame:
    """Adds r, the reading (READ) of the text ``t`` if it is an ISO 8601 time or an epoch number, else null."""
    whole = lambda c: F.try_to_number(c, F.lit("9999999999999999")).cast("bigint")
    two = lambda at: F.substring("t", at, 2).try_cast("int")
    micros = lambda c: F.coalesce(F.rpad(F.substring(c, 1, 6), 6, "0").try_cast("int"), F.lit(0))
    size = F.length(F.substring_index("t", ".", 1))
    matches = lambda pattern: F.coalesce(F.col("t").rlike(pattern), F.lit(False))
    df = settle(df, iso=matches(_ISO), number=matches(_NUMBER))
    tail = F.substring("t", 20, 20)
    df = settle(
        df,
        day=F.when(F.col("iso"), F.unix_date(F.translate(F.substring("t", 1, 10), "/", "-").try_cast("date"))),
        part=F.when(F.col("iso"), F.regexp_extract(tail, r"^[.,](\d+)", 1)),
        off=F.when(F.col("iso"), F.regexp_replace(tail, r"^[.,]\d+", "")),
        count=F.when(F.col("number"), whole(F.substring_index("t", ".", 1)) * F.when(size == 10, US).when(size == 13, 1000).otherwise(1) + F.when(F.contains("t", F.lit(".")), micros(F.substring_index("t", ".", -1))).otherwise(0)),
    )
    minutes = (F.substring("off", 2, 2).try_cast("int") * 60 + F.coalesce(F.substring("off", -2, 2).try_cast("int"), F.lit(0)) * F.when(F.length("off") > 3, 1).otherwise(0)) * F.when(F.col("off").startswith("-"), -1).otherwise(1)
    fits = F.col("day").isNotNull() & (two(12) <= 23) & (two(15) <= 59) & (two(18) <= 59)
    signed = F.length("off") > 1
    fits = fits & (~signed | ((F.substring("off", 2, 2).try_cast("int") <= 18) & ((F.length("off") <= 3) | (F.substring("off", -2, 2).try_cast("int") <= 59))))
    df = settle(
        df,
        fits=F.when(F.col("iso"), fits),
        local=F.when(F.col("iso") & fits, F.col("day").cast("bigint") * (86_400 * US) + (two(12) * 3600 + two(15) * 60 + two(18)).cast("bigint") * US + micros("part")),
        minutes=F.when(F.col("off") == "", None).otherwise(F.when(signed, minutes).otherwise(0)),
    )
    stamp = F.timestamp_micros("local")
    shown = lambda c: F.unix_micros(F.from_utc_timestamp(c, F.col("z_zone")))
    df = settle(df, utc=F.when(F.col("local").isNotNull() & F.col("minutes").isNull() & F.col("z_plain"), F.to_utc_timestamp(stamp, F.col("z_zone"))))
    again = functools.reduce(Column.__or__, (shown(F.timestamp_micros(F.unix_micros("utc") + m * 60 * US)) == F.col("local") for m in SETBACKS))
    times = F.when(shown(F.col("utc")) != F.col("local"), 0).when(again, 2).otherwise(1)
    reading = lambda state, n, us: F.struct(F.lit(state).alias("state"), (F.lit("fixed") if us is not None else F.lit(None).cast("string")).alias("order1"), n.cast("int").alias("n1"), F.coalesce(us if us is not None else F.lit(0), F.lit(0)).cast("bigint").alias("us1"), F.lit(None).cast("string").alias("order2"), F.lit(0).alias("n2"), F.lit(0).cast("bigint").alias("us2"))
    local = F.col("local")
    return settle(
        df,
        r=F.when(F.col("number"), reading("read", F.lit(1), F.col("count")))
        .when(~F.col("iso"), None)
        .when(~F.col("fits"), reading("impossible", F.lit(0), None))
        .when(F.col("minutes").isNotNull(), reading("read", F.lit(1), local - F.col("minutes").cast("bigint") * (60 * US)))
        .when(F.col("utc").isNotNull(), reading("read", times, F.when(times == 0, 0).otherwise(F.unix_micros("utc"))))
        .when(F.col("z_zone").isNull(), reading("zoneless", F.lit(0), local)),
    ).drop("iso", "number", "day", "part", "off", "count", "fits", "local", "minutes", "utc")


def read(df: DataFrame, value: str, source: str, zones: DataFrame, year: int = 2025) -> DataFrame:
    """``df`` with z_order and the struct i (READ): every reading of ``value`` that text and declared zone allow.

    The list of sources is joined without hint: Spark broadcasts it where its size allows.
    """

    @F.pandas_udf(READ)
    def parse(text: pd.Series, order: pd.Series, zone: pd.Series) -> pd.DataFrame:
        return read_batch(text, order, zone, year)

    had = df.columns
    df = df.select(*(F.col(c).alias(f"kept_{i}") for i, c in enumerate(had)), F.col(value).alias("v"), F.col(source).alias("s"))
    df = df.join(zones, F.col("s") == F.col("z_source"), "left")
    df = _digits(settle(df, t=strip_blanks(F.col("v"))))
    rest = F.when(F.col("r").isNull(), F.col("t"))
    return df.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(had)), "z_order", F.coalesce("r", parse(rest, F.when(rest.isNotNull(), F.col("z_order")), F.when(rest.isNotNull(), F.col("z_zone")))).alias("i"))


def sole_instant(df: DataFrame, value: str, source: str, zones: DataFrame, out: str, year: int = 2025) -> DataFrame:
    """Adds ``out``: the microseconds since 1970 UTC of the one instant in ``year`` that the value stands for, else null.

    What text and declared zone settle on their own, without the mixture: equal to the rows of
    :func:`normalise` with status ``exact``.
    """
    had = df.columns
    df = read(df, value, source, zones, year)
    one = F.when((F.col("i.state") == "read") & (F.col("i.n1") == 1) & F.col("i.order2").isNull(), F.col("i.us1"))
    return df.select(*had, _within(one, year).alias(out))


def _within(us: Column, year: int) -> Column:
    lo, hi = (int(dt.datetime(y, 1, 1, tzinfo=dt.UTC).timestamp()) * US for y in (year, year + 1))
    return F.when((us >= lo) & (us < hi), us)


#: Notations of dates; a value in digits with slashes may be in either of the first two.
NOTATIONS = ("dmy", "mdy", "ymd", "dotted", "named", "month", "compact", "number")
SOURCES = 10_000  # mixtures of sources that are broadcast; more are joined by source


def notation_signatures(df: DataFrame, value: str, source: str) -> DataFrame:
    """i_source, notations, n: for each source how many of its values are valid dates in which notations.

    The first six characters tell the notation, and whether the ninth is a digit: values are counted by these (a few
    thousand for a source, combined on the map side) before any of them is looked at.
    """
    first = F.substring("v", 1, 1)
    plain = F.when((first > " ") & (first < "\x7f"), F.col("v")).otherwise(F.ltrim(F.col("v"), F.lit(BLANKS)))
    heads = df.select(F.col(source).alias("i_source"), F.col(value).alias("v")).where("v is not null").select("i_source", plain.alias("v"))
    counts = heads.groupBy("i_source", F.substring("v", 1, 6).alias("head"), F.substring("v", 9, 1).between("0", "9").alias("long")).agg(F.count("*").alias("n"))
    shape = F.translate("head", "0123456789", "0000000000")
    begins = lambda *starts: functools.reduce(Column.__or__, (shape.startswith(x) for x in starts))
    day = lambda n: F.when(begins("0/", "00/"), F.substring_index(F.substring_index("head", "/", n), "/", -1).try_cast("int"))
    counts = settle(counts, a=day(1), b=day(2))
    dmy = F.col("a").between(1, 31) & F.col("b").between(1, 12)
    mdy = F.col("b").between(1, 31) & F.col("a").between(1, 12)
    notations = (
        F.when(F.col("a").isNotNull(), F.array_compact(F.array(F.when(dmy, "dmy"), F.when(mdy, "mdy"))))
        .when(begins("0000-", "0000/"), F.array(F.lit("ymd")))
        .when(begins("000000"), F.array(F.when(F.col("long"), "number").otherwise("compact")))
        .when(begins("0.", "00."), F.array(F.lit("dotted")))
        .when(begins("0-", "00-", "0 ", "00 ") | (F.substring(shape, 4, 1) == ","), F.array(F.lit("named")))
        .when(F.upper(F.substring(shape, 1, 1)).between("A", "Z"), F.array(F.lit("month")))
    )
    return counts.groupBy("i_source", notations.alias("notations")).agg(F.sum("n").alias("n")).where(F.size("notations") > 0)


def fit_notations(counts: DataFrame, iterations: int = 50, prior: float = 0.5) -> DataFrame:
    """EM over the notations of each source.

    ``counts``: i_source, notations (those in which a value is valid), n.  A source has a few rows here (the
    sets of notations), however many values it has, so a group is small.  Returns i_source and w_ with each of
    NOTATIONS, the mixture weights; ``prior`` is the pseudo-count of each notation.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        valid = np.array([[o in set(x) for o in NOTATIONS] for x in pdf["notations"]], dtype=float)
        n, w = pdf["n"].to_numpy(dtype=float), np.full(len(NOTATIONS), 1 / len(NOTATIONS))
        for _ in range(iterations):
            r = valid * w
            r /= r.sum(1, keepdims=True)
            new = (r * n[:, None]).sum(0) + prior
            new /= new.sum()
            if np.abs(new - w).max() < 1e-12:
                break
            w = new
        return pd.DataFrame({"i_source": [pdf["i_source"].iloc[0]]} | {f"w_{o}": [x] for o, x in zip(NOTATIONS, w, strict=True)})

    return counts.groupBy("i_source").applyInPandas(fit, "i_source string, " + ", ".join(f"w_{o} double" for o in NOTATIONS))


def normalise(df: DataFrame, value: str, source: str, zones: DataFrame, year: int = 2025, least: float = 0.95) -> DataFrame:
    """``df`` with utc_us, status, confidence, order: the chosen instant of ``value``.

    Each valid reading has its source's weight of its notation as prior, and the posterior chooses; a declared order
    leaves one reading.  A posterior below ``least`` is marked.  The mixtures (one row for each source) meet the rows by a
    broadcast if they are few, else by source.  Null values give ``missing``, empty texts ``unreadable``; a null source
    is a source without zone.  Columns of ``df`` named like those added are refused.
    """
    had = df.columns
    if clash := [c for c in had if c in ("i", "z_order", "utc_us", "status", "confidence", "order", "w_source", "w_dmy", "w_mdy")]:
        raise ValueError(f"rename the columns {clash}")
    w = materialise(fit_notations(notation_signatures(df, value, source)).select(F.col("i_source").alias("w_source"), "w_dmy", "w_mdy"))
    few = w.limit(SOURCES + 1).count() <= SOURCES
    both = read(df, value, source, zones, year).join(F.broadcast(w) if few else w, F.col(source).eqNullSafe(F.col("w_source")), "left")
    several = F.col("i.order2").isNotNull()
    mdy = several & (F.coalesce("w_mdy", F.lit(0.5)) > F.coalesce("w_dmy", F.lit(0.5)))
    share = F.greatest("w_dmy", "w_mdy") / (F.col("w_dmy") + F.col("w_mdy"))
    sure = F.when(several, F.coalesce(share, F.lit(0.5))).otherwise(1.0)
    n, us = F.when(mdy, F.col("i.n2")).otherwise(F.col("i.n1")), F.when(mdy, F.col("i.us2")).otherwise(F.col("i.us1"))
    status = (
        F.when(F.col("i.state") != "read", F.col("i.state"))
        .when(n == 0, "skipped")
        .when((n > 1) | (sure < least), "ambiguous")
        .otherwise(F.when(several, "inferred").otherwise("exact"))
    )
    chosen = F.when(status.isin("exact", "inferred"), us)
    return both.select(*had, _within(chosen, year).alias("utc_us"), status.alias("status"), sure.alias("confidence"), F.when(mdy, F.col("i.order2")).otherwise(F.col("i.order1")).alias("order"))
