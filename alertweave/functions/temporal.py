"""Functions on time: buckets, gaps, decay, thresholds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DECAYS = ("none", "exponential", "gaussian", "linear", "power")


def parse_iso(c: Column) -> Column:
    """A timestamp, null for what isn't one."""
    return F.try_to_timestamp(c)


def bucket(ts: Column, seconds: int = 60) -> Column:
    """Number of the tumbling window; null falls into bucket 0."""
    return F.coalesce(F.floor(F.unix_seconds(ts) / seconds), F.lit(0)).cast("bigint")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1_000_000


def gap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Seconds between two intervals, 0 where they overlap; infinite where a bound is null."""
    known = lo1.isNotNull() & hi1.isNotNull() & lo2.isNotNull() & hi2.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), F.greatest(lo1, lo2) - F.least(hi1, hi2))).otherwise(F.lit(float("inf")))


def decay(dt: Column, kind: str = "exponential", tau: float | None = 300.0, cutoff: float | None = None) -> Column:
    """Weight of a gap: 1 at 0 falling with ``dt / tau``; beyond ``cutoff`` 0; without a positive ``tau`` 1 only at 0."""
    if kind not in DECAYS:
        raise ValueError(f"no decay named {kind}; there are {', '.join(DECAYS)}")
    if kind == "none":
        w = F.lit(1.0)
    elif not tau or tau <= 0:
        w = F.when(dt <= 0, 1.0).otherwise(0.0)
    else:
        x = dt / F.lit(float(tau))
        w = {"exponential": F.exp(-x), "gaussian": F.exp(-x * x), "linear": F.greatest(F.lit(0.0), 1 - x), "power": F.when(x == float("inf"), 0.0).otherwise(1 / (1 + x))}[kind]
    return w if cutoff is None else F.when(dt > cutoff, 0.0).otherwise(w)


def share_threshold(n: Column, share: float, least: int) -> Column:
    """``max(least, round(n * share))``, halves to the even number."""
    return F.greatest(F.lit(least), F.bround(n * share).cast("int"))


def spread(rank: Column, n: Column, start: Column, duration: float) -> Column:
    """Seconds of the rank-proportional place in ``duration``; rank counts from 1."""
    return start + F.lit(duration) * (rank - 1) / F.greatest(F.lit(1), n - 1)


def duration_seconds(first: Column, last: Column) -> Column:
    """Whole seconds between two instants, fractions cut off after the difference; 0 where one is null."""
    us = F.unix_micros(last) - F.unix_micros(first)
    return F.coalesce((us - F.when(us >= 0, F.pmod(us, F.lit(1_000_000))).otherwise(-F.pmod(-us, F.lit(1_000_000)))) / 1_000_000, F.lit(0)).cast("bigint")


def relative_time(text: str, now: Column | None = None) -> Column:
    """``now``, ``now-60m``, ``now+1d`` (s, m, h, d, w) as a timestamp; another text is read as ISO 8601."""
    m = re.fullmatch(r"now(?:([+-])(\d+)([smhdw]))?", text.strip())
    if m is None:
        return F.try_to_timestamp(F.lit(text))
    now = F.current_timestamp() if now is None else now
    if m[1] is None:
        return now
    seconds = int(m[2]) * {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}[m[3]] * (-1 if m[1] == "-" else 1)
    return F.timestamp_micros(F.unix_micros(now) + seconds * 1_000_000)
