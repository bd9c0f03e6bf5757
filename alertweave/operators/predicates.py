"""Named predicates; each says what a missing value does."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Infrastructure that never discriminates, and patterns of it.
INFRASTRUCTURE = (
    "host:pa-vm300-01", "host:pa-vm300-02", "asset:pa-vm300-01", "asset:pa-vm300-02", "host:wazuh-server", "host:wazuh-manager", "asset:wazuh-server",
    "ip:0.0.0.0", "ip:127.0.0.1", "ip:255.255.255.255", "ip:1.1.1.1", "ip:8.8.8.8", "user:system", "user:root", "user:anonymous", "user:guest", "user:-", "user:none",
    "ip:18.197.147.66", "ip:192.168.3.1",
)
INFRASTRUCTURE_PATTERNS = (r"^user:svc-", r"^user:lab\..*\.adm$", r"^host:dc\d+$", r"^ip:10\.253\.13\.")
#: Entities too general to match a scenario by.
GENERIC = (
    "pa-vm300-01", "pa-vm300-02", "host:pa-vm300-01", "host:pa-vm300-02", "wazuh-server", "wazuh-manager", "localhost", "0.0.0.0", "127.0.0.1", "::1", "255.255.255.255",
    "labcorp.com", "labcorp.local", "vsphere.local", "10.252.11.21", "10.252.11.47", "", "none", "null", "unknown", "-", "--", "n/a", "8.8.8.8", "1.1.1.1",
)


def search(ts: Column, since: object, until: object, level: Column, least: int, rule: Column, rules: Sequence[str], decoder: Column, decoders: Sequence[str], replay: Column | None = None) -> Column:
    """Remote query: both ends of the time included; a missing level fails ``least``, a missing rule passes."""
    p = ts.between(F.lit(since), F.lit(until))
    if rules:
        p &= ~F.coalesce(rule.isin(*rules), F.lit(False))
    if decoders:
        p &= ~F.coalesce(decoder.isin(*decoders), F.lit(False))
    if least > 0:
        p &= F.coalesce(level >= least, F.lit(False))
    return p if replay is None else p & F.coalesce(replay, F.lit(False))


def least_level(level: Column, least: int) -> Column:
    """File reader: a missing level stays."""
    return level.isNull() | (level >= least)


def sampled(level: Column, least: int, rule: Column, rules: Sequence[str], decoder: Column, decoders: Sequence[str]) -> Column:
    """Sampler: a missing level is 0, a missing decoder or rule is "?"."""
    p = F.coalesce(level, F.lit(0)) >= least
    if rules:
        p &= ~F.coalesce(rule, F.lit("?")).isin(*rules)
    return p & ~F.coalesce(decoder, F.lit("?")).isin(*decoders) if decoders else p


def is_infrastructure(entity: Column) -> Column:
    e = F.lower(F.coalesce(entity, F.lit("")))
    return (e == "") | e.isin(*INFRASTRUCTURE) | e.rlike("|".join(INFRASTRUCTURE_PATTERNS))


def is_discriminating(entity: Column) -> Column:
    e = F.lower(F.trim(F.coalesce(entity, F.lit(""))))
    return ~e.isin(*GENERIC) & ~e.rlike("^202[56]-")


def is_number(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


def is_noise(c: Column) -> Column:
    return c < 0


def hits(entities: Column, wanted: Column) -> Column:
    """Whether two arrays share an entry; null arrays share none."""
    return F.coalesce(F.arrays_overlap(entities, wanted), F.lit(False))


def phase(entities: Column, users: Sequence[str], addresses: Sequence[str]) -> Column:
    """A where an entity holds a user mark, B where it holds an address mark, A first, else null."""
    holds = lambda marks: F.exists(entities, lambda e: functools.reduce(Column.__or__, (F.contains(e, F.lit(m)) for m in marks), F.lit(False)))
    return F.when(holds(users), "A").when(holds(addresses), "B")


def mentions(c: Column, part: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))
