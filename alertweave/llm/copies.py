"""Duplicates hidden by formatting: canonical keys, exact hot keys, salted two-level aggregation.

A record's canonical key is a 128-bit hash of its canonical fields, computed once.  Keys with many rows ("hot") are
found exactly from partial counts; their rows are salted and aggregated in two levels, all other keys take one
shuffle.  What comes out is one compact state for each key, its smallest identifier and its number of rows; no list
of members is ever built, and rows meet their key's state through a join that moves no row of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions.arrays import plain_entries
from alertweave.operators.instants import sole_instant
from alertweave.operators.skew import hot_rows, join_states
from alertweave.session import materialise

#: The eight fields that a line names.
LINE_FIELDS = ("rule_id", "decoder", "description", "src", "dst", "entity_users", "count", "first_seen")
SALTS = 64
KEY = ["k1", "k2"]


def bare(c: Column) -> Column:
    """Letters and digits, case ignored; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def bare_entries(c: Column) -> Column:
    """The entries' letters and digits, sorted, as often as they occur; null and empty ones count as nothing."""
    return F.array_sort(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), bare), lambda x: x != ""))


def canonical_address(c: Column) -> Column:
    """One spelling for each IPv4 or IPv6 address: no zeros in front, ``::`` written out, IPv4-mapped as IPv4."""
    x = F.regexp_replace(F.lower(c), r"^(?:0*:){2,7}ffff:(?=\d+\.)", "")
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(x, "::", 1)), groups(F.substring_index(x, "::", -1))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    whole = F.when(F.contains(x, F.lit("::")), F.concat(left, zeros, right)).otherwise(groups(x))
    short = lambda a: F.transform(a, lambda g: F.regexp_replace(g, r"^0+(?=.)", ""))
    return F.when(F.contains(x, F.lit(":")), F.array_join(short(whole), ":")).otherwise(F.array_join(short(F.split(x, r"\.")), "."))


def key_columns(fields: Sequence[Column]) -> list[Column]:
    """128 bits of the fields: two 64-bit hashes from different starts."""
    return [F.xxhash64(*fields).alias("k1"), F.xxhash64(F.lit("second"), *fields).alias("k2")]


def alert_keys(alerts: DataFrame) -> DataFrame:
    """rec_id, k1, k2, first_seen, agent_name of the rows with at least one user."""
    users = bare_entries(F.col("entity_users"))
    stored = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("decoder_name", "rule_id", "count", "first_seen", "last_seen")]
    lists = [F.array_sort(plain_entries(F.col(c))) for c in ("entity_ips", "entity_hosts")]
    return alerts.where(F.size(users) > 0).select(
        F.col("row_id").alias("rec_id"), *key_columns([*stored, *lists, bare(F.col("rule_description")), users]), "first_seen", "agent_name"
    )


def line_fields(lines: DataFrame) -> DataFrame:
    """line_id and the eight fields of each line as text (null where a line doesn't name one).

    A field's value reaches from its name to the next name, whatever the layout; JSON's escapes of white
    space are white space.
    """
    names = "|".join(LINE_FIELDS)
    text = F.regexp_replace("line_text", r"\\(?:[tnrbf]|u00[01a][0-9a-fA-F]|u20[02][0-9a-fA-F])", " ")
    marked = F.regexp_replace(text, rf"(?i)(?:^|[^A-Za-z0-9_])({names})[\"']?\s*[:=]", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    df = lines.select("line_id", parts.alias("parts"))
    of = lambda name: F.get(F.filter("parts", lambda p: F.lower(F.substring_index(p, "\u0002", 1)) == name), F.lit(0))
    return df.select("line_id", *(F.substring_index(of(n), "\u0002", -1).alias(n) for n in LINE_FIELDS))


def line_keys(lines: DataFrame) -> DataFrame:
    """rec_id, k1, k2 of the lines that name all eight fields."""
    f = line_fields(lines)
    for n in LINE_FIELDS:
        f = f.where(F.col(n).isNotNull())
    address = lambda c: canonical_address(F.regexp_extract(c, r"[0-9A-Fa-f:.]{2,}", 0))
    fields = [address("src"), address("dst"), F.regexp_replace("count", r"[^0-9]", ""), *(bare(F.col(c)) for c in ("rule_id", "decoder", "description", "first_seen")), bare_entries(F.split("entity_users", ","))]
    return f.select(F.col("line_id").alias("rec_id"), *key_columns(fields))


def group_states(keyed: DataFrame, total: int, least_hot: int = 10_000, salts: int = SALTS) -> DataFrame:
    """k1, k2, group_id, n_copies: one row for each key of ``keyed`` (rec_id, k1, k2, ...); null ids are ignored.

    ``total``: an upper bound of the rows; a key is hot from ``max(least_hot, total / 1000)`` rows on, so there are at
    most 1000 hot keys, and only they are broadcast.
    """
    keyed = keyed.where(F.col("rec_id").isNotNull())
    state = [F.min("rec_id").alias("group_id"), F.count("*").alias("n_copies")]
    hot = materialise(keyed.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= hot_rows(total, least_hot)).select(*KEY))
    if hot.isEmpty():
        return keyed.groupBy(*KEY).agg(*state)
    cold = keyed.join(F.broadcast(hot), KEY, "left_anti").groupBy(*KEY).agg(*state)
    salted = keyed.join(F.broadcast(hot), KEY).groupBy(*KEY, F.pmod(F.xxhash64("rec_id"), F.lit(salts)).alias("salt")).agg(*state)
    return cold.unionByName(salted.groupBy(*KEY).agg(F.min("group_id").alias("group_id"), F.sum("n_copies").alias("n_copies")))


def copy_groups(keyed: DataFrame, total: int, least_hot: int = 10_000) -> DataFrame:
    """The rows of ``keyed`` whose key has at least two rows, with group_id and n_copies; an empty input gives none."""
    states = materialise(group_states(keyed, total, least_hot).where(F.col("n_copies") > 1))
    return join_states(keyed.where(F.col("rec_id").isNotNull()), states, KEY, "n_copies", total, least_hot)


def timed_alerts(alerts: DataFrame, zones: DataFrame) -> DataFrame:
    """rec_id, k1, k2 of the alert rows that can have copies: with a user and a first_seen that stands for one instant."""
    return materialise(sole_instant(alert_keys(alerts), "first_seen", "agent_name", zones, "us").where(F.col("us").isNotNull()).select("rec_id", *KEY))


def alert_copies(alerts: DataFrame, zones: DataFrame) -> DataFrame:
    """group_id, rec_id, n_copies of alert rows with copies: rows with a user and a first_seen that stands for one instant.

    Keys are grouped before timestamps are read, so only rows with a copy are parsed.
    """
    total = alerts.count()
    near = copy_groups(materialise(alert_keys(alerts)), total).drop("group_id", "n_copies")
    sure = materialise(sole_instant(near, "first_seen", "agent_name", zones, "us").where(F.col("us").isNotNull()).select("rec_id", *KEY))
    return copy_groups(sure, total).select("group_id", "rec_id", "n_copies")


def line_copies(lines: DataFrame) -> DataFrame:
    """group_id, rec_id, n_copies of lines with copies."""
    return copy_groups(materialise(line_keys(lines)), lines.count()).select("group_id", "rec_id", "n_copies")


def collapsed_alerts(alerts: DataFrame, zones: DataFrame) -> DataFrame:
    """rec_id (the smallest of its copies) and n_copies: one row for each distinct record of the alert rows that can have copies."""
    total = alerts.count()
    return group_states(timed_alerts(alerts, zones), total).select(F.col("group_id").alias("rec_id"), "n_copies")


def collapsed_lines(lines: DataFrame) -> DataFrame:
    """The same of the lines that name all eight fields."""
    return group_states(materialise(line_keys(lines)), lines.count()).select(F.col("group_id").alias("rec_id"), "n_copies")
