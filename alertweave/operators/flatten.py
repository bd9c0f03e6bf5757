"""Projection of nested alerts and collection of their entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions import normalize as N

#: Where raw alerts name users, addresses and hosts, by dialect.
ENTITY_PATHS = {
    "strict": {
        "user": (
            "data.office365.UserId", "data.office365.MailboxOwnerUPN", "data.office365.UserKey", "data.office365.userPrincipalName", "data.vc_user",
            "data.agentDetectionInfo.agentLastLoggedInUserName", "data.userEmail", "data.source_user", "data.destination_user", "data.srcuser", "data.dstuser",
            "data.win.eventdata.targetUserName", "data.win.eventdata.subjectUserName", "data.win.eventdata.samAccountName",
        ),
        "ip": (
            "data.source_address", "data.destination_address", "data.nat_source_ip", "data.nat_destination_ip", "data.srcip", "data.dstip", "data.srcip2",
            "data.office365.ClientIP", "data.office365.ClientIPAddress", "data.office365.ActorIpAddress", "data.agentDetectionInfo.agentIpV4", "data.win.eventdata.ipAddress",
        ),
        "host": ("data.computerName", "data.agentRealtimeInfo.agentComputerName", "data.device_name", "predecoder.hostname", "data.win.system.computer"),
    },
    "simple": {
        "user": (
            "data.office365.UserId", "data.office365.MailboxOwnerUPN", "data.vc_user", "data.userEmail", "data.srcuser", "data.dstuser", "data.source_user", "data.destination_user",
            "data.agentDetectionInfo.agentLastLoggedInUserName",
        ),
        "ip": (
            "data.source_address", "data.destination_address", "data.srcip", "data.dstip", "data.srcip2", "data.office365.ClientIP", "data.office365.ClientIPAddress",
            "data.office365.ActorIpAddress", "data.agentDetectionInfo.agentIpV4", "data.win.eventdata.ipAddress",
        ),
        "host": ("data.computerName", "data.agentRealtimeInfo.agentComputerName", "data.device_name", "predecoder.hostname"),
    },
}


def path(json: Column, name: str) -> Column:
    """Null-safe access to a.b.c of a JSON text; lists and objects come as JSON."""
    return F.get_json_object(json, f"$.{name}")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def joined(c: Column) -> Column:
    """Array to comma text; null is empty."""
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",")


def safe_items(c: Column) -> Column:
    """Entries that are neither null nor empty; a null array is empty."""
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def flattened(json: Column) -> Column:
    """map<string,string> of the scalars below ``data`` down to three levels, named data.a.b.c.

    A list of texts right below ``data`` is joined by commas, another filled list there stays JSON, an empty one is
    null; lists deeper down are left out.
    """
    as_map = lambda c: F.from_json(c, "map<string,string>")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    is_object, is_list = (lambda v: F.ltrim(v).startswith("{")), (lambda v: F.ltrim(v).startswith("["))

    def level(prefix: Column, text: Column, depth: int) -> Column:
        def one(e: Column) -> Column:
            name, v = F.concat(prefix, F.lit("."), e["key"]), e["value"]
            texts = F.from_json(v, "array<string>")
            plain = ~v.rlike(r"^\[\s*(?:[^\"\s]|.*,\s*[^\"\s])")
            as_list = F.when(F.size(texts) == 0, F.lit(None).cast("string")).when(plain, F.array_join(texts, ",")).otherwise(v)
            scalar = F.array(entry(name, F.when(is_list(v), as_list).otherwise(v)))
            none = F.filter(scalar, lambda _: F.lit(False))
            if depth > 1:
                scalar = F.when(is_list(v), none).otherwise(scalar)
            return F.when(is_object(v), level(name, v, depth + 1) if depth < 3 else none).otherwise(scalar)

        return F.flatten(F.transform(F.coalesce(F.map_entries(as_map(text)), F.array().cast("array<struct<key:string,value:string>>")), one))

    return F.map_from_entries(level(F.lit("data"), F.get_json_object(json, "$.data"), 1))


def extracted(json: Column, dialect: str = "strict") -> dict[str, Column]:
    """users, ips, hosts: sorted distinct canonical entities of a raw alert, with the addresses in its description.

    Both dialects give entities with their kind in front.
    """
    norm = {"user": lambda c: N.norm_user(c, dialect), "ip": lambda c: N.norm_ip(c, dialect), "host": lambda c: N.norm_host(c, dialect)}
    named = lambda kind: lambda x: F.concat(F.lit(f"{kind}:"), x)
    out = {}
    for kind, paths in ENTITY_PATHS[dialect].items():
        got = F.transform(F.array(*(path(json, p) for p in paths)), norm[kind])
        if kind == "ip":
            text = path(json, "data.description")
            got = F.concat(got, F.coalesce(N.ips_after_at(text) if dialect == "strict" else F.array(N.norm_ip(N.ip_after_at(text), dialect)), F.array().cast("array<string>")))
        got = F.filter(got, lambda x: x.isNotNull())
        if dialect == "simple":
            got = F.transform(got, named(kind))
        got = F.array_sort(F.array_distinct(got))
        out[f"{kind}s"] = got
    return out


def first_entity(c: Column) -> Column:
    """The smallest entity, the primary one of its kind."""
    return F.array_min(c)


def documents_json(df: DataFrame) -> DataFrame:
    """Adds doc, the row as JSON: nulls and NaN left out, timestamps in ISO form."""
    clean = [F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema]
    return df.withColumn("doc", F.to_json(F.struct(*clean), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}))


def overridden(df: DataFrame, values: Mapping[str, object], ident: Sequence[str] = ()) -> DataFrame:
    """``df`` with constant columns set, and a replay id from the named key columns."""
    out = df.withColumns({k: F.lit(v) for k, v in values.items()})
    return out.withColumn("replay_id", F.concat(F.lit("replay-"), F.substring(F.sha2(F.concat_ws("|", *ident), 256), 1, 16))) if ident else out
