"""Dimensions of identities: addresses and hosts, aliases of users, stable pseudonyms."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions import normalize as N
from alertweave.operators.skew import join_states
from alertweave.session import materialise

#: The form of an alias, and the marks of a key's source.
ALIAS = r"^user_[0-9]{4,}_anonymized$"
KEY_MARKS = ("o365", "ad", "azure", "vcenter", "vc", "win", "windows", "email", "upn")


def single_pairs(rows: DataFrame, decoder: str | None = None) -> DataFrame:
    """ip, host of the rows that name exactly one of each; ``decoder``: only decoders with that part."""
    p = (F.size("ips") == 1) & (F.size("hosts") == 1)
    if decoder:
        p &= F.contains(F.lower("decoder_name"), F.lit(decoder.lower()))
    return rows.where(p).select(F.get("ips", F.lit(0)).alias("ip"), F.get("hosts", F.lit(0)).alias("host"))


def asset_map(pairs: DataFrame) -> DataFrame:
    """ip, host, source: the first host of each address by (priority, seq) of ``pairs`` (ip, host, source, priority, seq)."""
    return pairs.where("ip is not null and host is not null").groupBy("ip").agg(F.min_by(F.struct("host", "source"), F.struct("priority", "seq", "host")).alias("x")).select("ip", "x.host", "x.source")


def asset_stats(amap: DataFrame) -> DataFrame:
    return amap.agg(F.count("*").alias("n_ips"), F.count_distinct("host").alias("n_hosts"), F.count_distinct("source").alias("n_sources"))


def alias_groups(named: DataFrame, key: str, variant: str) -> DataFrame:
    """variant, canonical: names of one key (two or more), led by the first with a dot, else the smallest."""
    clean = named.select(F.col(key).alias("k"), N.clean_user(F.col(variant)).alias("variant")).where("variant is not null").distinct()
    dotted = F.min(F.when(F.contains("variant", F.lit(".")), F.col("variant")))
    heads = clean.groupBy("k").agg(F.coalesce(dotted, F.min("variant")).alias("canonical"), F.count("*").alias("n")).where("n >= 2")
    return clean.join(heads, "k").groupBy("variant").agg(F.max_by("canonical", "k").alias("canonical"))  # a later group wins


def key_root(c: Column) -> Column:
    """A scenario key without the mark of its source."""
    return F.regexp_replace(c, f"_(?:{'|'.join(KEY_MARKS)})$", "")


def paired_keys(keys: DataFrame) -> DataFrame:
    """ip, host of one document: the host whose key ends in the same digits (first in order), else the only pair.

    ``keys``: doc, kind (ip, host), key, pos, value.
    """
    digits = F.regexp_extract("key", r"(\d+)$", 1)
    side = lambda kind: keys.where(F.col("kind") == kind).select("doc", digits.alias("digits"), F.col("pos").alias(f"{kind}_pos"), F.col("value").alias(kind))
    hosts, ips = side("host"), side("ip")
    by_digits = hosts.where("digits <> ''").join(ips.where("digits <> ''"), ["doc", "digits"])
    first = by_digits.groupBy("doc", "host_pos", "host").agg(F.min_by("ip", "ip_pos").alias("ip")).select("doc", "host", "ip")
    sole = lambda df, kind: df.groupBy("doc").agg(F.count("*").alias("n"), F.first(kind).alias(kind)).where("n = 1").drop("n")
    only = sole(hosts, "host").join(sole(ips, "ip"), "doc").join(first.select("doc").distinct(), "doc", "left_anti").select("doc", "host", "ip")
    return first.unionByName(only)


def resolve(entities: DataFrame, amap: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """entity, resolved: an address or known host becomes asset:HOST, a user its canonical name, else unchanged.

    ``entities`` holds one row for each distinct entity; dimensions are joined by key and broadcast only where Spark
    knows them small.
    """
    ips = amap.select(F.concat(F.lit("ip:"), "ip").alias("entity"), F.concat(F.lit("asset:"), "host").alias("to"))
    hosts = amap.select(F.concat(F.lit("host:"), "host").alias("entity"), F.concat(F.lit("asset:"), "host").alias("to")).distinct()
    known = ips.unionByName(hosts)
    if aliases is not None:
        known = known.unionByName(aliases.select(F.concat(F.lit("user:"), "variant").alias("entity"), F.concat(F.lit("user:"), "canonical").alias("to")))
    return entities.join(known, "entity", "left").select("entity", F.coalesce("to", "entity").alias("resolved"))


def assign_aliases(users: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """canonical, id, alias: a bijection of users to user_NNNN_anonymized, extending ``known`` (canonical, id).

    ``users``: canonical, first_us.  New ids follow the largest known one in order of (first_us, canonical); values that
    are aliases already stay out.  Ids are counted over range partitions: each partition numbers its rows and starts
    after those before it, so no task sorts all users.
    """
    fresh = users.where(F.col("canonical").isNotNull() & ~F.col("canonical").rlike(ALIAS)).groupBy("canonical").agg(F.min("first_us").alias("first_us"))
    start = 0
    if known is not None:
        fresh = fresh.join(known.select("canonical"), "canonical", "left_anti")
        start = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    parts = fresh.repartitionByRange("first_us", "canonical").withColumn("part", F.spark_partition_id())
    inside = parts.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("first_us", "canonical")))
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # one row for each partition
    new = inside.join(F.broadcast(counts), "part").select("canonical", (F.col("rn") + F.coalesce("before", F.lit(0)) + start).cast("bigint").alias("id"))
    all_ids = new if known is None else known.select("canonical", "id").unionByName(new)
    return all_ids.withColumn("alias", F.format_string("user_%04d_anonymized", "id"))


def pseudonymise(rows: DataFrame, column: str, aliases: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``column`` replaced by its alias; aliases and unknown values stay; hot users don't shuffle."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column)).agg(F.count("*").alias("n_rows_"))
    states = counts.join(aliases.select(F.col("canonical").alias(column), F.col("alias").alias("alias_")), column, "left")
    named = join_states(rows.where(F.col(column).isNotNull()), states, [column], "n_rows_", total)
    named = named.withColumn(column, F.coalesce("alias_", column)).select(*rows.columns)
    return named.unionByName(rows.where(F.col(column).isNull()))


def lookup(values: DataFrame, column: str, aliases: DataFrame, reverse: bool = False) -> DataFrame:
    """``values`` with found: the alias of a canonical name, or with ``reverse`` the name of an alias; null where unknown.  Nothing is registered."""
    of, to = ("alias", "canonical") if reverse else ("canonical", "alias")
    return values.join(aliases.select(F.col(of).alias(column), F.col(to).alias("found")), column, "left")


def bounced(users: DataFrame, column: str, aliases: DataFrame, canonical: DataFrame) -> DataFrame:
    """``users`` with ``column`` unified in the space of aliases: alias to name, name to its canonical one, and back to an alias.

    ``canonical``: variant, canonical.  What is no alias, or leads to a name without one, stays.
    """
    way = aliases.select(F.col("alias").alias(column), F.col("canonical").alias("variant")).join(canonical.withColumnRenamed("canonical", "head"), "variant", "left")
    way = way.withColumn("head", F.coalesce("head", "variant")).join(aliases.select(F.col("canonical").alias("head"), F.col("alias").alias("to")), "head", "left").select(column, "to")
    return users.join(way, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")


def built_map(*sources: tuple[str, DataFrame]) -> DataFrame:
    """ip, host, source from named tables of pairs (ip, host, seq), the first with the highest priority: cleaned, first host of an address wins."""
    each = [
        df.select(N.clean_ip(F.col("ip")).alias("ip"), N.clean_host(F.col("host")).alias("host"), F.lit(name).alias("source"), F.lit(i).alias("priority"), F.col("seq").cast("bigint").alias("seq"))
        for i, (name, df) in enumerate(sources)
    ]
    return asset_map(functools.reduce(DataFrame.unionByName, each))


def anonymise_documents(docs: DataFrame, key: str, c: str, aliases: DataFrame) -> DataFrame:
    """``docs`` (key, c) with the names in ``c`` replaced by their aliases, for any number of names.

    The text is cut once into words (letters, digits, dots, hyphens, underscores) and what is between; words meet
    the aliases (canonical, alias) by a join, and DOMAIN\\ in front or @domain behind goes with its name.  A name with
    white space in it isn't one word and stays.  Null texts stay null; repeated keys are kept apart by row.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), key, F.col(c).alias("text"))
    unit = r"(?U)(?:[\w.-]+\\)?[\w.-]*\w[\w.-]*(?:@[\w.-]*\w)?"
    words = F.regexp_extract_all("text", F.lit(unit), 0)
    between = F.split("text", unit, -1)
    cut = materialise(docs.select("row", key, "text", words.alias("words"), between.alias("between")))
    long = cut.select("row", F.posexplode("words").alias("i", "w"))
    bare = F.regexp_replace(F.regexp_replace("w", r"^.*\\", ""), r"@.*$", "")
    name = F.regexp_extract(bare, r"^[.-]*(.*?)[.-]*$", 1)
    known = aliases.select(F.lower("canonical").alias("name"), "alias").dropDuplicates(["name"])
    met = long.select("row", "i", "w", name.alias("shown")).withColumn("name", F.lower("shown")).join(known, "name")
    lead, tail = F.regexp_extract(bare, r"^([.-]*)", 1), F.when(F.contains("w", F.lit("@")), "").otherwise(F.regexp_extract(bare, r"([.-]*)$", 1))
    new = met.select("row", "i", F.concat(lead, "alias", tail).alias("to")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("i", "to"))).alias("m"))
    out = cut.join(new, "row", "left")
    told = F.transform("words", lambda w, i: F.coalesce(F.col("m")[i], w))
    text = F.array_join(F.flatten(F.transform(F.arrays_zip(F.col("between").alias("a"), told.alias("b")), lambda s: F.array(F.coalesce(s["a"], F.lit("")), F.coalesce(s["b"], F.lit(""))))), "")
    return out.select(key, F.when(F.col("m").isNull(), F.col("text")).otherwise(text).alias(c))


def anonymise_text(text: Column, names: list[tuple[str, str]]) -> Column:
    """Names in a text by their aliases: DOMAIN\\name, name@domain and the bare name, longest names first."""
    for name, alias in sorted(names, key=lambda x: (-len(x[0]), x[0])):
        q = r"\Q" + name + r"\E"
        for pattern in (rf"(?iU)[\w.-]+\\{q}(?![\w.-])", rf"(?iU)(?<![\w.-]){q}@[\w.-]*\w", rf"(?iU)(?<![\w.-]){q}(?![\w.-])"):
            text = F.regexp_replace(text, pattern, alias)
    return text
