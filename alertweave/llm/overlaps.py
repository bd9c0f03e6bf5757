"""Pairs of alert rows whose users, addresses and hosts overlap strongly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm import forest
from alertweave.operators.skew import join_states
from alertweave.session import materialise

ARRAYS = {"u": "entity_users", "i": "entity_ips", "h": "entity_hosts"}
CHUNK = 256
LARGE = 2_000  # copies of a class from which on they are linked to their representative instead of with each other


def rows_with_sets(alerts: DataFrame, least: int = 5) -> DataFrame:
    """row_id, toks of the rows that list at least ``least`` different entries."""
    return alerts.select("row_id", forest.tokens(alerts, ARRAYS).alias("toks")).where(F.size("toks") >= least)


def linked_classes(alerts: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (row_id, cid, n), classes (cid, n, toks), pairs (a, b, similarity) of rows with equal sets.

    cid is the smallest row_id of a class.
    """
    rows = materialise(rows_with_sets(alerts))
    classes = materialise(rows.groupBy("toks").agg(F.min("row_id").alias("cid"), F.count("*").alias("n")))
    pairs = forest.similar_classes(classes.select("cid", "toks"), threshold, 3)
    members = join_states(rows, classes, ["toks"], "n", alerts.count()).select("row_id", "cid", "n")
    return members, classes.select("cid", "n", "toks"), pairs


def all_pairs(alerts: DataFrame, threshold: float = 0.7, large: int | None = LARGE) -> DataFrame:
    """row_id_a < row_id_b, similarity: every pair of rows, copies included.

    Classes are expanded in chunks of about CHUNK rows, so no task meets more than a chunk of each side.  A class of
    more than ``large`` exact copies would have a quadratic number of pairs that say nothing new: each of its copies is
    paired with the representative (the smallest row_id), and the representative with the rows of similar classes, so no
    link between different sets is lost.  ``large=None`` expands every class.
    """
    members, classes, pairs = linked_classes(alerts, threshold)
    whole = F.lit(True) if large is None else F.col("n") <= large
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    shown = lambda df: df.withColumn("n", F.when(whole, F.col("n")).otherwise(1))
    inside = shown(members.where(whole | (F.col("row_id") == F.col("cid"))))
    parts = materialise(inside.withColumn("part", F.pmod(F.xxhash64("row_id"), chunks("n")).cast("int")))
    sizes = shown(classes.select("cid", "n"))
    both = (
        pairs.join(sizes.select(F.col("cid").alias("a"), F.col("n").alias("na")), "a")
        .join(sizes.select(F.col("cid").alias("b"), F.col("n").alias("nb")), "b")
        .select("a", "b", "similarity", "na", "nb")
    )
    within = sizes.where(F.col("n") > 1).select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("similarity"), F.col("n").alias("na"), F.col("n").alias("nb"))
    cut = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    met = both.unionByName(within).withColumn("pa", cut("na")).withColumn("pb", cut("nb")).drop("na", "nb")
    left = parts.select(F.col("cid").alias("a"), F.col("part").alias("pa"), F.col("row_id").alias("x"))
    right = parts.select(F.col("cid").alias("b"), F.col("part").alias("pb"), F.col("row_id").alias("y"))
    out = met.join(left, ["a", "pa"]).join(right, ["b", "pb"]).where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    star = members.where(~whole & (F.col("row_id") != F.col("cid"))).select(F.col("cid").alias("row_id_a"), F.col("row_id").alias("row_id_b"), F.lit(1.0).alias("similarity"))
    return out.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"), "similarity").unionByName(star)


def link_counts(alerts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """row_id, class_id, n_copies, n_links: one row for each row with a large set; links are counted, not expanded.

    n_links counts the other rows that the row is similar to, copies included.
    """
    members, classes, pairs = linked_classes(alerts, threshold)
    sizes = classes.select("cid", "n")
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("cid")), F.struct(F.col("b").alias("me"), F.col("a").alias("cid")))))
    linked = ends.join(sizes, "cid").groupBy("me").agg(F.sum("n").alias("others"))
    states = sizes.join(linked, F.col("cid") == F.col("me"), "left").select("cid", F.col("n").alias("n_copies"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return join_states(members.drop("n"), states, ["cid"], "n_copies", alerts.count()).select("row_id", F.col("cid").alias("class_id"), "n_copies", "n_links")
