"""Exploration: frequencies, coverage of fields, cardinalities, strata, quantiles."""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.operators.report import heavy
from alertweave.session import materialise, release

SKETCH = 10_000  # a rank of a sketch is wrong by a share of 1 / SKETCH at most


def frequencies(df: DataFrame, dimensions: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """dimension, item, n, rnk: the most frequent values of several dimensions in one pass.

    A dimension's column may be an array; its entries count each.
    """
    parts = F.flatten(F.array(*(_tagged(k, c) for k, (c, _) in dimensions.items())))
    top = heavy(df.select(F.explode(parts).alias("p")).select("p.dimension", "p.item"), ["dimension"], F.col("item"), max(n for _, n in dimensions.values()))
    limit = F.create_map(*(x for k, (_, n) in dimensions.items() for x in (F.lit(k), F.lit(n))))
    return top.where(F.col("rnk") <= limit[F.col("dimension")])


def _tagged(name: str, items: Column) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(name).alias("dimension"), x.cast("string").alias("item")))


def field_coverage(df: DataFrame, group: str, fields: Column, k: int = 12, groups: int = 10) -> DataFrame:
    """group, field, n: the ``k`` most frequent fields (an array of names) of the ``groups`` largest groups."""
    largest = heavy(df, [], F.col(group), groups).select(F.col("item").alias(group))
    rows = df.join(F.broadcast(largest), group, "left_semi")  # at most ``groups`` rows
    return heavy(rows.select(group, F.explode(fields).alias("f")), [group], F.col("f"), k).select(group, F.col("item").alias("field"), "n")


def cardinality(df: DataFrame, group: str, kinds: Mapping[str, Column], k: int = 3) -> DataFrame:
    """group, kind, n_unique, top: distinct values of each kind in each group and the ``k`` most frequent ones."""
    parts = F.flatten(F.array(*(F.transform(c, _kind(name)) for name, c in kinds.items())))
    counts = df.select(group, F.explode(parts).alias("p")).where("p.item <> ''").groupBy(group, F.col("p.kind").alias("kind"), F.col("p.item").alias("item")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rnk", F.row_number().over(Window.partitionBy(group, "kind").orderBy(F.desc("n"), "item"))).where(F.col("rnk") <= k)
    top = ranked.groupBy(group, "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "item"))), lambda s: s["item"]), ",").alias("top"))
    return counts.groupBy(group, "kind").agg(F.count("*").alias("n_unique")).join(top, [group, "kind"])


def _kind(name: str):
    return lambda x: F.struct(F.lit(name).alias("kind"), x.alias("item"))


def stratum_share(df: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """keys, n, pct, rnk: the ``k`` largest strata and their percentage of all rows; the total is one row."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    top = n.orderBy(F.desc("n"), *keys).limit(k)
    return top.join(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("n") / F.col("total"), 4)).withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("n"), *keys))).drop("total")


def sample_share(sample: DataFrame, origin: DataFrame, key: str) -> DataFrame:
    """key, n_sample, n_origin, pct_sample, pct_origin."""
    s, o = sample.groupBy(key).agg(F.count("*").alias("n_sample")), origin.groupBy(key).agg(F.count("*").alias("n_origin"))
    both = o.join(s, key, "left").fillna(0, ["n_sample"])
    w = Window.partitionBy()  # as many rows as there are strata
    pct = lambda c: F.round(100 * F.try_divide(F.col(c), F.sum(c).over(w)), 4)
    return both.select(key, "n_sample", "n_origin", pct("n_sample").alias("pct_sample"), pct("n_origin").alias("pct_origin"))


def quantiles(df: DataFrame, c: str, at: Mapping[str, float]) -> DataFrame:
    """One row of exact quantiles, interpolated.

    A sketch brackets each quantile.  Only the values inside a bracket are told apart; those between brackets are
    counted together, so no task holds all values.  Where a rank lies outside, brackets are widened, up to all values.  ``df`` is
    computed for the sketch and again for the counts.
    """
    v, spark = F.col("v"), df.sparkSession
    values = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("v"))
    margin, found, total = 2 / SKETCH, {}, 0
    while True:
        around = [min(1.0, max(0.0, x)) for q in at.values() for x in (q - margin, q + margin)]
        ends = values.agg(F.percentile_approx("v", around, SKETCH).alias("ends")).first()["ends"]
        if ends is None:
            break
        release(spark)
        inside = functools.reduce(Column.__or__, (v.between(lo, hi) for lo, hi in zip(ends[::2], ends[1::2], strict=True))) if margin < 1 else F.lit(True)
        passed = F.size(F.filter(F.lit(ends[1::2]), lambda hi: hi < v))
        counts = materialise(values.groupBy(F.when(inside, v).alias("x"), F.when(~inside, passed).alias("gap")).agg(F.max("v").alias("v"), F.count("*").alias("k")))
        total = counts.agg(F.sum("k")).first()[0]
        wanted = {r for q in at.values() for r in (math.floor((total - 1) * q), math.ceil((total - 1) * q))}
        found, before = {}, 0
        for row in counts.orderBy("v").toLocalIterator():
            found |= {r: row["x"] for r in wanted if before <= r < before + row["k"]}
            before += row["k"]
        if None not in found.values():
            break
        margin *= 16

    def value(q: float) -> float:
        x = (total - 1) * q
        lo, hi = found[math.floor(x)], found[math.ceil(x)]
        return lo if lo == hi else (math.ceil(x) - x) * lo + (x - math.floor(x)) * hi

    row = spark.createDataFrame([tuple(value(q) if total else None for q in at.values())], ", ".join(f"{k} double" for k in at))
    return row.select(*(F.round(k, 6).alias(k) for k in at))


def histogram(df: DataFrame, c: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin (1 to ``bins``), n: counts of equal-width bins, the last one closed."""
    b = F.width_bucket(F.col(c), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
    return df.where(F.col(c).between(lo, hi)).groupBy(F.least(F.lit(bins), b).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def log_histogram(df: DataFrame, c: str) -> DataFrame:
    """bin (whole log10), n, of positive values."""
    return df.where(F.col(c) > 0).groupBy(F.floor(F.log10(c) + 1e-12).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def timeline(df: DataFrame, ts: str, unit: str = "minute") -> DataFrame:
    """start_us, n_rows, n_alerts by truncated time."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.unix_micros(F.date_trunc(unit, ts)).alias("start_us")).agg(F.count("*").alias("n_rows"), F.sum("count").alias("n_alerts"))


def respaced(df: DataFrame, ts: str, key: str, duration: float) -> DataFrame:
    """key, offset_s: rank-proportional places of the rows, in order of time, within ``duration`` seconds.

    Ranks are counted over range partitions: each numbers its rows and starts after those before it.
    """
    parts = df.select(key, ts).repartitionByRange(ts, key).withColumn("part", F.spark_partition_id())
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    w = Window.orderBy("part")  # one row for each partition
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    rn = F.row_number().over(Window.partitionBy("part").orderBy(ts, key))
    placed = parts.withColumn("rn", rn).join(F.broadcast(counts.drop("n")), "part")
    rank = F.col("rn") + F.col("before")
    return placed.select(key, F.round(F.lit(duration) * (rank - 1) / F.greatest(F.lit(1), F.col("total") - 1), 6).alias("offset_s"))
