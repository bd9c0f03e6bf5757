"""Scores against ground truth: recall, purity, separation, agreement of labelings."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scenario_rows(listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """row_id, scenario: rows with an entity of a scenario; ``listed``: row_id, entity; ``wanted``: scenario, entity."""
    return listed.join(wanted.select("scenario", "entity").distinct(), "entity").select("row_id", "scenario").distinct()


def first_scenario(hits: DataFrame, order: DataFrame) -> DataFrame:
    """row_id, scenario: the first matching scenario by ``pos`` of ``order`` (scenario, pos)."""
    return hits.join(order, "scenario").groupBy("row_id").agg(F.min_by("scenario", F.struct("pos", "scenario")).alias("scenario"))


def recall_purity(hits: DataFrame, rows: DataFrame, scenarios: DataFrame, min_recall: float = 0.3, min_purity: float = 0.5) -> DataFrame:
    """scenario, n_rows, main_comm, recall, purity, is_cross, verdict for every scenario of ``scenarios`` (scenario).

    The main community is that of most of its rows (the smaller id of equal ones), noise aside; recall divides by all
    rows of the scenario, noise included; purity by the community's size.  ``rows``: row_id, community_id, decoder_name.
    """
    placed = hits.join(rows, "row_id")
    total = placed.groupBy("scenario").agg(F.count("*").alias("n_rows"))
    per = placed.where("community_id >= 0").groupBy("scenario", "community_id").agg(F.count("*").alias("n"))
    main = per.groupBy("scenario").agg(F.max_by(F.struct("community_id", "n"), F.struct("n", -F.col("community_id"))).alias("m")).select("scenario", F.col("m.community_id").alias("main_comm"), F.col("m.n").alias("n"))
    size = rows.where("community_id >= 0").groupBy("community_id").agg(F.count("*").alias("size"), F.count_distinct("decoder_name").alias("d")).withColumnRenamed("community_id", "main_comm")
    scored = scenarios.join(total, "scenario", "left").join(main, "scenario", "left").join(size, "main_comm", "left")
    scored = scored.withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), "recall": F.round(F.col("n") / F.col("n_rows"), 6), "purity": F.round(F.col("n") / F.col("size"), 6), "is_cross": F.coalesce(F.col("d") > 1, F.lit(False))})
    shared = F.count("main_comm").over(Window.partitionBy("main_comm"))
    verdict = (
        F.when(F.col("n_rows") == 0, "NOT DETECTED")
        .when(F.col("main_comm").isNull(), "NO COMMUNITY")
        .when(shared > 1, "FAIL shared")
        .when((F.col("recall") >= min_recall) & (F.col("purity") >= min_purity), "OK")
        .when(F.col("purity") < min_purity, "WEAK purity")
        .otherwise("WEAK recall")
    )
    return scored.withColumn("verdict", verdict).select("scenario", "n_rows", "main_comm", "recall", "purity", "is_cross", "verdict")


def dispersion(hits: DataFrame, rows: DataFrame, k: int = 6) -> DataFrame:
    """scenario, community_id, n: the ``k`` next communities of a scenario after the main one."""
    per = hits.join(rows, "row_id").where("community_id >= 0").groupBy("scenario", "community_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("n"), "community_id"))
    return per.withColumn("rnk", rank).where((F.col("rnk") > 1) & (F.col("rnk") <= k + 1)).select("scenario", "community_id", "n")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """scenario, recall and purity of two runs, and whether purity or recall changed; every scenario of either."""
    left = a.select("scenario", F.col("recall").alias("recall_a"), F.col("purity").alias("purity_a"))
    right = b.select("scenario", F.col("recall").alias("recall_b"), F.col("purity").alias("purity_b"))
    j = left.join(right, "scenario", "full_outer")
    changed = F.when(~F.col("purity_a").eqNullSafe(F.col("purity_b")), "purity").when(~F.col("recall_a").eqNullSafe(F.col("recall_b")), "recall").otherwise("")
    return j.withColumn("changed", changed)


def contingency(df: DataFrame, truth: str, label: str) -> DataFrame:
    """t, c, n: counts of (truth, label) of the rows with a truth; noise is a label like the others."""
    return df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(label).alias("c")).agg(F.count("*").alias("n"))


def agreement(cells: DataFrame) -> DataFrame:
    """One row: ari, homogeneity, completeness, v of a contingency, in closed form from its sums."""
    c2 = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    xlogx = lambda c: F.sum(F.col(c) * F.ln(c))
    rows, cols = cells.groupBy("t").agg(F.sum("n").alias("a")), cells.groupBy("c").agg(F.sum("n").alias("b"))
    s = cells.agg(c2("n").alias("x"), xlogx("n").alias("h"), F.sum("n").alias("n")).join(rows.agg(c2("a").alias("xa"), xlogx("a").alias("ha"))).join(cols.agg(c2("b").alias("xb"), xlogx("b").alias("hb")))
    n = F.col("n")
    expected, most = F.try_divide(F.col("xa") * F.col("xb"), n * (n - 1) / 2), (F.col("xa") + F.col("xb")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("x") - expected) / (most - expected))
    ht, hc = F.ln(n) - F.col("ha") / n, F.ln(n) - F.col("hb") / n
    mi = ht + hc - (F.ln(n) - F.col("h") / n)
    part = lambda h: F.when(F.abs(h) < 1e-12, 1.0).otherwise(mi / h)
    s = s.select(ari.alias("ari"), part(ht).alias("homogeneity"), part(hc).alias("completeness"))
    v = F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness")))
    return s.select(*(F.round(c, 6).alias(c) for c in ("ari", "homogeneity", "completeness")), F.round(v, 6).alias("v"))


def adjusted_mutual_information(cells: pd.DataFrame) -> float:
    """AMI (arithmetic mean) of a contingency (t, c, n) of two labelings of a sample.

    The expected information sums over pairs of label sizes, so the cells, as many as there are pairs of labels, are
    needed at one place.
    """
    a, b = cells.groupby("t")["n"].sum().to_numpy(), cells.groupby("c")["n"].sum().to_numpy()
    n = int(cells["n"].sum())
    if len(a) == len(b) == 1 or n == 0:
        return 1.0
    p = cells.groupby(["t", "c"])["n"].sum().to_numpy() / n
    ht, hc = (-(x / n * np.log(x / n)).sum() for x in (a, b))
    mi = ht + hc + (p * np.log(p)).sum()
    lg = lambda k: math.lgamma(k + 1)
    expected = 0.0
    for (x, kx), (y, ky) in ((p, q) for p in zip(*np.unique(a, return_counts=True), strict=True) for q in zip(*np.unique(b, return_counts=True), strict=True)):
        x, y = int(x), int(y)
        for k in range(max(1, x + y - n), min(x, y) + 1):
            expected += kx * ky * k / n * math.log(n * k / (x * y)) * math.exp(lg(x) + lg(y) + lg(n - x) + lg(n - y) - lg(n) - lg(k) - lg(x - k) - lg(y - k) - lg(n - x - y + k))
    top = (ht + hc) / 2 - expected
    return float((mi - expected) / top) if abs(top) > 1e-15 else 1.0


def cohesion(df: DataFrame, truth: str, label: str) -> DataFrame:
    """scenario, cohesion, purity: share of a scenario in its majority cluster, and of the cluster's labelled rows.

    Noise is no majority cluster; ties go to the smaller cluster; a scenario of noise alone has 0 and 0.
    """
    cells = contingency(df, truth, label).withColumnRenamed("t", "scenario")
    total = cells.groupBy("scenario").agg(F.sum("n").alias("all"))
    main = cells.where("c >= 0").groupBy("scenario").agg(F.max_by(F.struct("c", "n"), F.struct("n", -F.col("c"))).alias("m"))
    size = cells.groupBy("c").agg(F.sum("n").alias("size"))
    j = total.join(main, "scenario", "left").select("scenario", "all", F.col("m.c").alias("c"), F.col("m.n").alias("n")).join(size, "c", "left")
    return j.select("scenario", F.round(F.coalesce(F.col("n") / F.col("all"), F.lit(0.0)), 6).alias("cohesion"), F.round(F.coalesce(F.col("n") / F.col("size"), F.lit(0.0)), 6).alias("purity"))


def over_repetitions(scores: DataFrame, group: str, c: str) -> DataFrame:
    return scores.groupBy(group).agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"))


def phase_table(rows: DataFrame) -> DataFrame:
    """community_id, a, b, other, both: rows of each phase (``other``: none) in each community, and whether it holds both phases."""
    count = lambda p: F.count_if(p)
    per = rows.groupBy("community_id").agg(count(F.col("phase") == "A").alias("a"), count(F.col("phase") == "B").alias("b"), count(F.col("phase").isNull()).alias("other"))
    return per.withColumn("both", (F.col("a") > 0) & (F.col("b") > 0))


def phases_together(rows: DataFrame) -> DataFrame:
    """One row, together: whether some community (noise aside) holds rows of both phases."""
    return phase_table(rows.where("community_id >= 0")).agg(F.coalesce(F.bool_or("both"), F.lit(False)).alias("together"))


def scenario_spans(truth: DataFrame) -> DataFrame:
    """scenario, first_us, last_us, seconds: from the first to the last emission (``t_emit``) of each scenario."""
    t = F.try_to_timestamp("t_emit")
    return truth.groupBy("scenario").agg(F.unix_micros(F.min(t)).alias("first_us"), F.unix_micros(F.max(t)).alias("last_us")).withColumn("seconds", (F.col("last_us") - F.col("first_us")) / 1_000_000)


def in_order(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows of the keys named by ``order``, in that order; keys without rows are left out."""
    place = F.coalesce(*(F.when(F.col(key) == k, F.lit(i)) for i, k in enumerate(order)), F.lit(None).cast("int"))
    return df.where(F.col(key).isin(*order)).orderBy(place)
