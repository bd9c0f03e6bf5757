"""The row graph: rows joined by shared entities, weighted and decayed by their gap in time."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions.temporal import decay, gap
from alertweave.session import materialise

POSTINGS = 400


def listings(rows: DataFrame, entities: Column, *keep: str) -> DataFrame:
    """row_id, entity (distinct per row), and the kept columns."""
    return rows.select("row_id", *keep, F.explode(F.array_distinct(entities)).alias("entity"))


def _few(listed: DataFrame, cap: int) -> DataFrame:
    """entity, e, n: the entities on 2 to ``cap`` rows, numbered."""
    few = listed.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap))
    return materialise(few.select("entity", F.monotonically_increasing_id().alias("e"), "n"))  # written, so a number stays


def _met(listed: DataFrame, few: DataFrame, *bounds: str, within: float | None = None) -> DataFrame:
    """x, y, shared: pairs of rows (structs of row_id and ``bounds``, the smaller row_id first) that share entities of ``few``, each once.

    Rows carry the numbers of their other entities, and a pair is made only where its least shared entity is.  So pairs,
    which are many times the listings, needn't be brought together: what is shuffled are listings.  ``within``: pairs
    between whose bounds (lo, hi) is more aren't made.
    """
    rows = listed.join(few, "entity").groupBy("row_id", *bounds).agg(F.sort_array(F.collect_set("e")).alias("es"))
    one = F.struct("row_id", *bounds, F.slice("es", 1, F.col("i")).alias("before"), F.slice("es", F.col("i") + 2, F.size("es")).alias("after"))
    post = rows.select("row_id", *bounds, "es", F.posexplode("es").alias("i", "e")).select("e", one.alias("row")).groupBy("e").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    first = post.select("rows", F.posexplode("rows").alias("i", "x"))
    others = F.slice("rows", F.col("i") + 2, F.size("rows"))
    if within is not None:
        x = F.col("x")
        others = F.filter(others, lambda y: (y["lo"] - x["hi"] <= within) & (x["lo"] - y["hi"] <= within))
    met = first.select("x", F.explode(others).alias("y"))
    shared = 1 + F.size(F.array_intersect("x.after", "y.after"))
    return met.where(~F.arrays_overlap("x.before", "y.before")).select("x", "y", shared.cast("bigint").alias("shared"))


def entity_pairs(listed: DataFrame, cap: int = POSTINGS) -> DataFrame:
    """a < b, shared: rows that share entities, and how many.

    An entity on more than ``cap`` rows joins nothing: it says nothing about a pair.  That is part of the operator's
    meaning; it also bounds each entity to cap * (cap - 1) / 2 pairs.
    """
    return _met(listed, _few(listed, cap)).select(F.col("x.row_id").alias("a"), F.col("y.row_id").alias("b"), "shared")


def timed_pairs(listed: DataFrame, cap: int = POSTINGS) -> DataFrame:
    """a < b, shared, dt: :func:`entity_pairs` with the gap of the rows' intervals.

    ``listed``: row_id, entity (distinct per row), lo, hi in seconds.  The bounds travel in the posting lists, so no join with
    the rows follows.
    """
    return _timed(_met(listed, _few(listed, cap), "lo", "hi"))


def _timed(met: DataFrame) -> DataFrame:
    apart = gap(*(F.col(c) for c in ("x.lo", "x.hi", "y.lo", "y.hi")))
    return met.select(F.col("x.row_id").alias("a"), F.col("y.row_id").alias("b"), "shared", apart.alias("dt"))


def weighty_pairs(listed: DataFrame, tau: float, slight: float, cap: int = POSTINGS) -> DataFrame:
    """:func:`timed_pairs` but for those that weigh less than ``slight`` all together under exponential decay.

    An entity adds exp(-dt / tau) to a pair's weight.  There are as many such summands as pairs in the posting lists, so
    those below ``slight`` through that number sum up to less than ``slight``; the gap from which they are is known
    before any pair is made.  For what sees no difference of ``slight`` in weights, as Louvain's moves.
    """
    few = _few(listed, cap)
    most = few.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(1.0))).first()[0]
    return _timed(_met(listed, few, "lo", "hi", within=max(0.0, tau * math.log(most / slight))))


def runs(listed: DataFrame, near: Callable[[Column], Column], cap: int = POSTINGS) -> DataFrame:
    """row_id, head: rows of an entity that gaps join without a break, with the least of them; a row once for each entity.

    They join the same rows as the pairs of :func:`timed_pairs` for whose gap ``near`` is true, and are no more than the
    listings.  ``near``: true for all smaller gaps if it is for one.  In order of time a row is near an earlier one only if
    it is near the one that ends last, and all that it is near are near each other, so one link holds them together.
    """
    few = listed.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap)).select("entity")
    own = F.greatest(F.lit(0.0), F.col("lo") - F.col("hi"))  # a row that ends before it begins is no nearer to others
    post = listed.select("row_id", "entity", "lo", "hi").join(few, "entity", "left_semi").where(F.col("lo").isNotNull() & F.col("hi").isNotNull() & near(own))
    w = Window.partitionBy("entity").orderBy("lo", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.greatest(F.lit(0.0), F.col("lo") - F.col("ended"))
    post = post.withColumn("ended", ended).withColumn("begins", F.when(F.col("ended").isNotNull() & near(apart), 0).otherwise(1))
    run = post.withColumn("run", F.sum("begins").over(w))
    return run.select("row_id", F.min("row_id").over(Window.partitionBy("entity", "run")).alias("head"))


def weighted(edges: DataFrame, kind: str = "exponential", tau: float | None = 300.0, cutoff: float | None = None, min_shared: int = 1, min_weight: float = 0.0) -> DataFrame:
    """Edges with w = shared * decay(dt); those of too few shared entities, without weight or below ``min_weight`` go."""
    f = decay(F.col("dt"), kind, tau, cutoff)
    out = edges.where(F.col("shared") >= min_shared).withColumn("w", F.col("shared") * f)
    return out.where((F.col("w") > 0) & (F.col("w") >= min_weight))


def edge_stats(edges: DataFrame, n_nodes: int) -> DataFrame:
    return edges.agg(
        F.lit(n_nodes).cast("bigint").alias("n_nodes"), F.count("*").alias("n_edges"), F.round(F.sum("w"), 4).alias("w_sum"), F.round(F.avg("w"), 6).alias("w_mean"), F.round(2 * F.count("*") / F.lit(max(1, n_nodes)), 6).alias("mean_degree")
    )


def tau_sweep(edges: DataFrame, taus: list[float | None], kind: str = "exponential", min_weight: float = 1.0) -> DataFrame:
    """tau (null: no decay), n_edges, w_sum for each tau, all in one pass over the edges."""
    each = F.array(*(F.struct(F.lit(t).cast("double").alias("tau"), (F.col("shared") * decay(F.col("dt"), kind if t is not None else "none", t)).alias("w")) for t in taus))
    long = edges.select(F.inline(each)).where((F.col("w") > 0) & (F.col("w") >= min_weight))
    return long.groupBy("tau").agg(F.count("*").alias("n_edges"), F.round(F.sum("w"), 4).alias("w_sum"))
