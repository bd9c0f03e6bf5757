"""Attack waves: spectral clustering of alert rows by shared users and addresses within a few hours.

Rows with equal sets in one time slot collapse into a node (any two of them are alike), so a wave of copies of
any size is one node.  Nodes are joined by an edge where their sets are similar and some of their rows lie
within the window; its affinity is the similarity times the rows of the node it leads to.  Affinities are normalised
once to the steps of a random walk, and several start vectors of random numbers are iterated at once by joins with
them: all of one shuffle a step.  Where all rows of a group are alike and alike to no other, every step at least
halves the differences inside (each affinity is at least the threshold's share of the largest), while other
groups keep other values.  The iteration ends when no node's surroundings close in like that any more.

The embedding is clustered by k-means.  k isn't given: centres start at the occupied cells of a grid, and nodes
move to the nearest centre around them until none moves.  Nodes whose surroundings haven't closed in belong to loose
groups; they are clustered at their own scale, among the centres that their neighbours belong to.  Members are
ranked by their affinity to the rest of their cluster.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.llm import forest
from alertweave.operators.instants import US, sole_instant
from alertweave.operators.skew import join_states
from alertweave.session import materialise

ARRAYS = {"u": "entity_users", "i": "entity_ips"}
VECTORS = 4
STRIDE = 4  # steps between two tests
SETTLED = 1e-6  # of the start vectors' range
REACH, SIDE = 1e-5, 1e-4  # places closer than REACH are one; side of a cell of the grid of first centres
LOOSE = 0.02  # the same for groups that aren't separate
ROUNDS = 10  # of k-means at most; usually none moves after two


def timed_sets(alerts: DataFrame, zones: DataFrame, window_us: int, least: int = 5) -> DataFrame:
    """row_id, toks, us, slot: rows with at least ``least`` users and addresses whose first_seen stands for one instant."""
    wide = alerts.select("row_id", forest.tokens(alerts, ARRAYS).alias("toks"), "first_seen", "agent_name").where(F.size("toks") >= least)
    timed = sole_instant(wide, "first_seen", "agent_name", zones, "us").where(F.col("us").isNotNull())
    return timed.select("row_id", "toks", "us", F.floor(F.col("us") / F.lit(window_us)).cast("int").alias("slot"))


def graph(rows: DataFrame, threshold: float, window_us: int) -> tuple[DataFrame, DataFrame]:
    """nodes (node, toks, slot, lo, hi, n) and edges (src, dst, similarity, n of dst; both directions, no loops).

    A node's id is the smallest row_id of it.  Nodes of one set lie in different slots, so a set has no more nodes
    than the time has slots.  Slots are as long as the window: rows two slots apart are never alike.
    """
    nodes = materialise(rows.groupBy("toks", "slot").agg(F.min("row_id").alias("node"), F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("n")))
    classes = materialise(nodes.groupBy("toks").agg(F.min("node").alias("cid")))
    pairs = forest.similar_classes(classes, threshold, 2)
    pairs = pairs.select(F.inline(F.array(F.struct("a", "b", "similarity"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))))
    pairs = pairs.unionByName(classes.select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("similarity")))
    placed = nodes.join(classes, "toks").select("cid", "node", "slot", "lo", "hi", "n")
    left = placed.select(F.col("cid").alias("a"), F.col("node").alias("src"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("slot").alias("s1"))
    right = placed.select(F.col("cid").alias("b"), F.col("node").alias("dst"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("slot").alias("s2"), "n")
    met = pairs.join(left, "a").withColumn("s2", F.explode(F.sequence(F.col("s1") - 1, F.col("s1") + 1))).join(right, ["b", "s2"])
    gap = F.greatest("lo1", "lo2") - F.least("hi1", "hi2")
    edges = met.where((F.col("src") != F.col("dst")) & (gap <= window_us)).select("src", "dst", "similarity", "n")
    return nodes, materialise(edges)


def walk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, p: the affinities of each node, those of its own rows to each other included, normalised to 1."""
    w = edges.select("src", "dst", (F.col("similarity") * F.col("n")).alias("w"))
    w = w.unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.col("n").cast("double").alias("w")))
    return materialise(w.join(w.groupBy("src").agg(F.sum("w").alias("all")), "src").select("src", "dst", (F.col("w") / F.col("all")).alias("p")))


def embedding(nodes: DataFrame, edges: DataFrame, threshold: float = 0.5, vectors: int = VECTORS, settled: float = SETTLED) -> DataFrame:
    """node, n, x0, x1, ..., spread: start vectors of random numbers in [0, 1) after steps of the normalised affinities.

    ``spread`` is the largest difference in a node's surroundings before the last step.  Nodes still closing in are
    those whose spread is above ``settled`` and has fallen as fast as in a closed group (to 1 - threshold in each step;
    half of that over a stride is allowed for); without any the iteration ends, and in a closed group it has ended by
    the last step that is done at most.
    """
    xs = [f"x{i}" for i in range(vectors)]
    steps = walk(nodes, edges)
    x = nodes.select("node", F.lit(1.0).alias("spread"), *((F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1 << 30)) / float(1 << 30)).alias(c) for i, c in enumerate(xs)))
    most = math.ceil(math.log(settled) / math.log(1 - threshold))
    for _ in range(0, most, STRIDE):
        before = x
        for k in range(STRIDE):
            ends = [F.max(c) - F.min(c) for c in xs] if k == STRIDE - 1 else []
            x = steps.join(x.select(F.col("node").alias("dst"), *xs), "dst").groupBy("src").agg(*(F.sum(F.col("p") * F.col(c)).alias(c) for c in xs), *([F.greatest(*ends).alias("spread")] if ends else []))
            x = x.withColumnRenamed("src", "node")
        x = materialise(x.join(before.select("node", F.col("spread").alias("was")), "node"))
        if x.where((F.col("spread") > settled) & (F.col("spread") <= 2 * (1 - threshold) ** STRIDE * F.col("was"))).isEmpty():
            break
    return x.join(nodes.select("node", "n"), "node").select("node", "n", *xs, "spread")


def _cells(xs: list[str], reach: float, side: float) -> Column:
    """The grid's cells within ``reach`` of a place."""
    sides = [(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)) for c in xs]
    return F.array_distinct(F.array(*(F.xxhash64(*corner) for corner in itertools.product(*sides))))


def _nearest(offered: DataFrame, xs: list[str], reach: float) -> DataFrame:
    """node, label: the nearest of the offered centres; places closer than ``reach`` are one, the centre of most rows first."""
    far = sum(((F.col(c) - F.col(f"c_{c}")) ** 2 for c in xs), F.lit(0.0))
    order = F.struct(F.when(far <= reach**2, 0.0).otherwise(far).alias("far"), (-F.col("mass")).alias("m"), "label")
    return offered.groupBy("node").agg(F.min(order)["label"].alias("label"))


def _centres(x: DataFrame, labels: DataFrame, xs: list[str]) -> DataFrame:
    of = x.join(labels, "node").groupBy("label").agg(*(F.sum(F.col(c) * F.col("n")).alias(f"s_{c}") for c in xs), F.sum("n").alias("mass"))
    return of.select("label", "mass", *((F.col(f"s_{c}") / F.col("mass")).alias(f"c_{c}") for c in xs))


def _moved(old: DataFrame, new: DataFrame) -> bool:
    return not old.join(new.withColumnRenamed("label", "to"), "node").where("label <> to").isEmpty()


def k_means(x: DataFrame, reach: float = REACH, side: float = SIDE, rounds: int = ROUNDS) -> DataFrame:
    """node, label: k-means of the embedding.

    The first centres are those of the occupied cells of a grid.  A node chooses among the centres of its own cell and
    of the cells within ``reach`` (one cell for most nodes, at most two in each dimension).
    """
    xs = [c for c in x.columns if c[0] == "x"]
    labels = x.select("node", F.xxhash64(*(F.floor(F.col(c) / side) for c in xs)).alias("label"))
    offers = materialise(x.select("node", *xs, F.explode(_cells(xs, reach, side)).alias("label")))
    for _ in range(rounds):
        new = materialise(_nearest(offers.join(_centres(x, labels, xs), "label"), xs, reach))
        still = not _moved(labels, new)
        labels = new
        if still:
            break
    return labels


def loose_groups(x: DataFrame, edges: DataFrame, reach: float = LOOSE, rounds: int = ROUNDS) -> DataFrame:
    """node, label: k-means of the embedding where groups aren't separate; the choice is among the clusters of a node's neighbours.

    Centres start at the nodes whose surroundings have most rows (the smallest id first), as many as some neighbour chose.
    """
    xs = [c for c in x.columns if c[0] == "x"]
    inner = edges.join(x.select(F.col("node").alias("src")), "src", "left_semi").join(x.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "n")
    inner = materialise(inner)
    w = x.join(inner.groupBy("src").agg(F.sum("n").alias("w")), F.col("node") == F.col("src"), "left").select("node", (F.coalesce("w", F.lit(0)) + F.col("n")).alias("w"))
    rank = F.struct("w", (-F.col("i")).alias("i")).alias("r")
    near = inner.join(w.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "w", F.col("dst").alias("i")).unionByName(w.select("node", "w", F.col("node").alias("i")))
    labels = materialise(near.select("node", rank).groupBy("node").agg((-F.max("r")["i"]).alias("label")))
    for _ in range(rounds):
        offered = inner.join(labels.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "label").unionByName(labels).distinct()
        new = materialise(_nearest(offered.join(x, "node").join(_centres(x, labels, xs), "label"), xs, reach))
        still = not _moved(labels, new)
        labels = new
        if still:
            break
    return labels


def clustered(alerts: DataFrame, zones: DataFrame, threshold: float = 0.5, hours: int = 6) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows, nodes, edges, and x (the embedding with label) of the alert rows; labels of k-means, loose groups not told apart yet."""
    window = hours * 3600 * US
    rows = materialise(timed_sets(alerts, zones, window))
    nodes, edges = graph(rows, threshold, window)
    x = materialise(embedding(nodes, edges, threshold))
    return rows, nodes, edges, materialise(x.join(k_means(x), "node"))


def closed_clusters(nodes: DataFrame, edges: DataFrame, labels: DataFrame, hours: int, least: int = 3) -> DataFrame:
    """label, cluster_row_id, size of the clusters whose rows are all alike and alike to no row outside.

    With m nodes and m(m - 1) edge ends, all inside, every node is joined with every other; a span of at most the
    window makes all their rows alike.
    """
    own = edges.join(labels.select(F.col("node").alias("src"), "label"), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("other")), "dst")
    ends = own.groupBy("label").agg(F.count("*").alias("ends"), F.count_if(F.col("label") != F.col("other")).alias("out"))
    size = nodes.join(labels, "node").groupBy("label").agg(
        F.count("*").alias("m"), F.sum("n").alias("size"), F.min("node").alias("cluster_row_id"), (F.max("hi") - F.min("lo")).alias("span")
    )
    whole = size.join(ends, "label", "left").fillna(0, ["ends", "out"])
    return whole.where((F.col("ends") == F.col("m") * (F.col("m") - 1)) & (F.col("out") == 0) & (F.col("span") <= hours * 3600 * US) & (F.col("size") >= least)).select("label", "cluster_row_id", "size")


def found(alerts: DataFrame, zones: DataFrame, hours: int = 6) -> DataFrame:
    """cluster_row_id, row_id of the members of the clusters of k-means that are closed.

    Rows without an instant, with null arrays or fewer than five entries are no members; repeated rows are members
    each; an empty table gives no rows.
    """
    rows, nodes, edges, x = clustered(alerts, zones, hours=hours)
    labels = x.select("node", "label")
    closed = closed_clusters(nodes, edges, labels, hours)
    inside = nodes.join(labels, "node").join(closed, "label").select("toks", "slot", "n", "cluster_row_id")
    return join_states(rows, inside, ["toks", "slot"], "n", alerts.count()).select("cluster_row_id", "row_id")


def described(alerts: DataFrame, zones: DataFrame, hours: int = 6, typical: int = 3, settled: float = REACH) -> DataFrame:
    """cluster_row_id, size, n_nodes, rank, row_id, affinity: every cluster of at least three rows with its most typical rows.

    The affinity of a row is the sum of its similarities with the other rows of its cluster; nodes stand for their
    rows (a node's copies have affinity 1 with each other), ties go to the smaller id.
    """
    _, nodes, edges, x = clustered(alerts, zones, hours=hours)
    loose = materialise(x.where(F.col("spread") > settled).drop("label", "spread"))
    named = x.where(F.col("spread") <= settled).select("node", "n", F.struct(F.lit(0).alias("kind"), "label").alias("label"))
    named = named.unionByName(loose_groups(loose, edges).join(nodes.select("node", "n"), "node").select("node", "n", F.struct(F.lit(1).alias("kind"), "label").alias("label")))
    named = materialise(named)
    ends = edges.select("src", "dst", "similarity").join(named.select(F.col("node").alias("src"), "label"), "src").join(named.select(F.col("node").alias("dst"), "label", "n"), ["dst", "label"])
    inner = ends.groupBy("src").agg(F.sum(F.col("similarity") * F.col("n")).alias("a"))
    scored = named.join(inner, F.col("node") == F.col("src"), "left").select("label", "node", "n", (F.coalesce("a", F.lit(0.0)) + F.col("n") - 1).alias("affinity"))
    size = scored.groupBy("label").agg(F.sum("n").alias("size"), F.count("*").alias("n_nodes"), F.min("node").alias("cluster_row_id")).where(F.col("size") >= 3)
    order = Window.partitionBy("label").orderBy(F.round("affinity", 9).desc(), "node")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= typical)
    return best.join(size, "label").select("cluster_row_id", "size", "n_nodes", "rank", F.col("node").alias("row_id"), F.round("affinity", 6).alias("affinity"))
