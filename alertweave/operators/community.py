"""Connected components, communities, and consolidation of small ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.session import materialise, release

LARGEST = 200_000  # edges of a graph that one task optimises; a larger one is optimised in blocks of as many
BATCH = 100_000  # edges that one task unites to components
MOST_PAIRS = 100_000  # of blocks that edges join, as the driver sees them; with more every two blocks meet
LEAST_GAIN = 1e-12  # of weight, by which a node moves to another community
MANY = 1_000_000  # from this many edges on the files of a round are removed before the next one


def _united(pdf: pd.DataFrame) -> pd.DataFrame:
    """node, component of the edges src, dst at one place."""
    ids, flat = np.unique(pdf[["src", "dst"]].to_numpy(dtype=np.int64).ravel(), return_inverse=True)
    root = list(range(len(ids)))
    for x, y in flat.reshape(-1, 2).tolist():
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    for v in range(len(ids)):
        root[v] = root[root[v]]  # a root is smaller than its members, so it is settled before them
    return pd.DataFrame({"node": ids, "component": ids[root]})


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node of it); ``nodes``: node, ``edges``: a, b between them.

    Alternating rounds of hooking to the smallest neighbour and pointer doubling; labels are written out each round,
    so lineage stays short and a lost executor costs a round.  Ends when no label changes.  Up to BATCH edges go to one
    task, which gives the same labels.
    """
    every = nodes.select(F.col("node").alias("id")).distinct()
    edges = materialise(edges.select("a", "b"))
    n_edges = edges.count()
    if n_edges <= BATCH:
        one = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0).alias("g")).groupBy("g")
        labels = one.applyInPandas(lambda pdf: _united(pdf), "node bigint, component bigint")
        return every.join(labels, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component"))
    ends = materialise(edges.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))).where("src <> dst").distinct())
    labels = materialise(ends.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct())  # nodes without edges keep themselves
    for _ in range(most_rounds):
        offered = ends.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("component").alias("least"))
        hooked = labels.join(offered, F.col("node") == F.col("src"), "left").select("node", "component", F.least("component", F.coalesce("least", "component")).alias("next"))
        # a root takes the smallest label any of its members was offered, then members follow their root's root
        roots = hooked.groupBy("component").agg(F.min("next").alias("root")).withColumnRenamed("component", "old")
        moved = hooked.join(roots, F.col("component") == F.col("old")).select("node", F.col("component").alias("was"), F.least("next", "root").alias("component"))
        jump = moved.select(F.col("node").alias("up"), F.col("component").alias("higher"))
        new = materialise(moved.join(jump, F.col("component") == F.col("up"), "left").select("node", "was", F.least("component", F.coalesce("higher", "component")).alias("component")))
        labels = new.select("node", "component")
        if n_edges >= MANY:
            del offered, hooked, roots, moved, jump
            release(nodes.sparkSession)
        if new.where("was <> component").isEmpty():
            out = every.join(labels, F.col("id") == F.col("node"), "left")
            return out.select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def joined_components(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """node, component (the smallest node of it) of ``nodes`` (node) that ``runs`` (row_id, head) hold together.

    A row's heads are one component, and heads are few: rows take the label of their least head.
    """
    held = runs.groupBy(F.col("row_id").alias("node")).agg(F.min("head").alias("first"), F.collect_set("head").alias("heads"))
    links = materialise(held.select(F.col("first").alias("a"), F.explode("heads").alias("b")).where("a <> b").distinct())
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialise(connected_components(ends, links).withColumnRenamed("node", "first"))
    del links, ends
    release(nodes.sparkSession)
    placed = runs.groupBy(F.col("row_id").alias("node")).agg(F.min("head").alias("first"))
    out = nodes.select("node").distinct().join(placed, "node", "left").join(labels, "first", "left")
    return out.select("node", F.coalesce("component", "first", "node").alias("component"))


def louvain(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float, degree: np.ndarray | None = None, bar: np.ndarray | None = None) -> np.ndarray:
    """A community (index of a member) for each of ``ids``; edges between positions, ``total`` the weight of the whole graph.

    Nodes move in order of id to the community of largest gain until none gains, communities become nodes, and so on.
    ``degree`` is that of the nodes in the whole graph, if they have edges to others as well; ``bar`` the best gain that
    those offer: a node with less here stays, and communities don't become nodes.
    """
    n = len(ids)
    place = np.arange(n)
    while True:
        src = np.concatenate([a, b])
        order = np.argsort(src, kind="stable")
        degree = np.bincount(src, np.concatenate([w, w]), n) if degree is None else degree
        ends = np.searchsorted(src, np.arange(n + 1), sorter=order).tolist()
        near, weight = np.concatenate([b, a])[order].tolist(), np.concatenate([w, w])[order].tolist()
        community, mass, own, share = list(range(n)), degree.tolist(), degree.tolist(), (degree / (2 * total)).tolist()
        least = bar.tolist() if bar is not None else None
        due = bytearray(b"\1" * n)  # nodes with a neighbour that moved since they were looked at
        moved, any_move = True, False
        whole = True  # all nodes are looked at in this pass
        while moved or not whole:
            if not moved:  # communities' masses changed as well, so all nodes are looked at before it ends
                due, whole = bytearray(b"\1" * n), True
            else:
                whole = 0 not in due
            moved = False
            v = due.find(1)
            while v >= 0:
                due[v] = 0
                c = community[v]
                links: dict[int, float] = {}
                i, j = ends[v], ends[v + 1]
                for u, z in zip(near[i:j], weight[i:j], strict=True):
                    u = community[u]
                    links[u] = links.get(u, 0.0) + z
                mass[c] -= own[v]
                best, gain, part = c, links.get(c, 0.0) - mass[c] * share[v], share[v]
                for k in sorted(links) if len(links) > 1 else links:
                    g = links[k] - mass[k] * part
                    if g > gain + LEAST_GAIN:
                        best, gain = k, g
                if least is not None and gain < least[v]:
                    best = c
                mass[best] += own[v]
                if best != c:
                    community[v], moved, any_move = best, True, True
                    for u in near[i:j]:
                        if community[u] != best:
                            due[u] = 1
                v = due.find(1, v + 1)
        names, new = np.unique(np.array(community, dtype=np.int64), return_inverse=True)
        place = new[place]
        if not any_move or len(names) == n or bar is not None:
            return place
        ca, cb = new[a], new[b]
        pairs = pd.DataFrame({"a": np.minimum(ca, cb), "b": np.maximum(ca, cb), "w": w})[ca != cb].groupby(["a", "b"], as_index=False)["w"].sum()
        a, b, w, degree, n = pairs["a"].to_numpy(), pairs["b"].to_numpy(), pairs["w"].to_numpy(), np.bincount(new, degree, len(names)), len(names)


def modularity(labels: DataFrame, edges: DataFrame) -> float:
    """Newman's modularity of node, community under the weighted edges a, b, w."""
    m = edges.agg(F.sum("w")).first()[0] or 0.0
    if not m:
        return 0.0
    la, lb = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = edges.join(la, "a").join(lb, "b")
    inner = e.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    strength = e.select(F.inline(F.array(F.struct(F.col("ca").alias("c"), "w"), F.struct(F.col("cb").alias("c"), "w")))).groupBy("c").agg(F.sum("w").alias("k"))
    return inner / m - (strength.agg(F.sum(F.pow(F.col("k") / (2 * m), F.lit(2)))).first()[0])


def _optimised(total: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """node, community (smallest node of it) of the edges a, b, w.

    With ka, kb (degrees in the whole graph) and the groups ga, gb of the ends, those of group g: edges to other
    groups only tell a node what it would gain there.
    """

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        degree = bar = None
        outside = pdf[pdf["ga"] != pdf["gb"]] if "ga" in pdf else None
        if outside is not None:
            pdf = pdf[pdf["ga"] == pdf["gb"]]
        pdf = pdf.sort_values(["a", "b"])
        ids, first, inverse = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_index=True, return_inverse=True)
        k = len(pdf)
        if outside is not None:
            degree = np.concatenate([pdf["ka"], pdf["kb"]])[first] if k else np.zeros(0)
        if outside is not None and len(outside):
            mine = np.where(outside["ga"] == outside["g"], outside["a"], outside["b"])
            gain = (outside["w"] - outside["ka"] * outside["kb"] / (2 * total)).to_numpy()
            bar = pd.Series(gain).groupby(mine).max().reindex(ids, fill_value=-np.inf).to_numpy()
        label = louvain(ids, inverse[:k], inverse[k:], pdf["w"].to_numpy(), total, degree, bar) if k else np.zeros(0, dtype=np.int64)
        least = pd.Series(ids).groupby(label).min()
        return pd.DataFrame({"node": ids.astype(np.int64), "community": least.loc[label].to_numpy().astype(np.int64)})

    return best


def paired(block: Column, n: int, turn: int) -> Column:
    """The group of a block (0 to n - 1) in a turn: in turns 1 to n - 1 (n if n is odd) every two blocks meet once; in turn 0 none."""
    if turn == 0 or n < 2:
        return block
    m = n + n % 2 - 1  # the circle method: block m stays, the others turn
    other = F.pmod(F.lit(2 * turn) - block, F.lit(m))
    fixed = turn % m
    return F.when(block == m, F.lit(fixed)).when(block == fixed, F.lit(fixed)).otherwise(F.least(block, other))


def met_in_turn(waiting: list[tuple[int, int]], n: int) -> list[int]:
    """The group of each of ``n`` blocks in a turn: the first pairs of ``waiting`` that share no block meet, others are alone."""
    group, free = list(range(n)), set(range(n))
    for i, j in waiting:
        if i != j and i in free and j in free:
            free -= {i, j}
            group[j] = i
    return group


def in_blocks(edges: DataFrame, total: float, batch: int | None = None) -> DataFrame:
    """node, community (smallest node of it) by Louvain over written edges a, b, w too many for a task.

    Nodes are cut into blocks, ranges of ids with about ``batch`` edges each, and a task moves the nodes inside its
    block by their degrees in the whole graph: communities of different blocks share no node, so their gains are exact
    and add up.  A node that a neighbour elsewhere offers more waits for it.  Communities become nodes; then the blocks
    that edges join meet in pairs, turn by turn, larger ones as the graph shrinks.  Ends when all of them have met since
    the last move: no move anywhere gains.
    """
    batch = batch or LARGEST
    graph, best = edges, _optimised(total)
    both = lambda *c: F.inline(F.array(*(F.struct(F.col(x).alias("node"), *c) for x in "ab")))
    degrees = materialise(graph.select(both("w")).groupBy("node").agg(F.sum("w").alias("k")))
    place = degrees.select("node", F.col("node").alias("community"))
    least, n, cuts, turn, alone = 0, 0, [], 0, True
    met: dict[tuple[int, int], int] = {}  # the turn in which two blocks met last
    still = 0  # the first turn since the last move
    while count := graph.count():
        if not n or count <= least:
            n = max(1, -(-count // batch))
            shares = [i / n for i in range(1, n)]
            cuts = graph.select(both()).agg(F.percentile_approx("node", shares, 100 * n)).first()[0] if shares else []
            least, met, still = count * 2 // 3, {}, turn
        block = lambda c: F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda x: x < c)) if cuts else F.lit(0)  # noqa: E731, B023
        ends = graph.withColumns({"i": block(F.col("a")), "j": block(F.col("b"))})
        near = [(0, 0)] if n == 1 else [tuple(r) for r in ends.select(F.least("i", "j"), F.greatest("i", "j")).distinct().limit(MOST_PAIRS + 1).collect()]
        if len(near) <= MOST_PAIRS:
            waiting = sorted((p for p in near if met.get(p, -1) < still), key=lambda p: (met.get(p, -1), p))
            if not waiting:
                break
            group = list(range(n)) if alone else met_in_turn(waiting, n)
            met |= {(i, j): turn for i, j in near if group[i] == group[j]}
            of = lambda c: F.get(F.lit(group), F.col(c))  # noqa: E731, B023
        else:  # every two blocks in turn
            every = n - 1 + n % 2
            if turn - still >= every:
                break
            of = lambda c: paired(F.col(c), n, 0 if alone else turn % every + 1)  # noqa: E731, B023
        sides = [degrees.select(F.col("node").alias(c), F.col("k").alias(f"k{c}")) for c in "ab"]
        ends = ends.select("a", "b", "w", of("i").alias("ga"), of("j").alias("gb")).join(sides[0], "a").join(sides[1], "b")
        inner = ends.withColumn("g", F.explode(F.array_distinct(F.array("ga", "gb"))))
        moved = materialise(inner.groupBy("g").applyInPandas(best, "node bigint, community bigint").where("node <> community"))
        turn, alone = turn + 1, False
        if not moved.isEmpty():
            still = turn
            to = lambda df, c: df.join(moved.select(F.col("node").alias(c), F.col("community").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: E731, B023
            graph = to(to(graph, "a"), "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))
            graph, degrees, place = materialise(graph), materialise(to(degrees, "node").groupBy("node").agg(F.sum("k").alias("k"))), materialise(to(place, "community"))
    return place


def detect_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, community (smallest node of it) of ``nodes`` (node, has_entity) and ``edges`` (a, b, w); -1: noise.

    Louvain with the whole graph's weight; no move crosses components, so they needn't be told apart.  Up to LARGEST
    edges go to one task, more are moved by :func:`in_blocks`.  A node without edges keeps its own community if it has
    an entity, else it is noise.
    """
    edges = materialise(edges.select("a", "b", F.col("w").cast("double").alias("w")))
    size = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("total")).first()
    if size["n"] <= LARGEST:
        found = edges.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_optimised(size["total"]), "node bigint, community bigint")
    else:
        found = in_blocks(edges, size["total"])
    alone = F.when(F.coalesce("has_entity", F.lit(False)), F.col("node")).otherwise(F.lit(-1))
    return nodes.join(found, "node", "left").select("node", F.coalesce("community", alone).cast("bigint").alias("community"))


def relabelled(labels: DataFrame) -> DataFrame:
    """node, community numbered 0, 1, ... in order of the old label; noise stays -1.

    The distinct labels are ranked, not the rows.
    """
    names = labels.where("community >= 0").select("community").distinct()
    ranks = names.select("community", (F.dense_rank().over(Window.orderBy("community")) - 1).cast("bigint").alias("new"))
    return labels.join(ranks, "community", "left").select("node", F.coalesce("new", F.lit(-1)).alias("community"))


def overlapping(rows: DataFrame, min_size: int = 3) -> DataFrame:
    """a < b: communities that share an entity, overlap in time, and aren't both large.

    ``rows``: node, community, lo, hi, entity (one row for each entity).
    """
    rows = rows.where("community >= 0")
    span = rows.groupBy("community").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_distinct("node").alias("size"))
    held = rows.select("community", "entity").where("entity is not null").distinct().join(span, "community")
    # one side is small; the smaller label of a pair may be either
    left = held.where(F.col("size") < min_size).select("entity", F.col("community").alias("x"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    right = held.select("entity", F.col("community").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = left.join(right, "entity").where("x <> y and lo1 <= hi2 and hi1 >= lo2")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def consolidate(rows: DataFrame, min_size: int = 3) -> DataFrame:
    """node, community after small communities joined those they overlap; transitive; noise stays -1.

    Merged communities take the label of the largest one, ties to the smaller label.  Columns as in :func:`overlapping`.
    """
    labels = materialise(rows.select("node", "community").distinct())
    groups = connected_components(labels.where("community >= 0").select(F.col("community").alias("node")).distinct(), overlapping(rows, min_size))
    size = labels.groupBy("community").agg(F.count("*").alias("n"))
    head = groups.join(size, F.col("node") == F.col("community")).groupBy("component").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("head"))
    merged = groups.join(head, "component").select(F.col("node").alias("community"), "head")
    return labels.join(merged, "community", "left").select("node", F.coalesce("head", "community").alias("community"))
