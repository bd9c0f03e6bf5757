"""Clustering of vectors: DBSCAN, k-means, hierarchical density clustering, Ward's method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.operators.community import connected_components
from alertweave.session import materialise

DENSE_ROWS = 20_000  # rows that one task clusters hierarchically; more are refused, not sampled
BLOCK = 2_000


def neighbours(df: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """a, b, d: ordered pairs of rows at most ``eps`` apart, by blocks of vectors.

    Blocks of about BLOCK rows meet pairwise, each pair of blocks in its own task by matrix products.  This is
    exact for any vectors; its work grows with the square of the rows, as the operator's definition does.
    """
    n = df.count()
    blocks = max(1, -(-n // BLOCK))
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("p"))
    left = rows.select("id", "v", F.col("p").alias("i"), F.explode(F.sequence("p", F.lit(blocks - 1))).alias("j"), F.lit(0).alias("side"))
    right = rows.select("id", "v", F.explode(F.sequence(F.lit(0), "p")).alias("i"), F.col("p").alias("j"), F.lit(1).alias("side"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["side"] == s] for s in (0, 1))
        out = pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64), "d": np.zeros(0)})
        if not len(x) or not len(y):
            return out
        u, w = np.stack(x["v"].to_list()), np.stack(y["v"].to_list())
        d2 = (u**2).sum(1)[:, None] + (w**2).sum(1)[None, :] - 2 * u @ w.T
        i, j = np.nonzero(d2 <= eps * eps + 1e-9)
        d = np.sqrt(((u[i] - w[j]) ** 2).sum(1))  # exact where the product isn't
        a, b = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
        keep = (d <= eps) & (a != b)
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        keep &= (a < b) if same else True
        a, b, d = a[keep], b[keep], d[keep]
        return pd.DataFrame({"a": np.concatenate([a, b]), "b": np.concatenate([b, a]), "d": np.concatenate([d, d])})

    return left.unionByName(right).groupBy("i", "j").applyInPandas(meet, "a bigint, b bigint, d double")


def dbscan(df: DataFrame, key: str, vector: str, eps: float, min_samples: int) -> DataFrame:
    """key, cluster_id: components of core rows (``min_samples`` rows within ``eps``, itself included).

    A cluster's id is its smallest core row; a border row joins the cluster of its smallest core neighbour; other rows
    are -1.
    """
    near = materialise(neighbours(df, key, vector, eps).select("a", "b"))
    core = near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("a").alias("node"))
    if min_samples <= 1:
        core = df.select(F.col(key).alias("node"))
    core = materialise(core)
    inner = near.join(core.withColumnRenamed("node", "a"), "a", "left_semi").join(core.withColumnRenamed("node", "b"), "b", "left_semi")
    comp = connected_components(core, inner.where("a < b"))
    border = near.join(core.withColumnRenamed("node", "b"), "b", "left_semi").groupBy("a").agg(F.min("b").alias("via")).join(comp.select(F.col("node").alias("via"), F.col("component").alias("c2")), "via")
    out = df.select(key).join(comp, F.col(key) == F.col("node"), "left").join(border.select("a", "c2"), F.col(key) == F.col("a"), "left")
    return out.select(key, F.coalesce("component", "c2", F.lit(-1)).cast("bigint").alias("cluster_id"))


def k_means(df: DataFrame, key: str, vector: str, k: int, inits: int = 10, seed: int = 0) -> DataFrame:
    """key, cluster_id: the best of ``inits`` starts by cost."""
    v = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    models = [KMeans(k=max(2, k), seed=seed * inits + i, maxIter=50).fit(v) for i in range(inits)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(v).select(key, F.col("prediction").cast("bigint").alias("cluster_id"))


def _density_tree(x: np.ndarray, min_cluster: int, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and strengths by hierarchical density: core distances, spanning tree, condensed tree, excess of mass."""
    n = len(x)
    if n < max(2, min_cluster):
        return np.full(n, -1), np.zeros(n)
    sq = (x**2).sum(1)
    core = np.empty(n)
    for i in range(0, n, 512):
        d = np.sqrt(np.maximum(0, sq[i : i + 512, None] + sq[None] - 2 * x[i : i + 512] @ x.T))
        core[i : i + 512] = np.partition(d, min(min_samples, n) - 1, axis=1)[:, min(min_samples, n) - 1]
    best, link, inside = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
    edges, v = [], 0
    for _ in range(n - 1):  # Prim's tree of mutual reachability
        inside[v] = True
        d = np.maximum(np.sqrt(np.maximum(0, sq + sq[v] - 2 * x @ x[v])), np.maximum(core, core[v]))
        closer = (d < best) & ~inside
        best[closer], link[closer] = d[closer], v
        v = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[v], link[v], v))
    edges.sort()
    parent, size, child, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}, {}

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for k, (d, a, b) in enumerate(edges):
        p, q, new = root(a), root(b), n + k
        parent[p] = parent[q] = new
        size[new], child[new], height[new] = size[p] + size[q], (p, q), d

    def leaves(a: int) -> list[int]:
        out, todo = [], [a]
        while todo:
            t = todo.pop()
            todo.extend(child[t]) if t >= n else out.append(t)
        return out

    lam = lambda a: 1 / max(height[a], 1e-12)
    birth, points, kids = {0: 0.0}, {0: []}, {0: []}
    todo, count = [(2 * n - 2, 0)], 1
    while todo:
        a, c = todo.pop()
        if a < n:
            points[c].append((a, np.inf))
            continue
        p, q = child[a]
        big = [t for t in (p, q) if size[t] >= min_cluster]
        if len(big) == 2:
            points[c] += [(None, lam(a))] * size[a]
            for t in big:
                birth[count], points[count], kids[count] = lam(a), [], []
                kids[c].append(count)
                todo.append((t, count))
                count += 1
        else:
            for t in (p, q):
                if t in big:
                    todo.append((t, c))
                else:
                    points[c] += [(leaf, lam(a)) for leaf in leaves(t)]
    top = lambda z: min(z, 1e12)
    stable = {c: sum(top(z) - birth[c] for _, z in points[c]) for c in birth}
    chosen = {c: c != 0 for c in birth}
    for c in sorted(birth, reverse=True):
        if kids[c]:
            below = sum(stable[k] for k in kids[c])
            if c == 0 or below > stable[c]:
                chosen[c], stable[c] = False, below
    labels, strength, number = np.full(n, -1), np.zeros(n), 0

    def members(c: int) -> list[tuple[int, float]]:
        out, todo = [], [c]
        while todo:
            t = todo.pop()
            out += [(i, z) for i, z in points[t] if i is not None]
            todo += kids[t]
        return out

    todo = [0]
    while todo:
        c = todo.pop(0)
        if chosen[c]:
            m = members(c)
            most = max((top(z) for _, z in m), default=1.0)
            for i, z in m:
                labels[i], strength[i] = number, min(1.0, top(z) / most) if most else 1.0
            number += 1
        else:
            todo += kids[c]
    return labels, strength


def density_clusters(df: DataFrame, key: str, vector: str, min_cluster: int = 5, min_samples: int | None = None, group: str | None = None) -> DataFrame:
    """key, cluster_id, cluster_prob: hierarchical density clusters (excess of mass), noise -1.

    The tree needs all rows of a group at one place: a group of more than DENSE_ROWS is an error (use
    :func:`dbscan` there); ``group`` clusters each of its values on its own.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), (F.col(group) if group else F.lit(0)).alias("g"))
    if (largest := rows.groupBy("g").count().agg(F.max("count")).first()[0] or 0) > DENSE_ROWS:
        raise ValueError(f"{largest} rows in one group; {DENSE_ROWS} fit a task")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        labels, p = _density_tree(np.stack(pdf["v"].to_list()), min_cluster, min_samples or min_cluster)
        return pd.DataFrame({key: pdf["key"].to_numpy(), "cluster_id": labels, "cluster_prob": p.astype(np.float32)})

    return rows.groupBy("g").applyInPandas(run, f"{key} bigint, cluster_id bigint, cluster_prob float")


def _ward(x: np.ndarray, k: int) -> np.ndarray:
    """Chains of nearest neighbours over centres: the merges of the greedy order, in memory of the rows' own size."""
    n = len(x)
    center, size, alive, chain, merges = x.astype(float).copy(), np.ones(n), np.ones(n, dtype=bool), [], []
    while len(merges) < n - 1:
        chain = chain or [int(alive.argmax())]
        while True:
            i = chain[-1]
            d = np.where(alive, size[i] * size / (size[i] + size) * ((center - center[i]) ** 2).sum(1), np.inf)
            d[i] = np.inf
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
                break
            chain.append(j)
        merges.append((d[j], i, j))
        center[j] = (size[i] * center[i] + size[j] * center[j]) / (size[i] + size[j])
        size[j] += size[i]
        alive[i] = False
        del chain[-2:]
    parent = list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(0, n - max(1, k))]:
        parent[root(i)] = root(j)
    return np.unique([root(v) for v in range(n)], return_inverse=True)[1]


def ward(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, cluster_id: Ward's agglomeration to ``k`` clusters, for any number of rows; one task, time as their square."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.lit(0).alias("g"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        return pd.DataFrame({key: pdf["key"].to_numpy(), "cluster_id": _ward(np.stack(pdf["v"].to_list()), k)})

    return rows.groupBy("g").applyInPandas(run, f"{key} bigint, cluster_id bigint")


def run(name: str, df: DataFrame, key: str, vector: str, k: int = 2, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Clustering by name: hdbscan, dbscan, kmeans, agglomerative; ``k`` is at least 2."""
    runs = {
        "hdbscan": lambda: density_clusters(df, key, vector, min_samples).select(key, "cluster_id"),
        "dbscan": lambda: dbscan(df, key, vector, eps, min_samples),
        "kmeans": lambda: k_means(df, key, vector, max(2, k)),
        "agglomerative": lambda: ward(df, key, vector, max(2, k)),
    }
    if name not in runs:
        raise ValueError(f"no clustering named {name}; there are {', '.join(runs)}")
    return runs[name]()


def transferred_k(labels: DataFrame, least: int = 2) -> int:
    """The number of clusters (noise aside) of a density clustering, for those that must be told one; ``least`` at least."""
    return max(least, labels.where("cluster_id >= 0").agg(F.count_distinct("cluster_id")).first()[0])
