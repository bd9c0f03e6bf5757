"""Similar pairs of sets: sorted forests of minhash sketches.

Sets are lists of 64-bit tokens.  Equal sets collapse into one class first.  Each tree has its own minhash
signature, packed into one number so that its order is the lexicographic order of the signature's values.  A
neighbourhood is a run of that order with a common prefix of ``depth`` values, and all pairs of a neighbourhood are
candidates.  The number of trees follows from the depth and the asked recall at the threshold: a pair of similarity
s shares a prefix in one tree with probability s**depth.  Neighbourhoods with too many classes are deepened value by
value: their classes form a smaller forest whose trees go on with the same values and one more, with as many more
trees as the recall then needs.  What is still too large at the last depth is compared block by block, so nothing is
dropped.  Candidates are verified by their exact Jaccard similarity.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions.arrays import entries
from alertweave.session import materialise

RECALL = 1 - 1e-6  # of a pair just at the threshold
FULL = 512  # classes of a neighbourhood that are compared at once
DEEPEST = 8  # values of a signature at most; a number holds 8 bits of each then


def tokens(alerts: DataFrame, arrays: dict[str, str]) -> Column:
    """Sorted 64-bit tokens of the entries of some array columns, kinds kept apart."""

    def of(kind: str, column: str) -> Column:
        return F.transform(entries(F.col(column)), lambda x: F.xxhash64(F.lit(kind), x))

    return F.array_sort(F.array_distinct(F.concat(*(of(k, c) for k, c in arrays.items()))))


def trees_for(threshold: float, depth: int, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # the multipliers of splitmix64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def signatures(toks: pd.Series, depth: int, trees: int) -> list[np.ndarray]:
    """For each set its signature in each tree: ``depth`` minhash values, the first in the highest bits.

    Value j of tree t is the same function at every depth.  The top bit is turned, so that signed numbers sort as
    the signatures do.
    """
    n = len(toks)
    sizes = toks.map(len).to_numpy()
    flat = np.concatenate([*toks.to_numpy(), np.zeros(0, dtype=np.int64)]).astype(np.int64).view(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
    out = np.zeros((n, trees), dtype=np.uint64)
    bits = np.uint64(64 // depth)
    if n:
        with np.errstate(over="ignore"):
            for t in range(trees):
                for j in range(depth):
                    least = np.minimum.reduceat(_mix(flat ^ _mix(np.array([t * 64 + j + 1], dtype=np.uint64))[0]), starts)
                    # the least of many hashes is small, so it is mixed again before its bits are taken
                    out[:, t] = (out[:, t] << bits) | (_mix(least) >> (np.uint64(64) - bits))
    return list((out << np.uint64(64 - int(bits) * depth) ^ np.uint64(1 << 63)).view(np.int64))


def _grown(classes: DataFrame, threshold: float, depth: int) -> DataFrame:
    """tree, prefix, cid: every class in every tree."""
    trees = trees_for(threshold, depth)

    @F.pandas_udf("array<bigint>")
    def sketch(toks: pd.Series) -> pd.Series:
        return pd.Series(signatures(toks, depth, trees))

    return materialise(classes.select("cid", F.posexplode(sketch("toks")).alias("tree", "prefix")))


def _runs(grown: DataFrame) -> DataFrame:
    return grown.groupBy("tree", "prefix").agg(F.count("*").alias("n"))


def _neighbours(grown: DataFrame, full: DataFrame) -> DataFrame:
    """a, b: pairs of classes of neighbourhoods that aren't full."""
    small = grown.join(full, ["tree", "prefix"], "left_anti").groupBy("tree", "prefix").agg(F.array_sort(F.collect_list("cid")).alias("ids"))
    first = small.where(F.size("ids") > 1).select("ids", F.posexplode("ids").alias("i", "a"))
    return first.select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))


def _blocks(grown: DataFrame, full: DataFrame) -> DataFrame:
    """a, b: pairs of classes of full neighbourhoods, block against block."""
    size = F.ceil(F.col("n") / FULL).cast("int")
    rows = grown.join(full, ["tree", "prefix"]).select("tree", "prefix", "cid", size.alias("blocks"), F.pmod(F.xxhash64("cid"), size).cast("int").alias("mine"))
    left = rows.select("tree", "prefix", F.col("cid").alias("a0"), F.col("mine").alias("p"), F.explode(F.sequence("mine", F.col("blocks") - 1)).alias("q"))
    right = rows.select("tree", "prefix", F.col("cid").alias("b0"), F.col("mine").alias("q"), F.explode(F.sequence(F.lit(0), "mine")).alias("p"))
    met = left.join(right, ["tree", "prefix", "p", "q"]).where((F.col("p") != F.col("q")) | (F.col("a0") < F.col("b0")))
    return met.select(F.least("a0", "b0").alias("a"), F.greatest("a0", "b0").alias("b"))


def similar_classes(classes: DataFrame, threshold: float, depth: int, deepest: int = DEEPEST) -> DataFrame:
    """a, b, similarity: pairs of ``classes`` (cid, toks: sorted distinct tokens) whose Jaccard similarity is at least ``threshold``.

    a < b.  Classes with an empty or null set pair with nothing; an empty table gives no pairs.  A pair at the
    threshold is found with probability RECALL, a more similar one with more.
    """
    classes = classes.where(F.size("toks") > 0)
    grown = _grown(classes, threshold, depth)
    met = []
    while True:
        full = materialise(_runs(grown).where(F.col("n") > FULL))
        met.append(_neighbours(grown, full))
        if full.isEmpty():
            break
        if depth == deepest:
            met.append(_blocks(grown, full))
            break
        depth += 1
        crowded = classes.join(grown.join(full, ["tree", "prefix"]).select("cid").distinct(), "cid", "left_semi")
        grown = _grown(crowded, threshold, depth)
    pairs = functools.reduce(DataFrame.unionByName, met).distinct()
    left, right = classes.select(F.col("cid").alias("a"), F.col("toks").alias("ta")), classes.select(F.col("cid").alias("b"), F.col("toks").alias("tb"))
    met = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    union = F.size("ta") + F.size("tb") - F.col("shared")
    # whole numbers, so that a pair just at the threshold counts
    enough = F.col("shared") * 1000 >= union * round(threshold * 1000)
    return met.where(enough).select("a", "b", (F.col("shared") / union).alias("similarity"))
