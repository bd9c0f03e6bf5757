"""Filling containers of fixed capacity with texts, neighbours in content together.

Each text is a hashed vector of its tokens, projected to a few dimensions; the Hilbert key of its place orders the
corpus so that neighbours on the curve are alike.  The order is split into ranges, and each range is packed by one
task in a stream: a window of neighbours at a time goes into the open containers by best fit, largest first;
containers that are nearly full are closed, the others stay open for the next window.  Only the containers still
open at the end of a range keep space, a handful for some ten thousand texts.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.tokens import _batches, encoder, vocabulary_path
from alertweave.session import materialise

CAPACITY = 2048
DIMENSIONS = 3
BITS = 8  # of a dimension's place on the curve
WINDOW = 1024  # texts packed at a time
OPEN = 64  # containers kept open between windows
RANGE = 20_000  # texts of a range, about


def _signs(n: int) -> np.ndarray:
    """A fixed random direction in each dimension for each token id."""
    x = (np.arange(n * DIMENSIONS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.where((x >> np.uint64(63)).astype(bool), 1.0, -1.0).reshape(n, DIMENSIONS).astype(np.float32)


def measured(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, v (the projection of the text's hashed token vector, of unit length before it)."""
    where = path or vocabulary_path()

    @F.pandas_udf("n int, v array<float>")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(where)
        signs = _signs(len(e.tokens))
        for s in texts:
            n, v = [], []
            for part in _batches(s):
                for ids in e.encode_batch(part):
                    u, c = np.unique(np.array(ids, dtype=np.int64), return_counts=True)
                    w = np.log1p(c)
                    n.append(len(ids))
                    v.append((w @ signs[u] / max(1e-9, np.sqrt(w @ w))).astype(np.float32))
            yield pd.DataFrame({"n": np.array(n, dtype=np.int32), "v": v})

    return documents.select("doc_id", measure("text").alias("m")).select("doc_id", F.col("m.n").alias("n_tokens"), F.col("m.v").alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of integer cells (rows of coordinates below ``2 ** bits``)."""
    x = [c.astype(np.int64).copy() for c in cells.T]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the smaller cubes
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


class Packer:
    """Online packing: windows of sized items into containers of one capacity."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: list[tuple[int, int]] = []  # (space left, container), sorted

    def pack(self, sizes: np.ndarray) -> np.ndarray:
        """A container for each item; best fit, the largest item first, ties in order of arrival."""
        out = np.zeros(len(sizes), dtype=np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            size = int(sizes[i])
            k = bisect.bisect_left(self.open, (size, -1))
            if k == len(self.open):
                space, c = self.capacity, self.next
                self.next += 1
            else:
                space, c = self.open.pop(k)
            out[i] = c
            if space - size > 0:
                bisect.insort(self.open, (space - size, c))
        self.open = self.open[-OPEN:]
        return out


def containers(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """container_id, doc_id, piece, n_tokens: one row for each text, or piece of a text larger than a container.

    Such a text is cut into full containers and a rest (pieces 0, 1, ...).  Null and empty texts have 0 tokens and
    go into any container; repeated doc_ids are packed each; an empty table gives no rows.  No range is one task's
    whole corpus: ranges are of the pair (curve, hash of doc_id), so equal texts are split too.
    """
    docs = materialise(measured(documents, path))
    places = [F.col("v")[i] for i in range(DIMENSIONS)]
    cuts = docs.where(F.col("n_tokens") > 0).select(*(p.alias(f"v{i}") for i, p in enumerate(places)))
    grid = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    edges = [np.array(q) for q in cuts.approxQuantile(cuts.columns, grid, 0.002)]  # DIMENSIONS x 255 numbers
    total = docs.count()
    ranges = max(1, total // RANGE)

    @F.pandas_udf("bigint")
    def place(v: pd.Series) -> pd.Series:
        m = np.array([np.asarray(x) for x in v], dtype=np.float64).reshape(len(v), DIMENSIONS)
        cells = np.stack([np.searchsorted(edges[i], m[:, i], side="right") if len(edges[i]) else np.zeros(len(v), dtype=np.int64) for i in range(DIMENSIONS)], axis=1)
        return pd.Series(hilbert_keys(cells, BITS))

    size = F.col("n_tokens")
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / capacity).cast("int") - 1)),
        lambda i: F.struct(i.cast("int").alias("piece"), F.least(F.lit(capacity), size - i * capacity).cast("int").alias("n_tokens")),
    )
    items = docs.select("doc_id", place("v").alias("key"), F.inline(pieces)).withColumn("h", F.xxhash64("doc_id"))
    ordered = items.repartitionByRange(ranges, "key", "h").sortWithinPartitions("key", "h", "doc_id", "piece")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        p = Packer(capacity, TaskContext.get().partitionId() << 40)
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            df = pd.concat(held, ignore_index=True)
            held.clear()
            return pd.DataFrame({"container_id": p.pack(df["n_tokens"].to_numpy()), "doc_id": df["doc_id"], "piece": df["piece"], "n_tokens": df["n_tokens"]})

        for b in batches:
            for at in range(0, len(b), WINDOW):
                held.append(b.iloc[at : at + WINDOW])
                if sum(map(len, held)) >= WINDOW:
                    yield flush()
        if held:
            yield flush()

    return ordered.select("doc_id", "piece", "n_tokens").mapInPandas(fill, "container_id bigint, doc_id bigint, piece int, n_tokens int")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, and the share of the space that is filled."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return each.agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"), F.max("used").alias("most")).withColumn(
        "filled", F.round(F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity), 6)
    )
