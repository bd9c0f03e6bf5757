"""Features of rows: vocabularies by coverage, multi-hot and one-hot columns, z-scores, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(df: DataFrame, items: Column, k: int, coverage: float = 0.7, k_max: int = 200) -> DataFrame:
    """item, n, rnk: the ``k`` most frequent items, and more until they cover ``coverage`` of all, ``k_max`` at most.

    The running sum goes over the ``max(k, k_max)`` first items only, so the window is bounded whatever the number of
    items is.  Ties go to the smaller item.
    """
    counts = df.select(F.explode(items).alias("item")).where("item is not null and item <> ''").groupBy("item").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    most = max(k, k_max, 1)
    top = counts.orderBy(F.desc("n"), "item").limit(most)
    order = Window.orderBy(F.desc("n"), "item")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = top.withColumns({"rnk": F.row_number().over(order), "before": before}).join(F.broadcast(total))
    return ranked.where((F.col("rnk") <= max(k, 1)) | ((F.col("rnk") <= k_max) & (F.col("before") < F.col("total") * coverage))).select("item", "n", "rnk")


def multi_hot(df: DataFrame, key: str, items: Column, words: DataFrame) -> DataFrame:
    """key, hot (sorted ranks of the vocabulary's items that the row holds): a sparse 0/1 vector."""
    vocab = words.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("item", "rnk"))).alias("v"))  # one row of at most k_max words
    ranks = F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: F.col("v")[x]), lambda r: r.isNotNull())))
    return df.join(F.broadcast(vocab)).select(key, ranks.alias("hot"))


def one_hot(df: DataFrame, c: str, k: int) -> DataFrame:
    """Adds ``c``_hot: the value if among the ``k`` most frequent, else __other__; null is __other__ too."""
    top = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("top")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "top").limit(k).select("top")
    return df.join(F.broadcast(top), F.col(c).cast("string") == F.col("top"), "left").withColumn(f"{c}_hot", F.coalesce("top", F.lit("__other__"))).drop("top")


def z_scores(df: DataFrame, columns: Sequence[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Adds z_NAME: (x - mean) / population deviation, times a weight; a constant column gives 0, null counts as 0."""
    x = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    stats = df.agg(*(f(x(c)).alias(f"{p}_{c}") for c in columns for p, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.join(F.broadcast(stats))
    z = {f"z_{c}": F.when(F.col(f"s_{c}") > 0, (x(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) * (weights or {}).get(c, 1.0) for c in columns}
    return out.withColumns(z).drop(*stats.columns)


def seconds_since_first(df: DataFrame, ts: str, out: str = "t_seconds") -> DataFrame:
    """Adds seconds since the earliest ``ts``; null is 0."""
    first = df.agg(F.min(ts).alias("t_first"))
    return df.join(F.broadcast(first)).withColumn(out, F.coalesce((F.unix_micros(ts) - F.unix_micros("t_first")) / 1_000_000, F.lit(0.0))).drop("t_first")


def projected(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """key, features: the first principal components (0 dims: the vector as it is), in place of a nonlinear embedding."""
    v = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
    if dims == 0:
        return v.select(key, vector_to_array("x").alias("features"))
    return PCA(k=dims, inputCol="x", outputCol="y").fit(v).transform(v).select(key, vector_to_array("y").alias("features"))


def build_features(rows: DataFrame, top_k: int = 30, time_weight: float = 2.0, coverage: float = 0.7, k_max: int = 200, ts: str = "alert_ts") -> DataFrame:
    """row_id, indices, values: one sparse row of the feature matrix for each alert row; its width is :func:`feature_width`.

    Three z-scores (seconds since the first alert, weighted; level; log of the count), one-hot decoders (10) and rules
    (``top_k``), other and null ones together, and multi-hot users, addresses, hosts, rule groups, tactics and techniques
    over vocabularies by coverage.  Vocabularies are small tables that are broadcast.
    """
    from alertweave.functions.normalize import csv_items

    lower = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
    lists = {"usr": lower("entity_users"), "ip": lower("entity_ips"), "host": lower("entity_hosts"), "grp": csv_items(F.col("rule_groups")), "tac": csv_items(F.col("mitre_tactic")), "tec": csv_items(F.col("mitre_technique"))}
    base = seconds_since_first(rows.drop("t_seconds"), ts).withColumns({"level": F.coalesce("rule_level", F.lit(0)).cast("double"), "log_count": F.log1p("count")})
    df = z_scores(base, ["t_seconds", "level", "log_count"], {"t_seconds": time_weight})
    at = 3
    hot = []
    for c, k in (("decoder_name", 10), ("rule_id", top_k)):
        df = _placed(df, rows.where(F.col(c).isNotNull()), F.array(F.col(c).cast("string")), f"v_{c}", k, 1.0, k)
        hot.append(F.array(F.coalesce(F.col(f"v_{c}")[F.col(c).cast("string")], F.lit(k + 1)) + (at - 1)))
        at += k + 1
    rank = lambda c: lambda x: F.col(f"v_{c}")[x]
    shift = lambda by: lambda r: r + by
    for c, items in lists.items():
        df = _placed(df, rows, items, f"v_{c}", top_k, coverage, k_max)
        hot.append(F.transform(F.array_sort(F.array_distinct(F.filter(F.transform(items, rank(c)), lambda r: r.isNotNull()))), shift(at - 1)))
        at += max(top_k, k_max)
    ones = F.flatten(F.array(*hot))
    z = F.array("z_t_seconds", "z_level", "z_log_count")
    return df.select("row_id", F.concat(F.sequence(F.lit(0), F.lit(2)), ones).alias("indices"), F.concat(z, F.transform(ones, lambda _: F.lit(1.0))).alias("values"))


def _placed(df: DataFrame, rows: DataFrame, items: Column, name: str, k: int, coverage: float, k_max: int) -> DataFrame:
    words = vocabulary(rows, items, k, coverage if k_max > k else 0.0, k_max)
    return df.join(F.broadcast(words.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("item", "rnk"))).alias(name))))  # one row of at most k_max words


def feature_width(top_k: int = 30, k_max: int = 200) -> int:
    """Columns of the matrix: three numbers, decoders and rules with their rest, and six vocabularies."""
    return 3 + 11 + top_k + 1 + 6 * max(top_k, k_max)


def dense(features: DataFrame, width: int) -> DataFrame:
    """row_id, features: the sparse rows of :func:`build_features` as arrays of ``width`` numbers."""
    cells = F.map_from_arrays("indices", "values")
    return features.select("row_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(cells[i], F.lit(0.0))).alias("features"))
