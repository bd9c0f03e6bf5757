"""Sinks: tables, metrics, documents, external writers."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replaces a stage's output (parquet, csv with header, or json)."""
    w = df.write.mode("overwrite")
    (w.option("header", True) if form == "csv" else w).format(form).save(path)


def append_csv(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Appends metrics; each write adds files with its own header, and :func:`appended_csv` reads the union of all columns.

    Nothing is rewritten or renamed, so any shared store will do.
    """
    df.coalesce(1).write.mode("append").option("header", True).csv(f"{path}/columns={'+'.join(df.columns)}")


def appended_csv(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were appended, as text, with the union of their columns."""
    from alertweave.sources.readers import folders

    parts = [spark.read.option("header", True).csv(p) for p in folders(spark, path)]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def documents(df: DataFrame, path: str, key: str, index: DataFrame | None = None) -> None:
    """One folder of JSON for each value of ``key``; ``index`` goes beside them into _index."""
    df.write.mode("overwrite").partitionBy(key).json(path)
    if index is not None:
        index.coalesce(1).write.mode("overwrite").json(f"{path}/_index")


def log_append(df: DataFrame, paths: dict[str, str], source: str = "source", line: str = "line") -> None:
    """Appends the lines of each source to the folder registered for it; a source that isn't registered is an error."""
    unknown = df.where(~F.coalesce(F.col(source).isin(*paths), F.lit(False))).select(source).limit(1).collect()
    if unknown:
        raise KeyError(unknown[0][0])
    for name, path in paths.items():
        df.where(F.col(source) == name).select(F.col(line).alias("value")).write.mode("append").text(path)


def report(df: DataFrame, path: str, rows: int = 50) -> str:
    """The first rows as a text table, written to ``path`` and returned for the screen."""
    names, top = df.columns, df.limit(rows).collect()
    text = "\n".join("\t".join("" if x is None else str(x) for x in r) for r in [names, *top])
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def declared_table(df: DataFrame, name: str, schema: str, recreate: bool = False) -> None:
    """Into a table of a declared schema; ``recreate`` drops it first."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    out = df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    out.write.mode("overwrite" if recreate else "append").saveAsTable(name)


def bulk(df: DataFrame, send: Callable[[list[dict]], list[bool]], size: int = 500) -> DataFrame:
    """n_ok, n_failed: rows sent in batches by ``send`` on the executors, which tells which ones were taken."""

    def run(batches):
        import pandas as pd

        ok = bad = 0
        for b in batches:
            rows = b.to_dict("records")
            for i in range(0, len(rows), size):
                taken = send(rows[i : i + size])
                ok, bad = ok + sum(taken), bad + len(taken) - sum(taken)
        yield pd.DataFrame({"n_ok": [ok], "n_failed": [bad]})

    return df.mapInPandas(run, "n_ok bigint, n_failed bigint").agg(F.sum("n_ok").alias("n_ok"), F.sum("n_failed").alias("n_failed"))


def persist_private(text: str, path: str) -> None:
    """Replaces a small file at once (new file, then rename), readable by its owner only."""
    new = f"{path}.new"
    fd = os.open(new, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with os.fdopen(fd, "w") as f:
        f.write(text)
    os.replace(new, path)
