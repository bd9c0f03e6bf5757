"""Session construction and the few run-time services operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "alertweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; ``conf`` entries override the defaults.

    On a cluster shuffles start with many partitions, which adaptive execution joins where they are small.
    """
    cores = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.appName(app).master(master or f"local[{cores}]")
    defaults = {
        "spark.sql.shuffle.partitions": cores if (master or "local").startswith("local") else "4000",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the Python workers of every executor this package, once for each session."""
    sc = spark.sparkContext
    if getattr(sc, "_alertweave", False):
        return
    root = Path(__file__).parent
    to = Path(tempfile.mkdtemp(prefix="alertweave-")) / "alertweave.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._alertweave = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    The folder named in the session is used as it is; only where none is set (tests, local mode) a
    temporary one is chosen.  Files are reliable across executor loss, unlike ``localCheckpoint``.  A checkpoint
    counts its rows first and computes them a second time to write them, so they are held until it is written.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="alertweave-"))
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.select("*").checkpoint(eager=True)
    finally:
        held.unpersist()


def release(spark: SparkSession) -> None:
    """Remove the shuffle files that no DataFrame uses any more.

    Spark's cleaner learns of them when Python's and then the JVM's garbage is collected, which may be long after the disk
    is full.  For the time between large jobs, since it takes seconds.
    """
    for _ in range(2):  # what the first collection frees may hold others
        gc.collect()
        time.sleep(1.2)  # once a second the JVM is told what Python has dropped
        spark.sparkContext._jvm.System.gc()
