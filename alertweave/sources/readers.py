"""Sources: alert files, ground truth, scenarios, tables, maps."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUTH = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("incident_id", "scenario")]
    + [T.StructField("is_benign", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("t_emit", "source", "type")]
    + [T.StructField(n, T.MapType(T.StringType(), T.StringType())) for n in ("entities", "vars")]
)


def ndjson(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """line_no, raw, status (ok, undecodable, bad) of the lines of files of one JSON document a line, strictly UTF-8.

    Blank lines don't count.  Lines are split on bytes, so one that isn't UTF-8 spoils no other.  ``max_lines`` keeps
    the first lines in order of the files.
    """
    lines = spark.read.text(path)  # bytes as they are
    df = lines.where(F.trim("value") != "").select(F.when(F.is_valid_utf8("value"), F.col("value")).alias("raw"), F.monotonically_increasing_id().alias("line_no"))
    ok = F.try_parse_json("raw").isNotNull()
    df = df.select("line_no", "raw", F.when(F.col("raw").isNull(), "undecodable").when(ok, "ok").otherwise("bad").alias("status"))
    return df if max_lines is None else df.orderBy("line_no").limit(max_lines)


def ndjson_counts(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("n_lines"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "undecodable", "bad")))


def ndjson_lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Documents by schema; lines that aren't JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def search(spark: SparkSession, path: str, predicate: Column | None = None) -> DataFrame:
    """Alerts of an exported index; the predicate reaches the scan.  No external connector is part of this package."""
    df = spark.read.parquet(path)
    return df if predicate is None else df.where(predicate)


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH).json(path)


def truth_entities(truth: DataFrame) -> DataFrame:
    """scenario, entity: discriminating values of entities and vars of each incident; numbers of vars don't count."""
    from alertweave.functions.normalize import incident_base
    from alertweave.operators.predicates import is_discriminating, is_number

    base = incident_base(F.col("incident_id")).alias("scenario")
    e = truth.select(base, F.explode(F.map_values("entities")).alias("entity"))
    v = truth.select(base, F.explode(F.map_values("vars")).alias("entity")).where(~is_number(F.col("entity")))
    return e.unionByName(v).where(is_discriminating(F.col("entity"))).distinct()


def scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """doc, incident_id, name, entities, events (offset, source, type, repeat, interval) of a folder of YAML files.

    A few small files, read at the driver in order of name; an unreadable one is skipped.
    """
    import yaml

    rows = []
    for p in sorted(Path(folder).glob("*.y*ml")):
        try:
            d = yaml.safe_load(p.read_text())
            events = [(float(e.get("t_offset", 0)), e.get("source"), e.get("type"), int(e.get("repeat", 1)), float(e.get("repeat_interval", 0))) for e in d.get("events") or []]
            rows.append((p.name, d.get("incident_id"), d.get("name"), {k: str(v) for k, v in (d.get("entities") or {}).items()}, events))
        except (yaml.YAMLError, AttributeError, TypeError, ValueError):
            continue
    return spark.createDataFrame(rows, "doc string, incident_id string, name string, entities map<string,string>, events array<struct<offset:double,source:string,type:string,repeat:int,interval:double>>")


def scenario_rows(events: DataFrame, scale: float = 1.0, split: float = 1000.0) -> DataFrame:
    """doc, pos, lo, hi, count, phase: one interval for each event of a scenario; phase A before ``split`` seconds."""
    e = events.select("doc", F.posexplode("events").alias("pos", "e"))
    lo = F.col("e.offset") * scale
    return e.select("doc", "pos", lo.alias("lo"), (lo + F.greatest(F.lit(0), F.col("e.repeat") - 1) * F.col("e.interval") * scale).alias("hi"), F.col("e.repeat").alias("count"), F.when(F.col("e.offset") < split, "A").otherwise("B").alias("phase"))


def alias_map(spark: SparkSession, path: str) -> DataFrame:
    """canonical, id of a persisted alias map; a broken one is an error, not an empty map."""
    df = spark.read.option("mode", "FAILFAST").schema("canonical string, id bigint").json(path)
    if df.where("canonical is null or id is null").limit(1).count():
        raise ValueError(f"the alias map {path} is corrupt")
    return df


def asset_map(spark: SparkSession, path: str) -> DataFrame:
    """ip, host, source of a persisted asset map; a broken one is an error."""
    df = spark.read.option("mode", "FAILFAST").schema("ip string, host string, source string").json(path)
    if df.where("ip is null or host is null").limit(1).count():
        raise ValueError(f"the asset map {path} is corrupt")
    return df


def next_id(known: DataFrame, declared: int = 0) -> int:
    """The id that the next alias gets: the largest of the declared one, one after the largest known and one after their number."""
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"), F.count("*").alias("n")).first()
    return max(declared, top["m"] + 1, top["n"] + 1)


def counted(df: DataFrame) -> int:
    """The rows that a scan would give, -1 where it fails; a caller ends on 0 or less."""
    from pyspark.errors import PySparkException

    try:
        return df.count()
    except PySparkException:
        return -1


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders right below a path, in order of name, in any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(f.getPath()) for f in fs.listStatus(at) if f.isDirectory())
