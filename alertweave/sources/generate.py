"""Test inputs: scenarios emitted over time, background noise, dedup rows without any sensor."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.functions.normalize import decoder_of, event_entities

#: Events a second of each source of background noise.
RATES = {"palo_alto": 2.0, "vcenter": 0.5, "office365": 1.2, "sentinelone": 0.1, "windows": 0.02}


def _uniform(*parts: str | int) -> Column:
    """A number in [0, 1) that only the parts decide."""
    return F.pmod(F.xxhash64(*(F.col(p) if isinstance(p, str) else F.lit(p) for p in parts)), F.lit(1 << 40)) / float(1 << 40)


def emissions(scenarios: DataFrame, start_us: int, scale: float = 1.0, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """incident_id, scenario, source, type, entities, pos, k, emit_us: every event of every scenario, repeats included, in order.

    Repeat k of an event comes at offset + k * interval, both scaled, and a jitter of at most ``jitter`` seconds.
    """
    e = scenarios.select(F.col("incident_id"), F.col("name").alias("scenario"), "entities", F.posexplode("events").alias("pos", "e"))
    e = e.select("incident_id", "scenario", "entities", "pos", "e.*").withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), "repeat") - 1)))
    at = (F.col("offset") + F.col("k") * F.col("interval")) * scale + _uniform("incident_id", "pos", "k", seed) * jitter
    return e.select("incident_id", "scenario", "source", "type", "entities", "pos", "k", (F.lit(start_us) + F.round(at * 1_000_000).cast("bigint")).alias("emit_us")).orderBy("emit_us", "incident_id", "pos", "k")


def truth(emitted: DataFrame) -> DataFrame:
    """One row of ground truth for each emission that names something: incident, scenario, time, source, type, entities."""
    return emitted.where(F.size("entities") > 0).select("incident_id", "scenario", F.lit(False).alias("is_benign"), F.date_format(F.timestamp_micros("emit_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("t_emit"), "source", "type", "entities")


def noise(spark: SparkSession, start_us: int, seconds: float, rates: Mapping[str, float] = RATES, seed: int = 0) -> DataFrame:
    """source, emit_us: background events of independent Poisson processes over ``seconds`` from ``start_us``.

    The number of events of a second is drawn from the Poisson distribution, and their places in it are uniform: the same
    process as exponential gaps, without a running sum, so seconds are made in any order and place.
    """
    whole = int(seconds) + (seconds > int(seconds))

    def one(source: str, rate: float) -> DataFrame:
        s = spark.range(whole).select(F.col("id").alias("second"), F.lit(source).alias("source"))
        # the smallest n whose distribution function exceeds a uniform number
        most = int(rate + 12 * rate**0.5 + 12)
        terms = [2.718281828459045 ** -rate]
        for n in range(1, most):
            terms.append(terms[-1] * rate / n)
        below = [sum(terms[: n + 1]) for n in range(most)]
        n = functools.reduce(lambda c, x: c + (F.col("u") > F.lit(x)).cast("int"), below, F.lit(0))
        s = s.withColumn("u", _uniform("second", "source", seed)).withColumn("n", n).where("n > 0")
        e = s.withColumn("k", F.explode(F.sequence(F.lit(1), "n")))
        at = F.col("second") + _uniform("second", "source", "k", seed + 1)
        return e.withColumn("at", at).where(F.col("at") < seconds).select("source", (F.lit(start_us) + F.floor(F.col("at") * 1_000_000)).alias("emit_us"))

    return functools.reduce(DataFrame.unionByName, (one(k, r) for k, r in rates.items()))


def dedup_rows(scenarios: DataFrame, scale: float = 1.0, split: float = 1000.0) -> DataFrame:
    """row_id, decoder_name, lo, hi, count, phase, entities: the rows that deduplication would make of each scenario's events.

    Times are seconds from the start; the entities are those of the scenario that the event's source names; phase A before
    ``split`` seconds.
    """
    e = scenarios.select("doc", "entities", F.posexplode("events").alias("pos", "e")).select("doc", "entities", "pos", "e.*")
    lo = F.col("offset") * scale
    hi = lo + F.greatest(F.lit(0), F.col("repeat") - 1) * F.col("interval") * scale
    return e.select(
        F.pmod(F.xxhash64("doc", "pos"), F.lit(1 << 53)).alias("row_id"), decoder_of(F.col("source")).alias("decoder_name"), lo.alias("lo"), hi.alias("hi"), F.greatest(F.lit(1), "repeat").cast("bigint").alias("count"),
        F.when(F.col("offset") < split, "A").otherwise("B").alias("phase"), event_entities(F.col("source"), F.col("entities")).alias("entities"),
    )
