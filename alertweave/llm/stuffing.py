"""Keyword-stuffed pages, link lists and product tags.

The five-word phrases of every page's whole text are exploded and the distinct hosts of each counted.  A phrase on
several hosts is replicated, and what it is shows in the pages that carry it: its list density is the mean over its
hosts of the mean over their pages.  As far as a page is stitched from replicated phrases their density decides;
what is left of it is judged by its own structure.

Structure knows no language.  A sentence ends with a full stop, question or exclamation mark, has a stretch of some
words between separators, and doesn't say the same words again; what is left, links included, is list.  A text
whose words are few and come again and again (Simpson's concentration) is a list too, whatever its punctuation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.functions.barrier import settle
from alertweave.session import materialise

WORDS = 5  # of a phrase
HOSTS = 3  # a phrase on as many hosts is replicated
LEAST_WORDS = 8  # fewer words are no page
SENTENCE, STRETCH, VARIED = 5, 4, 0.6  # words of a sentence, of its longest stretch; share of different words in it
CONCENTRATED = (0.04, 0.08)  # chance that two words of a text are one: running text stays below, lists of a few terms above
SHRINK = 20  # words that say nothing of the concentration yet
SCORE = 0.55

#: Words are letters alone: what holds digits (addresses, hashes, numbers) is none.
_WORDS = re.compile(r"\b[^\W\d_]+\b").findall
_LINKS = re.compile(r"(?:https?://|www\.)\S+|<[^>\n]*>|\[[^\]\n]*\]\([^)\n]*\)|#\S+|(?<!\S)\S+ dot \w+")
_CUT = re.compile(r"[\n\r ]+|(?<=[.!?…。])[\"'”’)\]]*\s+").split
_SEPARATED = re.compile(r"[;|·•→»]|[,/:>\-–—]\s").split
_ENDED = re.compile(r"[.!?…。][\"'”’)\]\s]*$").search
#: Names: what joins letters by dots, slashes, at signs or underscores.
_NAME = re.compile(r"\w[.@\\/_]\w").search
#: A line break before a small letter wraps a sentence.
_WRAP = re.compile(r"[\n\r ]+(?=[^\W\d_])")


def read_page(text: str | None) -> tuple[int, int, float, str]:
    """Words of the text, words of its sentences, the concentration of its words, and the words that phrases are made of."""
    if not text:
        return 0, 0, 0.0, ""
    text = _WRAP.sub(lambda m: " " if text[m.end()].islower() else "\n", text).lower()
    counts = Counter(_WORDS(text))
    total = counts.total()
    if not total:
        return 0, 0, 0.0, ""
    prose = 0
    seen: set[str] = set()
    for segment in _CUT(_LINKS.sub(" ", text)):
        words = _WORDS(segment)
        if len(words) < SENTENCE or not _ENDED(segment) or len(set(words)) < VARIED * len(words):
            continue
        key = " ".join(words)
        if key not in seen and max(len(_WORDS(p)) for p in _SEPARATED(segment)) >= STRETCH:
            seen.add(key)
            prose += len(words)
    same = sum(v * (v - 1) for v in counts.values()) / max(1, total * (total - 1)) * total / (total + SHRINK)
    return total, prose, same, " ".join(_WORDS(" ".join(t for t in text.split() if not _NAME(t))))


def pages(documents: DataFrame) -> DataFrame:
    """doc_id, host, words, list_density, phrases (64-bit, each once): one row for each document."""

    @F.pandas_udf("words int, prose int, same double, plain string")
    def parse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([read_page(t if isinstance(t, str) else None) for t in s], columns=["words", "prose", "same", "plain"])

    df = documents.select("doc_id", F.xxhash64("source").alias("h"), F.col("source").isNotNull().alias("known"), parse("text").alias("p"))
    df = settle(df, said=F.when(F.col("p.plain") != "", F.split("p.plain", " ")).otherwise(F.array().cast("array<string>")))
    low, high = CONCENTRATED
    listed = F.when(F.col("p.words") > 0, 1 - F.col("p.prose") / F.col("p.words")).otherwise(0.0)
    density = F.greatest(listed, F.least(F.lit(1.0), (F.col("p.same") - low) / (high - low)))
    shingle = lambda i: F.xxhash64(F.slice("said", i, WORDS))
    phrases = F.when(F.size("said") >= WORDS, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("said") - WORDS + 1), shingle))).otherwise(F.array().cast("array<bigint>"))
    return df.select("doc_id", F.when(F.col("known"), F.col("h")).alias("host"), "p.words", density.cast("float").alias("list_density"), phrases.alias("phrases"))


def replicated(pages_: DataFrame, hosts: int = HOSTS) -> DataFrame:
    """phrase, phrase_density: phrases on at least ``hosts`` distinct hosts (null is no host).

    (phrase, host) is made one row before hosts are counted, both combined on the map side, so a phrase of a third
    of all pages costs its task no more than its hosts.  The density is the mean over the phrase's hosts of the mean
    over their pages, so that no host outweighs others by repeats.
    """
    long = pages_.where(F.col("host").isNotNull()).select(F.explode("phrases").alias("phrase"), "host", "list_density")
    by_host = long.groupBy("phrase", "host").agg(F.avg("list_density").alias("list_density"))
    return by_host.groupBy("phrase").agg(F.count("*").alias("hosts"), F.avg("list_density").alias("phrase_density")).where(F.col("hosts") >= hosts).drop("hosts")


def scored(documents: DataFrame, hosts: int = HOSTS) -> DataFrame:
    """doc_id, words, list_density, stitched, phrase_density, score: one row for each document row.

    ``stitched`` is the share of the page that replicated phrases make up (words in links and names are in none),
    ``phrase_density`` the mean density of those; the score weighs it by ``stitched`` and the page's own density by
    the rest.  Null, empty and blank texts
    have 0 words and score 0; every repeat of a text has the same score; a text of fewer than five words has no
    phrases.  A phrase on very many pages is one row on the other side of the join, and Spark splits such a
    partition of the pages' side.
    """
    p = materialise(pages(documents).withColumn("row", F.monotonically_increasing_id()))
    met = p.select("row", F.explode("phrases").alias("phrase")).join(replicated(p, hosts), "phrase")
    marked = met.groupBy("row").agg(F.count("*").alias("hit"), F.avg("phrase_density").alias("phrase_density"))
    df = p.select("row", "doc_id", "words", F.col("list_density").cast("double").alias("list_density")).join(marked, "row", "left")
    stitched = F.coalesce("hit", F.lit(0)) / F.greatest(F.lit(1), F.col("words") - WORDS + 1)
    score = F.col("stitched") * F.coalesce("phrase_density", F.lit(0.0)) + (1 - F.col("stitched")) * F.col("list_density")
    df = df.withColumn("stitched", stitched)
    return df.select("doc_id", "words", "list_density", "stitched", "phrase_density", F.when(F.col("words") >= LEAST_WORDS, score).otherwise(0.0).alias("score"))


def found(documents: DataFrame, least: float = SCORE) -> DataFrame:
    """doc_id of the pages whose score is at least ``least``."""
    return scored(documents).where(F.col("score") >= least).select("doc_id")
