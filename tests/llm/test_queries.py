"""What must hold of the llm queries that SQL can't say, on the whole tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from alertweave.llm import tokens
from conftest import DATA


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: entry.queries()[name](spark, DATA)


def of(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_matches_hold_the_found_ones(spark, run):
    m = run("p2_matches")
    assert m.where("not (confidence between 0 and 1)").count() == 0 and m.groupBy("row_id", "asset_id").count().where("count > 1").count() == 0
    assert m.where("(confidence >= 0.5) <> (agree >= 2)").count() == 0


def test_waves(spark, run):
    w = run("p4_waves")
    assert w.where("size < 3 or n_nodes > size or rank > 3 or affinity < 0").count() == 0 and w.count() > 0
    assert w.groupBy("cluster_row_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m <> n").count() == 0


def test_ids_and_containers(spark, run):
    docs, ids = of(spark, "documents"), run("p7_ids")
    assert ids.count() == docs.count() == ids.select("doc_id").distinct().count()
    assert ids.join(docs, "doc_id").where("(coalesce(text, '') = '') <> (size(ids) = 0)").count() == 0
    c = run("p8_containers")
    assert c.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 2048").count() == 0
    assert c.groupBy("doc_id", "piece").count().where("count > 1").count() == 0
    packed = c.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    wrong = packed.join(ids, "doc_id", "full").where("not coalesce(n = size(ids) and pieces = greatest(1, ceil(n / 2048)), false)")
    assert wrong.count() == 0
    f = run("p8_fill").first()
    assert f.n_tokens == ids.select(F.sum(F.size("ids"))).first()[0] and f.n_containers <= -(-f.n_tokens // 2048) + 1
    assert docs.select(F.sum(tokens.count_of(F.col("text")))).first()[0] == f.n_tokens


def test_scores_of_repeats(spark, run):
    docs, s = of(spark, "documents").select("doc_id", "text"), run("p9_scored")
    assert s.count() == docs.count() and s.where("not (score between 0 and 1 and stitched between 0 and 1)").count() == 0
    per = s.join(docs, "doc_id").where("text is not null").groupBy("text").agg(F.max("score").alias("hi"), F.min("score").alias("lo"))
    assert per.where("hi - lo > 1e-6").count() == 0
    assert {r.doc_id for r in run("p9_found").collect()} == {r.doc_id for r in s.where("score >= 0.55").collect()}
