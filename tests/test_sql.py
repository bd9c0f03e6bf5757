"""Every query with SQL gives what DuckDB gives on the whole tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import DATA

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NA or x is pd.NaT:
            return "null"
        return f"{float(x):.6g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(one(x) for x in row) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


#: What must hold of the queries that SQL can't say: the table each is of (one row for each of its keys), and a condition on every row.
INVARIANTS = {
    "p6_normalised": (None, "(utc_us is null or status in ('exact', 'inferred')) and confidence between 0 and 1"),
    "connected_components_linked": ("real_alerts_clustered", "component <= node"),
    "louvain_communities": ("real_alerts_clustered", "community <= node"),
    "louvain_strong": ("real_alerts_clustered", "community <= node"),
    "pipeline_communities": ("real_alerts_clustered", "community >= -1"),
    "pipeline_documents": (None, "n_rows > 0 and duration_seconds >= 0 and is_summary = (community_id = -1)"),
    "tau_sweep": (None, "n_ok between 0 and 4 and (recall is null or recall between 0 and 1) and (purity is null or purity between 0 and 1)"),
    "ab_decay": (None, "changed in ('', 'purity', 'recall')"),
    "ami_score": (None, "ami between -1 and 1"),
    "feature_matrix": ("real_alerts_clustered", "indices like '0,1,2,%'"),
    "text_anonymize": ("documents", "true"),
    "triage_prompts": (None, "prompt like '%community_id%'"),
    "kmeans_embeddings": ("embeddings", "cluster_id between 0 and 9"),
    "agglomerative_embeddings": ("embeddings", "cluster_id between 0 and 9"),
    "hdbscan_embeddings": ("embeddings", "cluster_id >= -1 and cluster_prob between 0 and 1"),
    "pca_features": ("embeddings", "size(features) = 8"),
}
CORE = {n for n in set(entry.queries()) - set(SQL) if not (n[0] == "p" and n[1].isdigit()) or n.startswith(("p1_", "p6_"))}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_without_sql(spark, name):
    of, holds = INVARIANTS[name]
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    assert got
    if of:
        assert len(got) == spark.read.parquet(f"{DATA}/{of}.parquet").count() == len({r[0] for r in got})
    assert spark.createDataFrame(got, df.schema).where(f"not coalesce({holds}, false)").count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
