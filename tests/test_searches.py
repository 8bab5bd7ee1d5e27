"""Searches take every row whose id is divisible by 20, and match their SQL."""

import re

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = [
    "range_count_sparse", "range_count_wide", "overlap_pairs", "exists_count", "subtree_counts", "partitioned_counts", "region_hits", "shard_touches", "roofline", "drilled_shards",
    "replicas", "uniform_replicas", "routed_counts_dense", "flat_offsets", "morton_order", "check_per_query", "check_counters", "worker_traffic", "search_traffic_dispersion", "two_sets",
    "even_tasklets", "region_runs", "query_sets", "corner_order", "run_counts", "run_batches", "run_workers", "run_check", "set_estimates",
]


def views():
    con = duckdb.connect()
    for t in ("lineitem", "events", "embeddings", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_query_set(spark):
    n = views().sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    qids = sorted(r.qid for r in __spark_entry__.queries()["sampled_queries"](spark, SF).collect())
    assert qids == list(range(n // 20))
    for name, sql in __spark_entry__.oracle_sql().items():
        if name != "query_sets" and "FROM obj WHERE id %" in sql:
            assert set(re.findall(r"WHERE id % (\d+) = 0", sql)) <= {"20", "10"}, name


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = views().sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda it: sorted(map(str, it))
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want.select(*columns).fetchall())
