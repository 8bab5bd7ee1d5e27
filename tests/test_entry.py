import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known)
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "cnt"] and df.count() > 0


@pytest.mark.parametrize("name", ["range_count_index", "tree_nodes", "flat_offsets", "routed_counts_range", "search_work"])
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "events", "embeddings", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda it: sorted(map(str, it))
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want.select(*columns).fetchall())
