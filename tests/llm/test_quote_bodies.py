"""Operator 2's registered SQL, bodies included, on messages with quotes."""

import duckdb
import pandas as pd
from test_mix_quotes_pipeline import MESSAGES

import __spark_entry__


def test_bodies_match_the_registered_sql(spark, tmp_path):
    spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(MESSAGES, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(__spark_entry__.oracle_sql()["op2_quote_threads"])
    got = __spark_entry__.queries()["op2_quote_threads"](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
    assert any(r.parent_turn is not None for r in got.collect())
