"""The top-down grid split down to its leaves, against plain recursion and SQL."""

import math

import duckdb
import pytest

import __spark_entry__
from tessella.operators import index as ix
from tessella.operators import ranks

RECT = "id long, xmin int, ymin int, xmax int, ymax int"


def split(rows, leaf, fanout, path="0"):
    """{id: path} by recursion; a row is (id, cx, cy)."""
    n = len(rows)
    if n <= leaf:
        return {r[0]: path for r in rows}
    k = min(-(-n // leaf), fanout)
    sx, done, start, out = max(1, math.isqrt(k)), 0, 0, {}
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    for s in range(sx):
        size = n // sx + (s < n % sx)
        slab, start = sorted(rows[start : start + size], key=lambda r: (r[2], r[0])), start + size
        g, at = min(max(1, math.floor(size / n * k + 0.5)), fanout - done), 0
        for y in range(g):
            m = size // g + (y < size % g)
            out |= split(slab[at : at + m], leaf, fanout, f"{path}.{done}")
            at, done = at + m, done + 1
    return out


@pytest.mark.parametrize(("n", "leaf", "fanout"), [(0, 16, 8), (16, 16, 8), (700, 16, 8), (700, 3, 7), (300, 1, 2), (700, 5, 30)])
def test_split_until_the_leaf_capacity(spark, n, leaf, fanout):
    rows = [(i, (i * 37) % 211, (i * 53) % 197, (i * 37) % 211 + i % 9, (i * 53) % 197 + i % 5) for i in range(n)]
    leaves = ix.grid_leaves(spark.createDataFrame(rows, RECT), leaf, fanout)
    got = leaves.collect()
    want = split([(r[0], (r[1] + r[3]) // 2, (r[2] + r[4]) // 2) for r in rows], leaf, fanout)
    assert len(got) == n and {r.id: r.path for r in got} == want
    sizes = [r.cnt for r in got]
    assert all(1 <= s <= leaf for s in sizes)


def test_large_groups_are_numbered_by_ranges(spark, monkeypatch):
    rows = [(i, i * 7 % 101, i * 11 % 103, i * 7 % 101 + 2, i * 11 % 103 + 2) for i in range(200)]
    df = spark.createDataFrame(rows, RECT)
    want = sorted(ix.grid_leaves(df, 8, 4).collect())
    monkeypatch.setattr(ix, "ONE_TASK", 60)
    monkeypatch.setattr(ranks, "ONE_TASK", 60)
    assert sorted(ix.grid_leaves(df, 8, 4).collect()) == want


@pytest.mark.parametrize("name", ["grid_split_leaves", "grid_split_nodes"])
def test_matches_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    got = __spark_entry__.queries()[name](spark, sf)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda it: sorted(map(str, it))
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want.select(*columns).fetchall())
