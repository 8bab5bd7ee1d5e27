"""What only larger tables, or trees as deep as theirs, show."""

import pytest

from tessella.operators import index as ix
from tessella.operators import joins, metrics, placement

RECT = "id long, xmin int, ymin int, xmax int, ymax int"


def grid(spark, n=700):
    return spark.createDataFrame([(i, 10 * (i % 30), 7 * (i // 30), 10 * (i % 30) + i % 13, 7 * (i // 30) + i % 9) for i in range(n)], RECT)


@pytest.mark.parametrize(("leaf", "fanout", "depth"), [(16, 64, 2), (16, 4, 4)])
def test_region_runs_at_any_depth(spark, leaf, fanout, depth):
    index = ix.build(grid(spark), leaf, fanout)
    assert len(index.levels) == depth
    want = {}
    for leaf_ in index.leaves.collect():
        n, *box = want.get(leaf_.node_id // 8, (0, 1 << 40, 1 << 40, -1, -1))
        want[leaf_.node_id // 8] = (n + 1, min(box[0], leaf_.xmin), min(box[1], leaf_.ymin), max(box[2], leaf_.xmax), max(box[3], leaf_.ymax))
    assert {r.l1_id: tuple(r[1:]) for r in joins.region_runs(index, 8).collect()} == want


def test_region_runs_as_registered(spark, tmp_path):
    """328,000 events take a third level of the tree, which sf0.1 doesn't."""
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    con.sql("CREATE TABLE events AS SELECT event_id + 100 * c AS event_id, ts, user_id, value FROM (SELECT * FROM '/root/testdata/sf0.001/events.parquet' WHERE event_id < 100), (SELECT unnest(range(3280)) AS c)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    got = __spark_entry__.queries()["region_runs"](spark, str(tmp_path))
    want = con.sql(__spark_entry__.oracle_sql()["region_runs"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_two_sets_take_more_slots_than_workers(spark):
    slots = spark.createDataFrame([(i,) for i in range(9)], "slot long")
    got = [tuple(r) for r in placement.two_sets(slots, 1, 3, queue=True).orderBy("slot").collect()]
    assert got == [(0, 0, 0), (1, 1, 0)] + [(i, 1, i - 1) for i in range(2, 9)]


def test_work_goes_up_from_a_level_too_large_to_compare(spark, monkeypatch):
    index = ix.build(grid(spark), 4, 3)
    queries = index.objects.filter("id % 7 = 0").selectExpr("id AS qid", "xmin", "ymin", "xmax", "ymax")
    want = metrics.work(queries, index, 99).first()
    assert joins.asked_level(index, 1, 100) == 1 and joins.asked_level(index, 99, 100) == len(index.levels) - 1
    monkeypatch.setattr(joins, "MOST_COMPARED", 100 * index.levels[2])
    assert joins.asked_level(index, 1, 100) == 2 and joins.asked_level(index, 0, 10**9) == len(index.levels) - 1
    assert metrics.work(queries, index, 1).first() == want


def test_trees_of_more_levels_than_the_sql_unrolls(spark):
    """The registered SQL makes eight levels, as many as 18 million objects take; unrolled further it has the root too."""
    import duckdb

    from tessella import catalogue as cat

    objects = grid(spark)
    index = ix.build(objects, 2, 2)
    assert len(index.levels) > 8
    con = duckdb.connect()
    con.register("obj", objects.toArrow())
    made = {"tree_nodes": index.nodes, "node_headers": ix.headers(index), "tree_statistics": ix.statistics(index), "tree_bytes": ix.bytes_used(index), "breadth_first": ix.breadth_first(index), "depth_first": ix.depth_first(index), "flat_offsets": ix.flattened(index)}
    for name, got in made.items():
        want = con.sql(f"WITH RECURSIVE {cat._tree(2, 2, 14)}" + cat.ORACLE_SQL[name].split(cat._tree(), 1)[1])
        columns = sorted(got.columns)
        rows = lambda it: sorted(map(str, it))
        assert rows(map(tuple, got.select(*columns).collect())) == rows(want.select(*columns).fetchall()), name
