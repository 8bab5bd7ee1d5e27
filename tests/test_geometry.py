import pytest

from tessella.functions import geometry as g
from tessella.operators import batching
from tessella.operators import index as ix
from tessella.operators import joins, placement, verify
from tessella.plans.planner import range_count
from tessella.sources import rects

RECT = "id long, xmin int, ymin int, xmax int, ymax int"
QUERY = "qid long, xmin int, ymin int, xmax int, ymax int"
TOP = 2147483647


@pytest.mark.parametrize(
    ("a", "b", "hit"),
    [
        ((0, 0, 10, 10), (10, 0, 20, 10), 1),
        ((0, 0, 10, 10), (10, 10, 20, 20), 1),
        ((0, 0, 10, 10), (11, 0, 20, 10), 0),
        ((0, 0, 10, 10), (5, 5, 5, 5), 1),
        ((5, 5, 5, 5), (5, 5, 5, 5), 1),
        ((0, 0, 10, 10), (2, 2, 3, 3), 1),
        ((-10, -10, -5, -5), (-5, -5, 0, 0), 1),
        ((-TOP - 1, -TOP - 1, TOP, TOP), (7, 7, 8, 8), 1),
    ],
)
def test_closed_overlap(spark, a, b, hit):
    objects, queries = spark.createDataFrame([(1, *a)], RECT), spark.createDataFrame([(0, *b)], QUERY)
    for strategy in ("nested", "index"):
        assert [r.cnt for r in range_count(queries, objects, strategy).collect()] == [hit]


def test_empty_inputs(spark):
    none, some = spark.createDataFrame([], RECT), spark.createDataFrame([(1, 0, 0, 1, 1)], RECT)
    query = spark.createDataFrame([(0, 0, 0, 1, 1)], QUERY)
    assert range_count(query, none, "nested").collect()[0].cnt == 0
    assert ix.build(none).nodes.count() == 0
    assert range_count(spark.createDataFrame([], QUERY), some, "index").count() == 0


def test_centre_truncates_toward_zero_in_64_bits(spark):
    rows = spark.createDataFrame([(-3, 0), (3, 0), (TOP, TOP), (-TOP - 1, -TOP - 1)], "a int, b int")
    assert [r.c for r in rows.select(g.centre("a", "b").alias("c")).collect()] == [-1, 1, TOP, -TOP - 1]


def test_morton_code(spark):
    rows = spark.createDataFrame([(1, 0), (0, 1), (3, 5), (65535, 65535), (65536, 0)], "x long, y long")
    want = [1, 2, 0b100111, -1, 0]
    assert [r.z for r in rows.select(g.morton(rows.x, rows.y).alias("z")).collect()] == want


@pytest.mark.parametrize(("n", "levels"), [(999_709, [7832, 4, 1]), (8_419_312, [65_792, 30, 1]), (500, [4, 1]), (60_000, [484, 1]), (600_000, [4692, 2, 1])])
def test_shape_follows_from_the_count(n, levels):
    assert ix.shape(n) == levels


def test_small_shapes():
    assert ix.shape(60_000, 16, 8) == [3781, 484, 64, 9, 2, 1]
    assert ix.shape(500, 16, 8) == [35, 6, 1]


def _grid(spark, n=700):
    rows = [(i, (i * 37) % 211, (i * 53) % 197, (i * 37) % 211 + i % 9, (i * 53) % 197 + i % 5) for i in range(n)]
    return spark.createDataFrame(rows, RECT)


def test_index_structure(spark):
    index = ix.build(_grid(spark), 16, 4)
    nodes = {r.node_id: r for r in index.nodes.collect()}
    assert [sum(r.level == k for r in nodes.values()) for k in range(len(index.levels))] == index.levels
    for r in nodes.values():
        if r.parent_id is not None:
            p = nodes[r.parent_id]
            assert p.xmin <= r.xmin and p.ymin <= r.ymin and p.xmax >= r.xmax and p.ymax >= r.ymax
        assert 1 <= r.cnt <= (16 if r.is_leaf else 4)
    assert index.objects.select("id").distinct().count() == 700


def test_large_levels_are_built_as_small_ones(spark, monkeypatch):
    from tessella.operators import ranks

    want = sorted(ix.build(_grid(spark), 4, 3).nodes.collect())
    for module in (ix, ranks):
        monkeypatch.setattr(module, "ONE_TASK", 20)
    index = ix.build(_grid(spark), 4, 3)
    assert sorted(index.nodes.collect()) == want
    monkeypatch.setattr(ranks, "ONE_TASK", 30)
    flat = sorted(ix.flattened(index).collect())
    monkeypatch.undo()
    assert flat == sorted(ix.flattened(ix.build(_grid(spark), 4, 3)).collect())


def test_a_written_index_answers_as_the_built_one(spark, tmp_path):
    objects = _grid(spark)
    queries = rects.sampled_queries(objects, 7)
    index = ix.build(objects, 16, 4)
    index.write(str(tmp_path / "index"))
    back = ix.Index.read(spark, str(tmp_path / "index"))
    assert (back.levels, back.leaf, back.fanout) == (index.levels, 16, 4)
    assert sorted(back.nodes.collect(), key=str) == sorted(index.nodes.collect(), key=str)
    assert sorted(joins.counts_dense(queries, back).collect()) == sorted(joins.counts_nested(queries, objects).collect())


def test_work_does_not_depend_on_the_level_it_starts_from(spark):
    from tessella.operators import metrics

    objects = _grid(spark)
    queries, index = rects.sampled_queries(objects, 7), ix.build(objects, 16, 4)
    rows = [metrics.work(queries, index, k).first() for k in range(len(index.levels))]
    assert len(set(rows)) == 1
    equal = verify.counters_equal(metrics.work(queries, index, 0), metrics.work(queries, index, 9)).collect()
    assert len(equal) == 5 and all(r.equal for r in equal)


@pytest.mark.parametrize("change", [{}, {"replicate": False}, {"route": "range", "hot": 0, "work": "combined"}, {"dense_route": True, "dense": False, "check": False}])
def test_whole_run(spark, tmp_path, change):
    from tessella.plans.run import Config, run, write_log

    objects = _grid(spark)
    queries = rects.sampled_queries(objects, 7)
    config = Config(leaf=16, fanout=4, workers=60, shard_cap=2, block=64, launch=40, logical=7, **change)
    made = run(queries, objects, config)
    want = {r.qid: r.cnt for r in joins.counts_nested(queries, objects).collect() if r.cnt or config.dense}
    assert {r.qid: r.cnt for r in made.counts.collect()} == want
    if config.check:
        assert made.check.first()[1:] == (0, 0)
    summary = made.summary.first()
    assert summary.overlaps == sum(want.values()) and (summary.slots == 60) == config.replicate
    batches = made.batches.collect()
    assert sum(r.queries for r in batches) == 100 and sum(r.overlaps for r in batches) == summary.overlaps and len(batches) == 3
    write_log(spark, str(tmp_path / "log"), made, data="grid", seconds=1.5)
    assert spark.read.parquet(str(tmp_path / "log/workers")).count() == summary.slots
    assert spark.read.json(str(tmp_path / "log/records")).first().data == "grid"


def test_run_of_nothing(spark):
    from tessella.plans.run import Config, run

    objects, queries = spark.createDataFrame([], RECT), spark.createDataFrame([(0, 0, 0, 1, 1)], QUERY)
    made = run(queries, objects, Config(workers=4))
    assert [tuple(r) for r in made.counts.collect()] == [(0, 0)] and made.check.first().mismatches == 0
    assert run(spark.createDataFrame([], QUERY), _grid(spark, 50), Config(leaf=16, fanout=4, workers=4)).counts.count() == 0


def test_settings_by_name():
    from tessella.plans.run import Config

    assert Config.of({"TESSELLA_WORKERS": "64", "TESSELLA_REPLICATE": "0", "TESSELLA_ROUTE": "range", "OTHER": "x"}) == Config(workers=64, replicate=False, route="range")
    for bad in ({"TESSELLA_NOTHING": "1"}, {"TESSELLA_WORKERS": "x"}, {"TESSELLA_CHECK": "maybe"}):
        with pytest.raises(ValueError):
            Config.of(bad)


def test_two_sets_of_unequal_size(spark):
    slots = spark.createDataFrame([(i,) for i in range(9)], "slot long")
    got = [tuple(r) for r in placement.two_sets(slots, 3, 7).orderBy("slot").collect()]
    assert got == [(0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 0, 2), (5, 1, 2), (6, 1, 3), (7, 1, 4), (8, 1, 5)]
    assert [r.set_no for r in placement.two_sets(slots, 8, 1).orderBy("slot").collect()] == [0, 1] + [0] * 7
    with pytest.raises(ValueError):
        placement.two_sets(slots, 4, 4)


def test_catalogue_of_a_folder(spark, tmp_path):
    rects.write_csv(spark.createDataFrame([(0, 0, 2, 2), (5, 5, 6, 6)], "xmin int, ymin int, xmax int, ymax int").coalesce(1), str(tmp_path / "a.csv"))
    rects.write_csv(spark.createDataFrame([(0, 0, 1, 1)], "xmin int, ymin int, xmax int, ymax int").coalesce(1), str(tmp_path / "a_50.csv"))
    known = rects.Catalogue.of_folder(str(tmp_path), ["a"], ["50"])
    assert known.objects(spark, "a").count() == 2 and known.query_set(spark, "a", "50").count() == 1
    assert known.register(spark) == ["objects_a", "queries_a_50"]
    assert spark.sql("SELECT count(*) FROM queries_a_50 q JOIN objects_a o ON q.xmin <= o.xmax AND q.xmax >= o.xmin AND q.ymin <= o.ymax AND q.ymax >= o.ymin").first()[0] == 1
    with pytest.raises(KeyError):
        known.query_set(spark, "a", "75")


def test_a_cluster_without_a_shared_folder_is_an_error():
    from tessella.storage import shared_folder

    class Nothing:
        def isDefined(self):
            return False

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://x:7077", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("I", (), {"getCheckpointDir": staticmethod(Nothing)}))})})

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(Fake)


def test_plans_agree(spark):
    objects = _grid(spark)
    queries = rects.sampled_queries(objects, 7)
    want = {r.qid: r.cnt for r in joins.counts_nested(queries, objects).collect()}
    index = ix.build(objects, 16, 4)
    for k in range(len(index.levels)):
        assert {r.qid: r.cnt for r in joins.counts_dense(queries, index, from_level=k).collect()} == want
    shards = placement.base_shards(joins.leaves_of_regions(index), 2)
    table = placement.shard_table(shards, joins.region_hits(queries, index))
    for policy in ("uniform", "query", "data", "combined"):
        slots = placement.slots(placement.replicas(placement.scored(table, policy), 60))
        for how in ("block", "range"):
            part = batching.routed_counts(joins.leaf_candidates(queries, index), index.objects, shards, slots, queries.count(), how, 8)
            check = verify.per_query(joins.with_zeros(queries, joins.merged(part)), joins.counts_nested(queries, objects)).first()
            assert (check.mismatches, check.abs_diff) == (0, 0)


def test_replicas_equal_the_greedy_rule(spark):
    work = [7, 7, 0, 31, 12, 1]
    shards = spark.createDataFrame(list(enumerate(work)), "shard long, work long")
    have = [1] * len(work)
    for _ in range(14):
        s = max(range(len(work)), key=lambda i: (work[i] / have[i], -have[i], -i))
        have[s] += 1
    assert [r.replicas for r in placement.replicas(shards, 20).orderBy("shard").collect()] == have
    assert {r.replicas for r in placement.replicas(shards, 20, replicate=False).collect()} == {1}
    assert [r.replicas for r in placement.uniform_replicas(shards, 20).orderBy("shard").collect()] == [4, 4, 3, 3, 3, 3]


def test_row_numbers_by_ranges_equal_one_window(spark, monkeypatch):
    from tessella.operators import ranks

    df = _grid(spark).select("id", "xmin")
    want = {r.id: r.no for r in ranks.global_row_number(df, ["xmin", "id"], "no").collect()}
    monkeypatch.setattr(ranks, "ONE_TASK", 100)
    for few in (64, 2):
        monkeypatch.setattr(ranks, "FEW_RANGES", few)
        assert {r.id: r.no for r in ranks.global_row_number(df, ["xmin", "id"], "no").collect()} == want


def test_csv_sources(spark, tmp_path):
    good, bad, empty = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.csv"
    good.write_text("10,10,0,0\n1,2,3,4\n")
    bad.write_text("1,2,3,4\n1,2,3\n")
    empty.write_text("")
    assert sorted(map(tuple, rects.read_rects(spark, str(good)).collect())) == [(0, 0, 10, 10), (1, 2, 3, 4)]
    assert rects.count_lines(spark, str(good)) == 2
    with pytest.raises(Exception, match="not a rectangle"):
        rects.read_rects(spark, str(bad)).collect()
    assert rects.read_rects(spark, str(empty)).count() == 0
    good.write_text("0.5,-0.5,1.25,2\n")
    assert [tuple(r) for r in rects.read_scaled_rects(spark, str(good), 2).collect()] == [(1, -1, 3, 4)]
    with pytest.raises(KeyError):
        rects.Catalogue().objects(spark, "x")


def test_streamed_batches(spark, tmp_path):
    from tessella.streaming.batches import stream_counts

    objects = _grid(spark, 200)
    queries = rects.sampled_queries(objects, 5)
    queries.write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "q"))
    run = stream_counts(stream, ix.build(objects, 16, 4), str(tmp_path / "out"), str(tmp_path / "ck"))
    run.awaitTermination(120)
    got = {r.qid: r.cnt for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.qid: r.cnt for r in joins.counts_nested(queries, objects).collect()}


def test_policies_and_sizes():
    assert [batching.block_size(n) for n in (10, 1_999_999, 2_000_000)] == [256, 256, 2048]
    assert batching.block_size(10, 5) == 64
    assert [batching.chunk_size(n, 8) for n in (10, 640_000, 10**8)] == [256, 10_000, 16_384]
