"""The library's registered queries and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixtures as fx
from tessella.functions.geometry import SIDES, centre, centre_point, morton, normalised
from tessella.operators import batching, joins, metrics, placement, verify
from tessella.operators import index as ix
from tessella.operators.rank_counts import counts_ranked
from tessella.operators.ranks import global_row_number
from tessella.plans import run as whole
from tessella.plans.planner import counts_of_any_width, range_count
from tessella.sources.rects import query_sets, sampled_queries
from tessella.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Small capacities, so that small tables give deep trees.
LEAF, FANOUT, WORKERS, SHARD_CAP = 16, 8, 600, 4
#: Searches ask for every row whose id is divisible by this.
EVERY = 20

# ---- SQL that the oracles share ----

_HIT = "q.xmin <= o.xmax AND q.xmax >= o.xmin AND q.ymin <= o.ymax AND q.ymax >= o.ymin"
_BOX = "min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax"


def _base(table: str = "lineitem", every: int = EVERY) -> str:
    return f"obj AS MATERIALIZED ({fx.SQL[table]}),\nq AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS qid, xmin, ymin, xmax, ymax FROM obj WHERE id % {every} = 0)"


def _tile(name: str, source: str, cap: int, x: str, y: str, key: str) -> str:
    return f"""{name}_p AS (SELECT count(*)::DOUBLE AS n, ceil(count(*) / greatest(1, ceil(sqrt(count(*) / {cap}.0)))) AS size FROM {source}),
{name}_x AS (SELECT s.*, n, size, floor((row_number() OVER (ORDER BY {x}, {key}) - 1) / size)::BIGINT AS slice FROM {source} s, {name}_p),
{name}_y AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY {y}, {key}) - 1 AS ry FROM {name}_x),
{name} AS (SELECT * EXCLUDE (slice, ry, size), slice * ceil(size / {cap})::BIGINT + ry // {cap} AS group_no, ry % {cap} AS in_group FROM {name}_y)"""


def _tree(leaf: int = LEAF, fanout: int = FANOUT, depth: int = 8) -> str:
    """packed (objects with leaf_id) and nodes."""
    out = [_tile("packed0", "obj", leaf, "trunc((xmin::BIGINT + xmax) / 2)", "trunc((ymin::BIGINT + ymax) / 2)", "id"), "packed AS MATERIALIZED (SELECT * EXCLUDE (group_no, in_group, n), group_no AS leaf_id, in_group AS pos FROM packed0)"]
    out.append(f"l0 AS MATERIALIZED (SELECT leaf_id AS node_no, count(*) AS cnt, {_BOX}, true AS is_leaf FROM packed GROUP BY leaf_id)")
    parts, base = [], "0"
    for k in range(depth):
        out.append(_tile(f"t{k}", f"l{k}", fanout, "xmin::BIGINT + xmax", "ymin::BIGINT + ymax", "node_no"))
        out.append(f"g{k} AS MATERIALIZED (SELECT * EXCLUDE (group_no, in_group), CASE WHEN n <= {fanout} THEN 0 ELSE group_no END AS parent_no, CASE WHEN n <= {fanout} THEN node_no ELSE in_group END AS pos FROM t{k})")
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT parent_no AS node_no, count(*) AS cnt, {_BOX}, false AS is_leaf FROM g{k} WHERE n > 1 GROUP BY parent_no)")
        upto = f"{base} + (SELECT count(*) FROM l{k})"
        parts.append(f"SELECT node_no + {base} AS node_id, {k} AS level, CASE WHEN n > 1 THEN parent_no + {upto} END AS parent_id, pos, is_leaf, cnt, xmin, ymin, xmax, ymax FROM g{k}")
        base = upto
    out.append(f"nodes AS MATERIALIZED ({' UNION ALL '.join(parts)})")
    return ",\n".join(out)


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


#: A region is a node above the leaves; shards are even runs of its leaves.
_SHARDS = f"""lv AS (SELECT parent_id AS l1_id, node_id AS leaf_id, pos, cnt, xmin, ymin, xmax, ymax FROM nodes WHERE level = 0),
hits AS (SELECT r.node_id AS l1_id, count(q.qid) AS hits FROM nodes r LEFT JOIN q ON q.xmin <= r.xmax AND q.xmax >= r.xmin AND q.ymin <= r.ymax AND q.ymax >= r.ymin WHERE r.level = 1 GROUP BY r.node_id),
gs AS (SELECT l1_id, ceil(count(*) / {SHARD_CAP}.0)::BIGINT AS g, count(*) AS m FROM lv GROUP BY l1_id),
gb AS (SELECT *, coalesce(sum(g) OVER (ORDER BY l1_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM gs),
shl AS (SELECT lv.*, (base + CASE WHEN no < (m % g) * (m // g + 1) THEN no // (m // g + 1) ELSE m % g + (no - (m % g) * (m // g + 1)) // (m // g) END)::BIGINT AS shard
        FROM (SELECT *, row_number() OVER (PARTITION BY l1_id ORDER BY pos) - 1 AS no FROM lv) lv JOIN gb USING (l1_id)),
sh AS MATERIALIZED (SELECT shard, l1_id, count(*) AS n_leaves, sum(cnt)::BIGINT AS rects, any_value(hits) AS hits FROM shl JOIN hits USING (l1_id) GROUP BY shard, l1_id),
spare AS (SELECT greatest(0, {WORKERS} - count(*)) AS e, count(*) AS n FROM sh),
won AS (SELECT shard FROM (SELECT shard, hits / k AS v, k FROM sh, spare, unnest(generate_series(1, e)) AS x(k) ORDER BY v DESC, k, shard LIMIT (SELECT e FROM spare))),
rep AS MATERIALIZED (SELECT sh.*, 1 + (SELECT count(*) FROM won WHERE won.shard = sh.shard) AS replicas FROM sh),
slots AS (SELECT row_number() OVER (ORDER BY shard, r) - 1 AS slot, shard, l1_id, r AS replica_rank, replicas AS replica_count FROM rep, unnest(generate_series(0, replicas - 1)) AS x(r))"""


class _Case:
    """The fixture of one sf_dir. What is made by a shuffle and read by several steps is stored when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, leaf: int = LEAF, fanout: int = FANOUT, table=fx.line_items, every: int = EVERY):
        self.spark, self.sf_dir, self.table, self.every = spark, sf_dir, table, every
        self.leaf, self.fanout = leaf, fanout

    @functools.cached_property
    def objects(self) -> DataFrame:
        return self.table(self.spark, self.sf_dir)

    @functools.cached_property
    def queries(self) -> DataFrame:
        return stored(sampled_queries(self.objects, self.every), "queries")

    @functools.cached_property
    def index(self) -> ix.Index:
        return ix.build(self.objects, self.leaf, self.fanout)

    @functools.cached_property
    def leaves(self) -> DataFrame:
        return stored(placement.base_shards(joins.leaves_of_regions(self.index), SHARD_CAP), "leaves")

    @functools.cached_property
    def shards(self) -> DataFrame:
        return stored(placement.shard_table(self.leaves, joins.region_hits(self.queries, self.index)), "shards")

    @functools.cached_property
    def placed(self) -> DataFrame:
        return stored(placement.replicas(placement.scored(self.shards), WORKERS), "placed")


def _add(name: str, sql: str | None, **case):
    """Registers a query made from its fixture."""

    def take(f: Callable[[_Case], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(_Case(spark, sf_dir, **case))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return take


_COUNT = f"SELECT q.qid, count(o.id) AS cnt FROM q LEFT JOIN obj o ON {_HIT} GROUP BY q.qid"
_FULL = {"leaf": ix.LEAF, "fanout": ix.FANOUT}

# ---- range counts ----

_add("range_count_nested", _with(_base()) + _COUNT)(lambda c: joins.counts_nested(c.queries, c.objects))
_add("range_count_index", _with(_base()) + _COUNT, **_FULL)(lambda c: joins.counts_dense(c.queries, c.index))
_add("range_count_auto", _with(_base()) + _COUNT, **_FULL)(lambda c: range_count(c.queries, c.objects))
_add("range_count_deep", _with(_base()) + _COUNT)(lambda c: joins.counts_dense(c.queries, c.index, from_level=3))
_add("range_count_tenth", _with(_base(every=10)) + _COUNT, **_FULL, every=10)(lambda c: joins.counts_dense(c.queries, c.index))
_add("range_count_sparse", _with(_base()) + f"SELECT q.qid, count(*) AS cnt FROM q JOIN obj o ON {_HIT} GROUP BY q.qid", **_FULL)(lambda c: joins.counts_sparse(c.queries, c.index))
_add("range_count_events", _with(_base("events")) + _COUNT, table=fx.events)(lambda c: counts_of_any_width(c.queries, c.index.objects, c.index))
_add("range_count_embeddings", _with(_base("embeddings")) + _COUNT, table=fx.embeddings)(lambda c: joins.counts_dense(c.queries, c.index))
_add("range_count_parts", _with(_base("part")) + _COUNT, table=fx.parts)(lambda c: joins.counts_dense(c.queries, c.index))
_add("range_count_far", _with(_base()) + "SELECT qid, 0::BIGINT AS cnt FROM q", **_FULL)(lambda c: joins.counts_dense(fx.moved(c.queries, 10_000_000, 0), c.index))
_WIDE = _HIT.replace("q.xmin", "q.xmin - 500").replace("q.xmax", "q.xmax + 500").replace("q.ymin", "q.ymin - 500").replace("q.ymax", "q.ymax + 500")
_add("range_count_wide", _with(_base()) + f"SELECT q.qid, count(o.id) AS cnt FROM q LEFT JOIN obj o ON {_WIDE} GROUP BY q.qid", **_FULL)(lambda c: counts_of_any_width(fx.widened(c.queries, 500), c.index.objects, c.index))
_add("overlap_pairs", _with(_base()) + f"SELECT q.qid, o.id FROM q JOIN obj o ON {_HIT}", **_FULL)(lambda c: joins.pairs_index(c.queries, c.index))
_add("exists_count", _with(_base()) + f"SELECT count(DISTINCT q.qid) AS touched FROM q JOIN obj o ON {_HIT}", **_FULL)(lambda c: joins.touched(c.queries, c.index).agg(F.count("*").alias("touched")))
_add("subtree_counts", _with(_base(), _tree(), "own(subtree_id, node_id, level) AS (SELECT node_id, node_id, level FROM nodes WHERE level = (SELECT max(level) - 1 FROM nodes) UNION ALL SELECT o.subtree_id, n.node_id, n.level FROM own o JOIN nodes n ON n.parent_id = o.node_id)")
     + f"SELECT w.subtree_id, q.qid, count(*) AS cnt FROM packed o JOIN own w ON w.level = 0 AND w.node_id = o.leaf_id JOIN q ON {_HIT} GROUP BY ALL")(lambda c: joins.subtree_counts(c.queries, c.index))
_EVEN = "CASE WHEN no < (n % {w}) * (n // {w} + 1) THEN no // (n // {w} + 1) ELSE n % {w} + (no - (n % {w}) * (n // {w} + 1)) // greatest(1, n // {w}) END"
_SPLIT = "own AS (SELECT node_id AS leaf_id, " + _EVEN.format(w=32) + " AS worker FROM (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS no, count(*) OVER () AS n FROM nodes WHERE level = 0))"
_WORKER = f"part AS (SELECT w.worker, q.qid, count(*) AS cnt FROM packed o JOIN own w USING (leaf_id) JOIN q ON {_HIT} GROUP BY ALL)"
_add("partitioned_counts", _with(_base(), _tree(), _SPLIT, _WORKER) + "SELECT * FROM part")(lambda c: joins.partitioned_counts(c.queries, c.index, 32))
_add("merged_counts", _with(_base()) + f"SELECT q.qid, count(*) AS cnt FROM q JOIN obj o ON {_HIT} GROUP BY q.qid")(lambda c: joins.merged(joins.partitioned_counts(c.queries, c.index, 8)))
_add("region_hits", _with(_base(), _tree(), _SHARDS) + "SELECT l1_id, hits FROM hits")(lambda c: joins.region_hits(c.queries, c.index))
_TOUCH = """sm AS (SELECT * FROM q WHERE qid % 10 = 0), th AS (SELECT s.shard, count(DISTINCT q.qid) AS h FROM shl s LEFT JOIN sm q ON q.xmin <= s.xmax AND q.xmax >= s.xmin AND q.ymin <= s.ymax AND q.ymax >= s.ymin GROUP BY s.shard),
touch AS (SELECT shard, ((h * (SELECT count(*) FROM q) + (SELECT count(*) FROM sm) // 2) // (SELECT count(*) FROM sm))::BIGINT AS hits FROM th)"""
_add("shard_touches", _with(_base(), _tree(), _SHARDS, _TOUCH) + "SELECT * FROM touch")(lambda c: joins.shard_touches(c.queries, c.leaves, c.index))

# ---- the index ----

_add("tree_nodes", _with(_base(), _tree()) + "SELECT * FROM nodes")(lambda c: c.index.nodes)
_add("tree_nodes_wide", _with(_base(), _tree(ix.LEAF, ix.FANOUT, 4)) + "SELECT * FROM nodes", **_FULL)(lambda c: c.index.nodes)
_add("leaf_packing", _with(_base(), _tree()) + "SELECT id, leaf_id, pos FROM packed")(lambda c: c.index.objects.select("id", "leaf_id", "pos"))
_add("node_headers", _with(_base(), _tree()) + "SELECT node_id, is_leaf, cnt, xmin, ymin, xmax, ymax FROM nodes")(lambda c: ix.headers(c.index))
_add("leaf_payloads", _with(_base(), _tree()) + "SELECT leaf_id, count(*) AS n, sum(id * pos)::BIGINT AS weighted FROM packed GROUP BY leaf_id")(
    lambda c: ix.leaf_payloads(c.index).select("leaf_id", F.size("rects").cast("long").alias("n"), F.aggregate("rects", F.lit(0).cast("long"), lambda a, r: a + r["id"] * r["pos"]).alias("weighted"))
)
_add("tree_statistics", _with(_base(), _tree()) + "SELECT count(*) AS total_nodes, count(*) FILTER (is_leaf) AS leaf_nodes, count(*) FILTER (NOT is_leaf) AS internal_nodes, (max(level) + 1)::BIGINT AS depth FROM nodes")(lambda c: ix.statistics(c.index))
_add("tree_bytes", _with(_base(), _tree()) + "SELECT sum(32 + cnt * CASE WHEN is_leaf THEN 16 ELSE 8 END)::BIGINT AS bytes FROM nodes")(lambda c: ix.bytes_used(c.index))
_PATHS = "paths(node_id, path) AS (SELECT node_id, [0::BIGINT] FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, list_append(p.path, n.pos::BIGINT) FROM paths p JOIN nodes n ON n.parent_id = p.node_id)"
_BFS = "bfs AS MATERIALIZED (SELECT node_id, row_number() OVER (ORDER BY len(path), path) - 1 AS bfs FROM paths)"
_add("breadth_first", _with(_base(), _tree(), _PATHS, _BFS) + "SELECT node_id, bfs FROM bfs")(lambda c: ix.breadth_first(c.index))
_add("depth_first", _with(_base(), _tree(), _PATHS) + "SELECT node_id, row_number() OVER (ORDER BY path) - 1 AS dfs FROM paths")(lambda c: ix.depth_first(c.index))
_add("flat_offsets", _with(_base(), _tree(), _PATHS, _BFS) + """SELECT bfs, is_leaf, coalesce(sum(k) OVER w, 0)::BIGINT AS first_child, k::BIGINT AS child_cnt, coalesce(sum(r) OVER w, 0)::BIGINT AS first_rect, r::BIGINT AS rect_cnt
FROM (SELECT *, CASE WHEN is_leaf THEN 0 ELSE cnt END AS k, CASE WHEN is_leaf THEN cnt ELSE 0 END AS r FROM nodes JOIN bfs USING (node_id)) WINDOW w AS (ORDER BY bfs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")(lambda c: ix.flattened(c.index))  # fmt: skip
_GRID = """p AS (SELECT count(*) AS n, least(ceil(count(*) / 16.0), 8)::BIGINT AS k, greatest(1, floor(sqrt(least(ceil(count(*) / 16.0), 8))))::BIGINT AS w FROM obj),
a AS (SELECT id, trunc((ymin::BIGINT + ymax) / 2) AS cy, row_number() OVER (ORDER BY trunc((xmin::BIGINT + xmax) / 2), id) - 1 AS no, n, k, w FROM obj, p),
b AS (SELECT *, CASE WHEN no < (n % w) * (n // w + 1) THEN no // (n // w + 1) ELSE n % w + (no - (n % w) * (n // w + 1)) // greatest(1, n // w) END AS slab FROM a),
c AS (SELECT *, count(*) OVER (PARTITION BY slab) AS m, row_number() OVER (PARTITION BY slab ORDER BY cy, id) - 1 AS ry FROM b),
d AS (SELECT *, greatest(1, least(8, round(m * k / n::DOUBLE)))::BIGINT AS g FROM c)"""
_add("grid_split", _with(_base(), _GRID) + "SELECT id, slab::BIGINT AS slab, (CASE WHEN ry < (m % g) * (m // g + 1) THEN ry // (m // g + 1) ELSE m % g + (ry - (m % g) * (m // g + 1)) // greatest(1, m // g) END)::BIGINT AS part FROM d")(lambda c: ix.grid_split(c.objects, LEAF, FANOUT))


def _grid_levels(leaf: int = LEAF, fanout: int = FANOUT, depth: int = 8) -> str:
    """s{depth}: objects with path and n of their leaf, one split a level."""
    out = ["s0 AS MATERIALIZED (SELECT *, trunc((xmin::BIGINT + xmax) / 2) AS cx, trunc((ymin::BIGINT + ymax) / 2) AS cy, '0' AS path, count(*) OVER () AS n FROM obj)"]
    even = "CASE WHEN {no} < ({n} % {w}) * ({n} // {w} + 1) THEN {no} // ({n} // {w} + 1) ELSE {n} % {w} + ({no} - ({n} % {w}) * ({n} // {w} + 1)) // greatest(1, {n} // {w}) END"
    for j in range(depth):
        out.append(f"""sa{j} AS (SELECT *, greatest(1, floor(sqrt(k)))::BIGINT AS w, row_number() OVER (PARTITION BY path ORDER BY cx, id) - 1 AS rx FROM (SELECT *, least(ceil(n / {leaf}.0), {fanout})::BIGINT AS k FROM s{j} WHERE n > {leaf})),
sb{j} AS (SELECT *, {even.format(no="rx", n="n", w="w")} AS slab FROM sa{j}),
sc{j} AS (SELECT *, greatest(1, round(m / n::DOUBLE * k))::BIGINT AS g FROM (SELECT *, count(*) OVER (PARTITION BY path, slab) AS m, row_number() OVER (PARTITION BY path, slab ORDER BY cy, id) - 1 AS ry FROM sb{j})),
sd{j} AS (SELECT path, slab, coalesce(sum(g) OVER (PARTITION BY path ORDER BY slab ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT DISTINCT path, slab, g FROM sc{j})),
s{j + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM (SELECT id, xmin, ymin, xmax, ymax, cx, cy, path || '.' || (before + {even.format(no="ry", n="m", w="g")}) AS path FROM sc{j} JOIN sd{j} USING (path, slab)) UNION ALL BY NAME SELECT * FROM s{j} WHERE n <= {leaf})""")
    return ",\n".join(out)


_GRID_NODES = f"SELECT list_aggregate(p[:u], 'string_agg', '.') AS path, u - 1 AS level, bool_or(u = len(p)) AS is_leaf, CASE WHEN bool_or(u = len(p)) THEN count(*) ELSE count(DISTINCT p[u + 1]) END AS cnt, {_BOX} FROM (SELECT *, unnest(generate_series(1, len(p))) AS u FROM (SELECT *, string_split(path, '.') AS p FROM s8)) GROUP BY 1, 2"
_add("grid_split_leaves", _with(_base(), _grid_levels()) + "SELECT id, path, n AS cnt FROM s8")(lambda c: ix.grid_leaves(c.objects, LEAF, FANOUT).select("id", "path", "cnt"))
_add("grid_split_nodes", _with(_base(), _grid_levels()) + _GRID_NODES)(lambda c: ix.grid_nodes(ix.grid_leaves(c.objects, LEAF, FANOUT)))
_bits = " + ".join(f"((((cx >> {i}) & 1) << {2 * i}) + (((cy >> {i}) & 1) << {2 * i + 1}))" for i in range(16))
_add("morton_order", _with(_base()) + f"SELECT qid, (CASE WHEN z >= 2147483648 THEN z - 4294967296 ELSE z END)::INT AS z, row_number() OVER (ORDER BY CASE WHEN z >= 2147483648 THEN z - 4294967296 ELSE z END, qid) - 1 AS place FROM (SELECT qid, {_bits} AS z FROM (SELECT qid, trunc((xmin::BIGINT + xmax) / 2)::BIGINT AS cx, trunc((ymin::BIGINT + ymax) / 2)::BIGINT AS cy FROM q))")(
    lambda c: c.queries.select("qid", morton(centre("xmin", "xmax"), centre("ymin", "ymax")).alias("z")).transform(lambda df: global_row_number(df, ["z", "qid"], "place"))
)
_add("centre_points", _with(_base()) + "SELECT id, trunc((xmin::BIGINT + xmax) / 2)::BIGINT AS xmin, trunc((ymin::BIGINT + ymax) / 2)::BIGINT AS ymin, trunc((xmin::BIGINT + xmax) / 2)::BIGINT AS xmax, trunc((ymin::BIGINT + ymax) / 2)::BIGINT AS ymax FROM obj")(lambda c: c.objects.select("id", *centre_point()))
_add("scaled_rects", _with(_base("embeddings")) + "SELECT * FROM obj", table=fx.embeddings)(lambda c: c.objects.select("id", *SIDES))
_add("sampled_queries", _with(_base()) + "SELECT * FROM q")(lambda c: c.queries)

# ---- search work and figures ----

_NH = "q.xmin <= n.xmax AND q.xmax >= n.xmin AND q.ymin <= n.ymax AND q.ymax >= n.ymin"
_WORK = f"""wk AS (SELECT (SELECT count(*) FROM q) AS query_count, coalesce(sum(cnt) FILTER (NOT is_leaf), 0)::BIGINT AS child_pushes, count(*) FILTER (is_leaf) AS leaf_visits, coalesce(sum(cnt) FILTER (is_leaf), 0)::BIGINT AS rect_tests FROM q JOIN nodes n ON {_NH}),
work AS (SELECT query_count, query_count + child_pushes AS node_visits, leaf_visits, rect_tests, child_pushes FROM wk)"""
_add("search_work", _with(_base(), _tree(), _WORK) + "SELECT * FROM work")(lambda c: metrics.work(c.queries, c.index))
_add("roofline", _with(_base(), _tree(), _WORK) + "SELECT b AS bytes, node_visits + rect_tests AS ops, (node_visits + rect_tests) / b AS intensity, rect_tests / 2.0::DOUBLE / 1e9 AS gtests_s, b / 2.0::DOUBLE / 1e9 AS gb_s FROM (SELECT *, node_visits * 32 + child_pushes * 8 + rect_tests * 16 AS b FROM work)")(lambda c: metrics.roofline(metrics.work(c.queries, c.index), 2.0))
_add("worker_totals", _with(_base(), _tree(), _SPLIT, _WORKER) + "SELECT worker, sum(cnt)::BIGINT AS total FROM part GROUP BY ROLLUP (worker)")(lambda c: metrics.totals(joins.partitioned_counts(c.queries, c.index, 32)))
_add("traffic_dispersion", _with(_base(), _tree(), _SPLIT, "tr AS (SELECT worker, sum(cnt * 16 + 32) AS bytes FROM nodes JOIN own ON leaf_id = node_id GROUP BY worker)") + "SELECT sum(bytes)::BIGINT AS total, avg(bytes) AS mean, stddev_pop(bytes) AS stdev, stddev_pop(bytes) / avg(bytes) AS cv, max(bytes)::BIGINT AS max FROM tr")(
    lambda c: metrics.dispersion(placement.even_split(c.index.leaves, 32, "node_id").groupBy("worker").agg(F.sum(F.col("cnt") * 16 + 32).alias("bytes")))
)
_add("count_percentile", _with(_base()) + f"SELECT quantile_cont(cnt, 0.95) AS p FROM ({_COUNT})")(lambda c: metrics.percentile(joins.counts_dense(c.queries, c.index), "cnt"))
_add("kernel_time", _with(_base(), _tree()) + "SELECT sum(c) / 4e8 AS total_s, max(c) / 4e8 AS peak_s FROM (SELECT node_id % 5 AS batch, max(cnt * 1000) AS c FROM nodes WHERE is_leaf GROUP BY 1)")(
    lambda c: metrics.kernel_time(c.index.leaves.select((F.col("node_id") % 5).alias("batch"), (F.col("cnt") * 1000).alias("cycles")))
)
_add("running_sums", _with(_base(), _tree()) + "SELECT parent_id, node_id, cnt, sum(cnt) OVER (PARTITION BY parent_id ORDER BY node_id)::BIGINT AS running FROM nodes WHERE is_leaf")(lambda c: metrics.running_sum(c.index.leaves.select("parent_id", "node_id", "cnt"), "parent_id", "node_id", "cnt"))
_add("region_rects", _with(_base(), _tree()) + "SELECT parent_id AS l1_id, sum(cnt)::BIGINT AS rects FROM nodes WHERE level = 0 GROUP BY parent_id")(lambda c: joins.leaves_of_regions(c.index).groupBy("l1_id").agg(F.sum("cnt").alias("rects")))

# ---- placement ----

_PLACE = (_base(), _tree(), _SHARDS)
_add("leaf_split", _with(_base(), _tree(), _SPLIT) + "SELECT leaf_id, worker::BIGINT AS worker FROM own")(lambda c: placement.even_split(c.index.leaves.select(F.col("node_id").alias("leaf_id")), 32, "leaf_id"))
_add("merged_regions", _with(_base(), _tree()) + "SELECT l1_id, CASE WHEN n <= 99 THEN no ELSE no // ((n + 98) // 99) END AS merged_id FROM (SELECT node_id AS l1_id, row_number() OVER (ORDER BY node_id) - 1 AS no, count(*) OVER () AS n FROM nodes WHERE level = 1)")(lambda c: placement.merged_regions(joins.regions(c.index), 100))
_add("base_shards", _with(*_PLACE) + "SELECT leaf_id, l1_id, shard FROM shl")(lambda c: c.leaves.select("leaf_id", "l1_id", "shard"))
for _policy, _value in {"uniform": "1::BIGINT", "query": "hits", "data": "rects", "combined": "(hits + 1) * (rects + 1)"}.items():
    _add(f"shard_scores_{_policy}", _with(*_PLACE) + f"SELECT sh.*, {_value} AS work FROM sh")(lambda c, p=_policy: placement.scored(c.shards, p))
_add("hot_regions", _with(*_PLACE) + "SELECT * FROM hits ORDER BY hits DESC, l1_id LIMIT 4")(lambda c: placement.hottest(joins.region_hits(c.queries, c.index)))
_add("drilled_shards", _with(*_PLACE, _TOUCH, "hot AS (SELECT l1_id FROM hits ORDER BY hits DESC, l1_id LIMIT 4)") + "SELECT shard, l1_id, n_leaves, rects, CASE WHEN l1_id IN (SELECT l1_id FROM hot) AND t.hits > 0 THEN t.hits ELSE sh.hits END AS hits FROM sh JOIN touch t USING (shard)")(
    lambda c: placement.drilled(c.shards, placement.hottest(c.shards.select("l1_id", "hits").distinct()), joins.shard_touches(c.queries, c.leaves, c.index))
)
_add("replicas", _with(*_PLACE) + "SELECT shard, hits AS work, replicas FROM rep")(lambda c: c.placed.select("shard", "work", "replicas"))
_add("uniform_replicas", _with(*_PLACE) + "SELECT shard, 1 + e // n + CASE WHEN shard < e % n THEN 1 ELSE 0 END AS replicas FROM sh, spare")(lambda c: placement.uniform_replicas(c.shards, WORKERS).select("shard", "replicas"))
_add("slots", _with(*_PLACE) + "SELECT *, slot % 2 AS set_no FROM slots")(lambda c: placement.slots(c.placed))
_add("set_estimates", _with(*_PLACE) + "SELECT slot % 2 AS set_no, sum(hits / replica_count) AS estimate FROM slots JOIN sh USING (shard) GROUP BY 1")(lambda c: placement.set_estimate(placement.slots(c.placed), c.placed))
_add("region_report", _with(*_PLACE) + "SELECT l1_id, h AS hits, r AS rects, shards, reps AS replicas, (h + 1) * (r + 1) / reps AS est FROM (SELECT l1_id, max(hits) AS h, sum(rects)::BIGINT AS r, count(*) AS shards, sum(replicas)::BIGINT AS reps FROM rep GROUP BY l1_id)")(lambda c: placement.region_report(c.placed))
_add("capacity_check", _with(*_PLACE) + f"SELECT n AS shards, (SELECT count(*) FROM lv) AS leaves, {WORKERS}::BIGINT AS workers, n <= least((SELECT count(*) FROM lv), {WORKERS}) AS fits FROM spare")(
    lambda c: c.shards.agg(F.count("*").alias("shards")).select("shards", F.lit(c.index.levels[0]).cast("long").alias("leaves"), F.lit(WORKERS).cast("long").alias("workers"), (F.col("shards") <= min(c.index.levels[0], WORKERS)).alias("fits"))
)

# ---- batches and routing ----

_add("launch_batches", _with(_base(every=10)) + "SELECT qid, qid // 1000 AS batch, qid % 1000 AS local_qid, qid // 70 AS logical_batch FROM q", every=10)(lambda c: batching.batched(c.queries.select("qid"), 1000, 70))
_add("batch_report", _with(_base(every=10)) + "SELECT count(DISTINCT qid // 1000) AS batches, count(DISTINCT qid // 70) AS logical_batches, count(*) AS queries FROM q", every=10)(lambda c: batching.batch_report(c.queries, 1000, 70))
_CAND = f"cand AS (SELECT q.qid, s.shard, s.leaf_id, r.replicas, (SELECT count(*) FROM q) AS n FROM q JOIN shl s ON {_HIT.replace('o.', 's.')} JOIN rep r USING (shard))"
for _policy, _value in {"block": "(qid // 64) % replicas", "range": "((qid + 1) * replicas - 1) // n", "dense": "qid % replicas"}.items():
    _sql = f"SELECT slot, c.qid, count(*) AS cnt FROM (SELECT *, {_value} AS replica_rank FROM cand) c JOIN slots s ON s.shard = c.shard AND s.replica_rank = c.replica_rank JOIN packed o ON o.leaf_id = c.leaf_id JOIN q ON q.qid = c.qid AND {_HIT} GROUP BY ALL"

    def _routed(c: _Case, p: str = _policy) -> DataFrame:
        slots = stored(placement.slots(c.placed), "slots")
        found = joins.leaf_candidates(c.queries, c.index)
        return batching.routed_counts(found, c.index.objects, c.leaves, slots, c.queries.count(), "block" if p == "dense" else p, 64, p == "dense")

    _add(f"routed_counts_{_policy}", _with(*_PLACE, _CAND) + _sql)(_routed)
_add("tasklets", _with(_base()) + "SELECT qid, (qid // 64 // 3) % 11 AS tasklet FROM q")(lambda c: c.queries.select("qid", batching.tasklet_of(F.col("qid"), F.lit(3), 11, 64).alias("tasklet")))
_add("block_and_chunk_sizes", _with(_base()) + "SELECT count(*) AS queries, CASE WHEN count(*) < 2000000 THEN 256 ELSE 2048 END AS block, least(16384, greatest(256, count(*) // 64)) AS chunk FROM q")(
    lambda c: c.queries.agg(F.count("*").alias("queries")).select("queries", F.lit(batching.block_size(n := c.queries.count())).cast("int").alias("block"), F.lit(batching.chunk_size(n, 8)).cast("long").alias("chunk"))
)

# ---- checks ----

_add("check_totals", _with(_base()) + f"SELECT count(*) AS total_a, count(*) AS total_b, true AS equal FROM q JOIN obj o ON {_HIT}")(lambda c: verify.totals_equal(counts_ranked(c.queries, c.index.objects), joins.counts_dense(c.queries, c.index)))
_add("check_per_query", _with(_base(), _tree(), _SPLIT.replace("32", "8"), _WORKER, f"flat AS ({_COUNT})", "merged AS (SELECT qid, sum(cnt)::BIGINT AS cnt FROM part GROUP BY qid)")
     + "SELECT count(*) AS compared, count(*) FILTER (flat.cnt <> coalesce(merged.cnt, 0)) AS mismatches, sum(abs(flat.cnt - coalesce(merged.cnt, 0)))::BIGINT AS abs_diff FROM flat LEFT JOIN merged USING (qid)")(lambda c: verify.per_query(counts_ranked(c.queries, c.index.objects), joins.merged(joins.partitioned_counts(c.queries, c.index, 8))))
_COUNTERS = " UNION ALL ".join(f"SELECT '{c}' AS counter, {c} AS value_a, {c} AS value_b, true AS equal FROM work" for c in verify.COUNTERS)
_add("check_counters", _with(_base(), _tree(), _WORK) + _COUNTERS)(lambda c: verify.counters_equal(metrics.work(c.queries, c.index, 99), metrics.work(c.queries, c.index, 1)))

# ---- traffic, sets and tasklets ----

_READ = f"""rd AS (SELECT n.node_id AS leaf_id, sum(32 + 16 * n.cnt) AS b FROM q JOIN nodes n ON n.is_leaf AND {_NH} GROUP BY n.node_id),
tr AS (SELECT worker, coalesce(sum(b), 0)::BIGINT AS bytes FROM own LEFT JOIN rd USING (leaf_id) GROUP BY worker)"""
_add("worker_traffic", _with(_base(), _tree(), _SPLIT, _READ) + "SELECT worker::BIGINT AS worker, bytes FROM tr")(lambda c: metrics.worker_traffic(c.queries, c.index, 32))
_add("search_traffic_dispersion", _with(_base(), _tree(), _SPLIT, _READ) + "SELECT sum(bytes)::BIGINT AS total, avg(bytes) AS mean, stddev_pop(bytes) AS stdev, CASE WHEN avg(bytes) = 0 THEN 0 ELSE stddev_pop(bytes) / avg(bytes) END AS cv, max(bytes)::BIGINT AS max FROM tr")(
    lambda c: metrics.dispersion(metrics.worker_traffic(c.queries, c.index, 32))
)
_SETS = "SELECT slot, shard, l1_id, replica_rank, replica_count, CASE WHEN slot < 2 * {a} THEN slot % 2 ELSE 1 END AS set_no, CASE WHEN slot < 2 * {a} THEN slot // 2 ELSE slot - {a} END AS place FROM slots"
_add("two_sets", _with(*_PLACE) + _SETS.format(a=100))(lambda c: placement.two_sets(placement.slots(c.placed), 100, 100_000, queue=True))
_add("even_tasklets", _with(_base()) + "SELECT qid, qid // 1000 AS batch, ntile(11) OVER (PARTITION BY qid // 1000 ORDER BY qid) - 1 AS tasklet FROM q")(
    lambda c: batching.even_tasklets(batching.batched(c.queries.select("qid"), 1000).select("qid", "batch"), "batch", "qid", 11)
)
_add("region_runs", _with(_base(), _tree(ix.LEAF, ix.FANOUT, 4)) + f"SELECT node_id // 8 AS l1_id, count(*) AS n_leaves, {_BOX} FROM nodes WHERE level = 0 GROUP BY 1", table=fx.events, leaf=ix.LEAF, fanout=ix.FANOUT)(lambda c: joins.region_runs(c.index, 8))
ORACLE_SQL["region_runs"] = ORACLE_SQL["region_runs"].replace(fx.SQL["lineitem"], fx.SQL["events"])

# ---- sources ----

SHARES = {"1": 100, "5": 20, "10": 10, "25": 4, "50": 2, "100": 1}
_add("query_sets", _with(_base()) + " UNION ALL ".join(f"SELECT '{share}' AS share, count(*) AS queries, sum(id)::BIGINT AS ids FROM obj WHERE id % {every} = 0" for share, every in SHARES.items()))(lambda c: query_sets(c.objects, SHARES))
_add("corner_order", _with(_base("embeddings")) + "SELECT id, least(xmax, xmin) AS xmin, least(ymin, ymax) AS ymin, greatest(xmax, xmin) AS xmax, greatest(ymin, ymax) AS ymax FROM obj", table=fx.embeddings)(
    lambda c: c.objects.select("id", *normalised("xmax", "ymin", "xmin", "ymax"))
)

# ---- whole runs ----

_CONFIG = whole.Config(leaf=LEAF, fanout=FANOUT, workers=WORKERS, shard_cap=SHARD_CAP, hot=0, block=64, launch=1000, logical=70)
_add("run_counts", _with(_base()) + _COUNT)(lambda c: whole.run(c.queries, c.objects, _CONFIG).counts)
_add("run_batches", _with(_base(), f"per AS ({_COUNT})") + "SELECT qid // 1000 AS batch, count(*) AS queries, count(DISTINCT qid // 70) AS logical_batches, sum(cnt)::BIGINT AS overlaps, count(*) FILTER (cnt > 0) AS touched FROM per GROUP BY 1")(
    lambda c: whole.run(c.queries, c.objects, _CONFIG).batches
)
_ANSWERS = f"ans AS (SELECT slot, count(*) AS answers, sum(cnt)::BIGINT AS met FROM ({ORACLE_SQL['routed_counts_block'].split(_CAND)[1].strip()}) GROUP BY slot)"
_add("run_workers", _with(*_PLACE, _CAND, _ANSWERS) + "SELECT slot, shard, replica_rank, slot % 2 AS set_no, coalesce(answers, 0) AS answers, coalesce(met, 0)::BIGINT AS overlaps FROM slots LEFT JOIN ans USING (slot)")(
    lambda c: whole.run(c.queries, c.objects, _CONFIG).workers
)
_add("run_check", _with(_base()) + "SELECT count(*) AS compared, 0::BIGINT AS mismatches, 0::BIGINT AS abs_diff FROM q")(lambda c: whole.run(c.queries, c.objects, _CONFIG).check)
