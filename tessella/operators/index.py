"""Sort-tile-recursive rectangle index as plain tables.

objects: id, xmin, ymin, xmax, ymax; packed objects also have leaf_id.
nodes: node_id, level (leaves 0), parent_id, pos, is_leaf, cnt, xmin, ymin, xmax, ymax.
"""

from __future__ import annotations

import dataclasses
import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import SIDES, bounding, centre
from tessella.operators.ranks import ONE_TASK, global_row_number, global_sums_before
from tessella.storage import stored

LEAF = 128
FANOUT = 2540
NODES = "node_id long, level int, parent_id long, pos long, is_leaf boolean, cnt long, xmin int, ymin int, xmax int, ymax int"


def slices(n: int, cap: int) -> tuple[int, int]:
    """(number of slices, rows of a slice)."""
    s = max(1, math.ceil(math.sqrt(n / cap)))
    return s, math.ceil(n / s)


def shape(n: int, leaf: int = LEAF, fanout: int = FANOUT) -> list[int]:
    """Nodes of each level, leaves first; follows from n and the capacities alone."""
    levels = [_groups(n, leaf)]
    while levels[-1] > 1:
        levels.append(1 if levels[-1] <= fanout else _groups(levels[-1], fanout))
    return levels


def _groups(n: int, cap: int) -> int:
    if n == 0:
        return 0
    _, size = slices(n, cap)
    full, rest = divmod(n, size)
    return full * math.ceil(size / cap) + math.ceil(rest / cap)


def _tiled(df: DataFrame, n: int, cap: int, x: str, y: str, key: str) -> DataFrame:
    """df with group_no from 0: slices by x, then runs of cap by y. Slices after the first have equally many runs."""
    _, size = slices(n, cap)
    runs = -(-size // cap)
    ranked = global_row_number(df, [x, key], "rx", n).withColumn("slice", F.floor(F.col("rx") / size).cast("long"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy(y, key)) - 1
    return ranked.withColumn("ry", inside).withColumn("group_no", (F.col("slice") * runs + F.floor(F.col("ry") / cap)).cast("long")).withColumn("in_group", F.col("ry") % cap).drop("rx", "slice", "ry")


@dataclasses.dataclass
class Index:
    objects: DataFrame
    nodes: DataFrame
    levels: list[int]
    leaf: int
    fanout: int

    @property
    def leaves(self) -> DataFrame:
        return self.nodes.filter("is_leaf")

    def level(self, k: int) -> DataFrame:
        return self.nodes.filter(F.col("level") == k)

    def write(self, path: str) -> None:
        """Writes the index under path, which must not exist: nodes in a folder a level, objects by leaf."""
        spark = self.nodes.sparkSession
        self.objects.sortWithinPartitions("leaf_id").write.parquet(f"{path}/objects")
        self.nodes.write.partitionBy("level").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.levels, self.leaf, self.fanout)], "levels array<long>, leaf long, fanout long").coalesce(1).write.parquet(f"{path}/about")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        """An index that was written: built once, it answers any number of batches."""
        about = spark.read.parquet(f"{path}/about").first()
        objects = spark.read.parquet(f"{path}/objects")
        nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").select("node_id", "level", "parent_id", "pos", "is_leaf", "cnt", *SIDES)
        return Index(objects, nodes, list(about["levels"]), about["leaf"], about["fanout"])


def pack_leaves(objects: DataFrame, n: int, leaf: int = LEAF) -> DataFrame:
    """objects with leaf_id."""
    keyed = objects.select("id", *SIDES, centre("xmin", "xmax").alias("cx"), centre("ymin", "ymax").alias("cy"))
    return _tiled(keyed, n, leaf, "cx", "cy", "id").select("id", *SIDES, F.col("group_no").alias("leaf_id"), F.col("in_group").alias("pos"))


def _grouped(level: pa.Table, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """_tiled of a bounded level's nodes by the sums of their sides: (group_no, in_group) of each."""
    n = level.num_rows
    x, y = (level.column(f"{c}min").to_numpy().astype(np.int64) + level.column(f"{c}max").to_numpy() for c in "xy")
    key = level.column("node_no").to_numpy()
    _, size = slices(n, cap)
    slice_ = np.empty(n, np.int64)
    slice_[np.lexsort((key, x))] = np.arange(n) // size
    order = np.lexsort((key, y, slice_))
    inside = np.empty(n, np.int64)
    inside[order] = np.arange(n) - slice_[order] * size  # all slices before are full
    return slice_ * -(-size // cap) + inside // cap, inside % cap


def _upper(level: pa.Table, sizes: list[int], fanout: int, k: int, base: int) -> pa.Table:
    """The nodes of level k, of ONE_TASK rows at most, and of all above it."""
    parts = []
    for at in range(k, len(sizes)):
        have = sizes[at]
        number = level.column("node_no").to_numpy()
        parent, pos = (np.zeros(have, np.int64), number) if have <= fanout else _grouped(level, fanout)
        up = pa.array(parent + base + have) if have > 1 else pa.nulls(have, pa.int64())
        parts.append(pa.table({"node_id": number + base, "level": np.full(have, at, np.int32), "parent_id": up, "pos": pos, "is_leaf": np.full(have, at == 0), **{c: level.column(c) for c in ("cnt", *SIDES)}}))
        level = level.append_column("parent_no", pa.array(parent)).group_by("parent_no").aggregate([("xmin", "min"), ("ymin", "min"), ("xmax", "max"), ("ymax", "max"), ("cnt", "count")]).sort_by("parent_no")
        level = level.select(["parent_no", "cnt_count", "xmin_min", "ymin_min", "xmax_max", "ymax_max"]).rename_columns(["node_no", "cnt", *SIDES])
        base += have
    return pa.concat_tables(parts)


def build(objects: DataFrame, leaf: int = LEAF, fanout: int = FANOUT, n: int | None = None) -> Index:
    """The index of objects; no objects give no nodes. Ties go by id, so the index is the same whatever the partitions.

    Sums of the sides order upper levels, as the centres would. A level that fits into one node keeps its order. Packed
    objects and large levels are stored as they are made, so whatever reads the index doesn't build it again; from the
    first level of at most ONE_TASK nodes on, the levels are put together in the driver, which needs a few MB."""
    n = objects.count() if n is None else n
    sizes = shape(n, leaf, fanout) if n else []
    packed = stored(pack_leaves(objects, max(1, n), leaf), "index")
    spark = objects.sparkSession
    if not sizes:
        return Index(packed, spark.createDataFrame([], NODES), sizes, leaf, fanout)
    level = packed.groupBy(F.col("leaf_id").alias("node_no")).agg(F.count("*").alias("cnt"), *bounding())
    base, k, parts = 0, 0, []
    while sizes[k] > ONE_TASK:
        have = sizes[k]
        if have <= fanout:
            grouped = level.withColumn("parent_no", F.lit(0).cast("long")).withColumn("pos", F.col("node_no"))
        else:
            keyed = level.withColumn("sx", F.col("xmin").cast("long") + F.col("xmax")).withColumn("sy", F.col("ymin").cast("long") + F.col("ymax"))
            grouped = _tiled(keyed, have, fanout, "sx", "sy", "node_no").withColumnRenamed("group_no", "parent_no").withColumnRenamed("in_group", "pos").drop("sx", "sy")
        grouped = stored(grouped, "index")
        parts.append(
            grouped.select(
                (F.col("node_no") + base).alias("node_id"), F.lit(k).alias("level"), (F.col("parent_no") + base + have).alias("parent_id"), F.col("pos").cast("long").alias("pos"), F.lit(k == 0).alias("is_leaf"), "cnt", *SIDES
            )
        )
        level = grouped.groupBy(F.col("parent_no").alias("node_no")).agg(F.count("*").alias("cnt"), *bounding())
        base, k = base + have, k + 1
    small = level.select("node_no", "cnt", *SIDES).toArrow().sort_by("node_no")
    parts.append(spark.createDataFrame(_upper(small, sizes, fanout, k, base), NODES))
    return Index(packed, functools.reduce(DataFrame.union, parts), sizes, leaf, fanout)


def headers(index: Index) -> DataFrame:
    """What a search reads of a node before its contents."""
    return index.nodes.select("node_id", "is_leaf", "cnt", *SIDES)


def leaf_payloads(index: Index) -> DataFrame:
    """Each leaf's rectangles as an array of at most the leaf capacity."""
    rect = F.struct("pos", "id", *SIDES)
    return index.objects.groupBy("leaf_id").agg(F.array_sort(F.collect_list(rect)).alias("rects"))


def statistics(index: Index) -> DataFrame:
    return index.nodes.agg(F.count("*").alias("total_nodes"), F.count_if("is_leaf").alias("leaf_nodes"), F.count_if(~F.col("is_leaf")).alias("internal_nodes"), F.coalesce(F.max("level") + 1, F.lit(0)).cast("long").alias("depth"))


def bytes_used(index: Index, node: int = 32, pointer: int = 8, rect: int = 16) -> DataFrame:
    each = F.lit(node) + F.col("cnt") * F.when(F.col("is_leaf"), F.lit(rect)).otherwise(F.lit(pointer))
    return index.nodes.agg(F.coalesce(F.sum(each), F.lit(0)).cast("long").alias("bytes"))


def breadth_first(index: Index) -> DataFrame:
    """node_id and its number in queue order from the root. Nodes of a level follow their parents' order."""
    order = None
    for k in range(len(index.levels) - 1, -1, -1):
        here = index.level(k).select("node_id", "parent_id", "pos")
        if order is None:
            order, done = here.select("node_id", F.lit(0).cast("long").alias("bfs")), index.levels[k]
            continue
        above = order.select(F.col("node_id").alias("parent_id"), F.col("bfs").alias("up"))
        ranked = global_row_number(here.join(above, "parent_id"), ["up", "pos"], "no", index.levels[k])
        order = order.union(ranked.select("node_id", (F.col("no") + done).alias("bfs")))
        done += index.levels[k]
    return order


def depth_first(index: Index) -> DataFrame:
    """node_id and its number in pre-order: parents first, children from left to right. A node's path of positions
    sorts after its parent's path and before its next sibling's."""
    top = len(index.levels) - 1
    paths = index.level(top).select("node_id", F.array(F.lit(0).cast("long")).alias("path"))
    level = paths
    for k in range(top - 1, -1, -1):
        above = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("up"))
        level = index.level(k).join(above, "parent_id").select("node_id", F.concat("up", F.array("pos")).alias("path"))
        paths = paths.union(level)
    return global_row_number(paths, ["path"], "dfs", sum(index.levels)).select("node_id", "dfs")


def flattened(index: Index) -> DataFrame:
    """Compressed rows in breadth-first order: bfs, is_leaf, first_child, child_cnt, first_rect, rect_cnt."""
    ranked = index.nodes.join(breadth_first(index), "node_id")
    kids, rects = F.when(F.col("is_leaf"), F.lit(0)).otherwise(F.col("cnt")), F.when(F.col("is_leaf"), F.col("cnt")).otherwise(F.lit(0))
    own = ranked.select("bfs", "is_leaf", kids.cast("long").alias("child_cnt"), rects.cast("long").alias("rect_cnt"))
    return global_sums_before(own, ["bfs"], {"first_child": F.col("child_cnt"), "first_rect": F.col("rect_cnt")}, sum(index.levels))


def grid_split(objects: DataFrame, leaf: int = LEAF, fanout: int = FANOUT, n: int | None = None) -> DataFrame:
    """id and part of one top-down split: k = min(ceil(n / leaf), fanout) parts, floor(sqrt(k)) even slabs by centre
    x, and in each an even number of groups by centre y as its share of k."""
    n = objects.count() if n is None else n
    k = min(-(-n // leaf), fanout)
    sx = max(1, math.isqrt(k))
    keyed = objects.select("id", centre("xmin", "xmax").alias("cx"), centre("ymin", "ymax").alias("cy"))
    ranked = global_row_number(keyed, ["cx", "id"], "rx", n)
    size, extra = divmod(n, sx)  # the first extra slabs have one more
    bound = extra * (size + 1)
    slab = F.when(F.col("rx") < bound, F.floor(F.col("rx") / (size + 1))).otherwise(extra + F.floor((F.col("rx") - bound) / max(1, size))).cast("long")
    ranked = ranked.withColumn("slab", slab)
    here = F.count("*").over(Window.partitionBy("slab"))
    groups = F.greatest(F.lit(1), F.least(F.lit(fanout), F.round(here * k / F.lit(n)).cast("long")))
    ry = F.row_number().over(Window.partitionBy("slab").orderBy("cy", "id")) - 1
    ranked = ranked.withColumn("m", here).withColumn("g", groups).withColumn("ry", ry)
    small = F.floor(F.col("m") / F.col("g"))
    more = F.col("m") % F.col("g")
    part = F.when(F.col("ry") < more * (small + 1), F.floor(F.col("ry") / (small + 1))).otherwise(more + F.floor((F.col("ry") - more * (small + 1)) / F.greatest(F.lit(1), small)))
    return ranked.select("id", "slab", part.cast("long").alias("part"))


def _even_sizes(n: int, parts: int) -> list[int]:
    return [n // parts + (i < n % parts) for i in range(parts)]


def _child_sizes(n: int, leaf: int, fanout: int) -> list[int]:
    """Objects of each child of a group of n, as _split_groups makes them."""
    k = min(-(-n // leaf), fanout)
    out: list[int] = []
    for m in _even_sizes(n, max(1, math.isqrt(k))):
        out += _even_sizes(m, min(max(1, math.floor(m / n * k + 0.5)), fanout - len(out)))
    return out


def _numbered(rows: DataFrame, by: list[str], order: list[str], name: str, biggest: int, n: int) -> DataFrame:
    """rows with a number from 0 in order inside each group of by; groups beyond ONE_TASK rows span ranges."""
    if biggest <= ONE_TASK:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    ranked = global_row_number(rows, [*by, *order], name, n)
    # sizes of a level are about even, so its groups are few while one is that large
    first = ranked.groupBy(*by).agg(F.min(name).alias("first_no"))
    return ranked.join(F.broadcast(first), by).withColumn(name, F.col(name) - F.col("first_no")).drop("first_no")


def _place(no: Column, n: Column, parts: Column) -> Column:
    """Which of an even number of parts row no of n is in; the first n % parts have one more."""
    size, extra = F.floor(n / parts), n % parts
    bound = extra * (size + 1)
    return F.when(no < bound, F.floor(no / (size + 1))).otherwise(extra + F.floor((no - bound) / F.greatest(F.lit(1), size))).cast("long")


def _split_groups(rows: DataFrame, leaf: int, fanout: int, biggest: int, total: int) -> DataFrame:
    """Every group (path) of more than leaf rows (n), split once: path and n are those of the child."""
    n = F.col("n")
    k = F.least(F.ceil(n / leaf), F.lit(fanout))
    rows = _numbered(rows.withColumn("k", k).withColumn("sx", F.greatest(F.lit(1), F.floor(F.sqrt("k")))), ["path"], ["cx", "id"], "rx", biggest, total)
    size, extra = F.floor(n / F.col("sx")), n % F.col("sx")
    rows = rows.withColumn("slab", _place(F.col("rx"), n, F.col("sx"))).withColumn("m", size + F.when(F.col("slab") < extra, 1).otherwise(0))
    rows = _numbered(rows, ["path", "slab"], ["cy", "id"], "ry", biggest, total)
    share = lambda m: F.greatest(F.lit(1), F.round(m / n * F.col("k")).cast("long"))
    rows = rows.withColumn("before", F.least("slab", extra) * share(size + 1) + F.greatest(F.col("slab") - extra, F.lit(0)) * share(size))
    rows = rows.withColumn("g", F.least(share(F.col("m")), F.lit(fanout) - F.col("before"))).withColumn("part", _place(F.col("ry"), F.col("m"), F.col("g")))
    child = F.concat("path", F.lit("."), (F.col("before") + F.col("part")).cast("string"))
    held = F.floor(F.col("m") / F.col("g")) + F.when(F.col("part") < F.col("m") % F.col("g"), 1).otherwise(0)
    return rows.select("id", *SIDES, "cx", "cy", F.when(n > leaf, child).otherwise(F.col("path")).alias("path"), F.when(n > leaf, held).otherwise(n).cast("long").alias("n"))


def grid_leaves(objects: DataFrame, leaf: int = LEAF, fanout: int = FANOUT, n: int | None = None) -> DataFrame:
    """id, corners, path and cnt: the top-down split, level by level, until no group has more than leaf objects. path has
    the numbers of the children from the root ("0") down to the leaf, cnt is the leaf's size. The sizes of all groups
    follow from n, so levels are looped without counting. (The reference's split into halves is for a node without
    children, which a group of more than leaf objects never is.)"""
    if leaf < 1 or fanout < 2:
        raise ValueError("leaf must be 1 at least and fanout 2")
    n = objects.count() if n is None else n
    rows = objects.select("id", *SIDES, centre("xmin", "xmax").alias("cx"), centre("ymin", "ymax").alias("cy"), F.lit("0").alias("path"), F.lit(n).cast("long").alias("n"))
    sizes = {n}
    while max(sizes) > leaf:
        rows = _split_groups(rows, leaf, fanout, max(sizes), n)
        sizes = {s for m in sizes for s in (_child_sizes(m, leaf, fanout) if m > leaf else [m])}
    return rows.select("id", *SIDES, "path", F.col("n").alias("cnt"))


def grid_nodes(leaves: DataFrame) -> DataFrame:
    """path, level (root 0), is_leaf, cnt (objects of a leaf, children of others) and corners of grid_leaves' nodes."""
    boxes = leaves.groupBy("path").agg(F.count("*").alias("own"), *bounding()).withColumn("steps", F.split("path", r"\."))
    each = boxes.select("*", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("upto"))
    each = each.withColumn("node", F.array_join(F.slice("steps", F.lit(1), F.col("upto")), ".")).withColumn("child", F.get("steps", F.col("upto")).cast("long"))
    found = each.groupBy(F.col("node").alias("path"), (F.col("upto") - 1).cast("long").alias("level")).agg(F.max(F.col("child").isNull()).alias("is_leaf"), F.max(F.coalesce(F.col("child") + 1, F.col("own"))).cast("long").alias("cnt"), *bounding())
    return found.select("path", "level", "is_leaf", "cnt", *SIDES)
