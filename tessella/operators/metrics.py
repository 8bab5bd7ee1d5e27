"""Search work, totals and dispersion figures."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import SIDES, overlaps
from tessella.operators.index import Index
from tessella.operators.joins import BROADCAST_NODES, asked_level, candidates, leaf_candidates, start_level
from tessella.operators.placement import even_split
from tessella.storage import stored


def work(queries: DataFrame, index: Index, from_level: int | None = None) -> DataFrame:
    """query_count, node_visits, leaf_visits, rect_tests, child_pushes of a search from the root that looks at every
    child of an overlapping node. As overlapping nodes have overlapping parents, sums over all overlapping nodes give
    these. Small upper levels are compared with all queries in one broadcast join; below, each level joins by node id
    what the one above left, which is stored. A from_level of too many nodes to compare with all queries is raised."""
    n = queries.count()
    base = start_level(index) if from_level is None else asked_level(index, from_level, n)
    cnt, leaf = F.col("cnt"), F.col("is_leaf")
    figures = [F.sum(F.when(leaf, 0).otherwise(cnt)).alias("pushes"), F.count_if(leaf).alias("leaves"), F.sum(F.when(leaf, cnt).otherwise(0)).alias("tests")]
    # levels from base up have about as many nodes as base alone
    above = index.nodes.filter(F.col("level") >= base).select("is_leaf", "cnt", *SIDES)
    parts = [queries.alias("q").join(F.broadcast(above).alias("n"), overlaps("q", "n")).agg(*figures)]
    at = None
    for k in range(base - 1, -1, -1):
        up = at if at is not None else candidates(queries, index, base, base).drop("cnt")
        below = index.level(k).select(F.col("node_id").alias("child_id"), "parent_id", "is_leaf", "cnt", *SIDES)
        below = F.broadcast(below) if index.levels[k] <= BROADCAST_NODES else below
        joined = up.alias("q").join(below.alias("n"), (F.col("q.node_id") == F.col("n.parent_id")) & overlaps("q", "n"))
        here = joined.select("q.qid", *[F.col(f"q.{s}") for s in SIDES], F.col("n.child_id").alias("node_id"), "n.is_leaf", "n.cnt")
        here = stored(here) if k else here
        parts.append(here.agg(*figures))
        at = here.drop("is_leaf", "cnt")
    found = functools.reduce(DataFrame.union, parts)
    sums = found.agg(F.coalesce(F.sum("pushes"), F.lit(0)).alias("p"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("v"), F.coalesce(F.sum("tests"), F.lit(0)).alias("t"))
    return sums.select(F.lit(n).cast("long").alias("query_count"), (F.lit(n) + F.col("p")).cast("long").alias("node_visits"), F.col("v").cast("long").alias("leaf_visits"), F.col("t").cast("long").alias("rect_tests"), F.col("p").cast("long").alias("child_pushes"))


def worker_traffic(queries: DataFrame, index: Index, workers: int, node: int = 32, rect: int = 16) -> DataFrame:
    """(worker, bytes) that a search reads of each worker's leaves, zeros included: a header and the rectangles of every
    leaf that a query overlaps. Leaves are split evenly."""
    owner = even_split(index.leaves.select(F.col("node_id").alias("leaf_id")), workers, "leaf_id", index.levels[0])
    read = leaf_candidates(queries, index).groupBy("leaf_id").agg(F.sum(F.lit(node) + F.col("leaf_cnt") * rect).alias("read"))
    return owner.join(read, "leaf_id", "left").groupBy("worker").agg(F.coalesce(F.sum("read"), F.lit(0)).cast("long").alias("bytes"))


def roofline(counters: DataFrame, seconds: float, node: int = 32) -> DataFrame:
    """Bytes, operations, intensity and rates of a search that took seconds."""
    moved = F.col("node_visits") * node + F.col("child_pushes") * 8 + F.col("rect_tests") * 16
    done = F.col("node_visits") + F.col("rect_tests")
    return counters.select(
        moved.alias("bytes"), done.alias("ops"), F.when(moved > 0, done / moved).otherwise(0.0).alias("intensity"), (F.col("rect_tests") / F.lit(seconds) / 1e9).alias("gtests_s"), (moved / F.lit(seconds) / 1e9).alias("gb_s")
    )


def totals(partial: DataFrame, by: str = "worker") -> DataFrame:
    """Sums of cnt by worker, and overall where the worker is null."""
    return partial.rollup(by).agg(F.sum("cnt").alias("total"))


def dispersion(traffic: DataFrame, value: str = "bytes") -> DataFrame:
    """total, mean, population deviation, its share of the mean, and maximum."""
    return traffic.agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"), F.when(F.avg(value) == 0, 0.0).otherwise(F.stddev_pop(value) / F.avg(value)).alias("cv"), F.max(value).alias("max"))


def percentile(df: DataFrame, value: str, q: float = 0.95) -> DataFrame:
    """Exact, by linear interpolation at (n - 1) * q."""
    return df.agg(F.percentile(value, F.lit(q)).alias("p"))


def kernel_time(cycles: DataFrame, hertz: float = 400e6) -> DataFrame:
    """From (batch, cycles): a batch takes as long as its slowest row; sum and peak over batches, in seconds."""
    each = cycles.groupBy("batch").agg(F.max("cycles").alias("c"))
    return each.agg((F.sum("c") / F.lit(hertz)).alias("total_s"), (F.max("c") / F.lit(hertz)).alias("peak_s"))


def running_sum(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Inclusive prefix sum of value inside each group."""
    return df.withColumn("running", F.sum(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
