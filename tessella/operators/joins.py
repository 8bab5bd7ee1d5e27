"""Range joins between queries (qid and sides) and objects (id and sides)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import SIDES, bounding, overlaps
from tessella.operators.index import Index

#: A level of up to so many nodes, about 4 MB, is broadcast.
BROADCAST_NODES = 1 << 16
#: What one more level costs a query, in comparisons: the children of two nodes, and its way through the join.
_DOWN = 2000
#: A level that is asked for is compared with all queries up to so many comparisons, half a minute of a few cores.
MOST_COMPARED = 10**10


def pairs_nested(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """(qid, id) of every overlap, comparing all with all; the plain reference for small inputs."""
    return queries.alias("q").join(objects.alias("o"), overlaps("q", "o")).select("q.qid", "o.id")


def counts_nested(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """(qid, cnt) with zeros, comparing all with all."""
    joined = queries.alias("q").join(objects.alias("o"), overlaps("q", "o"), "left")
    return joined.groupBy("q.qid").agg(F.count("o.id").alias("cnt"))


def start_level(index: Index) -> int:
    """The level that is compared with all queries at once: of those small enough, the one from which a query takes
    fewest comparisons down to the leaves."""
    top = len(index.levels) - 1
    small = [k for k, have in enumerate(index.levels) if have <= BROADCAST_NODES] or [top]
    return min(small, key=lambda k: index.levels[k] + k * (2 * index.fanout + _DOWN))


def asked_level(index: Index, level: int, n_queries: int) -> int:
    """The level asked for, or the first above it that n_queries can be compared with at once."""
    top = len(index.levels) - 1
    fits = lambda k: index.levels[k] <= BROADCAST_NODES and index.levels[k] * n_queries <= MOST_COMPARED
    return next((k for k in range(min(level, top), top) if fits(k)), top)


def candidates(queries: DataFrame, index: Index, to_level: int = 0, from_level: int | None = None) -> DataFrame:
    """(qid, sides of the query, node_id, cnt) of the overlapping nodes of a level.

    One level is compared with all queries by a broadcast join whose size start_level bounds; from there each level
    joins its children by node id and drops what doesn't overlap. Levels of at most BROADCAST_NODES are broadcast."""
    k = max(to_level, start_level(index) if from_level is None else min(from_level, len(index.levels) - 1))
    top = index.level(k).select("node_id", "cnt", *SIDES)
    found = queries.alias("q").join(F.broadcast(top).alias("n"), overlaps("q", "n")).select("q.qid", *[F.col(f"q.{s}") for s in SIDES], "n.node_id", "n.cnt")
    while k > to_level:
        k -= 1
        child = index.level(k).select(F.col("node_id").alias("child_id"), F.col("parent_id").alias("up"), F.col("cnt").alias("child_cnt"), *SIDES)
        child = F.broadcast(child) if index.levels[k] <= BROADCAST_NODES else child
        joined = found.alias("q").join(child.alias("n"), (F.col("q.node_id") == F.col("n.up")) & overlaps("q", "n"))
        found = joined.select("q.qid", *[F.col(f"q.{s}") for s in SIDES], F.col("n.child_id").alias("node_id"), F.col("n.child_cnt").alias("cnt"))
    return found


def leaf_candidates(queries: DataFrame, index: Index, from_level: int | None = None) -> DataFrame:
    """(qid, sides of the query, leaf_id, leaf_cnt) of overlapping leaves."""
    return candidates(queries, index, 0, from_level).withColumnRenamed("node_id", "leaf_id").withColumnRenamed("cnt", "leaf_cnt")


def pairs_index(queries: DataFrame, index: Index, from_level: int | None = None) -> DataFrame:
    """(qid, id) of every overlap: an object is in one leaf, so no pair comes twice."""
    found = leaf_candidates(queries, index, from_level)
    joined = found.alias("q").join(index.objects.alias("o"), (F.col("q.leaf_id") == F.col("o.leaf_id")) & overlaps("q", "o"))
    return joined.select("q.qid", "o.id")


def counts_sparse(queries: DataFrame, index: Index, **how: int | None) -> DataFrame:
    """(qid, cnt) without zeros: partial counts are summed on the map side."""
    return pairs_index(queries, index, **how).groupBy("qid").agg(F.count("*").alias("cnt"))


def with_zeros(queries: DataFrame, sparse: DataFrame) -> DataFrame:
    return queries.select("qid").join(sparse, "qid", "left").select("qid", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def counts_dense(queries: DataFrame, index: Index, **how: int | None) -> DataFrame:
    """(qid, cnt) with zeros."""
    return with_zeros(queries, counts_sparse(queries, index, **how))


def merged(partial: DataFrame) -> DataFrame:
    """Partial (qid, cnt) of several workers or batches, summed."""
    return partial.groupBy("qid").agg(F.sum("cnt").alias("cnt"))


def regions(index: Index, fanout: int = 256) -> DataFrame:
    """Level-1 regions (l1_id, first and number of leaves, sides): the nodes above the leaves, or, if that is the root
    alone, runs of fanout leaves."""
    if len(index.levels) > 2:
        return index.level(1).select(F.col("node_id").alias("l1_id"), F.col("cnt").alias("n_leaves"), *SIDES)
    return region_runs(index, fanout)


def region_runs(index: Index, fanout: int = 256) -> DataFrame:
    """Runs of fanout leaves as regions (l1_id, number of leaves, sides), whatever the depth of the tree."""
    runs = index.leaves.withColumn("l1_id", F.floor(F.col("node_id") / fanout).cast("long"))
    return runs.groupBy("l1_id").agg(F.count("*").alias("n_leaves"), *bounding())


def leaves_of_regions(index: Index, fanout: int = 256) -> DataFrame:
    """(l1_id, leaf_id, pos in the region, cnt, sides)."""
    own = F.col("parent_id") if len(index.levels) > 2 else F.floor(F.col("node_id") / fanout).cast("long")
    pos = F.col("pos") if len(index.levels) > 2 else F.col("node_id") % fanout
    return index.leaves.select(own.alias("l1_id"), F.col("node_id").alias("leaf_id"), pos.alias("pos"), "cnt", *SIDES)


def region_hits(queries: DataFrame, index: Index, fanout: int = 256) -> DataFrame:
    """(l1_id, hits): queries that overlap each region, zeros included. Regions that are nodes are found by descent;
    runs of leaves are compared with all queries, which are a root's leaves over fanout, ten or so."""
    own = regions(index, fanout)
    if len(index.levels) > 2:
        found = candidates(queries, index, 1).groupBy(F.col("node_id").alias("l1_id")).agg(F.count("*").alias("h"))
    else:
        found = queries.alias("q").join(F.broadcast(own).alias("r"), overlaps("q", "r")).groupBy("r.l1_id").agg(F.count("*").alias("h"))
    return own.select("l1_id").join(found, "l1_id", "left").select("l1_id", F.coalesce("h", F.lit(0)).cast("long").alias("hits"))


def subtree_counts(queries: DataFrame, index: Index) -> DataFrame:
    """(subtree_id, qid, cnt): every top subtree's own counts; merged() gives the totals."""
    top = len(index.levels) - 1
    owner = index.level(max(0, top - 1)).select(F.col("node_id").alias("subtree_id"), F.col("node_id").alias("at"))
    for k in range(top - 2, -1, -1):
        owner = index.level(k).join(owner, F.col("parent_id") == F.col("at")).select("subtree_id", F.col("node_id").alias("at"))
    found = leaf_candidates(queries, index).join(owner, F.col("leaf_id") == F.col("at")).drop("at")
    joined = found.alias("q").join(index.objects.alias("o"), (F.col("q.leaf_id") == F.col("o.leaf_id")) & overlaps("q", "o"))
    return joined.groupBy("q.subtree_id", "q.qid").agg(F.count("*").alias("cnt"))


def touched(queries: DataFrame, index: Index) -> DataFrame:
    """qids with at least one overlap: a candidate leaf stays if it holds an overlapping object."""
    found = leaf_candidates(queries, index)
    held = found.alias("q").join(index.objects.alias("o"), (F.col("q.leaf_id") == F.col("o.leaf_id")) & overlaps("q", "o"), "left_semi")
    return held.select("qid").distinct()


def shard_touches(queries: DataFrame, leaves: DataFrame, index: Index, every: int = 10) -> DataFrame:
    """(shard, hits): of every every-th query, how many overlap a leaf of the shard, scaled back and rounded. leaves has
    leaf_id and shard."""
    sample = queries.filter(F.pmod("qid", F.lit(every)) == 0)
    total, taken = queries.agg(F.count("*").alias("n_all")), sample.agg(F.count("*").alias("n_some"))
    found = leaf_candidates(sample, index).join(leaves.select("leaf_id", "shard"), "leaf_id").select("shard", "qid").distinct().groupBy("shard").agg(F.count("*").alias("h"))
    scaled = F.when(F.col("n_some") > 0, F.floor((F.col("h") * F.col("n_all") + F.floor(F.col("n_some") / 2)) / F.col("n_some"))).otherwise(F.lit(0))
    # total and taken have one row each
    return leaves.select("shard").distinct().join(found, "shard", "left").withColumn("h", F.coalesce("h", F.lit(0))).join(F.broadcast(total)).join(F.broadcast(taken)).select("shard", scaled.cast("long").alias("hits"))


def partitioned_counts(queries: DataFrame, index: Index, workers: int) -> DataFrame:
    """(worker, qid, cnt): leaves split evenly between workers, each of which answers all queries on its own."""
    from tessella.operators.placement import even_split

    owner = even_split(index.leaves.select(F.col("node_id").alias("leaf_id")), workers, "leaf_id", index.levels[0]).select("leaf_id", "worker")
    found = leaf_candidates(queries, index).join(owner, "leaf_id")
    joined = found.alias("q").join(index.objects.alias("o"), (F.col("q.leaf_id") == F.col("o.leaf_id")) & overlaps("q", "o"))
    return joined.groupBy("q.worker", "q.qid").agg(F.count("*").alias("cnt"))
