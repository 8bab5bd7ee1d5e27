"""Batches of queries and their division between replicas and tasklets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import SIDES, overlaps
from tessella.storage import sized_join, stored

LAUNCH = 720_000
LOGICAL = 50_000


def batched(queries: DataFrame, launch: int = LAUNCH, logical: int = LOGICAL) -> DataFrame:
    """queries with batch, local_qid (its number there) and logical_batch."""
    q = F.col("qid")
    return queries.withColumn("batch", F.floor(q / launch).cast("long")).withColumn("local_qid", (q % launch).cast("long")).withColumn("logical_batch", F.floor(q / logical).cast("long"))


def batch_report(queries: DataFrame, launch: int = LAUNCH, logical: int = LOGICAL) -> DataFrame:
    """How many batches there are, and how many of the logical ones each launch replaces."""
    b = batched(queries, launch, logical)
    return b.agg(F.countDistinct("batch").alias("batches"), F.countDistinct("logical_batch").alias("logical_batches"), F.count("*").alias("queries"))


def block_size(n_queries: int, asked: int | None = None, launch: int = LAUNCH, least: int = 64) -> int:
    """Queries of a block: 256, from two million queries on 2048; at most a launch, at least a staging batch."""
    size = asked if asked else 256 if n_queries < 2_000_000 else 2048
    return max(least, min(size, launch))


def chunk_size(n_queries: int, threads: int) -> int:
    """Queries that a thread claims at once."""
    return min(16384, max(256, n_queries // (8 * threads)))


def replica_of(qid: Column, replicas: Column, n: int, policy: str = "block", block: int = 256, dense: bool = False) -> Column:
    """The replica that answers a query: by block, by range of the batch, or one by one (dense, whatever the policy)."""
    if dense:
        return (qid % replicas).cast("long")
    if policy == "block":
        return (F.floor(qid / block) % replicas).cast("long")
    if policy == "range":
        return F.floor(((qid + 1) * replicas - 1) / n).cast("long")
    raise ValueError(f"no such policy: {policy}")


def tasklet_of(qid: Column, replicas: Column, tasklets: int, block: int = 256) -> Column:
    """In block mode: the tasklet of the query's block inside its replica."""
    return (F.floor(F.floor(qid / block) / replicas) % tasklets).cast("long")


def even_tasklets(rows: DataFrame, group: str, order: str, tasklets: int) -> DataFrame:
    """rows with tasklet: each group's rows in order, in even runs, of which the first n mod tasklets have one more."""
    return rows.withColumn("tasklet", (F.ntile(tasklets).over(Window.partitionBy(group).orderBy(order)) - 1).cast("long"))


def routed_counts(candidates: DataFrame, objects: DataFrame, leaf_shards: DataFrame, slots: DataFrame, n_queries: int, policy: str = "block", block: int = 256, dense: bool = False) -> DataFrame:
    """(slot, qid, cnt): each candidate (qid, leaf) goes to one replica of the leaf's shard. The replica's number salts
    the join, so a hot shard's queries spread over as many tasks as it has replicas."""
    own = candidates.join(leaf_shards.select("leaf_id", "shard"), "leaf_id")
    counts = stored(slots.groupBy("shard").agg(F.max("replica_count").alias("replicas")))
    own = sized_join(own, counts, "shard", row_bytes=16).withColumn("replica_rank", replica_of(F.col("qid"), F.col("replicas"), n_queries, policy, block, dense))
    held = slots.select("slot", "shard", "replica_rank").join(leaf_shards.select("leaf_id", "shard"), "shard").join(objects.select("id", "leaf_id", *SIDES), "leaf_id")
    joined = own.alias("q").join(held.alias("o"), (F.col("q.leaf_id") == F.col("o.leaf_id")) & (F.col("q.replica_rank") == F.col("o.replica_rank")) & overlaps("q", "o"))
    return joined.groupBy("o.slot", "q.qid").agg(F.count("*").alias("cnt"))
