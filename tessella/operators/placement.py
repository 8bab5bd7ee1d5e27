"""Workload-aware placement of leaves on workers: shards, scores, replicas and slots.

All tables here have a row per leaf, shard or worker, not per object, so windows over them stay small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranks import global_row_number, global_sums_before


def even_split(df: DataFrame, workers: int, order: str, n: int | None = None) -> DataFrame:
    """df with worker: runs of equal length in order, the first n mod workers one longer."""
    n = df.count() if n is None else n
    size, extra = divmod(n, workers)
    bound = extra * (size + 1)
    ranked = global_row_number(df, [order], "no", n)
    worker = F.when(F.col("no") < bound, F.floor(F.col("no") / (size + 1))).otherwise(extra + F.floor((F.col("no") - bound) / max(1, size)))
    return ranked.withColumn("worker", worker.cast("long")).drop("no")


def merged_regions(regions: DataFrame, cap: int) -> DataFrame:
    """Consecutive regions merged so that there are fewer than cap: l1_id, merged_id."""
    n = regions.count()
    span = 1 if n <= cap - 1 else -(-n // (cap - 1))
    return global_row_number(regions.select("l1_id"), ["l1_id"], "no", n).select("l1_id", F.floor(F.col("no") / span).cast("long").alias("merged_id"))


def base_shards(leaves: DataFrame, cap: int) -> DataFrame:
    """leaves (l1_id, leaf_id, pos, cnt) with shard: each region in ceil(leaves / cap) even runs, numbered in order."""
    whole = Window.partitionBy("l1_id")
    own = whole.orderBy("pos")
    n, no = F.count("*").over(whole), F.row_number().over(own) - 1
    ranked = leaves.withColumn("m", n).withColumn("no", no).withColumn("g", F.ceil(F.col("m") / cap))
    small, more = F.floor(F.col("m") / F.col("g")), F.col("m") % F.col("g")
    part = F.when(F.col("no") < more * (small + 1), F.floor(F.col("no") / (small + 1))).otherwise(more + F.floor((F.col("no") - more * (small + 1)) / small))
    ranked = ranked.withColumn("part", part.cast("long"))
    first = global_sums_before(ranked.groupBy("l1_id").agg(F.first("g").alias("g2")), ["l1_id"], {"base": F.col("g2")})
    return ranked.join(first, "l1_id").withColumn("shard", (F.col("base") + F.col("part")).cast("long")).drop("m", "no", "g", "g2", "base", "part")


def shard_table(leaves: DataFrame, hits: DataFrame) -> DataFrame:
    """(shard, l1_id, n_leaves, rects, hits) from leaves with shards and region hits."""
    each = leaves.groupBy("shard", "l1_id").agg(F.count("*").alias("n_leaves"), F.sum("cnt").alias("rects"))
    return each.join(hits, "l1_id").select("shard", "l1_id", "n_leaves", "rects", "hits")


def scored(shards: DataFrame, policy: str = "query") -> DataFrame:
    """shards with work by policy: uniform, query (default), data or combined."""
    value = {"uniform": F.lit(1), "query": F.col("hits"), "data": F.col("rects"), "combined": (F.col("hits") + 1) * (F.col("rects") + 1)}
    if policy not in value:
        raise ValueError(f"no such policy: {policy}")
    return shards.withColumn("work", value[policy].cast("long"))


def hottest(hits: DataFrame, k: int = 4) -> DataFrame:
    """The k regions with most hits, ties by id."""
    return hits.orderBy(F.col("hits").desc(), "l1_id").limit(k)


def drilled(shards: DataFrame, hot: DataFrame, touches: DataFrame) -> DataFrame:
    """shards whose hits are replaced by the shard's own, in hot regions where that is above 0."""
    own = touches.select("shard", F.col("hits").alias("own"))
    marked = shards.join(F.broadcast(hot.select("l1_id").withColumn("is_hot", F.lit(True))), "l1_id", "left").join(own, "shard", "left")
    return marked.withColumn("hits", F.when(F.col("is_hot") & (F.col("own") > 0), F.col("own")).otherwise(F.col("hits"))).drop("is_hot", "own")


def replicas(shards: DataFrame, workers: int, replicate: bool = True) -> DataFrame:
    """shards (shard, work) with replicas: one each, then each spare worker to the shard with most work per replica,
    ties to fewer replicas, then the lower shard. The k-th spare of a shard is won at work / k (as doubles), so the
    spares go to the greatest quotients. The last one that wins is at least all work / workers, which bounds what a
    shard can win; without any work the spares go round."""
    n, total = shards.agg(F.count("*"), F.coalesce(F.sum("work"), F.lit(0))).first()
    spare = workers - n if replicate else 0
    if spare <= 0 or not n:
        return shards.withColumn("replicas", F.lit(1).cast("long"))
    most = F.floor(F.col("work") * workers / F.lit(total)) + 1 if total > 0 else F.lit(-(-spare // n))
    offers = shards.select("shard", "work", F.explode(F.sequence(F.lit(1).cast("long"), F.least(most.cast("long"), F.lit(spare)))).alias("k"))
    won = offers.orderBy((F.col("work") / F.col("k")).desc(), "k", "shard").limit(spare).groupBy("shard").agg(F.count("*").alias("more"))
    return shards.join(won, "shard", "left").withColumn("replicas", (1 + F.coalesce("more", F.lit(0))).cast("long")).drop("more")


def uniform_replicas(shards: DataFrame, workers: int) -> DataFrame:
    """Spares dealt round by shard number."""
    n = shards.count()
    spare = max(0, workers - n)
    ranked = global_row_number(shards, ["shard"], "no", n)
    return ranked.withColumn("replicas", (1 + spare // max(1, n) + F.when(F.col("no") < spare % max(1, n), 1).otherwise(0)).cast("long")).drop("no")


def slots(placed: DataFrame) -> DataFrame:
    """(slot, shard, l1_id, replica_rank, replica_count, set_no): shards in order, replicas after each other; slots
    alternate between two sets."""
    each = placed.select("shard", "l1_id", "replicas", F.explode(F.sequence(F.lit(0), F.col("replicas").cast("int") - 1)).alias("replica_rank"))
    ranked = global_row_number(each, ["shard", "replica_rank"], "slot")
    return ranked.select("slot", "shard", "l1_id", F.col("replica_rank").cast("long").alias("replica_rank"), F.col("replicas").alias("replica_count"), (F.col("slot") % 2).alias("set_no"))


def two_sets(slots_: DataFrame, size_a: int, size_b: int, queue: bool = False) -> DataFrame:
    """slots with set_no and place in the set, for sets of size_a and size_b workers: slots alternate, beginning with
    set 0, until one set is full; the rest goes to the other. More slots than workers is an error, or with queue they
    go on in that other set, at places beyond its workers."""
    n = 0 if queue else slots_.count()
    if n > size_a + size_b:
        raise ValueError(f"{n} slots for {size_a + size_b} workers")
    both = 2 * min(size_a, size_b)
    turn, s = F.col("slot") < both, F.col("slot")
    longer = F.lit(0 if size_a > size_b else 1)
    return slots_.drop("set_no").withColumn("set_no", F.when(turn, s % 2).otherwise(longer).cast("long")).withColumn("place", F.when(turn, F.floor(s / 2)).otherwise(s - both // 2).cast("long"))


def set_estimate(slots_: DataFrame, scored_: DataFrame) -> DataFrame:
    """(set_no, estimate): work over replicas, summed."""
    return slots_.join(scored_.select("shard", "work"), "shard").groupBy("set_no").agg(F.sum(F.col("work") / F.col("replica_count")).alias("estimate"))


def fits(n_shards: int, n_leaves: int, workers: int) -> bool:
    """Whether every shard has a worker; Spark runs them all the same."""
    return n_shards <= min(n_leaves, workers)


def region_report(placed: DataFrame) -> DataFrame:
    """Per region: hits, rects, shards, replicas, and the combined estimate per replica."""
    each = placed.groupBy("l1_id").agg(F.max("hits").alias("hits"), F.sum("rects").alias("rects"), F.count("*").alias("shards"), F.sum("replicas").alias("replicas"))
    return each.withColumn("est", (F.col("hits") + 1) * (F.col("rects") + 1) / F.col("replicas"))
