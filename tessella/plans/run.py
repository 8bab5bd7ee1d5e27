"""A whole run: index, placement, routed batches, merge, check and report."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import batching, joins, metrics, placement, verify
from tessella.operators import index as ix
from tessella.storage import stored


@dataclasses.dataclass(frozen=True)
class Config:
    """How a run goes. work: uniform, query, data or combined; route: block or range; dense_route: one query after the
    other, whatever route says; dense: results with zeros; hot: regions whose shards are scored by their own hits
    (0: none); replicate: spare workers hold copies; check: compare with a search of the index alone."""

    leaf: int = ix.LEAF
    fanout: int = ix.FANOUT
    workers: int = 2540
    shard_cap: int = 256
    work: str = "query"
    hot: int = 4
    replicate: bool = True
    route: str = "block"
    dense_route: bool = False
    block: int | None = None
    dense: bool = True
    launch: int = batching.LAUNCH
    logical: int = batching.LOGICAL
    check: bool = True

    @classmethod
    def of(cls, given: Mapping[str, str] | None = None, prefix: str = "TESSELLA_") -> Config:
        """From texts by name, as the environment has them: TESSELLA_WORKERS=64, TESSELLA_REPLICATE=0 and so on. A name
        that isn't a setting, or a text that isn't of its kind, is an error."""
        given = os.environ if given is None else given
        kinds = {f.name: f.type for f in dataclasses.fields(cls)}
        found: dict[str, object] = {}
        for key, text in given.items():
            if not key.startswith(prefix):
                continue
            name = key[len(prefix) :].lower()
            if name not in kinds:
                raise ValueError(f"no such setting: {key}")
            if kinds[name] == "bool":
                if text.lower() not in ("0", "1", "false", "true"):
                    raise ValueError(f"{key} is 0 or 1, not {text!r}")
                found[name] = text.lower() in ("1", "true")
            else:
                found[name] = text if kinds[name] == "str" else int(text)
        return cls(**found)


@dataclasses.dataclass
class Run:
    """What a run gives: counts (qid, cnt); batches, workers and placement; summary of one row; check or None."""

    counts: DataFrame
    batches: DataFrame
    workers: DataFrame
    placement: DataFrame
    summary: DataFrame
    check: DataFrame | None

    def log(self, path: str) -> None:
        """Appends the run's records under path: a table each of batches, workers, placement and summary."""
        for name in ("batches", "workers", "placement", "summary"):
            getattr(self, name).write.mode("append").parquet(f"{path}/{name}")


def placed(queries: DataFrame, index: ix.Index, config: Config) -> tuple[DataFrame, DataFrame]:
    """(leaves with their shards, shards with work and replicas)."""
    leaves = stored(placement.base_shards(joins.leaves_of_regions(index), config.shard_cap))
    shards = placement.shard_table(leaves, joins.region_hits(queries, index))
    if config.hot:
        shards = stored(shards)
        hot = placement.hottest(shards.select("l1_id", "hits").distinct(), config.hot)
        shards = placement.drilled(shards, hot, joins.shard_touches(queries, leaves, index))
    scored = stored(placement.scored(shards, config.work))
    return leaves, stored(placement.replicas(scored, config.workers, config.replicate))


def run(queries: DataFrame, objects: DataFrame, config: Config = Config(), index: ix.Index | None = None) -> Run:
    """Answers queries (qid from 0, sides) over objects (id, sides); an index that exists already is used.

    Empty objects or queries give zero counts or none. Every replica of a shard answers its share of the shard's
    queries; partial counts of all slots are summed by query."""
    queries = stored(queries)
    n = queries.count()
    index = index or ix.build(objects, config.leaf, config.fanout)
    if not index.levels:
        return _empty(queries, config)
    leaves, shards = placed(queries, index, config)
    slots = stored(placement.slots(shards))
    found = joins.leaf_candidates(queries, index)
    block = batching.block_size(n, config.block, config.launch)
    partial = stored(batching.routed_counts(found, index.objects, leaves, slots, max(1, n), config.route, block, config.dense_route))
    sparse = stored(joins.merged(partial.select("qid", "cnt")))
    return _reported(queries, sparse, partial, slots, shards, config, joins.counts_sparse(queries, index) if config.check else None)


def _empty(queries: DataFrame, config: Config) -> Run:
    spark = queries.sparkSession
    none = spark.createDataFrame([], "slot long, qid long, cnt long")
    slots = spark.createDataFrame([], "slot long, shard long, l1_id long, replica_rank long, replica_count long, set_no long")
    shards = spark.createDataFrame([], "l1_id long, shard long, n_leaves long, rects long, hits long, work long, replicas long")
    return _reported(queries, none.select("qid", "cnt"), none, slots, shards, config, none.select("qid", "cnt") if config.check else None)


def _reported(queries: DataFrame, sparse: DataFrame, partial: DataFrame, slots: DataFrame, shards: DataFrame, config: Config, other: DataFrame | None) -> Run:
    counts = joins.with_zeros(queries, sparse)
    batches = batching.batched(counts, config.launch, config.logical).groupBy("batch").agg(
        F.count("*").alias("queries"), F.countDistinct("logical_batch").alias("logical_batches"), F.sum("cnt").alias("overlaps"), F.count_if(F.col("cnt") > 0).alias("touched")
    )
    each = partial.groupBy("slot").agg(F.count("*").alias("answers"), F.sum("cnt").alias("overlaps"))
    zero = F.lit(0).cast("long")
    workers = slots.join(each, "slot", "left").select("slot", "shard", "replica_rank", "set_no", F.coalesce("answers", zero).alias("answers"), F.coalesce("overlaps", zero).alias("overlaps"))
    totals = counts.agg(F.count("*").alias("queries"), F.coalesce(F.sum("cnt"), zero).alias("overlaps"), F.count_if(F.col("cnt") > 0).alias("touched"))
    placed_ = shards.agg(F.count("*").alias("shards"), F.coalesce(F.sum("replicas"), zero).alias("slots"))
    spread = metrics.dispersion(workers, "overlaps").select(F.col("cv").alias("overlap_cv"), F.col("max").alias("overlap_max"))
    summary = totals.crossJoin(placed_).crossJoin(spread)  # a row each
    shown = counts if config.dense else counts.filter("cnt > 0")
    return Run(shown, batches, workers, placement.region_report(shards), summary, None if other is None else verify.per_query(counts, joins.with_zeros(queries, other)))


def write_log(spark: SparkSession, path: str, made: Run, **figures: object) -> None:
    """The run's tables and one record of further figures (seconds of each step, names of inputs), appended."""
    from tessella.sources.rects import append_record

    made.log(path)
    append_record(spark, f"{path}/records", **figures)
