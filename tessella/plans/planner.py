"""Chooses how a range count runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import index as ix
from tessella.operators import joins
from tessella.operators.rank_counts import counts_ranked

#: Up to so many comparisons, comparing all with all beats building an index (about half a second on one machine).
NESTED = 50_000_000
#: Up to so many rows of a query and a leaf that it overlaps, the index join shuffles them (about 30 bytes each).
LEAF_ROWS = 20_000_000
#: Queries from which their number is told.
TRIED = 1000


def range_count(queries: DataFrame, objects: DataFrame, strategy: str = "auto", dense: bool = True, leaf: int = ix.LEAF, fanout: int = ix.FANOUT, index: ix.Index | None = None) -> DataFrame:
    """(qid, cnt) of the objects that overlap each query.

    strategy: nested, index or auto; dense: with zeros. An index that exists already is used."""
    if strategy not in ("auto", "nested", "index"):
        raise ValueError(f"no such strategy: {strategy}")
    if strategy == "auto":
        strategy = "index" if index is not None or queries.count() * objects.count() > NESTED else "nested"
    if strategy == "nested":
        counts = joins.counts_nested(queries, objects)
        return counts if dense else counts.filter("cnt > 0")
    index = index or ix.build(objects, leaf, fanout)
    return joins.counts_dense(queries, index) if dense else joins.counts_sparse(queries, index)


def leaf_rows(queries: DataFrame, index: ix.Index) -> int:
    """About how many rows of a query and an overlapping leaf a search makes, told by TRIED queries with qids from 0."""
    n = queries.count()
    every = max(1, n // TRIED)
    tried = queries.filter(F.pmod("qid", F.lit(every)) == 0)
    return joins.leaf_candidates(tried, index).count() * every if index.levels else 0


def counts_of_any_width(queries: DataFrame, objects: DataFrame, index: ix.Index) -> DataFrame:
    """(qid, cnt) with zeros. Queries that overlap few leaves go down the index; where they overlap so many that its rows
    would grow with queries times objects, ranks are counted instead. The trial only chooses the plan: both are exact."""
    return joins.counts_dense(queries, index) if leaf_rows(queries, index) <= LEAF_ROWS else counts_ranked(queries, objects)
