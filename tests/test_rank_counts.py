"""Counts by ranks against all with all."""

import random

import numpy as np
import pytest

import __spark_entry__
from tessella.operators import index as ix
from tessella.operators import joins, rank_counts
from tessella.plans import planner

SIDES = "xmin int, ymin int, xmax int, ymax int"


def rects(n, span, size, seed):
    rng = random.Random(seed)
    for i in range(n):
        x, y = rng.randrange(span), rng.randrange(span)
        yield i, x, y, x + rng.randrange(size), y + rng.randrange(size)


def test_dominated():
    rng = np.random.default_rng(1)
    for n, asked in ((0, 3), (1, 5), (300, 100)):
        (p, u), w, (qp, qu) = rng.integers(0, 50, (2, n)), rng.integers(1, 5, n), rng.integers(-1, 52, (2, asked))
        assert (rank_counts.dominated(p, u, w, qp, qu) == [w[(p < a) & (u < b)].sum() for a, b in zip(qp, qu, strict=True)]).all()


@pytest.mark.parametrize(("n", "span", "size"), [(0, 9, 1), (600, 100, 9), (900, 12, 4), (500, 1000, 900)])
def test_as_nested(spark, monkeypatch, n, span, size):
    """With repeated rectangles and queries, touching edges, sides the wrong way round and nulls."""
    monkeypatch.setattr(rank_counts, "SLAB_ROWS", 30)
    more = [(-1, 5, 5, 1, 9), (-2, None, 1, 2, 3)] * 2 if n else []
    objects = spark.createDataFrame([*rects(n, span, size, 1), *more], "id long, " + SIDES)
    queries = spark.createDataFrame([*rects(100, span + 5, size, 2), (1000, 50, 5, 0, 900), (1001, None, 0, 1, 1), (3, 0, 0, 900, 900)], "qid long, " + SIDES)
    assert sorted(rank_counts.counts_ranked(queries, objects).collect()) == sorted(joins.counts_nested(queries, objects).collect())


def test_wide_queries_take_no_row_per_leaf(spark, monkeypatch):
    objects = spark.createDataFrame(list(rects(500, 100, 90, 3)), "id long, " + SIDES)
    queries = spark.createDataFrame(list(rects(60, 100, 90, 4)), "qid long, " + SIDES)
    index, taken = ix.build(objects, 4, 4), []
    monkeypatch.setattr(planner, "counts_ranked", lambda *a: taken.append(a) or rank_counts.counts_ranked(*a))
    few = sorted(planner.counts_of_any_width(queries, objects, index).collect())
    monkeypatch.setattr(planner, "LEAF_ROWS", 1000)
    assert not taken and planner.leaf_rows(queries, index) == joins.leaf_candidates(queries, index).count() > 1000
    assert sorted(planner.counts_of_any_width(queries, objects, index).collect()) == few and len(taken) == 1


@pytest.mark.parametrize("name", ["check_totals", "check_per_query"])
def test_checks_compare_no_all_with_all(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join LeftOuter" in line and "xmin#" in line for line in plan.splitlines())
