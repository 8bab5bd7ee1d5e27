"""Range counts by inclusion and exclusion of ranks, without a row per pair or per candidate.

With xmin <= xmax and ymin <= ymax on both sides, an object misses a query if it ends before it begins or begins after
it ends, on one axis or on both: cnt = N - left - right - below - above + the four corners. Each corner counts the points
with p < qp and u < qu. Both axes are cut into slabs; a corner is then the whole cells before the query's cell (from
histograms), and the rest of the query's own slab of x and of y, which one task counts for all queries of the slab."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import SIDES
from tessella.operators.joins import pairs_nested
from tessella.storage import stored

#: Slabs of an axis that the objects' quantiles, and the queries', make at most.
SLABS = 64
#: Objects (distinct rectangles) of a slab, while there are fewer slabs.
SLAB_ROWS = 20_000
_FAR = 1 << 40  # beyond any side
_PART = "family int, slab int, p long, u long, v long, w long"


def dominated(p: np.ndarray, u: np.ndarray, w: np.ndarray, qp: np.ndarray, qu: np.ndarray) -> np.ndarray:
    """For each query the sum of w over p < qp and u < qu, by a wavelet matrix over the ranks of u in order of p."""
    order = np.argsort(p, kind="stable")
    hi = np.searchsorted(p[order], qp, side="left")
    lo, found = np.zeros(len(qp), np.int64), np.zeros(len(qp), np.int64)
    by_u = np.argsort(u, kind="stable")
    rank = np.empty(len(u), np.int64)
    rank[by_u] = np.arange(len(u))
    below = np.searchsorted(u[by_u], qu, side="left")
    rank, w = rank[order], w[order]
    for bit in range(len(u).bit_length() - 1, -1, -1):
        zero = (rank >> bit) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(zero)])
        sums = np.concatenate([[0], np.cumsum(np.where(zero, w, 0))])
        one = (below >> bit) & 1 == 1
        found += np.where(one, sums[hi] - sums[lo], 0)
        lo, hi = (np.where(one, zeros[-1] + at - zeros[at], zeros[at]) for at in (lo, hi))
        rank, w = (np.concatenate([a[zero], a[~zero]]) for a in (rank, w))
    return found


def _axes(left: str, right: str, below: str, above: str) -> list[Column]:
    """The four axes, each so that smaller means outside: objects by (xmax, xmin, ymax, ymin), queries by the opposite."""
    up = lambda c: F.col(c).cast("long")
    return [up(left).alias("a0"), (-up(right)).alias("a1"), up(below).alias("a2"), (-up(above)).alias("a3")]


def _slab_cuts(objects: DataFrame, queries: DataFrame, n: int) -> list[np.ndarray]:
    """Where the slabs of each axis begin. A quantile's value has a slab of its own, so that one with very many objects
    takes no other with it, and as nothing is less than itself these objects needn't be looked at there."""
    parts = max(1, min(SLABS, -(-n // SLAB_ROWS)))
    if parts == 1:
        return [np.empty(0, np.int64)] * 4
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    rows = [df.agg(*[F.percentile_approx(f"a{i}", shares, F.lit(10_000)).alias(f"a{i}") for i in range(4)]).first() for df in (objects, queries)]
    values = [np.array([v for r in rows for v in r[i] or ()], np.int64) for i in range(4)]
    return [np.unique(np.concatenate([v, v + 1])) for v in values]


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _histograms(objects: DataFrame, cuts: list[np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Objects by slab of each axis of x and each of y."""
    sizes = [len(c) + 1 for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(x, y): np.zeros(sizes[x] * sizes[y], np.int64) for x in (0, 1) for y in (2, 3)}
        for batch in batches:
            *axes, w = _columns(batch, ["a0", "a1", "a2", "a3", "w"])
            at = [np.searchsorted(c, a, side="right") for c, a in zip(cuts, axes, strict=True)]
            for (x, y), into in held.items():
                np.add.at(into, at[x] * sizes[y] + at[y], w)
        for (x, y), counts in held.items():
            cell = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), x, np.int32)), pa.array(np.full(len(cell), y, np.int32)), pa.array(cell), pa.array(counts[cell])], names=["x", "y", "cell", "w"])

    found = objects.mapInArrow(run, "x int, y int, cell long, w long").groupBy("x", "y", "cell").agg(F.sum("w").alias("w")).toArrow()
    xs, ys, cells, ws = (found.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "cell", "w"))
    out = {}
    for x in (0, 1):
        for y in (2, 3):
            grid, own = np.zeros(sizes[x] * sizes[y], np.int64), (xs == x) & (ys == y)
            grid[cells[own]] = ws[own]
            out[x, y] = grid.reshape(sizes[x], sizes[y])
    return out


def _before(grids: dict[tuple[int, int], np.ndarray]) -> pa.Table:
    """Rows that stand for all objects of the slabs before one: for a slab of x their number, for one of y their numbers
    by slab of x. Those of y come twice, by either axis of x, which a negative row makes up for."""
    rows = []

    def put(family: int, slab: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        rows.append(np.stack([np.full(len(w), family), np.full(len(w), slab), np.full(len(w), -_FAR), u, v, w]))

    for x in (0, 1):
        for slab, total in enumerate(np.concatenate([[0], np.cumsum(grids[x, 2].sum(axis=1))[:-1]])):
            put(x, slab, np.array([_FAR]), np.array([_FAR]), np.array([total]))
    for y in (2, 3):
        upto = [np.concatenate([np.zeros((g.shape[0], 1), np.int64), np.cumsum(g, axis=1)[:, :-1]], axis=1) for g in (grids[0, y], grids[1, y])]
        for slab in range(upto[0].shape[1]):
            for x in (0, 1):
                t = np.flatnonzero(upto[x][:, slab])
                far = np.full(len(t), _FAR)
                put(y, slab, far if x else t, t if x else far, upto[x][t, slab])
            put(y, slab, np.array([_FAR]), np.array([_FAR]), -upto[0][:, slab].sum(keepdims=True))
    family, slab, *rest = np.concatenate(rows, axis=1)
    return pa.table([family.astype(np.int32), slab.astype(np.int32), *rest], names=["family", "slab", "p", "u", "v", "w"])


def _dealt(rows: DataFrame, cuts: list[np.ndarray], last: str, drop_single: bool) -> DataFrame:
    """Each row four times: by slab of x with both axes of y, by slab of y with the slabs of both axes of x."""
    single = [np.concatenate([[False], np.diff(c) == 1, [False]])[: len(c) + 1] if len(c) else np.zeros(1, bool) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            axes = _columns(batch, ["a0", "a1", "a2", "a3"])
            at = [np.searchsorted(c, a, side="right") for c, a in zip(cuts, axes, strict=True)]
            for k in range(4):
                u, v = (axes[2], axes[3]) if k < 2 else (at[0], at[1])
                kept = ~single[k][at[k]] if drop_single else np.ones(len(u), bool)
                rest = batch.column(last).filter(pa.array(kept))
                n = len(rest)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(at[k][kept].astype(np.int32)), pa.array(axes[k][kept]), pa.array(u[kept]), pa.array(v[kept]), rest], names=["family", "slab", "p", "u", "v", last])

    return rows.mapInArrow(run, f"family int, slab int, p long, u long, v long, {last} long")


def _counted(n: int):
    def run(objects: pa.Table, queries: pa.Table) -> pa.Table:
        numbers = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        p, u, v, w = (numbers(objects, c) for c in ("p", "u", "v", "w"))
        qp, qu, qv = (numbers(queries, c) for c in ("p", "u", "v"))
        order = np.argsort(p, kind="stable")
        sums = np.concatenate([[0], np.cumsum(w[order])])
        got = dominated(p, u, w, qp, qu) + dominated(p, v, w, qp, qv) - sums[np.searchsorted(p[order], qp, side="left")]
        if len(qp) and queries.column("family")[0].as_py() == 0:
            got += n
        return pa.table({"qid": queries.column("qid").cast(pa.int64()), "cnt": got})

    return run


def counts_ranked(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """(qid, cnt) with zeros, as counts_nested gives them. Equal rectangles count as one with a weight. Shuffled are four
    rows of each distinct rectangle and of each query, however many overlaps there are; a slab's rows are held by one
    task. Rectangles with sides the wrong way round, which readers don't make, are compared one by one; one with a null
    overlaps nothing."""
    well = (F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax"))
    odd = (F.col("xmin") > F.col("xmax")) | (F.col("ymin") > F.col("ymax"))
    queries = stored(queries.select(F.col("qid").cast("long").alias("qid"), *SIDES), "queries")
    boxes = stored(objects.groupBy(*SIDES).agg(F.count("*").alias("w")), "objects")
    n, distinct, odd_objects = boxes.agg(F.coalesce(F.sum(F.when(well, F.col("w"))), F.lit(0)), F.count_if(well), F.count_if(odd)).first()
    odd_queries = queries.filter(odd).count()
    parts = [queries.select("qid", F.lit(0).cast("long").alias("cnt"))]
    if n:
        points = boxes.filter(well).select(*_axes("xmax", "xmin", "ymax", "ymin"), "w")
        asked = queries.filter(well).select(*_axes("xmin", "xmax", "ymin", "ymax"), "qid")
        cuts = _slab_cuts(points, asked, distinct)
        before = queries.sparkSession.createDataFrame(_before(_histograms(points, cuts)), _PART)
        held = _dealt(points, cuts, "w", True).union(before).groupBy("family", "slab")
        parts.append(held.cogroup(_dealt(asked, cuts, "qid", False).groupBy("family", "slab")).applyInArrow(_counted(n), "qid long, cnt long"))
    for asked, others, some in ((queries, boxes.filter(odd), odd_objects), (queries.filter(odd), boxes.filter(well), odd_queries)):
        if some:
            numbered = others.withColumn("id", F.col("w"))
            parts.append(pairs_nested(asked, numbered).select("qid", F.col("id").alias("cnt")))
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    return found.groupBy("qid").agg(F.sum("cnt").alias("cnt"))
