"""Connected components by contraction, with no step that gathers a component in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import drop_staged, staged


def _mapped(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """column replaced by its parent, where it has one."""
    p = parents.select(F.col("u").alias("cc_u"), F.col("p").alias("cc_p"))
    return rows.join(p.hint("merge"), rows[column] == p["cc_u"], "left").withColumn(column, F.coalesce("cc_p", column)).drop("cc_u", "cc_p")


#: Up to so many distinct edges (a few MB) are contracted in one task; more by rounds over all tasks.
ONE_TASK_EDGES = 1 << 18


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        for end in (u, v):
            np.minimum.at(label, before[end], low)  # the least label of a neighbour, at the root
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _in_one_task(left: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = pa.Table.from_batches(list(batches), pa.schema([("hi", pa.int64()), ("lo", pa.int64())]))
        nodes, roots = least_labels(*(all_.column(c).to_numpy() for c in ("hi", "lo")))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["id", "root"])

    return staged(left.select("hi", "lo").coalesce(1).mapInArrow(run, "id long, root long"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b): root is the same long for all nodes of a component, one of its ids.

    Each round every node points at its least neighbour below it (a map-side combined minimum, so hubs don't hurt),
    the pointers are shortened to roots by doubling, and edges between different roots remain. The number of nodes at
    least halves for all but star-like parts, which end one round later. Every round is a written table. What is no
    more than ONE_TASK_EDGES edges is done in one task instead. Self-loops, repeated edges and edges with a null end are
    ignored; no edges give no rows.
    """
    left = staged(
        edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    if left.count() <= ONE_TASK_EDGES:
        return _in_one_task(left)
    labels = staged(left.select(F.explode(F.array("hi", "lo")).alias("id")).distinct().withColumn("root", F.col("id")))
    while left.limit(1).count():
        parents = staged(left.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("p")))
        while True:
            up = parents.select(F.col("u").alias("g_u"), F.col("p").alias("g_p"))
            joined = parents.join(up.hint("merge"), parents["p"] == up["g_u"], "left")
            shorter = staged(joined.select("u", F.coalesce("g_p", "p").alias("p"), F.col("g_p").isNotNull().alias("moved")))
            drop_staged(parents)
            moved, parents = shorter.filter("moved").limit(1).count(), shorter
            if not moved:
                break
        last = labels, left
        labels = staged(_mapped(labels, "root", parents))
        ends = _mapped(_mapped(left, "hi", parents), "lo", parents)
        left = staged(ends.filter("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
        for old in (*last, parents):
            drop_staged(old)
    return labels
