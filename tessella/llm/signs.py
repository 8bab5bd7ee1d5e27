"""Near duplicates of embeddings by random-hyperplane sign hashing in several tables.

Vectors that are equal form one class. A class's signature is the signs of its vector's products with random
hyperplanes; each table takes some bits of it as its bucket. Classes that share a bucket in any table and whose
sketches (at most SKETCH bits of the signature, so a row's width doesn't grow with the number of tables) differ in few
bits become candidates, and the cosine in double precision decides. Vectors are divided by their largest component
first, so that no finite vector overflows or vanishes.

The number of bits grows with the logarithm of the number of classes, so that buckets stay small, and the number of
tables follows from it and from MISS, the chance that a pair at exactly the threshold shares no bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import modest_batches, staged
from tessella.llm.components import components

COSINE = 0.95
MISS = 1e-4
SEED = 11
#: Bits of the signature that a table's rows carry.
SKETCH = 256


def plan(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int, int]:
    """(bits of a bucket, tables, most differing bits of a candidate's sketch) for n classes."""
    same = 1 - math.acos(cosine) / math.pi
    bits = max(8, math.ceil(math.log2(max(2, n))) - 4)
    tables = math.ceil(math.log(miss) / math.log(1 - same**bits))
    whole = min(SKETCH, bits * tables)
    return bits, tables, math.ceil(whole * (1 - same) + 6 * math.sqrt(whole * same * (1 - same)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, each divided by its largest component."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    most = np.abs(rows).max(axis=1, keepdims=True, initial=0.0)
    # a largest component near the least double has no finite inverse, but a quotient
    return rows / np.where(most > 0, most, 1.0)


def _valid(embedding: str) -> Column:
    """Not null, not empty or zero, and all components finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x.cast("double") != 0.0), F.lit(False))


def classes_of(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows (vec_id, k1, k2) and classes of equal vectors (cid, k1, k2, rep, m, v, dim)."""
    keyed = vectors.filter(_valid(embedding)).select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
    keyed = keyed.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    grouped = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v"))
    return keyed.select("vec_id", "k1", "k2"), staged(grouped.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))


def pairs(classes: DataFrame, cosine: float = COSINE, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """(a, b) of classes (cid, v, dim), a < b, whose cosine is at least the threshold."""
    bits, tables, most = plan(classes.count(), cosine, miss)
    sketch = min(SKETCH, bits * tables)
    longs = -(-sketch // 64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits * tables))
                on = _matrix(part.column("v")) @ planes[dim] > 0
                packed = np.zeros((len(on), longs * 64), bool)
                packed[:, :sketch] = on[:, :sketch]
                words = np.packbits(packed, axis=1, bitorder="little").view("<i8")
                buckets = on.reshape(len(on), tables, bits) @ (1 << np.arange(bits))
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("dim"), pa.array(list(buckets.astype(np.int32)), pa.list_(pa.int32())), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(longs)]],
                    names=["cid", "dim", "buckets", *[f"s{i}" for i in range(longs)]],
                )

    words = [f"s{i}" for i in range(longs)]
    signed = classes.select("cid", "dim", "v").mapInArrow(sign, f"cid long, dim int, buckets array<int>, {', '.join(f'{w} long' for w in words)}")
    rows = staged(signed.select("cid", "dim", F.posexplode("buckets").alias("t", "bucket"), *words))
    a = rows.select("t", "bucket", "dim", F.col("cid").alias("a"), *[F.col(w).alias(f"a_{w}") for w in words])
    b = rows.select("t", "bucket", "dim", F.col("cid").alias("b"), *[F.col(w).alias(f"b_{w}") for w in words])
    apart = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words), F.lit(0))
    found = a.join(b.hint("merge"), ["t", "bucket", "dim"]).filter((F.col("a") < F.col("b")) & (apart <= most)).select("a", "b").distinct()
    own = classes.select("cid", "v")
    both = found.join(own.select(F.col("cid").alias("a"), F.col("v").alias("va")).hint("merge"), "a").join(own.select(F.col("cid").alias("b"), F.col("v").alias("vb")).hint("merge"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("va").value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x, y = _matrix(part.column("va")), _matrix(part.column("vb"))
                value = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
                yield part.select(["a", "b"]).filter(pa.array(value >= cosine))

    return both.select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are their own
    component; so have vectors of other dimensions than the rest among themselves. Rows that repeat a vector count as
    linked with each other, also under one id. A null id comes back as null, and its component_id is the smallest id
    that it reaches; component_id has the type of the ids. An empty table gives no rows. Only vec_id and embedding are
    read, so further columns, whatever their names, change nothing. A very long vector costs its length times the number
    of planes, which are held for each dimension that a task meets.
    """
    keyed, classes = classes_of(modest_batches(vectors), vec_id, embedding)
    links = staged(pairs(classes, cosine))
    weight = classes.select(F.col("cid").alias("w_cid"), "m")
    ends = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).toDF("cid", "other")
    degree = ends.join(weight.hint("merge"), F.col("other") == F.col("w_cid")).groupBy("cid").agg(F.sum("m").alias("deg"))
    member = components(links)
    named = classes.select("cid", "k1", "k2", "rep", "m").join(member.withColumnRenamed("id", "cid").hint("merge"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    full = named.join(least.hint("merge"), "root").join(degree.hint("merge"), "cid", "left")
    full = staged(full.select("k1", "k2", (F.col("m") - 1 + F.coalesce("deg", F.lit(0))).alias("n_links"), "component_id"))
    linked = keyed.join(full.hint("merge"), ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = vectors.filter(~_valid(embedding)).select(F.col(vec_id).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95
),
reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON id = vec_id LEFT JOIN degree ON a = vec_id
"""
