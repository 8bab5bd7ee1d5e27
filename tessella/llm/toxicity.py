"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy learns from confirmed toxic documents and unlabelled ones. With the class prior pi, the
risk is pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)): unlabelled documents stand for negatives once the positives among
them are taken off, and the estimate of the negatives' risk may not fall below 0 (where it would, the step goes back up
it instead). The loss is logistic, so a document's score is its estimated probability of being toxic.

Features are words and the beginnings of words (of 4, 5 and 6 bytes), present or not. Which of them carry weight is
chosen from counts that Spark aggregates; only the chosen ones' columns of the bounded sample reach the driver.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textbytes as tb
from tessella.llm.common import guarded_join, held_out, modest_batches, staged

#: The classifier is fitted on a sample of so many rows at most, chosen by a hash of the id. Scores cover all rows.
MAX_POSITIVE = 4000
MAX_UNLABELLED = 10_000
#: Features that get a weight.
MAX_FEATURES = 4096
#: A feature must occur in so many positive documents of the sample to be chosen.
MIN_POSITIVE = 4
BEGINNINGS = (4, 5, 6)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each text, and how many each has. A text without words has none."""
    hashes, owners = [], []
    for i, text in enumerate(_chunks(texts)):
        data = np.frombuffer(text[1], np.uint8)
        starts, ends, whole = tb._hash_words(data, tb._FOLDED)
        begins = np.cumsum([0, *text[2]])
        owner = text[0] + np.searchsorted(begins, starts, side="right") - 1
        up, down = tb.powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(tb._FOLDED[data] * up[:-1], out=total[1:])
        hashes.append(whole)
        owners.append(owner)
        for k in BEGINNINGS:
            longer = ends - starts > k
            s = starts[longer]
            hashes.append(tb.mix((total[s + k] - total[s]) * down[s] + np.uint64(k << 32)))
            owners.append(owner[longer])
    h, o = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(o, kind="stable")
    found, counts, _ = tb.distinct(h[order], np.bincount(o, minlength=len(texts)))
    return found, counts


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, bytes, list[int]]]:
    """(number of the first text, joined texts, their lengths); a very long text comes in parts cut at white space."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= 2 * tb.SLICE):
            size += len(texts[end])
            end += 1
        if size <= 2 * tb.SLICE:
            yield at, b" ".join(texts[at:end]) + b" ", [len(t) + 1 for t in texts[at:end]]
        else:
            text, begin = texts[at], 0
            while begin < len(text):
                stop = min(len(text), begin + tb.SLICE)
                while stop < len(text) and not tb._SPACE[text[stop]]:
                    stop += 1
                yield at, text[begin:stop], [stop - begin]
                begin = stop
        at = end


@dataclasses.dataclass
class Model:
    """Weights of the chosen features' hashes (ascending) and a bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(self.keys) or not len(hashes):
            return np.full(len(counts), self.bias)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        own = np.where(self.keys[at] == hashes, self.weights[at], 0.0)
        return self.bias + np.bincount(np.repeat(np.arange(len(counts)), counts), weights=own, minlength=len(counts))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*features(texts)), -500, 500)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of n binary features and the bias, from each document's list of feature numbers. Adam on the whole
    sample; without positives or unlabelled documents the weights are 0 and the bias is that of the prior."""
    base = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled or not n:
        return np.zeros(n), base
    docs = [*positive, *unlabelled]
    column = np.concatenate(docs).astype(np.int64)
    row = np.repeat(np.arange(len(docs)), list(map(len, docs)))
    is_p = np.arange(len(docs)) < len(positive)
    weights, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    weights[n] = base
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=weights[column], minlength=len(docs)) + weights[n]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        minus = np.logaddexp(0, z)  # the loss if negative
        negative = minus[~is_p].mean() - prior * minus[is_p].mean()
        # d loss / d z by document
        g_minus = np.where(is_p, -prior * p / len(positive), p / len(unlabelled))
        if negative >= 0:
            g = np.where(is_p, prior * (p - 1) / len(positive), 0.0) + g_minus
        else:
            g = -g_minus
        grad = np.append(np.bincount(column, weights=g[row], minlength=n), g.sum())
        grad[:n] += decay / len(docs) * weights[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights[:n], float(weights[n])


def _sampled(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """At most about most rows, by a hash of the id."""
    n = rows.count()
    share = min(1.0, most / max(1, n))
    return rows.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, label).

    Only rows outside the held-out fold are learnt from. Labels that are null are no labels; repeated ones count once.
    Of documents that repeat an id the one with the least list of features counts, so that what reaches the driver is
    bounded. The prior is the share of positives among the labelled rows outside the fold, between 0.01 and 0.5.
    """
    modest_batches(docs)
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    marked = own.agg(F.count("*"), F.sum("y")).first()
    prior = min(0.5, max(0.01, (marked[1] or 0) / max(1, marked[0])))
    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = _sampled(own.filter("y = 1").select("doc_id"), MAX_POSITIVE, 1)
    positive = guarded_join(texts, staged(chosen), "doc_id", "left_semi").withColumn("p", F.lit(1))
    unlabelled = _sampled(texts, MAX_UNLABELLED, 2).withColumn("p", F.lit(0))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, parts in tb.slices(batches):
            found, counts = features(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("p"), lists], names=["doc_id", "p", "f"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    given = positive.union(unlabelled).select("doc_id", "p", "text").mapInArrow(extract, f"doc_id {id_type}, p int, f array<long>")
    sample = staged(given.groupBy("doc_id", "p").agg(F.min("f").alias("f")).select("p", "f"))
    sizes = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    counted = sample.select("p", F.explode("f").alias("k")).groupBy("k").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b")).filter(F.col("a") >= MIN_POSITIVE)
    share_p, share_u = (F.col("a") + 0.5) / (n_p + 1), (F.col("b") + 0.5) / (n_u + 1)
    strength = (share_p - share_u) / F.sqrt(share_u)
    best = counted.orderBy(F.abs(strength).desc(), "k").limit(MAX_FEATURES).select("k").collect()
    keys = np.sort(np.array([r["k"] for r in best], np.int64).view(np.uint64))
    if not len(keys) or not n_p or not n_u:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for one in batch.column("f"):
                h = np.array(one.values, np.int64).view(np.uint64)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                lists.append(at[keys[at] == h].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(lists, pa.list_(pa.int32()))], names=["p", "f"])

    rows = sample.mapInArrow(project, "p int, f array<int>").toArrow()
    lists = [np.asarray(x.values) if x.values is not None else np.zeros(0, np.int32) for x in rows.column("f")]
    p = rows.column("p").to_pylist()
    # in one order whatever the partitions, so that reruns agree
    order = sorted(range(len(p)), key=lambda i: lists[i].tobytes())
    weights, bias = fit_nnpu([lists[i] for i in order if p[i]], [lists[i] for i in order if not p[i]], len(keys), prior)
    return Model(keys, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a score between 0 and 1, from the whole text alone. Null and empty texts get the bias's score; rows
    are independent, so ties and repeated rows get equal scores; a column named into is replaced. A very long text is
    read in parts, of which the features' hashes are held. An empty table gives no rows."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = modest_batches(docs).drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in tb.slices(batches, text):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shared.value.scores(texts))], names=[*rows.schema.names, into])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(into, DoubleType(), False)]))
