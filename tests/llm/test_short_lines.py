"""Operator 4 and the pipeline's second stage count lines of any length; by brute force, without a limit."""

import hashlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.01"


def cross_site(rows):
    sites = defaultdict(set)
    for text, site in rows:
        for x in (text or "").split("\n"):
            if x.strip(" "):
                sites[x].add(site)
    return {x for x, s in sites.items() if len(s) >= 8}


def test_op4_removes_short_lines(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    bad = cross_site((d["text"], d["source"]) for d in docs)
    assert any(len(x) < 10 for x in bad)
    want = []
    for d in docs:
        own = [] if d["text"] is None else d["text"].split("\n")
        kept = [x for x in own if x not in bad]
        want.append((d["doc_id"], len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = [tuple(r) for r in __spark_entry__.queries()["op4_line_spread"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_the_pipeline_removes_short_lines(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, f"own {i}\nok\n \nx{i % 2}", "en", f"s{i}", 0) for i in range(9)]
    got = pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == [(i, f"own {i}\n \nx{i % 2}", 10 - 2 + 2) for i in range(9)]
