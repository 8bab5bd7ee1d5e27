"""What removing repeats deals out and leaves behind."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import suffixes
from tessella.storage import shared_folder

LETTERS = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ.0123456789"


def texts(n, size, passage_in):
    rng = random.Random(21)
    passage = "".join(rng.choices(LETTERS, k=400))
    return [(i, "".join(rng.choices(LETTERS, k=size)) + (passage[: 400 - i] if i < passage_in else "")) for i in range(n)]


def written(spark):
    """Bytes that the stages so far have written for others to read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_texts_that_lose_nothing_stay_where_they_are(spark, tmp_path):
    rows = texts(200, 20_000, 4)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    before = written(spark)
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(spark.read.parquet(f"{tmp_path}/documents")).drop("kept").collect()}
    dealt = sum(n for k, n in written(spark).items() if k not in before)
    assert got == {i: {0: 399, 1: 399, 2: 398, 3: 397}.get(i, 0) for i in range(200)}
    assert 0 < dealt < 0.7 * sum(len(t) for _, t in rows)  # pieces without their bytes, a few texts


def test_lists_of_pieces_are_not_broadcast(spark, monkeypatch):
    sized, plain = [], suffixes.guarded_join
    monkeypatch.setattr(suffixes, "guarded_join", lambda big, small, on, **more: sized.append(sorted(small.columns)) or plain(big, small, on, **more))
    df = spark.createDataFrame(texts(8, 900, 4), "doc_id long, text string")
    assert suffixes.remove_repeats(df).filter("n_removed > 0").count() == 4
    assert sized == [["a", "uniform"]]  # rows of bounded width alone


def test_pieces_are_not_dealt_out_to_find_those_of_hot_anchors(spark, monkeypatch):
    sized, plain = [], suffixes.guarded_join
    monkeypatch.setattr(suffixes, "guarded_join", lambda big, small, on, *how: sized.append((small.columns, *how)) or plain(big, small, on, *how))
    df = spark.createDataFrame(texts(8, 900, 4), "doc_id long, text string")
    assert suffixes.remove_repeats(df, anchor_bytes=300).filter("n_removed > 0").count() == 4
    assert sized[1:] == [(["a"], "left_anti"), (["a"], "left_semi")]


@pytest.mark.parametrize("anchor_bytes", [1 << 20, 300])
def test_tables_go_when_they_have_been_read(spark, anchor_bytes):
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    found = suffixes.remove_repeats(spark.createDataFrame(texts(8, 900, 4), "doc_id long, text string"), anchor_bytes=anchor_bytes)
    assert len(set(os.listdir(folder)) - before) == 1  # the spans, which found reads
    assert found.filter("n_removed > 0").count() == 4


@pytest.mark.parametrize("bits", [10, 25])
def test_filter_loses_no_key_and_no_row(spark, monkeypatch, bits):
    monkeypatch.setattr(suffixes, "FILTER_BITS", bits)
    rows, key = spark.range(20_000), F.xxhash64("id")
    made = suffixes.Filter(rows.filter("id % 10 = 0"), key)
    held = {r.id for r in made.split(rows, key).collect()}
    rest = {r.id for r in made.split(rows, key, "left_anti").collect()}
    assert held | rest == set(range(20_000)) and not held & rest
    assert held >= set(range(0, 20_000, 10)) and (bits == 10 or len(held) < 2500)
    assert made.split(rows, key).join(rows, "id").count() == len(held)
    assert suffixes.Filter(rows.limit(0), key).split(rows, key).count() == 0


def test_filter_that_lets_all_through(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "FILTER_BITS", 6)
    rows = [*texts(60, 300, 40), (3, None), (None, ""), (None, texts(1, 300, 1)[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffixes.remove_repeats(df).drop("kept").collect()), key=str)
    monkeypatch.setattr(suffixes, "FILTER_BITS", 25)
    assert got == sorted(map(tuple, suffixes.remove_repeats(df).drop("kept").collect()), key=str)
    assert len(got) == 63 and sum(r[2] > 0 for r in got) == 41
