"""Packed numbers of the similarity join, and the choice of one row per group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from measurelens.llm import jaccard
from measurelens.llm.texts import map_texts


def test_packed_numbers_come_back():
    draw = np.random.default_rng(5)
    numbers = draw.integers(0, 1 << 32, 1000).astype(np.uint32)
    assert (jaccard.from_planes(jaccard.planes(numbers)) == numbers).all()
    assert len(jaccard.from_planes(jaccard.planes(numbers[:0]))) == 0
    size = np.array([3, 0, 500, 9000])
    owner, code = np.repeat(np.arange(4), size), draw.integers(0, 1 << 63, size.sum()).astype(np.uint64)
    counts = [jaccard.unpacked(c) for c in jaccard.bucket_counts(owner, code, size)]
    assert [int(c.sum()) for c in counts[:3]] == [3, 0, 500] and all(c.max() <= 15 for c in counts)


def test_bounds_of_packed_counts_stay_below_the_difference():
    draw = np.random.default_rng(6)
    for n in (40, 700):
        x, y = (np.unique(draw.integers(0, 2 * n, n)).astype(np.uint64) for _ in range(2))
        both = [jaccard.unpacked(jaccard.bucket_counts(np.zeros(len(s), np.int64), jaccard.mix(s), np.array([len(s)]))[0]) for s in (x, y)]
        assert jaccard.least_difference(both[0], both[1][None, :])[0] <= len(np.setxor1d(x, y))


def test_a_carried_text_keeps_its_nulls(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    results = T.StructType([T.StructField("n", T.LongType())])
    found = map_texts(rows, "text", results, lambda: lambda col: [pa.array([len(x) for x in col.to_pylist()], pa.int64())])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a b", 3), (2, None, 0), (3, "", 0)]


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near, other = long.replace("w59", "x59"), " ".join(f"v{i}" for i in range(60))
    rows = [(5, long, "a"), (None, long, "b"), (7, near, "c"), (5, other, "d"), (9, other, "e"), (9, "", "f"), (9, None, "g"), (5, near, "h"), (8, "alone", "i"), (None, "by itself", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = {r.root for r in jaccard.keep_one(docs).collect()}
    # two rows of the first group have id 5: the smaller text stays
    assert kept == {"a", "d", "f", "g", "i", "j"}
    assert jaccard.keep_one(docs).columns == docs.columns
