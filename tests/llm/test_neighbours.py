"""Neighbours against brute force: several blocks and cells, ties, repeated vectors, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, cell string, _v string"


def brute(rows, asked, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if asked(i):
            d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
            best = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in best]
    return out


def found(spark, rows, asked, **options):
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    out = {}
    for r in neighbours.nearest(table, queries=asked, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("block", [16_384, 150])
def test_recall_of_one_and_of_many_blocks(spark, block):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 3
    x = centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)) * 0.5
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows, F.col("_id") % 20 == 0, block=block), brute(rows, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / 750 >= 0.95
    assert all(got[i] == sorted(got[i], key=lambda p: (p[1], p[0])) and len(got[i]) == 10 for i in got)


def test_the_stop_leaves_most_of_clustered_rows_unverified():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(50, 32)) * 3
    x = centres[rng.integers(0, 50, 8000)] + rng.normal(size=(8000, 32)) * 0.3
    index = neighbours.Index(np.arange(8000), x)
    hits = 0
    for i in range(0, 8000, 100):
        _, ids = index.search(x[i], 11)
        hits += len(set(ids.tolist()) & set(np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:11].tolist()))
    assert index.verified < 0.05 * 80 * 8000 and hits >= 0.95 * 80 * 11


def test_ties_and_repeated_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(400)] + [(400 + i, [0.0, 1.0, float(i % 3)]) for i in range(30)]
    got = found(spark, rows, F.col("_id") % 100 == 0, block=64)
    assert got == brute(rows, lambda i: i % 100 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 2.0]), (2, [9.0, 9.0])]
    got = found(spark, rows, F.lit(True))
    assert {i: [j for j, _ in v] for i, v in got.items()} == {1: [2], 2: [1]}
    assert found(spark, [], F.lit(True)) == {} and found(spark, [(1, [1.0])], F.lit(True)) == {}
