import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventledger.llm import topk


def plain(rows, queries, k):
    out = set()
    for qid, q in queries:
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid and len(v) == len(q)
        )
        out |= {(qid, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shard_rows", [64, 8192])
def test_equals_brute_force_with_ties_and_sizes(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    rng = random.Random(1)
    rows = [(i, [rng.randint(-3, 3) for _ in range(4)]) for i in range(300)]
    rows += [(i, [1, 2, 2, 1]) for i in range(300, 420)] + [(500, [7]), (501, [-7]), (502, []), (503, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    queries = [r for r in rows if r[0] % 20 == 0]
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 7)
    assert {tuple(r) for r in got.collect()} == plain(rows, queries, 7)


def test_odd_vectors(spark):
    rows = [
        (0, [1.5, -0.01]), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, None), (None, [1.0, 1.0]),
        (4, [float("inf"), 0.0]), (20, [0.5, 0.5]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (0, [1.5, -0.01]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", topk.whole_numbers(F.col("embedding")))
    assert [r.v for r in df.where("vec_id = 0").collect()] == [[96, -1]] * 2
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()]
    near = 96 * 32 - 32
    assert got == [
        (0, 1, 5, near), (0, 2, 5, near), (0, 3, 20, near),
        (20, 1, 0, near), (20, 2, 0, near), (20, 3, 5, 2048), (20, 4, 5, 2048),
    ]
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_products_beyond_doubles():
    big = np.array([[1 << 40, 3]], np.int64)
    assert topk.products(big, np.array([[1 << 20, 1]], np.int64)).tolist() == [[(1 << 60) + 3]]
    assert topk.products(big, np.array([[1 << 40, 1]], np.int64)).tolist() == [[(1 << 63) - 1]]
