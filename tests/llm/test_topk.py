"""Exact top-k by sorted lists against scores of all pairs."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from orefield.llm import topk


def slow(rows, k):
    """rows (id, vector): sorted (query_id, rank, vec_id, score) of those whose id 50 divides."""
    valid = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, top = [], 2**63 - 1
    for a, (i, q) in enumerate(valid):
        if i is None or i % 50:
            continue
        scored = [(max(-top, min(top, sum(x * y for x, y in zip(q, v)))), j) for b, (j, v) in enumerate(valid) if a != b and len(v) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(i, r, j, s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def run(spark, rows, k=5, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("clash")).withColumn("score", F.lit(1)).repartition(parts)
    return sorted((tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, k).collect()), key=repr)


def test_matches_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, [rng.choice([-0.25, 0.0, 0.25]) for _ in range(8)]) for i in range(300)]  # ties
    rows += [(700 + i, rows[50][1]) for i in range(120)]  # copies of a query's vector
    rows += [(50, rows[50][1]), (50, rows[3][1]), (None, rows[50][1]), (None, [1.0] * 8)]
    rows += [(2000, None), (2001, [None] * 8), (2050, [float("nan")] * 8), (2100, [float("inf")] + [0.0] * 7), (2150, [0.0] * 8)]
    rows += [(2200, [0.5, 0.5]), (2250, [0.5, -0.5]), (2251, [0.1, 0.2]), (2300, []), (2301, []), (2350, [3.0])]
    assert run(spark, rows) == slow(rows, 5)
    assert run(spark, rows, k=1, parts=7) == slow(rows, 1)


def test_very_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1.0, -1.0]) * rng.random() * 10.0 ** rng.choice([0, 3, 8, 16, 300]) for _ in range(3)]) for i in range(120)]
    assert run(spark, rows) == slow(rows, 5)
    rows = [(i, [rng.random() * 2.0**22, -rng.random() * 2.0**22]) for i in range(120)]
    assert run(spark, rows) == slow(rows, 5)


def test_empty_and_nobody_asked(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert run(spark, [(0, [1.0])]) == []


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 30)
    rng = random.Random(3)
    rows = [(i * 10, [rng.gauss(0, 1) for _ in range(4)]) for i in range(150)]
    assert run(spark, rows) == slow(rows, 5)


def test_stops_early_where_the_threshold_falls():
    rng = np.random.default_rng(4)
    spread = np.exp(rng.normal(0, 3, (4096, 4)))  # few large components
    vectors = np.floor(spread / spread.max() * 1000)
    lists = topk.Lists(vectors, np.ones(4096, np.int64), np.arange(4096), np.arange(4096))
    queries = vectors[rng.permutation(4096)[:64]] + 1
    best = topk.Best(64, 5)
    took = lists.search(queries, np.full(64, -1), np.arange(64), best)
    scores = queries @ vectors.T
    want = np.lexsort((np.broadcast_to(np.arange(4096), scores.shape), -scores), axis=1)[:, :5]
    assert (best.id == want).all() and took < 0.2 * 64 * 4096
