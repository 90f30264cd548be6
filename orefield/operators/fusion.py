"""Reciprocal rank fusion and linear combination of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.operators.retrieval import rank

RRF_K = 60


def rrf_fuse(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """(query_id, id, rrf, best, <modality>_rank..., rank) from ranked lists (query_id, id, score, rank).

    A weight of 0 leaves a list out of the plan. Ties go by the best component score and then the id as text.
    """
    weights = weights or {}
    used = {m: df for m, df in lists.items() if weights.get(m, 1.0) > 0}
    rows = [
        df.select("query_id", "id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("r"), F.lit(m).alias("m"), F.lit(float(weights.get(m, 1.0))).alias("w"))
        for m, df in used.items()
    ]
    fused = reduce(DataFrame.unionByName, rows).groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("w") / (k + F.col("r"))), 12).alias("rrf"),
        F.max("score").alias("best"),
        *(F.max(F.when(F.col("m") == m, F.col("r"))).alias(f"{m}_rank") for m in lists),
    )
    out = rank(fused, F.desc("rrf"), F.desc("best"), F.col("id").cast("string"))
    return out if top is None else out.where(F.col("rank") <= top)


def linear_hybrid(a: DataFrame, b: DataFrame, alpha: float = 0.65, top: int = 10) -> DataFrame:
    """alpha * a + (1 - alpha) * b over all pairs of either list; a missing score counts as 0."""
    both = a.select("query_id", "id", (alpha * F.col("score")).alias("s")).unionByName(b.select("query_id", "id", ((1 - alpha) * F.col("score")).alias("s")))
    summed = both.groupBy("query_id", "id").agg(F.round(F.sum("s"), 12).alias("score"))
    return rank(summed, F.desc("score"), F.col("id")).where(F.col("rank") <= top)
