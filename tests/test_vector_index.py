"""The inverted file over vectors against the exact search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orefield.operators import retrieval, vector_index

SCHEMA = "id long, embedding array<float>, tag string"


def rows(n=600, hot=300, size=8, seed=1):
    """Clusters, one vector that a third of all rows share, and rows that aren't vectors."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(12)]
    out = [(i, [x + rng.gauss(0, 0.4) for x in middles[i % 12]], f"t{i % 5}" if i % 50 else "rare") for i in range(n)]
    out += [(n + i, middles[0], "hot") for i in range(hot)]
    return out + [(5000, None, "t1"), (5001, [], "t1"), (5002, [None] * size, "t1"), (5003, [0.0] * size, "t1"), (5004, middles[1], None)]


def queries(spark, data, step=20):
    asked = [(r[0], r[1], r[2]) for r in data if r[1] and r[1][0] is not None and r[0] % step == 0]
    return spark.createDataFrame(asked, "query_id long, embedding array<float>, tag string")


def found(df):
    return {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def built(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumn("cell", F.lit("clash")).repartition(5)
    return data, df, vector_index.build(df, tag_col="tag")


def test_all_cells_give_the_exact_result(spark, built):
    data, df, index = built
    assert index.cells == 30 and index.rows.count() == 902
    asked = queries(spark, data)
    assert found(vector_index.search(index, asked, 7, index.cells)) == found(retrieval.vector_topk(asked, df, 7))


def test_settled_probes_reach_the_recall_and_read_little(spark, built):
    data, _, index = built
    asked = queries(spark, data)
    probes = vector_index.settle_probes(index, asked, 7, 0.95)
    r = vector_index.recall(index, asked, 7, probes).first()
    assert r.recall >= 0.95 and r.n_queries == asked.count() and probes < index.cells / 2
    # A third of all rows are one vector, so one cell, and a third of the queries read it.
    assert r.rows_read < 0.6


def test_index_depends_on_the_rows_alone(spark, built):
    data, _, index = built
    shuffled = data[:]
    random.Random(3).shuffle(shuffled)
    other = vector_index.build(spark.createDataFrame(shuffled, SCHEMA).repartition(2), tag_col="tag")
    assert (other.centroids == index.centroids).all()
    cells = lambda x: sorted((r.id, r.cell) for r in x.rows.select("id", "cell").collect())
    assert cells(other) == cells(index)


def test_filtered_search_finds_rare_tags(spark, built):
    data, df, index = built
    asked = queries(spark, data).withColumn("tag", F.when(F.col("query_id") % 3 == 0, "rare").otherwise(F.col("tag")))
    plan = vector_index.plan_filter(index, asked, 5, 30, 4)
    modes = {r.want: r["mode"] for r in plan.collect()}
    assert modes["rare"] == "pre"
    got = found(vector_index.filtered_search(index, plan, 5, 30))
    exact = {}
    for tag in ("rare", "hot", *(f"t{i}" for i in range(5))):
        exact |= found(retrieval.vector_topk(asked.where(F.col("tag") == tag), df.where(F.col("tag") == tag), 5))
    assert len({k for k in exact if got.get(k) == exact[k]}) >= 0.9 * len(exact)
    tags = dict((r[0], r[2]) for r in data)
    want = {r.query_id: r.tag for r in asked.collect()}
    assert all(tags[i] == want[q] for (q, _), (i, _) in got.items())


def test_recall_of_both_filters_is_measured(spark, built):
    data, _, index = built
    asked = queries(spark, data).withColumn("tag", F.when(F.col("query_id") % 3 == 0, "rare").otherwise(F.lit("none such")))
    got = vector_index.filter_recall(index, asked, 5, 10, 2).collect()
    rare = [r for r in got if r.query_id % 3 == 0]
    assert all(abs(r.selectivity - 100 * 12 / 902) < 1e-9 for r in rare) and all(r.pre_recall >= r.post_recall for r in rare)
    assert sum(r.post_recall for r in rare) < 0.7 * len(rare) < 0.9 * len(rare) <= sum(r.pre_recall for r in rare)
    assert all((r.selectivity, r.pre_recall, r.post_recall, r.recall_delta) == (0, 1, 1, 0) for r in got if r.query_id % 3)


def test_blocks_of_queries_and_odd_tables(spark, built, monkeypatch):
    data, df, index = built
    asked = queries(spark, data)
    want = found(vector_index.search(index, asked, 3, 6))
    monkeypatch.setattr(vector_index, "BLOCK_NUMBERS", 200)
    assert found(vector_index.search(index, asked, 3, 6)) == want
    none = vector_index.build(df.limit(0), tag_col="tag")
    assert none.rows.count() == 0 and none.cells == 1
    one = vector_index.build(df.where("id = 3"))
    assert found(vector_index.search(one, queries(spark, data, 200), 3, 4)) == found(retrieval.vector_topk(queries(spark, data, 200), df.where("id = 3"), 3))
    with pytest.raises(Exception, match="every vector needs"):
        vector_index.build(spark.createDataFrame([(1, [1.0], "a"), (2, [1.0, 2.0], "a")], SCHEMA))
