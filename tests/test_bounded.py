"""Order statistics, context packing and structure pairs: exact results without a group in one task."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from orefield.operators import evaluate, fingerprints, rerank


def floors(values, points=(0.5, 0.95, 0.99)):
    v = sorted(values)
    return tuple(v[int(p * (len(v) - 1))] for p in points)


def between(values, points=(0.5, 0.95, 0.99)):
    v = sorted(values)
    at = [p * (len(v) - 1) for p in points]
    return tuple(v[math.floor(x)] + (v[math.ceil(x)] - v[math.floor(x)]) * (x - math.floor(x)) for x in at)


@pytest.mark.parametrize("parts, few", [(4096, 4096), (64, 40)])
def test_order_statistics(spark, monkeypatch, parts, few):
    monkeypatch.setattr(evaluate, "PARTS", parts)
    monkeypatch.setattr(evaluate, "SORTED_ROWS", few)
    rng = random.Random(parts)
    groups = {
        "even": [rng.random() for _ in range(200)],
        "steep": [math.copysign(10.0 ** rng.randint(-8, 8), rng.random() - 0.5) for _ in range(120)],
        "same": [2.5] * 400,
        "two": [1.0] * 300 + [math.nextafter(1.0, 2.0)] * 300,
        "one": [-7.0],
        None: [float(i) for i in range(50)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit("clash")).repartition(3)
    got = {r.g: tuple(r)[1:] for r in evaluate.floor_percentiles(df, "v", by="g").collect()}
    assert got == {g: floors(v) for g, v in groups.items()}
    got = {r.g: tuple(r)[1:] for r in evaluate.percentiles(df, "v", by="g").collect()}
    assert got.keys() == groups.keys() and all(got[g] == pytest.approx(between(v)) for g, v in groups.items())


def test_order_statistics_of_whole_numbers_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SORTED_ROWS", 5)
    values = [2**60 + i % 9 for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert tuple(evaluate.floor_percentiles(df, "v").first()) == floors(values)
    assert evaluate.floor_percentiles(df.limit(0), "v", by="v").collect() == []


def slow_pack(chunks, budget, most):
    out, n, total = {}, 0, 0
    for i, score, title, section, page, text in sorted(chunks, key=lambda c: (-c[1], c[0])):
        head = " | ".join(x for x in (f"Source [{n + 1}]: {title or 'Document'}", f"Section: {section}" if section else None, f"Page: {page}" if page is not None else None) if x)
        block = f"### {head}\n{text.strip(' ')}\n"
        cost = max(1, int(max(1.3 * len(block.split()), len(block) / 3.8)))
        fits = n < most and total + cost <= budget
        n, total = n + fits, total + cost * fits
        out[i] = fits, n if fits else None, cost
    return out


def test_packing_matches_a_loop_over_the_pool(spark):
    rng = random.Random(9)
    pools = {q: [(i, rng.choice([0.1, 0.5, 0.9, 0.95]), rng.choice(["T", "", None, "Long title"]), rng.choice(["", None, "S 1"]), rng.choice([None, 3]), "word " * rng.randint(1, 90)) for i in range(q * 1000, q * 1000 + n)] for q, n in enumerate([1, 5, 40, 200])}
    rows = [(q, *c) for q, cs in pools.items() for c in cs]
    df = spark.createDataFrame(rows, "query_id long, id long, score double, title string, section string, page int, text string").repartition(4)
    for tokens, most in ((500, 10), (300, 3)):
        got = {r.id: (r.used, r.number, r.tokens) for r in rerank.pack_context(df, tokens + 100, 100, most).collect()}
        want = {i: x for cs in pools.values() for i, x in slow_pack(cs, max(128, tokens), most).items()}
        assert got == want


def test_packing_a_pool_of_a_million(spark):
    pool = spark.range(1_000_000).select(
        F.lit(1).alias("query_id"), "id", (F.col("id") % 1000 / 1000).alias("score"), F.lit("t").alias("title"), F.lit("").alias("section"), F.lit(None).cast("int").alias("page"),
        F.repeat(F.lit("word "), (F.col("id") % 97 + 1).cast("int")).alias("text"),
    )
    got = rerank.pack_context(pool, 1400, 400, 8)
    used = got.where("used").collect()
    assert got.count() == 1_000_000 and sum(r.tokens for r in used) <= 1000 and sorted(r.number for r in used) == list(range(1, len(used) + 1))


SMILES = ["CCO", "CCCO", "c1ccccc1", "Cc1ccccc1", "CC(=O)O", "CCC(=O)O", "[Na+].[Cl-]", "BrCCl", "C%12CC%12", "C", "", None, "  ", "N#N"]


def test_fingerprint_pairs_match_all_pairs(spark):
    rng = random.Random(4)
    notations = SMILES + ["".join(rng.choice(["C", "O", "N", "(=O)", "c1ccccc1", "Cl", "[nH]"]) for _ in range(rng.randint(1, 9))) for _ in range(80)] + ["CCO"] * 60
    e = spark.createDataFrame(list(enumerate(notations)), "id long, smiles string").withColumn("bit", F.lit("clash")).repartition(3)
    sets = {r.id: set(r.on) for r in e.select("id", fingerprints.bits(F.col("smiles")).alias("on")).collect()}
    assert sets[10] == sets[11] == sets[12] == set() and len(sets[9]) == 1
    q = e.where("id % 3 = 0").select(F.col("id").alias("query_id"), "smiles")
    for least in (0.5, 0.8):
        got = {(r.query_id, r.id): round(r.score, 9) for r in fingerprints.similar(q, e, least).collect()}
        want = {(a, b): round(s, 9) for a in sets if a % 3 == 0 for b in sets if sets[a] and sets[b] and (s := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= least}
        assert got == want


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_fingerprint_blocks_lose_no_pair(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "BLOCK", size)
    rows = [(i, n) for i, n in enumerate(["CCO"] * 10 + [" CCO"] * 3 + ["CCCO"] * 7 + ["c1ccccc1", None, ""])] + [(5, "CCO"), (None, "CCO")]
    e = spark.createDataFrame(rows, "id long, smiles string")
    got = fingerprints.similar(e.where("id % 4 = 1").withColumnRenamed("id", "query_id"), e, 0.5, digits=2).collect()
    key = lambda n: "CCO" if n in ("CCO", " CCO") else n
    scores = {("CCO", "CCCO"): 0.83, ("CCCO", "CCO"): 0.83}
    want = [(a, b, scores.get((key(m), key(n)), 1.0)) for a, m in rows if a is not None and a % 4 == 1 and m for b, n in rows if n and (key(m) == key(n) or (key(m), key(n)) in scores)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_pairs_of_one_fingerprint_are_told_by_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 64, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        e = spark.range(4000).select("id", F.lit("CCO").alias("smiles"))
        pairs = fingerprints.similar(e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), e, 0.8)
        told = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(told) == 200 * 4000 and max(told) < 0.6 * sum(told)


def test_fingerprint_as_words_and_vector(spark):
    row = spark.createDataFrame([("Cc1ccccc1O",)], "s string").select(fingerprints.bits(F.col("s")).alias("b"))
    r = row.select("b", fingerprints.packed(F.col("b")).alias("p"), fingerprints.vector(F.col("b")).alias("v")).first()
    assert sum(bin(x & (1 << 64) - 1).count("1") for x in r.p) == len(r.b) == sum(r.v) and [i for i, x in enumerate(r.v) if x] == r.b
    assert all(r.p[b // 64] >> (b % 64) & 1 for b in r.b) and len(r.p) == 16 and len(r.v) == 1024
