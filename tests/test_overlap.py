"""Word overlap under score bounds against counts of all pairs."""

from __future__ import annotations

import random
import re

from orefield.operators import overlap, retrieval

WORDS = [f"w{i}" for i in range(400)]


def corpus(rng, n):
    pick = lambda m: " ".join(WORDS[min(399, int(rng.expovariate(0.02)))] for _ in range(m))
    texts = [pick(rng.choice([3, 30, 300])) for _ in range(n)]
    return texts + ["", None, "W0, w1; W2!", "w0 " * 50, texts[0], texts[0], "reads CAS 50-78-2 and React-102b", "xreact-102", "50-78-21"]


def slow(queries, texts, k, boost=2.0):
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    out = {}
    for q, text in queries:
        asked = words(text)
        idents = re.findall(r"\b\d{2,7}-\d{2}-\d\b|\b[A-Z]{2,8}-\d{1,6}\b", text or "")
        scored = []
        for i, t in enumerate(texts):
            held = any(re.search(rf"(?<!\w){re.escape(x.lower())}", (t or "").lower()) for x in idents)
            score = len(asked & words(t)) / max(1, len(asked)) + (boost if held else 0)
            scored += [(-score, i)] if score > 0 else []
        out |= {(q, r): (i, round(-s, 9)) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def fast(spark, queries, texts, k, **kw):
    q = spark.createDataFrame(queries, "query_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    return {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in retrieval.token_overlap_topk(q, d, k, **kw).collect()}


def test_matches_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    texts = corpus(rng, 500)
    queries = [(i, " ".join(rng.sample(WORDS, rng.randint(1, 25)))) for i in range(40)]
    queries += [(100, ""), (101, None), (102, "none of these"), (103, "CAS 50-78-2 w1 REACT-102"), (104, "w0"), (105, texts[0])]
    counters = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    monkeypatch.setattr(overlap, "SEEDS", 40)
    monkeypatch.setattr(overlap, "TILE_CELLS", 20_000)
    assert fast(spark, queries, texts, 5, counters=counters) == slow(queries, texts, 5)
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    meet = sum(1 for _, q in queries for t in texts if words(q) & words(t))
    assert 0 < counters[0].value < 0.5 * meet
    monkeypatch.setattr(overlap, "BLOCK_WORDS", 100)
    assert fast(spark, queries, texts, 3) == slow(queries, texts, 3)


def test_fewer_texts_than_asked_for(spark):
    assert fast(spark, [(1, "a b c")], ["a", None, "c b"], 5) == slow([(1, "a b c")], ["a", None, "c b"], 5)
    assert fast(spark, [(1, "a b c")], [], 5) == {}
    assert fast(spark, [], ["a"], 5) == {}
