"""Full-text search: grammar, phrases, covers and highlights against plain code."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from orefield.operators import fulltext

VOCABULARY = ["acid", "acids", "bonds", "the", "of", "Catalyst", "reaction", "reactions", "yields", "Ion", "studies", "water", "glass", "virus", "trees", "52"]


def words(text):
    return [None if w.lower() in fulltext.STOP else fulltext.stem(w.lower()) for w in re.findall(r"\w+", text or "")]


def slow(query, text):
    """None, or the score of all groups that match."""
    own, total, hit = words(text), 0.0, False
    groups = {}
    for g, _, excluded, term in fulltext.terms(query):
        starts = [s for s in range(len(own)) if all(s + p < len(own) and own[s + p] == w for p, w in term)]
        groups.setdefault(g, []).append((excluded, starts, term[-1][0] + 1))
    for terms in groups.values():
        positive = [(s, w) for x, s, w in terms if not x]
        if not positive or any(s for x, s, _ in terms if x) or not all(s for s, _ in positive):
            continue
        hit = True
        entries = sorted((p, t, w) for t, (starts, w) in enumerate(positive) for p in starts)
        for a in range(len(entries)):  # the shortest stretch from this entry on that holds all terms, if none later is within it
            for b in range(a, len(entries)):
                if {t for _, t, _ in entries[a : b + 1]} == set(range(len(positive))):
                    if a == b or {t for _, t, _ in entries[a + 1 : b + 1]} != set(range(len(positive))) and entries[a][0] < min([p for p, _, _ in entries[a + 1 : b + 1]]):
                        lasts = {t: (p, w) for p, t, w in entries[a : b + 1]}
                        end = max(p + w - 1 for p, w in lasts.values())
                        total += 0.1 / (1 + max(0, end - entries[a][0] + 1 - sum(w for _, _, w in entries[a : b + 1])))
                    break
    return total if hit else None


def test_grammar():
    assert fulltext.terms('Acids "bonds of the trees" -water or -"ion glass" virus OR') == [
        (0, 0, False, [(0, "acid")]),
        (0, 1, False, [(0, "bond"), (3, "tree")]),
        (0, -3, True, [(0, "water")]),
        (1, -4, True, [(0, "ion"), (1, "glass")]),
        (1, 0, False, [(0, "virus")]),
    ]
    assert fulltext.terms("the of") == fulltext.terms(None) == fulltext.terms('""') == []
    assert [fulltext.stem(w) for w in ("studies", "trees", "acids", "glass", "virus", "s", "gases")] == ["study", "tree", "acid", "glass", "virus", "s", "gase"]


QUERIES = [
    "acid water", '"acid bonds"', "acid or water", "reaction -water", '"bonds of the catalyst"', 'ion "water glass" -virus or studies yields', "the", "-acid", "unknown", "acid unknown or glass",
    "catalyst catalysts", "", None, "trees " * 3, '"reactions yield" or "yield reaction"', "52 -52",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    out = [" ".join(rng.choice(VOCABULARY) + rng.choice(["", "", ",", "."]) for _ in range(rng.choice([2, 8, 40]))) for _ in range(150)]
    return out + ["", None, "acid " * 300 + "water", "İon Water İ", "ACID. bonds"]


@pytest.fixture(scope="module")
def index(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "acid")], "id long, text string").withColumn("word", F.lit("clash")).repartition(4)
    return fulltext.build(docs)


def test_matches_and_scores(spark, texts, index):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    got = {(r.query_id, r.id): round(r.score, 9) for r in fulltext.search(index, asked, 10**6).collect()}
    want = {(q, i): round(s, 9) for q, query in enumerate(QUERIES) for i, t in enumerate(texts) if (s := slow(query, t)) is not None}
    assert got.keys() == want.keys()
    single = {q for q, query in enumerate(QUERIES) if '"' not in (query or "")}
    assert {k: v for k, v in got.items() if k[0] in single} == {k: v for k, v in want.items() if k[0] in single}
    assert all(abs(got[k] - want[k]) < 0.3 for k in got)
    assert {tuple(r) for r in fulltext.match(index, asked).collect()} == want.keys()
    top = fulltext.search(index, asked, 3).collect()
    for q in range(len(QUERIES)):
        order = sorted(((-s, i) for (p, i), s in got.items() if p == q))[:3]
        assert sorted((r["rank"], r.id) for r in top if r.query_id == q) == [(n, i) for n, (_, i) in enumerate(order, 1)]


def test_identifiers_come_first_and_keep_ranks(spark):
    docs = spark.createDataFrame([(1, "Aspirin CAS 50-78-2 is acetylsalicylic acid"), (2, "Paracetamol CAS 103-90-2 is acetaminophen"), (3, "see react-102 and 50-78-2"), (4, "150-78-2")], "id long, text string")
    asked = spark.createDataFrame([(1, "CAS 50-78-2 aspirin"), (2, "REACT-102")], "query_id long, text string")
    got = {(r.query_id, r["rank"]): (r.id, round(r.score, 6), r.first is None) for r in fulltext.search(fulltext.build(docs), asked, 5).collect()}
    assert got[1, 1][0] == 1 and got[1, 1][1] > 1 and got[1, 2] == (3, 1.0, True) and (1, 3) not in got
    assert got[2, 1][0] == 3 and got[2, 1][1] < 1  # the text has it in lower case


def test_highlight(spark, index, texts):
    asked = spark.createDataFrame([(1, "acid water"), (2, "studies")], "query_id long, text string")
    ranked = fulltext.search(index, asked, 50)
    rows = fulltext.highlight(index, ranked, asked).collect()
    assert rows
    for r in rows:
        plain = re.sub("</?b>", "", r.highlight)
        assert plain in texts[r.id] and "<b>" in r.highlight
        n = len(re.findall(r"\w+", plain))
        assert n <= 35 and n >= min(15, len(re.findall(r"\w+", texts[r.id])))
        marked = {fulltext.stem(w.lower()) for w in re.findall("<b>(.*?)</b>", r.highlight)}
        assert marked <= ({"acid", "water"} if r.query_id == 1 else {"study"})
    assert fulltext.fragment("one two three four five", {"four"}, 3, 3, 3, 4, ("[", "]")) == "three [four] five"
    assert fulltext.fragment("a b c d e f g h", {"b", "g"}, 1, 6, 2, 4, ("<b>", "</b>")) == "<b>b</b> c d e"


def test_empty_index(spark, index):
    none = fulltext.build(spark.createDataFrame([], "id long, text string"))
    asked = spark.createDataFrame([(1, "acid")], "query_id long, text string")
    assert fulltext.search(none, asked, 3).collect() == [] and fulltext.match(index, asked.limit(0)).collect() == []


def test_the_index_reads_texts_once_and_deals_them(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    docs = spark.range(400).coalesce(1).select("id", F.lit("some words").alias("text")).mapInArrow(count, "id long, text string")
    index = fulltext.build(docs)
    assert read.value == 400 and len(index.postings.inputFiles()) >= 4
