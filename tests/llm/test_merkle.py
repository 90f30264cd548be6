"""Merkle manifest: digests, roots and proofs against a plain implementation, over one and several levels of blocks."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from orefield.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def slow_leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """(root, the siblings before and after each node, level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            lo = i // 16 * 16
            paths[leaf].append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 16])))
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def slow(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for name in names:
        own = sorted(((r[0] is not None, r[0] or 0, slow_leaf(*r)), r) for r in trees[name])
        made[name] = own, *climb([x[0][2] for x in own])
    root, upper = climb([made[n][1] for n in names])
    return [(r[0], key[2], made[n][1], root, tuple(p) + tuple(u)) for n, u in zip(names, upper) for (key, r), p in zip(made[n][0], made[n][2])]


def check(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("root", F.lit("clash")).withColumn("tree", F.lit(1)).repartition(parts)
    made = merkle.manifest(docs, keep={"size": F.length("text")})
    got = made.withColumn("back", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("digest", merkle.proof_digest(F.col("proof"))).collect()
    plain = [(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.proof)) for r in got]
    assert sorted(plain, key=repr) == sorted(slow(rows), key=repr)
    assert all(r.back == r.root and r.digest == h("".join(s.before + s.after for s in r.proof)) for r in got)
    assert sorted((r.doc_id or -1, r["size"] or 0) for r in got) == sorted((r[0] or -1, len(r[1] or "")) for r in rows)


def test_manifest_matches_plain_code(spark):
    rng = random.Random(1)
    rows = [(i, f"text {i}", "en", "hot", 6) for i in range(900)]  # four blocks and a second traversal
    rows += [(i, "x" * (i % 50), None, f"s{i % 40}", i) for i in range(1000, 1400)]
    rows += [(i, "ab", "de", f"one {i}", None) for i in range(2000, 2300)]  # over 256 sources: the upper tree takes two as well
    rows += [(None, None, None, None, None), (None, "", "en", None, 0), (5, "é中", "zh", "", 2), (5, "é中", "zh", "", 2), (5, "other", "zh", "", 2)]
    rows += [(7, None, "en", "hot", 3)] * 40  # repeats and ties of an id
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4097])
def test_sizes_at_the_edges_of_blocks(spark, n):
    check(spark, [(i, f"t{i}", "en", "a", 1) for i in range(n)], 2)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_change_of_a_text_is_found(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", 6) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [F.col(c) for c in merkle.COLUMNS]
    changed = merkle.leaf([*names[:4], F.lower("text")])
    made = merkle.manifest(docs, keep={"changed": changed}).withColumn("back", merkle.fold(F.col("changed"), F.col("proof")))
    assert all(r.back != r.root for r in made.collect())
