"""Fill-in-middle: cuts, outputs and restored texts against a plain implementation, in one chunk and in many."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield.llm import infill


def slow(doc_id, text, salt=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def hard_texts(rng, n):
    bits = ["\n", "\n\n", "<", "<P", "<S", "M>", ">", "P>", "é", "中文", "\U0001f600", "plain words ", "PSM", "\r\n", "\t", "\x00"]
    out = [None, "", "\n", "x", "\n\n\n", "<P>", "a<S>b\nc", "a<M\n>b", "<<P>", "<P<P>>", "a\nb", "ends\n"]
    out += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return out + ["line of text\n" * 300, "é" * 500, "\n" * 400, "x" * 700 + "<M" + ">" * 3]


@pytest.mark.parametrize("chunk", [1 << 16, 5, 64])
def test_transform_matches_plain_code(spark, chunk):
    rng = random.Random(chunk)
    texts = hard_texts(rng, 150)
    rows = [(i if i % 50 else None, t, float(i)) for i, t in enumerate(texts)] + [(7, "one\ntwo\nthree\n", 1.0)] * 3 + [(8, "ab\n" * 40, 2.0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut1 double").withColumn("h1", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    made = infill.transform(docs, chunk_bytes=chunk)
    assert made.columns == ["doc_id", "text", "cut1", "h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = made.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.text, r.cut1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=repr)
    assert got == sorted(((i, t, x, *slow(i, t)) for i, t, x in rows), key=repr)
    assert all(r.back == (r.text or "") and r.h1 == "clash" for r in back)


def test_rates_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(200)], "doc_id long, text string")
    made = infill.transform(docs, salt=3, rate=40, suffix_first=10).collect()
    assert {(r.doc_id, r.form, r.output) for r in made} == {(i, *(slow(i, "a\nb\nc\n", 3, 40, 10)[k] for k in (1, 4))) for i in range(200)}
    assert len({r.form for r in made}) == 3
    assert infill.transform(docs.limit(0)).collect() == []


def test_functions_compose(spark):
    rng = random.Random(1)
    for text in hard_texts(rng, 60)[1:]:
        data = text.encode()
        cuts = sorted(rng.randint(0, len(data)) for _ in range(3))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        whole = infill.Scan(data).tree.whole()
        tree = infill.Tree(*(np.array(x) for x in zip(*(infill.Scan(p).tree.whole() for p in parts))))
        assert all((a == b).all() for a, b in zip(whole, tree.whole()))


def test_a_text_of_many_chunks(spark):
    rng = random.Random(5)
    text = "".join("w" * rng.randint(0, 200) + rng.choice(["\n", "é\n", " "]) for _ in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, "short\n")], "doc_id long, text string")
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in infill.transform(docs, chunk_bytes=4096).collect()}
    assert got == {1: slow(1, text), 2: slow(2, "short\n")}
