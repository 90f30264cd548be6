"""The operators against brute force on small rows, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from orefield.llm import decontaminate, linededup, piece, simhash, toxicity
from orefield.llm.arrow import map_texts, plain_words
from orefield.llm.components import connected_components
from orefield.session import BATCH, materialize, ship

WORDS = "amber birch cedar delta ember flint grove heath inlet jetty knoll larch maple north ocean petal quill river stone thorn umber vivid waltz xenon yield zebra".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None) for i, t in zip(ids, texts)], SCHEMA).repartition(3)


# -- SimHash ---------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def slow_components(fps):
    """fps: list of (doc_id, fingerprint) -> smallest doc_id reachable for each row."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    base = sentence(rng, 400)
    texts = [None, "", "one", "one two", "ONE two", "\t\n", "É x y z"] + [sentence(rng, rng.randint(1, 60)) for _ in range(40)]
    texts += [base] * 3 + [base.replace(base.split()[k], "word%d" % k, 1) for k in range(0, 90)]
    texts.append(" ".join(texts[20:60]) * 40)
    docs = frame(spark, texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [(i, slow_fingerprint(t)) for i, t in enumerate(texts)]
    want = {i: (f"{fp:016x}", c) for (i, fp), c in zip(fps, slow_components(fps))}
    assert got == want


def test_simhash_spark_and_library_hash_agree(spark):
    word = "einß wörd x"
    fp = spark.range(1).select(F.xxhash64(F.lit(word))).first()[0]
    assert fp % 2**64 == xxhash.xxh64(word.encode(), seed=42).intdigest()


@pytest.mark.parametrize("seed", range(2))
def test_links_of_dense_and_crowded_fingerprints(spark, seed):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)}  # over CROWDED in a bucket
    for x in list(fps)[:80]:
        for _ in range(3):
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    roots = connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")))
    got = {}
    for r in roots.collect():
        got.setdefault(r.root % 2**64, set()).update({r.node % 2**64, r.root % 2**64})
    want = {}
    for x, c in zip(fps, slow_components([(i, x) for i, x in enumerate(fps)])):
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}


def test_keep_one_and_empty_table(spark):
    rng = random.Random(5)
    a, b = sentence(rng, 80), sentence(rng, 80)
    docs = frame(spark, [a, b, a, a, b, None], ids=[7, 3, 9, 9, 8, 1])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3, 7]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_pages_of_one_template_do_not_meet(spark):
    rng = random.Random(21)
    shared = [rng.choice(WORDS) + str(rng.randint(0, 9999)) for _ in range(300)]
    pages = [" ".join(shared[:150] + [f"own{p}x{i}" for i in range(60)] + shared[150:]) for p in range(300)]
    docs = frame(spark, pages)
    rows = simhash.sketches(docs, "doc_id", "text", 5, 0.8).cache()
    sets = rows.select("sid", "size", F.col("sid").alias("root"))
    assert simhash._prefix_pairs(sets, rows, docs, "doc_id", "text", 5, 0.8).count() <= 20 * 300
    assert simhash.keep_one(docs, similarity=0.8).count() >= 295  # a few fingerprints are within two bits
    rows.unpersist()


def test_prefix_pairs_miss_none_that_is_similar(spark):
    rng = random.Random(22)
    texts = []
    for size in (6, 40, 200, 400):
        for _ in range(12):
            base = sentence(rng, size).split()
            for edits in (0, 0.002, 0.004, 0.006, 0.01):
                own = [w if rng.random() > edits else f"new{rng.random()}" for w in base]
                texts.append(" ".join(own[: int(len(own) * rng.choice([1, 1, 0.95, 0.88, 0.82]))]))
    texts = list(dict.fromkeys(texts))
    docs = frame(spark, texts)
    rows = simhash.sketches(docs, "doc_id", "text", 5, 0.8).cache()
    sid = {r.doc_id: r.sid for r in rows.collect()}
    sets = rows.select("sid", "size", F.col("sid").alias("root")).where("size > 0").distinct()
    got = {(r.u, r.v) for r in simhash._prefix_pairs(sets, rows, docs, "doc_id", "text", 5, 0.8).collect()}
    shingles = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    want = {(max(sid[i], sid[j]), min(sid[i], sid[j])) for i, a in enumerate(shingles) for j, b in enumerate(shingles[:i]) if len(a & b) >= 0.8 * len(a | b) and sid[i] != sid[j]}
    assert len(want) > 100 and want <= got and len(got) < 4 * len(want)
    rows.unpersist()


def test_near_dedup_shuffles_few_texts_and_leaves_no_shuffle_files(spark):
    """Of 400 long texts ten have a near copy; the other texts are not shuffled, and what is shuffled goes at once."""
    rng = random.Random(23)
    texts = [" ".join(f"{rng.getrandbits(60):x}" for _ in range(800)) for _ in range(400)]
    texts += [t.replace(t.split()[400], "new", 1) for t in texts[:10]]
    docs = materialize(frame(spark, texts + texts[20:22], ids=[*range(410), 20, 21]), "docs")
    store, disk = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    written = lambda: store.executorList(True).apply(0).totalShuffleWrite()
    files = lambda: {f.name for top in disk.localDirsString() for f in Path(top).rglob("shuffle_*")}
    was, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), (written(), files())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = materialize(simhash.keep_one(docs, similarity=0.8), "kept")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == list(enumerate(texts[:400]))
    for _ in range(50):
        time.sleep(0.2)  # Spark deletes in the background and counts a task's bytes a little later
        if not files() - before[1]:
            break
    left = {f.split("_")[1] for f in files() - before[1]}
    assert len(left) <= 20  # those of counts and other queries that wrote no table
    assert written() - before[0] < 0.5 * sum(map(len, texts))


def test_key_filter_lets_every_key_pass_and_few_others(spark):
    rows = spark.range(60_000).select("id", F.concat(F.lit("k"), "id").alias("_row"))
    keys = rows.where("id % 20 = 0").select("_row")
    table, passes = simhash._key_filter(keys)
    through = rows.join(table, passes, "left_semi")
    assert through.where("id % 20 = 0").count() == 3_000 and through.count() < 3_000 + 0.1 * 60_000
    assert rows.join(table, passes, "left_anti").count() + through.count() == 60_000
    assert rows.join(*simhash._key_filter(keys.where("false")), "left_semi").count() == 0


def test_rows_that_repeat_id_and_text_keep_the_same_one(spark):
    rows = [(1, "a b c d e f g h i j", "en", f"s{i}", i) for i in range(20)]
    kept = {simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(n), similarity=0.8).first().source for n in (1, 3, 7)}
    assert len(kept) == 1
    maps = spark.createDataFrame([(1, "a b c")] * 2, "doc_id long, text string").withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    assert simhash.keep_one(maps).count() == 1


def test_keep_one_of_rows_without_or_with_the_same_id(spark):
    rng = random.Random(6)
    a, b, c, d, e = (sentence(rng, 80) for _ in range(5))
    rows = [(None, a), (None, b), (None, c), (None, c), (4, c), (4, c), (4, d), (4, e), (2, e), (9, None), (None, "")]
    docs = frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=repr)
    assert got == sorted([(None, a), (None, b), (4, c), (4, d), (2, e), (9, None)], key=repr)


def test_pipeline_drops_all_near_copies_by_shingle_similarity(spark):
    rng = random.Random(8)
    texts, sets = [None, "", "one two", "ONE  two"], []
    for _ in range(12):
        base = sentence(rng, rng.randint(30, 250)).split()
        for k in range(12):
            texts.append(" ".join(edited(rng, base, k // 2 if k % 3 else 0)))
    hub = sentence(rng, 300).split()
    texts += [" ".join(hub[:k] + ["swap%d" % k] + hub[k + 1 :]) for k in range(5, 295, 3)]
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted({find(i) for i in range(len(texts))})
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), "").collect())
    assert got == want


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    """Every stage on nulls, empties, repeats and clashing names, each against what it should leave; then the whole run."""
    rng = random.Random(21)
    shared = "\n".join(sentence(rng, 12) for _ in range(6))
    item = sentence(rng, 30)
    bad = ["grrk", "blarg", "snarl", "hiss", "spit"]
    rows = [(None, None), (1, None), (2, ""), (2, ""), (3, shared), (4, f"own words here\n{shared}\nand an end"), (5, "before " + item + " after")]
    rows += [(6, sentence(rng, 90)), (7, sentence(rng, 90))]
    rows += [(8, rows[-1][1]), (7, rows[-1][1])]
    toxic = {}
    for d in range(100, 400):
        words = sentence(rng, 60).split()
        if d % 5 == 0:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        toxic[d] = int(d % 5 == 0)
        rows.append((d, " ".join(words)))
    docs = frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    docs = docs.withColumn("n_lines", F.lit("mine")).withColumn("_row", F.lit("mine")).withColumn("found", F.lit("mine")).withColumn("own", F.lit("mine"))
    labels = spark.createDataFrame([(d, 1, t) for d, t in toxic.items()], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    sf = f"file://{tmp_path}"
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{sf}/{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)

    calm = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert calm.columns == docs.columns and {tuple(r) for r in calm.select("n_lines", "_row", "found", "own").collect()} == {("mine",) * 4}
    left = {i for i, _ in told(calm)}
    assert left >= {None, 1, 2, 3, 4, 5, 6, 7, 8} and len(left & set(toxic)) == pytest.approx(240, abs=12)
    assert sum(toxic[d] for d in left & set(toxic)) <= 3

    cut = corpus_pipeline.drop_repeated_lines(spark, docs, sf)
    assert cut.columns == docs.columns
    want = [(i, "own words here\nand an end" if i == 4 else t) for i, t in rows]
    got = told(cut)
    gone = [x for x in sorted(want, key=repr) if x not in got]
    assert gone == [(8, rows[8][1])] and {(r.n_chars, r.n_lines) for r in cut.where("doc_id = 4").collect()} == {(25, "mine")}

    one = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert one.columns == docs.columns
    assert sorted(i or 0 for i, _ in told(one) if (i or 0) < 100) == [1, 3, 5, 6, 7] or sorted(i or 0 for i, _ in told(one) if (i or 0) < 100) == [1, 3, 4, 5, 6, 7]

    clean = corpus_pipeline.drop_leaks(spark, docs, sf)
    assert clean.columns == docs.columns and told(clean) == sorted((x for x in rows if x[0] != 5), key=repr)

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coded = sorted(((r.doc_id, list(r.ids)) for r in corpus_pipeline.encode(spark, docs, sf).collect()), key=repr)
    assert coded == sorted(((i, sp.encode(t or "")) for i, t in rows), key=repr)

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0, name

    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and 5 not in ids and 8 not in ids and {3, 6, 7} <= set(ids)


# -- decontamination -------------------------------------------------------------------------------------------------


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[k] = "edit%d" % rng.randrange(99)
        elif kind == 1:
            words.insert(k, "more%d" % rng.randrange(99))
        elif len(words) > 1:
            del words[k]
    return words


def slow_edits(item, text):
    """Fewest word edits of the item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_alignment_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        item = np.array([rng.randrange(5) for _ in range(rng.randint(1, 90))], dtype=np.uint64)
        text = np.array([rng.randrange(5) for _ in range(rng.randint(0, 40))], dtype=np.uint64)
        assert decontaminate.best_alignment(item, text)[0] == slow_edits(item.tolist(), text.tolist())


def test_leaks_recall_and_precision(spark):
    rng = random.Random(11)
    items = [sentence(rng, rng.randint(8, 70)) for _ in range(30)] + [None, "", "two words"]
    texts, planted = [None, "", "amber"], set()
    for d in range(3, 203):
        words = sentence(rng, rng.randint(0, 150)).split()
        if d % 2:
            k = rng.randrange(30)
            item = edited(rng, items[k].split(), rng.randint(0, int(0.2 * len(items[k].split()))))
            at = rng.randint(0, len(words))
            words[at:at] = item
        texts.append((", " if d % 3 else " ").join(words).title())
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            words = plain_words((item or "").encode())
            if len(words) >= 4 and t:
                e = slow_edits(words, plain_words(t.encode()))
                if e <= int(0.2 * len(words) + 1e-9):
                    want[d, k] = e
    assert set(got) <= set(want) and len(want) > 80
    assert len(got) >= 0.9 * len(want)
    assert all(got[x] == want[x] for x in got)


@pytest.mark.parametrize("low,high", [(4, 7), (8, 15), (16, 40), (60, 150), (300, 400)])
def test_recall_by_item_length_at_all_allowed_edits(low, high):
    rng = random.Random(low)
    items = [sentence(rng, rng.randint(low, high)) for _ in range(60)]
    index = decontaminate.Index.build([(i, t.encode()) for i, t in enumerate(items)], decontaminate.Settings())
    caught = 0
    for n in range(600):
        k = rng.randrange(60)
        words = items[k].split()
        words = sentence(rng, 40).split() + edited(rng, words, n % (1 + int(0.2 * len(words)))) + sentence(rng, 40).split()
        tokens = np.array([decontaminate.hash64(w.encode()) for w in words] + [0] * (decontaminate.MAX_STEPS + 1), dtype=np.uint64)
        found = decontaminate.verify(index, tokens, 0, len(words), index.hits(tokens))
        caught += k in found
        assert all(slow_edits(items[j].split(), words) == e for j, (e, _, _) in found.items()) if high < 20 else True
    print(low, high, caught / 600)
    assert caught >= 0.9 * 600


def test_clean_drops_leaking_ids(spark):
    rng = random.Random(2)
    items = [sentence(rng, 30), sentence(rng, 12)]
    docs = frame(spark, ["start " + items[0] + " stop", sentence(rng, 60), None, items[1]])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 2]
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.leaks(docs.where("false"), bench).count() == 0


def test_short_items_are_found_word_for_word(spark):
    items = ["Two words", "solo", "three short words", "not here", ", !", "more than four words here"]
    texts = ["a two, WORDS b two words", "two", "words two", "solo", "x three short words", "three words short", None, "say more than four words here solo", ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits, r.first_word, r.end_word) for r in decontaminate.leaks(frame(spark, texts), bench).collect())
    assert got == [(0, 0, 0, 1, 3), (3, 1, 0, 0, 1), (4, 2, 0, 1, 4), (7, 1, 0, 6, 7), (7, 5, 0, 1, 6)]
    assert sorted(r.doc_id for r in decontaminate.clean(frame(spark, texts), bench).collect()) == [1, 2, 5, 6, 8]


# -- toxicity --------------------------------------------------------------------------------------------------------


def slow_segments(scores):
    """Maximal segments by their definition: recursively the best segment, then left and right of it."""
    if not len(scores):
        return []
    best, where = 0.0, None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > best + 1e-9 or (where and abs(s - best) < 1e-9 and b - a < where[1] - where[0]):
                best, where = s, (a, b)
    if not where:
        return []
    a, b = where
    left = slow_segments(scores[:a])
    right = [(x + b, y + b) for x, y in slow_segments(scores[b:])]
    return left + [(a, b)] + right


def test_segments_match_their_definition():
    rng = random.Random(4)
    for _ in range(150):
        scores = [rng.choice([-1, 1]) * (rng.random() + 0.01) for _ in range(rng.randint(0, 25))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(scores))] == slow_segments(scores)


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    bad = ["grrk", "blarg", "snarl", "hiss"]
    texts, labels = [None, "", "amber"], []
    for d in range(3, 600):
        words = sentence(rng, rng.randint(30, 150)).split()
        toxic = d % 6 == 0
        if toxic:
            for _ in range(rng.randint(3, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append((d, int(toxic)))
    docs = frame(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 600 and all(0 <= r.score <= 1 for r in got.values())
    held = [(d, t) for d, t in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum((got[d].score >= 0.3) == t for d, t in held) >= 0.97 * len(held)
    assert got[0].score == got[1].score == min(r.score for r in got.values())
    p = got[6].passages
    assert p and all(0 <= x.first < x.end <= got[6].n_words and x.e_value <= 0.05 for x in p)
    kept = toxicity.reject(docs.withColumn("score", F.lit("own")).withColumn("passages", F.lit(0)), model)
    assert kept.columns == docs.columns + ["score", "passages"] and {r.score for r in kept.collect()} == {"own"}
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs.where("false"), empty).count() == 0
    assert all(r.score < 0.3 for r in toxicity.score(docs, empty).collect())


def test_toxicity_model_does_not_depend_on_row_order(spark):
    rng = random.Random(13)
    texts, labels = [], []
    for d in range(200):
        text = sentence(rng, 60) + (" grrk blarg snarl" * 2 if d % 5 == 0 else "")
        texts += [text, text.replace(" ", "  ", 3).upper() if d % 3 else text]  # near-copies under one label
        labels += [(2 * d, int(d % 5 == 0)), (2 * d + 1, int(d % 5 == 0))]
    docs, marks = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    for rows in (docs.coalesce(1), docs.repartition(7, "text").sortWithinPartitions(F.desc("doc_id"))):
        model = toxicity.fit(rows, marks)
        seen.append(sorted((r.doc_id, r.score) for r in toxicity.score(docs, model).collect()))
    assert seen[0] == seen[1]


# -- pieces ----------------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("piece_bpe_32k.model")


def hard_texts():
    rng = random.Random(9)
    alphabet = ["a", "e", "t", "th", " ", "  ", "\n", "▁", "é", "ß", "中", "🙂", "\u0000", " ", "<s>", "<0x41>", "1", ".", "*", "\t", "ñ", "́"]
    texts = [None, "", " ", "  ", "▁", " ▁ ", "a  b", " hi", "hi ", "\u0000", "e" * 5000, "  " * 700, "x y " * 3000]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_encoding_and_decoding_equal_the_library(spark):
    texts = hard_texts()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = piece.encode(frame(spark, texts).withColumn("ids", F.lit(1)))
    got = {r.doc_id: r for r in rows.collect()}
    back = {r.doc_id: r.text for r in piece.decode(rows).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert list(got[i].ids) == ids, t
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert got[i].decoded_sha256 == sha(sp.decode(ids)), t
        assert back[i] == sp.decode(ids)


def test_units_keep_letters_and_others_apart():
    m, rng = piece.PieceModel(PATH), random.Random(5)
    marks = ["", ",", ".", "***", "!!\n", ".\n\t", "%%%", "\u00b2.", "42", "_x", "\u0301", "\ue000", "\U0001f600"]
    words = ["Haus", "ñandú", "дом", "中文", "don't", "é", "tzpfbe"]
    texts = [rng.choice(["", " ", "  "]).join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    units = [m.units(t) for t in texts]
    assert ["".join(u) for u in units] == ["▁" + t.replace(" ", "▁") for t in texts]
    few = m.units(" ".join(w + x for w in words[:4] for x in (",", ".", "***", "!!\n")))
    assert {u for u in few if any(c.isalpha() for c in u)} == {"▁" + w for w in words[:4]}  # one for each word, whatever follows it
    cache = piece.Units(m)
    cache.learn({u for x in units for u in x})
    told = sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts)
    assert [np.frombuffer(b"".join(cache[u] for u in x), np.int32).tolist() for x in units] == told
    some = sorted(cache)[:50]
    with pytest.raises(ValueError, match="differently"):
        m.check(some, [cache[u] for u in some[:-1]] + [b"\0\0\0\0"])


# -- line dedup ------------------------------------------------------------------------------------------------------


def slow_runs(docs, min_words):
    """doc_id -> lines that lie in a run of min_words words which also starts at an earlier place."""
    lines = {d: (t or "").split("\n") for d, t in docs}
    words = {d: [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls] for d, ls in lines.items()}
    places = [(d, i) for d in sorted(lines) for i in range(len(lines[d]))]
    gone = {d: set() for d in lines}
    for n, (d, i) in enumerate(places):
        for e, j in places[:n]:
            k = 0
            while i + k < len(lines[d]) and j + k < len(lines[e]) and lines[d][i + k] == lines[e][j + k]:
                k += 1
            if k and sum(words[d][i : i + k]) >= min_words:
                gone[d].update(range(i, i + k))
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.randint(1, 9)) for _ in range(12)] + ["", " ", "\t"]
    docs = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for d in range(25)]
    passage = "\n".join(rng.choice(pool) for _ in range(9))
    docs += [(30 + d, f"{d} own line\n{passage}\n{d} end") for d in range(5)] + [(40, None), (41, ""), (42, passage), (43, passage)]
    docs += [(44, "\n".join([sentence(rng, 6)] * 40))]
    frame_ = spark.createDataFrame([(d, t, "x", "keep") for d, t in docs], "doc_id long, text string, line string, row string")
    got = {r.doc_id: r for r in linededup.dedup_lines(frame_, min_words=15).collect()}
    want = slow_runs(docs, 15)
    for d, t in docs:
        gone = {i for r in got[d].dropped_lines for i in range(r["first"], r["last"] + 1)}
        assert gone == want[d], d
        kept = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone)
        assert got[d].text == (kept if t is not None else None) and got[d].row == "keep"


def test_line_dedup_repeated_rows_null_ids_and_empty(spark):
    long = " ".join(["word"] * 60)
    rows = [(1, long), (1, long), (2, long), (None, long), (3, "short"), (4, "short")]
    got = sorted((r.doc_id or -1, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, ""), (1, long), (1, long), (2, ""), (3, "short"), (4, "short")]
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- batches ---------------------------------------------------------------------------------------------------------


def test_arrow_batches_are_bounded_in_bytes(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("toxic "), 700).alias("text"))
    measure = lambda: lambda texts, part: {"bytes": [part.column(1).buffers()[2].size] * len(texts)}
    largest = lambda: map_texts(docs, {"doc_id": "doc_id"}, "bytes long", measure).agg(F.max("bytes"), F.count("*")).first()
    before = spark.conf.get(BATCH, None)
    try:
        spark.conf.unset(BATCH)
        most, n = largest()
        assert n == 3000 and most < 6 << 20  # 12.6 MB of texts were one batch
        spark.conf.set(BATCH, "16m")  # who sets a bound keeps it
        ship(spark)
        assert spark.conf.get(BATCH) == "16m"
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
