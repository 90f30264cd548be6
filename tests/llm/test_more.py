"""Token counts, personal data, WARC archives, licences and quality rules against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orefield.llm import decontaminate, licenses, pii, quality, queries, sql, tokencount, warc
from orefield.llm.arrow import plain_words
from orefield.session import load, scratch_path

# -- token counts ----------------------------------------------------------------------------------------------------


def test_edits_keep_trees_equal_to_full_counts():
    tok = tokencount.load_tokenizer(tokencount.default_ranks())
    rng = random.Random(1)
    alphabet = ["a", "the", " ", "  ", "\n", " \n ", "'s", "'", "1", "23", ".", "!?", "é", "🙂", "　", "word", "x" * 50]
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    partly = 0
    for _ in range(300):
        text = some(rng.choice([0, 1, 5, 60, 900]))
        tree = tokencount.Tree.build(text, tok)
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 7, 300])
            new = some(rng.choice([0, 1, 3, 200]))
            want = text[:a] + new + text[b:]
            text, tree, n = tokencount.edit(text, tree, a, b, new, tok)
            assert text == want
            assert tree.tokens[1] == len(tok.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)
            for nodes in (tree.chars, tree.tokens):
                assert all(nodes[i] == nodes[2 * i] + nodes[2 * i + 1] for i in range(1, tree.size))
            partly += n < len(tok.pieces(text)) / 2
    assert partly > 200


def test_token_state_in_spark(spark):
    tok = tokencount.load_tokenizer(tokencount.default_ranks())
    texts = [None, "", "one two", "lorem ipsum " * 3000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, tree_chars int")
    table = spark.createDataFrame([(2, 1, 0, 3, "three"), (2, 2, 5, 5, "!"), (3, 1, 100, 200, None), (0, 1, 0, 9, "new")], "doc_id long, seq int, start int, end int, new string")
    state = tokencount.build_trees(docs).join(tokencount.edits_of(table), "doc_id", "left")
    got = {r.doc_id: r for r in tokencount.apply_edits(state).collect()}
    want = {0: "new", 1: "", 2: "three! two", 3: texts[3][:100] + texts[3][200:]}
    for i, t in want.items():
        assert got[i].text == t and got[i].n_tokens == len(tok.encoding.encode_ordinary(t)) and got[i].n_chars == len(t)
        assert got[i].n_before == len(tok.encoding.encode_ordinary(texts[i] or ""))
    assert got[3].n_counted < 300 and sum(got[3].tree_tokens[len(got[3].tree_tokens) // 2 :]) == got[3].n_tokens
    assert tokencount.build_trees(docs.where("false")).count() == 0


def test_op1_on_all_documents(spark, sf):
    tok = tokencount.load_tokenizer(tokencount.default_ranks())
    docs = load(spark, sf, "documents").collect()
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        t = d.text or ""
        n = len(t)
        assert got[d.doc_id].n_before == len(tok.encoding.encode_ordinary(t))
        for a, b, new in ((n // 3, n // 3, " a note, added in 2024. "), (n // 2, n // 2 + 40, ""), (max(n - 60, 0), max(n - 60, 0) + 9, "an edited end")):
            t = t[:a] + new + t[b:]
        assert got[d.doc_id].n_tokens == len(tok.encoding.encode_ordinary(t)) and got[d.doc_id].n_chars == len(t)


# -- personal data ---------------------------------------------------------------------------------------------------


def slow_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub(r"[^0-9]", "", m[0])]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def pii_texts():
    rng = random.Random(6)
    bits = ["a", "b.c", "@", "x@y.zz", "é", " ", "-", "--", "_", ".", "1", "255", "256", "10.0.0.1", "+", "+1 (017) 555-7713", "4845168114407329", "4929 3483 8514 6306", "%", "(", "call 555-123-4567"]
    bits += ['token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"', "\n", "🙂"]
    return [None, "", "9" * 5000, "a-" * 3000, "a@" * 500] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(600)]


def test_pii_base_spans_match_the_patterns(spark):
    texts = pii_texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = slow_base(t or "")
        r = rows[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k in pii.BASE_KINDS], t
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        found = [(f.kind, f.start, f.end) for f in r.found]
        assert [x for x in found if x[0] in pii.BASE_KINDS] == want
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert all(0 <= a < b <= len(t) for _, a, b in found)
    assert pii.find(docs.where("false")).count() == 0


def test_pii_finds_secrets_and_leaves_plain_runs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f'some words token = "{hexa}" more words' if i % 3 else f"order ticket page 2024-{'ab1' * 2}-{'x' * 14} more words here"))
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(any(f.kind == "secret" for f in got[i].found) == bool(i % 3) for i in range(300))


def test_em_recovers_reliabilities():
    rng = random.Random(3)
    right = [0.95, 0.8, 0.7, 0.9]
    counts = Counter()
    truth = Counter()
    for _ in range(20000):
        y = rng.random() < 0.4
        v = tuple((1 if y else -1) * (1 if rng.random() < r else -1) if rng.random() < 0.9 else 0 for r in right)
        counts["ip", v] += 1
        truth["ip", v] += y
    prior, table, post = pii.reliabilities(counts)
    assert abs(prior["ip"] - 0.4) < 0.03
    for j, r in enumerate(right):
        assert abs(table[1, j, 2] / (table[1, j, 2] + table[1, j, 0]) - r) < 0.04
    err = sum(abs(post[k] * n - truth[k]) for k, n in counts.items()) / 20000
    assert err < 0.04


# -- WARC ------------------------------------------------------------------------------------------------------------


def pages_frame(spark):
    big, other = "<p>é same body</p>" * 80, "<p>other</p>" * 200
    rows = [(i, f"http://www.Example{i % 7}.com:80/a/{i % 5}?q#x", big if i % 3 else f"<b>{i}</b>") for i in range(200)]
    rows += [(500, "not a url\r\nX: y", other), (501, None, other), (502, "https://u@h.org", None), (503, "https://h.org/", ""), (504, "ftp://h.org", "x" * 999), (505, "ftp://h.org", "x" * 999)]
    rows += [(600, "http://one.org/", "y" * 1000), (600, "http://one.org/", "y" * 1000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")), rows


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 7)
    pages, rows = pages_frame(spark)
    got = warc.archive(spark, pages.repartition(3)).collect()
    payload = {i: (h or "").encode() for i, _, h in rows}
    last = {}
    for i, h in payload.items():
        if len(h) >= 1000:
            last[h] = max(i, last.get(h, i))
    want = Counter((i, len(h), hashlib.sha1(h).hexdigest(), *(("response", None) if last.get(h, i) == i else ("revisit", last[h]))) for i, h in ((r[0], payload[r[0]]) for r in rows))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(bytes(r.payload) == payload[r.page_id] if r.record_type == "response" else r.payload is None for r in got)


def test_archives_are_plain_warc_and_lookups_are_exact(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 3)
    pages, rows = pages_frame(spark)
    folder = scratch_path(spark, "warc-test")
    captures = warc.write(pages.repartition(2), folder)
    files = warc.build_index(captures, folder)
    fs, path = warc.store(folder)
    n = 0
    for name in {r.file for r in captures.collect()}:
        data = fs.open_input_file(f"{path}/{name}").read()
        while data:
            d = zlib.decompressobj(31)
            record = d.decompress(data)
            data = d.unused_data
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            n += 1
    assert n == len(rows)
    index = warc.Index(folder, files)
    held = Counter((r.key, r.page_id) for r in captures.collect())
    for (key, page), k in held.items():
        assert len(index.find(key.encode(), page)) == k
    assert index.find(b"com,example1,www)/a/1?q", 99999) == [] and index.find(b"zzz", 0) == [] and index.find(b"", -5) == []
    assert warc.archive(spark, pages.where("false")).count() == 0


@pytest.mark.parametrize(
    "url,key",
    [("http://www.A.com/x?y=1#z", "com,a,www)/x?y=1"), ("https://u:p@a.b.org:8080", "org,b,a)/"), ("weird", "weird"), (None, "")],
)
def test_url_keys(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.url_key(F.col("u"))).first()[0] == key


# -- licences --------------------------------------------------------------------------------------------------------


def test_licences_match_sql(spark):
    rng = random.Random(2)
    bits = [n for _, n, _ in licenses.BASE + licenses.NOTICES] + [p for _, _, p in licenses.NOTICES] + ["cc", "by", "all", "rights", "reserved", "public", "é", "the"]
    texts = [None, "", "...", "CC-BY", "cc bye cc", "cc  by cc-by"] + [rng.choice([" ", "-", ", "]).join(rng.choice(bits).title() for _ in range(rng.randint(1, 12))) for _ in range(200)]
    texts.append("all rights reserved " * 500)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, w int")
    got = sorted(tuple(r) for r in licenses.digest(licenses.scan(docs)).collect())
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    want = sorted(con.sql(licenses.sql()).fetchall())
    assert got == want
    assert licenses.digest(licenses.scan(docs.where("false"))).count() == 0


# -- quality ---------------------------------------------------------------------------------------------------------


def test_repeated_words_match_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [str(rng.randrange(rng.choice([2, 5, 300]))).encode() for _ in range(rng.randint(0, 60))]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = Counter(grams)
        want = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        assert quality.repeated_words(words) == len(want)
    words = [b"w%d" % i for i in range(9000)] + [b"w%d" % i for i in range(3)] + [b"w%d" % i for i in range(100, 107)]
    assert quality.repeated_words(words) == 14


def test_quality_matches_sql(spark):
    rng = random.Random(4)
    rows = [(0, None, "en", "a"), (1, "", None, None), (2, "one\n\none", "en", "a")]
    for i in range(3, 900):
        words = [rng.choice(["red", "green", "blue", "été"]) + str(rng.randrange(400)) + rng.choice(["", "", "***", "|"] if i % 9 == 0 else [""]) for _ in range(rng.randint(5, 90))]
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)] * (1 + (i % 50 == 0))
        rows.append((i, "\n".join(lines), rng.choice(["en", "de", "fr"]), "hot" if i % 3 else f"s{i % 40}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit(1)).repartition(3)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(tuple(r) for r in quality.judge(docs).select(*names).collect())
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(["doc_id", "text", "lang", "source"], map(list, zip(*rows))))))
    want = sorted(con.sql(sql.OP8_SQL).fetchall())
    assert got == want
    assert 10 < sum(not r[-1] and not r[-2] for r in got) < 300
    assert quality.judge(docs.where("false")).count() == 0


def test_sketch_merges_and_bounds(spark):
    values = sorted(int(10 ** np.random.default_rng(1).uniform(0, 6)) for _ in range(3000))
    table = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b")).collect()
    assert all(r.b <= r.v < r.b * (1 + 1 / 16) + 1 for r in table)


def test_a_groups_own_distribution_decides(spark):
    rng = random.Random(12)
    noun = lambda: rng.choice(["red", "green", "blue", "grey"]) + str(rng.randrange(5000))

    def group(first, source, marked):
        """300 texts, of which a share has a sign at every fourth word."""
        return [
            (first + i, " ".join(noun() + ("#" if k % 4 == 0 and i < 300 * marked else "") for k in range(60)), "en", source)
            for i in range(300)
        ]

    text = " ".join(f"word{k}" + ("#" if k % 4 == 0 else "") for k in range(60))
    probes = [(1, text, "en", "plain"), (2, text, "en", "code")]

    def kept(rows):
        return {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("doc_id < 10").collect()}

    plain, code = group(1000, "plain", 0.0), group(2000, "code", 0.4)
    assert kept(probes + plain + code) == {1: False, 2: True}
    assert kept(probes + group(1000, "plain", 0.4) + code) == {1: True, 2: True}
    assert kept(probes + plain + group(2000, "code", 0.0)) == {1: False, 2: False}


def judged(spark, rows):
    return {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}


@pytest.mark.parametrize("letters", [i / 16 for i in range(17)])
def test_an_even_source_is_kept(spark, letters):
    """400 texts of one vocabulary, of a mean word length anywhere in its bucket; other sources have shorter words."""
    rng = random.Random(int(16 * letters))
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([3, 4, 5, 6, 7]) + (rng.random() < letters))) for _ in range(600)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(300)), "en", "even") for i in range(400)]
    rows += [(1000 + i, " ".join(rng.choice(words)[:3] for _ in range(200)), "en", f"s{i % 7}") for i in range(700)]
    assert sum(r.kept for d, r in judged(spark, rows).items() if d < 400) >= 396


def test_few_symbols_in_a_long_text_are_kept(spark):
    rng = random.Random(5)
    plain = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    rows = [(i, " ".join(plain(rng.randint(100, 300))), "en", "a") for i in range(300)]
    rows += [(1000, " ".join([*plain(3000), "#", "$", "*", "&"]), "en", "a"), (1001, " ".join([*plain(20), "#", "$", "*", "&"]), "en", "a")]
    got = judged(spark, rows)
    assert got[1000].kept and not got[1001].kept and got[1001].reasons == ["symbol_rate"]


def test_one_more_text_does_not_switch_a_verdict(spark):
    """A source's fence moves little with one text more, at whatever size."""
    rng = random.Random(6)
    text = lambda share: " ".join(f"w{rng.randrange(9000)}" + ("#" if rng.random() < share else "") for _ in range(100))
    own = [(text(0.06), "en", "own") for _ in range(402)]
    other = [(i, text(0.0), "en", f"s{i % 9}") for i in range(10_000, 11_000)]

    def fence(n):
        docs = spark.createDataFrame([(i, *own[i]) for i in range(n)] + other, "doc_id long, text string, lang string, source string")
        limits = quality.fences(quality.thresholds(quality.sketches(quality.metrics(docs))))
        return limits.where("g1 = 'own'").first().max_symbol_rate

    for n in (20, 199, 200, 400):
        a, b = fence(n), fence(n + 1)
        assert abs(a - b) <= 0.15 * a


def test_word_numbers_are_those_of_plain_words():
    texts = [b"", b" ", b"a b  a", "É é ab-ba 7".encode(), b"x" * 2_100_000 + b" y", b"\xff\xfe z", b"9" * 70_000, b""]
    numbers, counts = decontaminate.word_numbers(texts)
    words = [plain_words(t) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    known = {}
    for word, number in zip((w for ws in words for w in ws), numbers.tolist()):
        assert known.setdefault(word, number) == number
    assert len(set(known.values())) == len(known)
    tokens, lows, ends = decontaminate.padded(numbers, counts)
    assert all((tokens[a:b] == part).all() for a, b, part in zip(lows, ends, np.split(numbers, np.cumsum(counts)[:-1])))
    assert np.count_nonzero(tokens) == len(numbers)


def test_licenses_are_found_alike_whatever_word_is_rarest(spark):
    """With ties everywhere, and with every order of the words' rarity, other words look the templates up; places stay."""
    texts = [n for _, n, _ in licenses.BASE + licenses.NOTICES] + ["all rights all rights reserved cc cc by by", "license", "by", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = licenses.vocabulary()
    weights = ({w: 1.0 for w in words}, {w: float(i) for i, w in enumerate(words)}, {w: -float(i) for i, w in enumerate(words)})
    asked = [{p["rare"] for p in licenses._postings(idf)} for idf in weights]
    assert asked[0] != asked[1] != asked[2]
    want = sorted(map(repr, licenses.digest(licenses.scan(docs)).collect()))
    for idf in weights:
        assert sorted(map(repr, licenses.digest(licenses.scan(docs, idf=idf)).collect())) == want
