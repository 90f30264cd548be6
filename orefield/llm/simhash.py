"""SimHash near-duplicates: pigeonring filtering of segment chains, then the full Hamming check.

For whole similarity classes, min-hash bands find candidate texts, whose shingle sets are then compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.llm.arrow import HashCache, hash64, map_texts
from orefield.llm.components import connected_components
from orefield.session import discard, materialize

#: A ring of five segments covers the 64 bits.
WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(sum(WIDTHS[:i]) for i in range(len(WIDTHS)))
#: Buckets of more distinct fingerprints than this are linked through Hamming-ball centres instead of pairs.
CROWDED = 64
SLAB = 1 << 15
#: Min-hashes that a band joins, and the odds that a pair of just the similarity asked for is missed: that it shares fewer
#: than two bands, or that fewer of its min-hashes agree than the full comparison asks for.
BAND_ROWS = 3
MISS = 1e-5
#: Classes of set sizes grow by this factor.
SIZE_STEP = 1.02
#: Bits for each key in the filter that rows pass before their texts are shuffled, and its most words of 64 bits.
FILTER_BITS, FILTER_WORDS = 16, 1 << 18
#: Under each key each set is compared with so many others, within parts of about so many sets, before all pairs left apart are.
NEIGHBOURS, PART_SETS = 8, 256


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority of the XXH64 bits over all shingles of ASCII-lower-cased, ASCII-whitespace-separated words."""
    words = data.lower().split()
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    n = max(1, len(words) - shingle + 1)
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter(map(digest, map(b" ".join, parts)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, SLAB):
        bits = np.unpackbits(hashes[i : i + SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, row_key: bool = False) -> DataFrame:
    """(doc_id, fp long), one row for each row of docs; a null text counts as empty, whose fingerprint is zero.

    With ``row_key`` also that key of the row's id and text.
    """

    def make():
        def work(texts, _):
            seen: dict[bytes, int] = {}
            for t in texts:
                if t not in seen:
                    seen[t] = fingerprint(t, shingle)
            return {"fp": np.array([seen[t] for t in texts], dtype=np.uint64).view(np.int64)}

        return work

    keep = {"doc_id": f"`{id_col}`"} | ({"row_key": _row_key(id_col, text_col)} if row_key else {})
    return map_texts(docs, keep, "fp long", make, text_col)


def _segment(fp: Column, i: int) -> Column:
    i %= len(WIDTHS)
    return F.shiftrightunsigned(fp, STARTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1).cast("long"))


def chain_keys(fp: Column) -> Column:
    """One key for each ring start: two consecutive whole segments.

    Pigeonring with 5 segments and a total of 2: some start has prefix sums of at most floor(l * 2 / 5) for
    l = 1..5, which is 0, 0, 1, 1, 2. So two fingerprints within distance 2 agree on one such key.
    """
    return F.array(
        *(
            F.lit(i).cast("long") * F.lit(1 << 26) + _segment(fp, i) * F.lit(1 << 13) + _segment(fp, i + 1)
            for i in range(len(WIDTHS))
        )
    )


def _chain_holds(a: Column, b: Column, key: Column) -> Column:
    """Prefix sums of the chain that starts where ``key`` says: at most 1 over three and four segments, 2 over five."""
    diff = a.bitwiseXOR(b)
    start = F.shiftrightunsigned(key, 26)

    def upto(i: int, length: int) -> Column:
        bits = sum(((1 << WIDTHS[j % 5]) - 1) << STARTS[j % 5] for j in range(i, i + length))
        return F.bit_count(diff.bitwiseAND(F.lit(bits - (1 << 64) if bits >= 1 << 63 else bits)))

    tests = F.lit(False)
    for i in range(len(WIDTHS)):
        tests = tests | ((start == i) & (upto(i, 3) <= 1) & (upto(i, 4) <= 1))
    return tests & (F.bit_count(diff) <= 2)


def _centres(fp: Column) -> Column:
    flips = [1 << b for b in range(63)] + [-(1 << 63)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(x)) for x in flips))


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) pairs of distinct fingerprints ``fp`` whose transitive closure is that of all pairs within 2 bits.

    Buckets of up to CROWDED fingerprints are compared pair by pair under the chain budgets. Members of fuller
    buckets are linked without pairs: two fingerprints are within 2 bits exactly when they share a centre within
    1 bit of both, and a centre has 65 neighbours at most, so each gets a star to its smallest member.
    """
    rows = materialize(distinct.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key")), "chains")
    sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = materialize(rows.join(sizes, "key"), "shared")
    discard(rows, sizes)
    few = shared.where(F.col("n") <= CROWDED).select("key", "fp")
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    pairs = a.join(b, (a.key == b.key) & (a.u > b.v) & _chain_holds(a.u, b.v, a.key)).select("u", "v")
    many = shared.where(F.col("n") > CROWDED).select("fp").distinct()
    balls = many.select("fp", F.explode(_centres(F.col("fp"))).alias("centre"))
    stars = (
        balls.groupBy("centre")
        .agg(F.min("fp").alias("v"), F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select(F.explode("members").alias("u"), "v")
        .where("u <> v")
    )
    return pairs.unionByName(stars).distinct()


def _row_key(id_col: str, text_col: str) -> str:
    """SQL of a key of the row's id and text; a null id is none of the ids, a null text is empty."""
    return f"concat(if(`{id_col}` is null, '-', '+'), coalesce(cast(`{id_col}` as string), ''), ' ', md5(coalesce(cast(`{text_col}` as string), '')))"


def _key_filter(keys: DataFrame) -> tuple[DataFrame, Column]:
    """(a table to be broadcast, a condition): the condition holds for every row whose column _row is one of the only column
    of keys, and for few others, some 6 % of them at most up to a million keys. Beyond that more pass; none is ever lost."""
    words = min(FILTER_WORDS, max(1, -(-keys.count() * FILTER_BITS // 64)))
    at = lambda c: (F.pmod(F.xxhash64(c), F.lit(words)), F.shiftrightunsigned(F.xxhash64(c), 58).cast("int"))
    word, bit = at(keys.columns[0])
    made = keys.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    word, bit = at("_row")
    return F.broadcast(made), (F.col("_word") == word) & F.call_function("getbit", "_bits", bit).cast("boolean")


def _classes(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of distinct, one for each fp, with the root of their component in the graph of edges (u, v)."""
    roots = connected_components(edges)
    named = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root")).distinct()
    classes = materialize(distinct.join(named, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    discard(roots)
    return classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each row of docs.

    Fingerprints link at two or fewer differing bits; component_id is the smallest doc_id reachable. Null and empty
    texts have fingerprint zero and link like any other. Rows that repeat a doc_id each get a row. Null doc_ids take
    part and are never a component_id unless the whole component lacks ids. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    edges = materialize(links(distinct.select("fp")), "links")
    rooted = _classes(distinct, edges)
    lows = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    classes = materialize(rooted.join(lows, "root").select("fp", "component_id"), "named")
    discard(distinct, edges, rooted, lows)
    return rows.join(classes, "fp").select(
        "doc_id",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def grams(numbers: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one run."""
    width = min(width, len(numbers))
    if not width:
        return np.zeros(0, np.uint64)
    n = len(numbers) - width + 1
    out = numbers[:n].copy()
    for k in range(1, width):
        out = ((out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) + numbers[k : k + n]
    return np.unique((out ^ (out >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53))


def n_bands(similarity: float) -> int:
    """The fewest bands of which a pair of this similarity shares at least two, but for odds of MISS."""
    p, n = similarity**BAND_ROWS, 2
    while p < 1 and (1 - p) ** n + n * p * (1 - p) ** (n - 1) > MISS:
        n += 1
    return n


def least_agreement(similarity: float, n: int) -> int:
    """Of n min-hashes, as many agree in a pair of this similarity, but for odds of MISS."""
    odds, k = 0.0, 0
    while similarity < 1:
        odds += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if odds > MISS:
            return k
        k += 1
    return n


def bands(found: np.ndarray, similarity: float, seed: int = 42) -> tuple[np.ndarray, bytes]:
    """(a key of each band, a byte of each min-hash) of a set; an empty set has neither."""
    n = n_bands(similarity)
    if not len(found):
        return np.zeros(0, np.int64), b""
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 64, (n * BAND_ROWS, 1), dtype=np.uint64) for _ in range(2))
    least = np.full(n * BAND_ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(found), 1 << 12):
        np.minimum(least, (found[i : i + (1 << 12)] * (a | np.uint64(1)) + b).min(axis=1), out=least)
    key = np.arange(n, dtype=np.uint64)
    for part in least.reshape(n, BAND_ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    # The least values are all small numbers, so a byte of each is taken from its mixture.
    return key.view(np.int64), ((least * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(56)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(doc_id, row_key, fp, sid, size, keys, sig) for each row of docs: sid names its set of ``width``-word shingles."""

    def make():
        cache = HashCache(hash64)

        def work(texts, _):
            seen: dict[bytes, tuple] = {}
            for t in texts:
                if t not in seen:
                    found = grams(cache.array(t.lower().split(), np.uint64), width)
                    seen[t] = fingerprint(t), hash64(found.tobytes()), len(found), *bands(found, similarity)
            fps, sids, sizes, keys, sigs = zip(*(seen[t] for t in texts))
            as_long = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            return {"fp": as_long(fps), "sid": as_long(sids), "size": np.array(sizes, np.int64), "keys": pa.array(keys, pa.list_(pa.int64())), "sig": pa.array(sigs, pa.binary())}

        return work

    keep = {"doc_id": f"`{id_col}`", "row_key": _row_key(id_col, text_col)}
    return map_texts(docs, keep, "fp long, sid long, size long, keys array<long>, sig binary", make, text_col)


def _agreeing(pairs: DataFrame, sigs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of which enough min-hashes agree; sigs (sid, sig) has a row for each of theirs."""
    n = n_bands(similarity) * BAND_ROWS
    least = least_agreement(similarity, n)
    u, v = (sigs.select(F.col("sid").alias(x), F.col("sig").alias(f"s{x}")) for x in "uv")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, n) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= least, pa.bool_()))

    both = pairs.join(u, "u").join(v, "v").select("u", "v", "su", "sv")
    return materialize(both.mapInArrow(compare, "u long, v long"), "agreeing")


def _texts_of(asked: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text): one text for each asked sid. Texts that aren't asked for are not shuffled, but for a few that a filter lets pass."""
    one = materialize(rows.groupBy("sid").agg(F.min("row_key").alias("_key")).join(asked, "sid").select("_key"), "asked")
    texts = docs.select(F.expr(_row_key(id_col, text_col)).alias("_row"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.join(*_key_filter(one), "left_semi")
    return texts.join(one, F.col("_row") == F.col("_key"), "left_semi").dropDuplicates(["_row"])


def _similar(pairs: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of sids whose sets have at least the similarity (Jaccard), compared in full."""
    asked = pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid"))).distinct()

    def make():
        cache = HashCache(hash64)

        def work(batch, _):
            sets = [grams(cache.array(t.lower().split(), np.uint64), width).tobytes() for t in batch]
            return {"sid": np.array([hash64(x) for x in sets], dtype=np.uint64).view(np.int64), "grams": pa.array(sets, pa.binary())}

        return work

    sets = materialize(map_texts(_texts_of(asked, rows, docs, id_col, text_col), {}, "sid long, grams binary", make), "grams")
    u, v = (sets.select(F.col("sid").alias(n), F.col("grams").alias(f"g{n}")) for n in "uv")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(u, "u").join(v, "v").select("u", "v", "gu", "gv")
    found = materialize(both.mapInArrow(compare, "u long, v long"), "similar")
    discard(sets)
    return found


def _prefix_rows(sets: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(key, sid, size, root, place, class, partner) of sets (sid, size, root): the shingles through which sets can meet.

    Two sets of sizes x and y have the similarity s if they share at least a = s / (1 + s) * (x + y) shingles. Put in one
    order, the rarest first, the first shingle that they share is then among the first x - a + 1 of the one and y - a + 1
    of the other. So sets meet through their rarest shingles alone, and pages of one template, whose own words are rarer
    than the template's, never meet unless they are that similar. Sizes are classed finely, as the bound needs both: a set
    stands under each class that its partner may have, with the shingles that this class leaves. Shingles of sets in one
    component only are left out, as these needn't meet.
    """

    def make():
        cache = HashCache(hash64)

        def work(batch, _):
            own = [grams(cache.array(t.lower().split(), np.uint64), width) for t in batch]
            sid = np.array([hash64(x.tobytes()) for x in own], dtype=np.uint64).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            return {"sid": sid, "grams": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}

        return work

    texts = _texts_of(sets.select("sid"), rows, docs, id_col, text_col)
    held = map_texts(texts, {}, "sid long, grams array<long>", make).join(sets, "sid").select("sid", "size", "root", F.explode("grams").alias("gram"))
    held = materialize(held, "grams")
    often = held.groupBy("gram").agg(F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("apart")).where("n > 1")
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.coalesce("n", F.lit(1)), "gram")).cast("int")
    # Size and root meet the sets again when these lie together: twice shuffled with each shingle they'd be half of its bytes.
    placed = held.select("sid", "gram").join(often, "gram", "left").withColumn("place", place).where("apart").drop("n", "apart").join(sets, "sid")
    share, step = similarity / (1 + similarity), math.log(SIZE_STEP)
    reach = math.ceil(-math.log(similarity) / step) + 1
    own_class = F.floor(F.log("size") / step).cast("int")
    partner = F.explode(F.sequence(own_class - reach, own_class + reach)).alias("partner")
    # A little is taken off each bound, so that rounding never loses a pair; the exact test follows the join.
    least = F.greatest(F.lit(1.0), F.exp(F.col("partner") * step) * (1 - 1e-9))
    spread = placed.select("*", own_class.alias("class"), partner).where(F.col("place") <= F.floor(F.col("size") + 1 - share * (F.col("size") + least) + 1e-6))
    key = F.xxhash64("gram", F.least("class", "partner"), F.greatest("class", "partner")).alias("key")
    spread = materialize(spread.select(key, "sid", F.col("size").cast("int").alias("size"), "root", "place", "class", "partner"), "spread")
    discard(held)
    return spread


def _apart(spread: DataFrame) -> DataFrame:
    """The rows of keys whose sets are in several components and of which two can be partners, with the number of the
    key's sets and its most frequent root, main."""
    counts = spread.groupBy("key", "root").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.min(F.least("class", "partner")).alias("one"), F.max(F.greatest("class", "partner")).alias("other"))
    main = counts.groupBy("key").agg(
        F.max(F.struct("n", "root"))["root"].alias("main"),
        F.sum("n").alias("sets"),
        F.count("*").alias("roots"),
        # The key names both classes; sets of both must be there, or of the one that is its own partner.
        ((F.min("low") == F.min("one")) & (F.max("high") == F.max("other"))).alias("met"),
    )
    return materialize(spread.join(main.where("roots > 1 and met").drop("roots", "met"), "key"), "rest")


def _with_roots(rest: DataFrame, roots: DataFrame) -> DataFrame:
    """rest with the sets' present roots (sid, root). Components only grow, so other keys than these never matter again."""
    return rest.drop("root", "main", "sets").join(roots, "sid")


def _can_be_similar(similarity: float) -> Column:
    """Of two of those rows, _u and _v, under one key: the exact test of sizes and places, and other components."""
    need = similarity / (1 + similarity) * (F.col("size_u") + F.col("size_v")) - 1e-6
    fits = (F.col("place_u") <= F.col("size_u") + 1 - need) & (F.col("place_v") <= F.col("size_v") + 1 - need)
    return fits & (F.col("root_u") != F.col("root_v")) & (F.col("partner_u") == F.col("class_v"))


_SIDE = ("sid", "size", "root", "place", "class", "partner")


def _neighbour_pairs(rest: DataFrame, similarity: float) -> DataFrame:
    """(u, v): under each key each set and the NEIGHBOURS next ones, in an order of the key's own and in parts of bounded size."""
    part = F.pmod(F.xxhash64("sid", "key"), F.ceil(F.col("sets") / PART_SETS))
    order = Window.partitionBy("key", "part").orderBy(F.xxhash64("key", "sid"), "sid")
    ahead = F.array(*(F.lead(F.struct(*_SIDE), k).over(order) for k in range(1, NEIGHBOURS + 1)))
    pairs = rest.withColumn("part", part).withColumn("ahead", ahead).select(*(F.col(c).alias(f"{c}_u") for c in _SIDE), F.explode("ahead").alias("x")).where("x is not null")
    pairs = pairs.select("*", *(F.col(f"x.{c}").alias(f"{c}_v") for c in _SIDE)).where(_can_be_similar(similarity))
    return pairs.select(F.greatest("sid_u", "sid_v").alias("u"), F.least("sid_u", "sid_v").alias("v"))


def _all_pairs(rest: DataFrame, similarity: float) -> DataFrame:
    """(u, v): all pairs in different components that can have the similarity; those of a key's most frequent component
    are not paired with each other."""
    a, b = (rest.select("key", "main", *(F.col(c).alias(f"{c}_{n}") for c in _SIDE)) for n in "uv")
    pairs = a.where("root_u <> main").join(b.drop("main"), "key").where(_can_be_similar(similarity))
    return pairs.select(F.greatest("sid_u", "sid_v").alias("u"), F.least("sid_u", "sid_v").alias("v")).distinct()


def _prefix_pairs(sets: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(u, v): all pairs of sets (sid, size, root) in different components that can have the similarity."""
    spread = _prefix_rows(sets, rows, docs, id_col, text_col, width, similarity)
    return _all_pairs(_apart(spread), similarity)


def similar_links(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(u, v) links of fp and sid of ``sketches`` rows: texts that share either, or whose shingle sets are similar enough.

    Each set is first compared with the smallest of every band that it shares, which joins most of a large group of
    near-copies. Sets that share two bands with ones in other components then meet through a prefix filter: first each
    with a few neighbours, which joins most of what is left of such a group, then all that are still apart. Pairs of which
    too few min-hashes agree are left out before the full comparison.
    """
    units = materialize(rows.groupBy("fp", "sid").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "units")
    same = units.select(F.col("fp").alias("u"), F.col("sid").alias("v")).unionByName(links(units.select("fp").distinct()))
    same = materialize(same, "same")
    sets = units.dropDuplicates(["sid"])
    sigs = materialize(sets.where("size > 0").select("sid", "sig"), "sigs")
    banded = materialize(sets.select("sid", "size", F.explode("keys").alias("key")), "bands")
    first = banded.groupBy("key").agg(F.min(F.struct("sid", "size")).alias("c"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(banded.join(first, "key"), "shared")
    discard(units, banded)
    near = lambda a, b: F.least(a, b) >= F.greatest(a, b) * similarity - 1e-9
    tried = shared.sparkSession.createDataFrame([], "u long, v long")

    def compare(pairs: DataFrame) -> None:
        """Adds what of these pairs is similar to the links; no pair is compared twice."""
        nonlocal same, tried
        fresh = materialize(pairs.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
        agreed = _agreeing(fresh, sigs, similarity)
        found = _similar(agreed, rows, docs, id_col, text_col, width, similarity)
        both, seen = materialize(same.unionByName(found), "same"), materialize(tried.unionByName(fresh), "tried")
        discard(same, tried, fresh, agreed, found)
        same, tried = both, seen

    def rooted() -> DataFrame:
        """(sid, root) of all that have a link."""
        roots = connected_components(same)
        named = materialize(roots.select(F.col("node").alias("sid"), "root").unionByName(roots.select(F.col("root").alias("sid"), "root")).distinct(), "rooted")
        discard(roots)
        return named

    stars = shared.where(F.col("sid") != F.col("c.sid")).where(near(F.col("size"), F.col("c.size")))
    compare(stars.select(F.greatest("sid", "c.sid").alias("u"), F.least("sid", "c.sid").alias("v")))
    roots = rooted()
    ones = shared.select("sid", "size", "key").join(roots, "sid")
    apart = ones.groupBy("key").agg((F.min("root") < F.max("root")).alias("apart")).where("apart").select("key")
    left = ones.join(apart, "key").groupBy("sid").agg(F.first("size").alias("size"), F.first("root").alias("root"), F.count("*").alias("n")).where("n > 1").drop("n")
    left = materialize(left, "left")
    spread = _prefix_rows(left, rows, docs, id_col, text_col, width, similarity)
    rest = _apart(spread)
    discard(roots, shared, left, spread)
    compare(_neighbour_pairs(rest, similarity))
    roots = rooted()
    last = _apart(_with_roots(rest, roots))
    discard(roots, rest)
    compare(_all_pairs(last, similarity))
    discard(sigs, last, tried)
    return same


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, width: int = 5) -> DataFrame:
    """One row of docs for each group of near-duplicates: that of the smallest id, nulls last, then of the smallest
    fingerprint and text hash. Rows that share an id, or have none, go only if they repeat a text or a group. Of rows that
    repeat both id and text, that with the smallest hash of all columns stays.

    Near-duplicates are linked as by ``near_duplicates`` and, given a similarity, also where the sets of ``width``-word
    shingles have at least that Jaccard similarity.
    """
    if similarity is None:
        rows = materialize(fingerprints(docs, id_col, text_col, row_key=True), "fingerprints")
    else:
        rows = materialize(sketches(docs, id_col, text_col, width, similarity), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "row_key")
    distinct = materialize(rows.groupBy("fp").agg(F.min(rank).alias("first")), "distinct")
    if similarity is None:
        edges = materialize(links(distinct.select("fp")), "links")
    else:
        edges = similar_links(rows, docs, id_col, text_col, width, similarity)
    classes = _classes(distinct, edges)
    stay = materialize(classes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_key").alias("stay")), "stay")
    counts = rows.groupBy("row_key").agg(F.count("*").alias("n"))
    unsure = materialize(counts.join(stay, F.col("row_key") == F.col("stay"), "left").where("stay is null or n > 1").select("row_key"), "unsure")
    discard(rows, distinct, edges, classes)
    # Columns go by number here, so none of docs clashes. Rows that stay and don't repeat are passed on where they are read;
    # of the others, the join and the removal of repeated rows share one shuffle.
    names = docs.columns
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.expr(_row_key(id_col, text_col)).alias("_row"))
    table, passes = _key_filter(unsure)
    sure = keyed.join(table, passes, "left_anti").drop("_row")
    kept = keyed.join(table, passes, "left_semi").join(stay.hint("merge"), F.col("_row") == F.col("stay"), "left_semi")
    # Maps have no hash; rows that differ in nothing else are told apart by no rule.
    hashed = F.xxhash64(*(f"c{i}" for i, c in enumerate(names) if "map<" not in docs.schema[i].dataType.simpleString()))
    kept = kept.groupBy("_row").agg(F.min_by(F.struct(*(f"c{i}" for i in range(len(names)))), hashed).alias("own")).select("own.*")
    return sure.union(kept).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
