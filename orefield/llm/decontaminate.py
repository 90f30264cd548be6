"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit verification.

Texts and items are sequences of plain words (lower-cased letters and digits). Windows start at anchors, which a hash of
the word picks, so an edit elsewhere doesn't move them; a text's windows start at words that are anchors of some item.
From there a CGK walk reads symbols: at step j it emits the current word and moves on if bit j of a random function of
the word is set. Windows within a small edit distance then emit words that agree at most steps, and tables that sample a
few steps find them. A walk is as long as its item needs, up to MAX_STEPS, about 32 words; longer items have windows of
that size at all their anchors. What they find is aligned exactly, word by word, against the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.arrow import WORD_TABLE, map_texts

#: Items go to every task in blocks whose index takes at most about this much memory; INDEX_RATIO is index by text.
INDEX_BYTES = 32 << 20
INDEX_RATIO = 20
MAX_STEPS = 64
CHUNK = 1 << 14  # windows that walk together; their state fits a core's cache
BITMAP_BITS = 17


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.8  # edits allowed: floor((1 - similarity) * words of the item)
    walks: int = 3
    samplings: int = 4  # tables for each walk and length class
    sampled: int = 4  # steps that a table samples
    anchor_mask: int = 3  # one word in anchor_mask + 1 is an anchor
    min_words: int = 4  # shorter items allow no edit and are looked up word by word
    seed: int = 20240


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(salt)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


#: A word's number is the sum of its bytes' numbers times powers of an odd base by place (round after 2^16 places), mixed.
WORD_BYTES = 1 << 20  # bytes numbered at once
BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE[32] = 0
POWER = np.cumprod(np.append(np.uint64(1), np.full((1 << 16) - 1, np.uint64(0x9E3779B97F4A7C15))))


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the plain words of all texts in order, words of each text): lower-cased runs of ASCII letters, digits and
    non-ASCII characters. Bytes are numbered in parts of about WORD_BYTES, so long texts need little more than themselves."""
    rows = [(t if t.isascii() else t.decode("utf-8", "replace").lower().encode()).translate(WORD_TABLE) for t in texts]
    data = np.frombuffer(b" ".join(rows) + b" ", np.uint8)
    inside = data != 32
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + WORD_BYTES)))
        stop = int(starts[j]) if j < len(starts) else len(data)
        own = starts[i:j] - starts[i]
        place = np.arange(stop - starts[i]) - np.repeat(own, np.diff(own, append=stop - starts[i]))
        out[i:j] = np.add.reduceat(BYTE[data[starts[i] : stop]] * POWER[place & 0xFFFF], own)
        i = j
    ends = np.cumsum([len(r) + 1 for r in rows])
    return mix(out, 11), np.diff(np.searchsorted(starts, ends), prepend=0)


def hash64(word: bytes) -> int:
    """The number of one plain word."""
    return int(word_numbers([word])[0][0])


def padded(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all texts' words, each text's followed by MAX_STEPS + 1 padding words; first word of each text; end of each)."""
    lows = np.cumsum(counts + MAX_STEPS + 1) - counts - MAX_STEPS - 1
    tokens = np.zeros(len(numbers) + len(counts) * (MAX_STEPS + 1), np.uint64)
    tokens[np.arange(len(numbers)) + np.repeat(np.arange(len(counts)) * (MAX_STEPS + 1), counts)] = numbers
    return tokens, lows, lows + counts


def steps_of(n_words: int) -> int:
    """Steps of the walk for the length class of an item; a walk of t steps reads about t / 2 words."""
    return max(4, min(MAX_STEPS, 3 << (n_words.bit_length() - 2)))


@dataclass
class Table:
    """One sample of steps: the items' signatures in order, and the item and place that each comes from."""

    walk: int
    sample: np.ndarray
    sigs: np.ndarray
    items: np.ndarray
    places: np.ndarray
    bitmap: np.ndarray  # of the signatures' first bits, which turns most lookups away

    @classmethod
    def build(cls, walk: int, sample: np.ndarray, sigs: np.ndarray, items: np.ndarray, places: np.ndarray) -> Table:
        order = np.argsort(sigs, kind="stable")
        bitmap = np.zeros(1 << BITMAP_BITS, bool)
        bitmap[sigs >> np.uint64(64 - BITMAP_BITS)] = True
        return cls(walk, sample, sigs[order], items[order], places[order], bitmap)

    def find(self, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the signature asked, row of the table) of all that meet."""
        asked = np.flatnonzero(self.bitmap[sig >> np.uint64(64 - BITMAP_BITS)])
        low = np.searchsorted(self.sigs, sig[asked], "left")
        n = np.searchsorted(self.sigs, sig[asked], "right") - low
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.repeat(asked, n), rows


@dataclass
class Index:
    """Signatures of a block of items as sorted arrays; small enough to go to every task (see INDEX_BYTES)."""

    settings: Settings
    ids: list[int]
    words: np.ndarray  # all items' words, one after the other
    ends: np.ndarray
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # anchors of the items
    tables: list[Table] = field(default_factory=list)
    short: dict[int, dict[tuple[int, ...], list[int]]] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple[int, bytes]], s: Settings) -> Index:
        items, short = [], []
        numbers, counts = word_numbers([text for _, text in rows])
        for (item_id, _), words in zip(rows, np.split(numbers, np.cumsum(counts)[:-1])):
            if len(words):
                (items if len(words) >= s.min_words else short).append((item_id, words))
        every = items + short
        lengths = np.array([len(t) for _, t in every], dtype=np.int64)
        index = cls(s, [i for i, _ in every], np.concatenate([t for _, t in every]) if every else np.zeros(0, np.uint64), np.cumsum(lengths))
        picked = [np.flatnonzero((mix(t, 7) & np.uint64(s.anchor_mask)) == 0) for _, t in items]
        # Items with few anchors lend their first words as further anchors.
        extra = [t[:3] for (_, t), at in zip(items, picked) if (at < max(1, len(t) // 2)).sum() < 3]
        if extra:
            extra = np.unique(np.concatenate(extra))
            picked = [np.union1d(at, np.flatnonzero(np.isin(t, extra))) for (_, t), at in zip(items, picked)]
        rng = np.random.default_rng(s.seed)
        heads = []
        for steps in sorted({steps_of(len(t)) for _, t in items}):
            samples = [np.sort(rng.choice(steps, min(s.sampled, steps), replace=False)) for _ in range(s.walks * s.samplings)]
            parts, starts, owners, places, at = [], [], [], [], 0
            pad = np.zeros(MAX_STEPS + 1, np.uint64)
            for k, (_, t) in enumerate(items):
                if steps_of(len(t)) == steps:
                    own = picked[k][picked[k] + max(1, min(len(t), steps // 2)) <= len(t)]
                    parts += [t, pad]
                    starts.append(own + at)
                    owners.append(np.full(len(own), k, np.int32))
                    places.append(own.astype(np.int32))
                    heads.append(t[own])
                    at += len(t) + len(pad)
            tokens, starts, owners, places = map(np.concatenate, (parts, starts, owners, places))
            for r in range(s.walks):
                own = samples[r * s.samplings : (r + 1) * s.samplings]
                bits = walk_bits(tokens, r, s)
                made = [signatures(tokens, bits, starts[i : i + CHUNK], own) for i in range(0, len(starts), CHUNK)]
                index.tables += [Table.build(r, sample, np.concatenate([m[j] for m in made]), owners, places) for j, sample in enumerate(own) if made]
        index.heads = np.unique(np.concatenate(heads)) if heads else index.heads
        for k, (_, t) in enumerate(short, len(items)):
            index.short.setdefault(len(t), {}).setdefault(tuple(t.tolist()), []).append(k)
        return index

    def item(self, k: int) -> np.ndarray:
        return self.words[self.ends[k - 1] if k else 0 : self.ends[k]]

    def starts(self, tokens: np.ndarray) -> np.ndarray:
        """Where windows start: at words that are an anchor of some item."""
        few = np.zeros(1 << 16, bool)
        few[self.heads & np.uint64(0xFFFF)] = True
        near = np.flatnonzero(few[tokens & np.uint64(0xFFFF)])
        return near[np.isin(tokens[near], self.heads)]

    def hits(self, tokens: np.ndarray) -> list[tuple[int, int, int]]:
        """(window start, item number, start within the item) of every signature that meets an item's, in order."""
        starts = self.starts(tokens)
        out = [np.zeros((0, 3), np.int64)]
        for r in range(self.settings.walks):
            tables = [t for t in self.tables if t.walk == r]
            bits = walk_bits(tokens, r, self.settings)
            samples = [t.sample for t in tables]
            for i in range(0, len(starts), CHUNK):
                part = starts[i : i + CHUNK]
                for table, sig in zip(tables, signatures(tokens, bits, part, samples)):
                    asked, rows = table.find(sig)
                    if len(rows):
                        out.append(np.stack([part[asked], table.items[rows], table.places[rows]], axis=1))
        return list(map(tuple, np.unique(np.concatenate(out), axis=0).tolist()))

    def short_hits(self, tokens: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, item number) of every place where an item of under ``min_words`` words stands as it is."""
        for width, table in self.short.items():
            heads = np.array(sorted({t[0] for t in table}), dtype=np.uint64)
            for at in np.flatnonzero(np.isin(tokens, heads)).tolist():
                for k in table.get(tuple(tokens[at : at + width].tolist()), ()):
                    yield at, k


def walk_bits(tokens: np.ndarray, walk: int, s: Settings) -> np.ndarray:
    """The random function of a walk: bit j of a word's number says whether the walk moves on at step j."""
    return mix(tokens, s.seed * 31 + walk)


def signatures(tokens: np.ndarray, bits: np.ndarray, starts: np.ndarray, samples: list[np.ndarray]) -> list[np.ndarray]:
    """CGK walks from all starts at once, and for each sample the hashes of the words met at its steps.

    ``tokens`` ends in MAX_STEPS padding words, so no walk leaves it.
    """
    last = max((int(x[-1]) for x in samples), default=-1)
    wanted = [[k for k, x in enumerate(samples) if j in x] for j in range(last + 1)]
    sigs = [np.full(len(starts), np.uint64(1469598103934665603)) for _ in samples]
    pos = starts.astype(np.int64)
    one, multiplier, fold = np.uint64(1), np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
    for j in range(last + 1):
        if wanted[j]:
            symbols = tokens[pos]
            for k in wanted[j]:
                x = (sigs[k] ^ symbols) * multiplier
                sigs[k] = x ^ (x >> fold)
        pos += ((bits[pos] >> np.uint64(j)) & one).astype(np.int64)
    return [x * multiplier for x in sigs]


def best_alignment(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(fewest word edits, first end) of the pattern against any stretch of the text: Myers' bit-parallel rows."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def verify(index: Index, tokens: np.ndarray, low: int, high: int, found: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """item number -> (edits, first word, end) of the best alignment within tokens[low:high], where few enough.

    A word of the item that the stretch lacks costs an edit at least, so stretches that lack too many are not aligned.
    """
    best: dict[int, tuple[int, int, int]] = {}
    tried: set[tuple[int, int]] = set()
    items: dict[int, tuple[np.ndarray, set[int]]] = {}
    for start, k, at in found:
        if k not in items:
            items[k] = (index.item(k), set(index.item(k).tolist()))
        item, different = items[k]
        allowed = int((1 - index.settings.similarity) * len(item) + 1e-9)
        begin = start - at
        if (k, begin) in tried:
            continue
        tried.add((k, begin))
        a, b = max(low, begin - allowed), min(high, begin + len(item) + 2 * allowed)
        if len(different.difference(tokens[a:b].tolist())) > allowed:
            continue
        edits, end = best_alignment(item, tokens[a:b])
        if edits <= allowed:
            _, back = best_alignment(item[::-1], tokens[a : a + end][::-1])
            case = (edits, a + end - back - low, a + end - low)
            best[k] = min(best.get(k, case), case)
    return best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The items in blocks of bounded size, so each block's index may go to every task."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total * INDEX_RATIO // INDEX_BYTES
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted((r[0], bytes(r[1])) for r in part.collect())


def _found(docs: DataFrame, index: Index, keep: dict[str, str], text_col: str) -> DataFrame:
    """The columns ``keep`` and found, the items of one block that each row holds."""

    def make():
        def work(texts, _):
            tokens, lows, ends = padded(*word_numbers(texts))
            bounds = list(zip(lows.tolist(), ends.tolist()))
            found: dict[int, list] = {}
            for hit in index.hits(tokens):
                found.setdefault(int(np.searchsorted(lows, hit[0], side="right")) - 1, []).append(hit)
            told = [[] for _ in texts]
            brief: set[tuple[int, int]] = set()
            for at, k in index.short_hits(tokens):
                d = int(np.searchsorted(lows, at, side="right")) - 1
                if (d, k) not in brief:
                    brief.add((d, k))
                    n = len(index.item(k))
                    told[d].append({"item_id": index.ids[k], "edits": 0, "item_words": n, "similarity": 1.0, "first_word": at - bounds[d][0], "end_word": at - bounds[d][0] + n})
            for d, hits in found.items():
                for k, (edits, first, end) in sorted(verify(index, tokens, *bounds[d], hits).items()):
                    n = len(index.item(k))
                    told[d].append({"item_id": index.ids[k], "edits": edits, "item_words": n, "similarity": 1 - edits / n, "first_word": first, "end_word": end})
            return {"found": pa_list(told)}

        return work

    return map_texts(docs, keep, f"found {FOUND}", make, text_col)


def leaks(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, edits, item_words, similarity, first_word, end_word): one row for each item found in a row of docs.

    An item is found where some stretch of the text is within floor((1 - similarity) * item_words) word edits; its best
    alignment is told, the earliest on ties. Items of under ``min_words`` words are found where they stand word for word.
    Null and empty texts hold nothing; null item ids or texts and items without words are left out; repeated rows are told again. The texts are read once for each block of items and
    never shuffled.
    """
    blocks = [_found(docs, Index.build(rows, settings), {"doc_id": f"`{id_col}`"}, text_col) for rows in _blocks(benchmark, item_col, item_text)]
    return reduce(DataFrame.unionByName, blocks).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


FOUND = "array<struct<item_id:bigint,edits:bigint,item_words:bigint,similarity:double,first_word:bigint,end_word:bigint>>"


def pa_list(told: list[list[dict]]):
    import pyarrow as pa

    longs = [(n, pa.int64()) for n in ("item_id", "edits", "item_words")]
    kind = pa.struct([*longs, ("similarity", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    return pa.array(told, type=pa.list_(kind))


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, all columns as they are, without the rows that hold an item; nothing is joined or shuffled."""
    names = docs.columns
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    for rows in _blocks(benchmark, item_col, item_text):
        own = {f"c{i}": f"c{i}" for i in range(len(names))}
        out = _found(out, Index.build(rows, settings), own, f"c{names.index(text_col)}").where(F.size("found") == 0).drop("found")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
