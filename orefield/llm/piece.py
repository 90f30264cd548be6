"""SentencePiece merge-type encoding by a score-ordered agenda of adjacent pairs, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from orefield.llm.arrow import begin_task, held, map_texts
from orefield.session import ship

SPACE = "▁"
#: The library checks so many units in one text, with a character between them that no piece holds.
CHECKED = 16
#: Two generations of remembered units take at most about twice this and a slice of text.
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 200
#: A longer unit has an agenda of its own, as its merges would hold up the others.
LONG_UNIT = 40
NONE = np.iinfo(np.int32).max


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unit_pattern(pieces: list[str]) -> re.Pattern:
    """A unit is spaces and then letters only or others only, where pieces keep them apart. No piece reaches over its end.

    Characters that stand side by side in a piece are of one kind, and so is what these stand beside elsewhere.
    """
    kind: dict[str, str] = {}

    def of(c: str) -> str:
        while (up := kind.setdefault(c, c)) != c:
            kind[c] = c = kind[up]
        return c

    for p in pieces:
        for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:]):
            kind[of(a)] = of(b)
    chars = {c for p in pieces for c in p} - {SPACE}
    lettered = {of(c) for c in chars if c.isalpha()}
    letters = re.escape("".join(sorted(c for c in chars if of(c) in lettered)))
    apart = f"{SPACE}*[{letters}]+|" if letters else ""
    return re.compile(f"{apart}{SPACE}*[^{letters}{SPACE}]+|{SPACE}+")


class PieceModel:
    """A merge-type vocabulary with byte fallback and without text normalisation, as the library loads it."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        # Equal scores rank alike; the agenda then takes the leftmost pair.
        order = sorted({sp.get_score(i) for i in plain}, reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        self.rank = {self.pieces[i]: rank[sp.get_score(i)] for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes_of = [b""] * n
        self.names = list(map(str, range(n)))
        for i in plain:
            self.bytes_of[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        # Symbols are numbered: the pieces, then characters that are none, then all that are in none. A pair of symbols that make a piece has a row here.
        self.symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - set(self.ids)):
            self.symbols[c] = n + len(self.symbols)
        self.symbol_of = np.full(sys.maxunicode + 1, n + len(self.symbols), np.int32)
        for c in filter(lambda c: len(c) == 1, self.symbols):
            self.symbol_of[ord(c)] = self.symbols[c]
        made = {(self.symbols[p[:i]], self.symbols[p[i:]]): p for p in self.ids for i in range(1, len(p)) if p[:i] in self.symbols and p[i:] in self.symbols}
        pairs = sorted(made)
        self.pair_keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        self.piece_at = np.zeros(len(order), np.int32)
        merged = set(made.values())
        for p in merged:
            self.piece_at[self.rank[p]] = self.ids[p]
        # Pieces of equal score, of which none holds another: units that hold one have to look at where pairs stand.
        times = Counter(self.rank[p] for p in merged)
        tied = {p for p in merged if times[self.rank[p]] > 1}
        self.tied = [p for p in tied if not any(q != p and q in p for q in tied)]
        self.pair_ranks = np.array([self.rank[made[x]] for x in pairs], np.int32)
        self.unit = unit_pattern(list(self.ids))
        if len(self.byte_ids) != 256 or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the vocabulary needs 256 byte pieces and spaces only at the start of a piece")
        self.between = next(c for c in map(chr, chain([10], range(0xE000, 0xF900))) if c not in self.symbols)

    def encode_unit(self, unit: str) -> list[int]:
        """Merge the best-ranked adjacent pair, the leftmost on ties, until no pair is a piece."""
        n = len(unit)
        rank, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        end = list(range(1, n + 1))  # where the symbol that starts here ends; 0 for swallowed starts
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            r = rank(unit[i : i + 2])
            if r is not None:
                agenda.append((r, i, i + 1, i + 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, mid, stop = pop(agenda)
            if end[i] != mid or end[mid] != stop:
                continue  # one of the two has been merged since
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                r = rank(unit[i : end[stop]])
                if r is not None:
                    push(agenda, (r, i, stop, end[stop]))
            h = before[i]
            if h >= 0:
                r = rank(unit[h:stop])
                if r is not None:
                    push(agenda, (r, h, i, stop))
        out, i, ids = [], 0, self.ids.get
        while i < n:
            k = ids(unit[i : end[i]])
            if k is None:
                out += [self.byte_ids[b] for b in unit[i : end[i]].encode()]
            else:
                out.append(k)
            i = end[i]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NONE where they make no piece."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode_units(self, units: list[str]) -> list[bytes]:
        """As ``encode_unit`` for each, packed; the agendas of units of equal length are worked off side by side."""
        out: list[bytes] = [b""] * len(units)
        by_length: dict[int, list[int]] = {}
        tied = {u for p in self.tied for u in units if p in u}
        for i, u in enumerate(units):
            if len(u) <= LONG_UNIT and u not in tied:
                by_length.setdefault(len(u), []).append(i)
            else:
                out[i] = array("i", self.encode_unit(u)).tobytes()
        for length, owners in by_length.items():
            symbols = self.symbol_of[np.frombuffer("".join([units[i] for i in owners]).encode("utf-32-le"), np.uint32)].reshape(-1, length)
            ids = self._merge(symbols)
            some = ids >= 0
            data, ends = ids[some].tobytes(), np.cumsum(some.sum(axis=1) * 4).tolist()
            for i, a, b in zip(owners, [0] + ends, ends):
                out[i] = data[a:b]
            for k in np.flatnonzero((ids >= len(self.pieces)).any(axis=1)).tolist():  # a character that is no piece: its bytes
                out[owners[k]] = array("i", self.encode_unit(units[owners[k]])).tobytes()
        return out

    def _merge(self, symbols: np.ndarray) -> np.ndarray:
        """Each row's symbols after all merges, -1 where one has been swallowed. Changes ``symbols``.

        ``rank`` is the agenda: an entry for each symbol and its next one. Every step takes each row's best entry, the
        leftmost on ties, merges that pair and renews the two entries that it touches.
        """
        n, width = symbols.shape
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self._ranks(symbols[:, :-1], symbols[:, 1:])
        follow = np.tile(np.arange(1, width + 1), (n, 1)).ravel()  # where the next symbol starts
        before = np.tile(np.arange(-1, width - 1), (n, 1)).ravel()
        symbol, entry = symbols.ravel(), rank.ravel()
        rows = np.arange(n)
        while len(rows):
            best = rank[rows].argmin(axis=1)
            at = rows * width + best
            found = entry[at]
            some = found != NONE
            rows, at, best, found = rows[some], at[some], best[some], found[some]
            base = rows * width
            swallowed = base + follow[at]
            after = follow[swallowed]
            symbol[at], symbol[swallowed], entry[swallowed] = self.piece_at[found], -1, NONE
            follow[at] = after
            entry[at] = NONE
            i = np.flatnonzero(after < width)
            behind = base[i] + after[i]
            before[behind] = best[i]
            entry[at[i]] = self._ranks(symbol[at[i]], symbol[behind])
            i = np.flatnonzero(before[at] >= 0)
            ahead = base[i] + before[at[i]]
            entry[ahead] = self._ranks(symbol[ahead], symbol[at[i]])
        return symbols

    def units(self, text: str) -> list[str]:
        """The library's view of a text: a space put before it, spaces escaped; nothing for an empty text."""
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.encode_unit(u)]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    def check(self, units: list[str], ids: list[bytes]) -> None:
        """Compare with the library, which sees CHECKED units in a text, each behind a character that merges with none."""
        mark = array("i", map(self.byte_ids.__getitem__, self.between.encode())).tobytes()
        head = array("i", self.library.encode(self.between)).tobytes()  # with the space that the library puts before a text
        parts = [slice(i, i + CHECKED) for i in range(0, len(units), CHECKED)]
        told = self.library.encode([self.between + self.between.join(units[p]) for p in parts], num_threads=1)
        for p, x in zip(parts, told):
            if array("i", x).tobytes() != head + mark.join(ids[p]):
                raise ValueError(f"the agenda and the library encode one of {units[p]!r} differently")


def load_model(path: str) -> PieceModel:
    return held(("pieces", path), lambda: PieceModel(path))


class Units(dict):
    """unit -> its ids as packed int32; two generations, bounded in bytes."""

    def __init__(self, model: PieceModel, limit: int = CACHE_BYTES):
        super().__init__()
        self.model, self.limit, self.used, self.old = model, limit, 0, {}

    def learn(self, units: set[str]) -> None:
        """Hold all these units, at least until the next call; new ones are encoded and checked against the library."""
        if self.used > self.limit:
            self.old = dict(self)
            self.clear()
            self.used = 0
        fresh = []
        for u in units.difference(self):
            x = self.old.get(u)
            if x is None:
                fresh.append(u)
            else:
                self[u] = x
                self.used += ENTRY_BYTES + 4 * len(u)
        ids = self.model.encode_units(fresh)
        self.model.check(fresh, ids)
        self.update(zip(fresh, ids))
        self.used += ENTRY_BYTES * len(fresh) + 6 * sum(map(len, fresh))


def load_units(path: str) -> Units:
    """One for each worker process while it runs this operator, so tasks find what earlier ones have learnt."""
    return held(("units", path), lambda: Units(load_model(path)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, ids_sha256, decoded_sha256): a row for each row of docs.

    ids are what the library gives without begin and end ids; null texts count as empty and have none. ``with_ids``
    false leaves the array out. Repeated rows are encoded alike; no other column is read. Bytes that aren't UTF-8 become
    U+FFFD first.
    """
    path = model or default_model()

    def make():
        m = load_model(path)
        cache = load_units(path)

        def work(texts, _):
            n_tokens, shas, decoded, lists = [], [], [], []
            split = [m.units(t.decode("utf-8", "replace")) for t in texts]
            cache.learn(set(chain.from_iterable(split)))
            for units in split:
                ids = np.frombuffer(b"".join(map(cache.__getitem__, units)), np.int32)
                numbers = ids.tolist()
                n_tokens.append(len(numbers))
                shas.append(hashlib.sha256(",".join(map(m.names.__getitem__, numbers)).encode()).hexdigest())
                decoded.append(hashlib.sha256(m.decode(numbers).encode()).hexdigest())
                if with_ids:
                    lists.append(ids)
            return ({"ids": lists} if with_ids else {}) | {"n_tokens": np.array(n_tokens, np.int64), "ids_sha256": shas, "decoded_sha256": decoded}

        return work

    fields = ("ids array<int>, " if with_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, {"doc_id": f"`{id_col}`"}, fields, make, text_col)


def decode(encoded: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", model: str | None = None) -> DataFrame:
    """(doc_id, text): the texts behind arrays of ids; null arrays give empty texts."""
    import pyarrow as pa

    path = model or default_model()
    ship(encoded.sparkSession)
    rows = encoded.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids")

    def run(batches):
        m = begin_task(lambda: load_model(path))
        for batch in batches:
            texts = [m.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
