"""Fill-in-middle transformation: cut points at line ends found by a parallel automaton scan.

An automaton over bytes knows whether the next character begins a unit (a line with its end, or a last line without)
and how much of a sentinel has been read. A piece of text, whatever stands before it, is a function from the state at
its start to the state at its end, and a count of the units that begin in it for each state at its start. Functions of
neighbours compose associatively, so a balanced tree of them gives the whole text's function; walking down from its root
with the start state selects the place where the k-th unit begins.

A text of one chunk is scanned where it is read. Longer ones are dealt over the cluster in chunks: tasks emit the chunks'
functions, these compose to a tree for each text (of at most 2 GB, the limit of a value, so 32,768 functions), the tree
tells which chunk holds a cut and in which state it is entered, and tasks select the places within those chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.arrow import SLICE_BYTES
from orefield.session import materialize, ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK_BYTES = 1 << 16
SALT = 7
#: Per cent of texts that are transformed, and per cent of these that get their suffix first.
RATE, SUFFIX_FIRST = 100, 50

# Symbols. A run of OTHER acts like a single one, so only its first byte is kept.
OTHER, NEWLINE, OPEN, LETTER, CLOSE = range(5)
SYMBOL = bytes({10: NEWLINE, 60: OPEN, 80: LETTER, 83: LETTER, 77: LETTER, 62: CLOSE}.get(b, OTHER) for b in range(256))
# A state is 2 * (characters of a sentinel read; 3: one was found, for good) + (0 at a unit's begin, 1 within it).
STATES = 8
FOUND = 3


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The next state and the units that begin, by symbol and state."""
    step = np.zeros((5, STATES), np.uint8)
    for symbol in range(5):
        for state in range(STATES):
            read = state >> 1
            if read != FOUND:
                if symbol == OPEN:
                    read = 1
                elif (read, symbol) in ((1, LETTER), (2, CLOSE)):
                    read += 1
                else:
                    read = 0
            step[symbol, state] = 2 * read + (symbol != NEWLINE)
    begins = np.tile(1 - (np.arange(STATES) & 1), (5, 1))
    return step, begins.astype(np.int64)


STEP, BEGINS = _tables()


class Tree:
    """The composition tree over a sequence of functions: states (m, STATES) and counts (m, STATES) by start state."""

    def __init__(self, states: np.ndarray, counts: np.ndarray):
        self.levels = [(states, counts)]
        while len(states) > 1:
            if len(states) & 1:  # an identity at the end
                states = np.concatenate([states, np.arange(STATES, dtype=np.uint8)[None]])
                counts = np.concatenate([counts, np.zeros((1, STATES), np.int64)])
                self.levels[-1] = states, counts
            first, then, row = states[::2], states[1::2], np.arange(len(states) // 2)[:, None]
            counts = counts[::2] + counts[1::2][row, first]
            states = then[row, first]
            self.levels.append((states, counts))

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """End state and count of the whole sequence by start state; an empty sequence is the identity."""
        states, counts = self.levels[-1]
        return (states[0], counts[0]) if len(states) else (np.arange(STATES, dtype=np.uint8), np.zeros(STATES, np.int64))

    def select(self, k: int, state: int = 0) -> tuple[int, int, int]:
        """(item, state at its start, units of it before) for the item in which the k-th unit from 0 begins."""
        item = 0
        for states, counts in self.levels[-2::-1]:
            item *= 2
            own = counts[item, state]
            if k >= own:
                k -= own
                state = states[item, state]
                item += 1
        return item, int(state), int(k)


class Scan:
    """A piece of text under the automaton."""

    def __init__(self, data: bytes):
        symbols = np.frombuffer(data.translate(SYMBOL), np.uint8)
        kept = symbols != OTHER
        kept[1:] |= symbols[:-1] != OTHER
        kept[:1] = True
        self.data, self.at = data, np.flatnonzero(kept)
        self.tree = Tree(STEP[symbols[self.at]], BEGINS[symbols[self.at]])

    def chars_before(self, k: int, state: int = 0) -> int:
        """Code points before the k-th unit that begins in this piece."""
        return code_points(self.data[: int(self.at[self.tree.select(k, state)[0]])])


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def found(states: np.ndarray) -> bool:
    """Whether a text with this function holds a sentinel."""
    return int(states[0]) >> 1 == FOUND


def targets(draw: tuple[int, int], n: int) -> tuple[int, int]:
    """The units after which prefix and middle end."""
    a, b = (x % (n + 1) for x in draw)
    return min(a, b), max(a, b)


def _draws(id_col: Column, salt: int) -> list[Column]:
    """Four numbers from the id alone; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


CUTS = "n long, marked boolean, cut1 long, cut2 long"


def _cut_short(rows: DataFrame) -> DataFrame:
    """rows (columns, t, h1, h2) and n, marked and the code points before each cut, text by text."""
    place = {c: i for i, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(place["t"])), dtype=np.int64)
            start = 0
            while start < len(batch):
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SLICE_BYTES, side="right")))
                part = batch.slice(start, stop - start)
                start = stop
                made: list[list] = [[], [], [], []]
                texts = part.column(place["t"]).cast(pa.binary()).to_pylist()
                for text, h1, h2 in zip(texts, part.column(place["h1"]).to_pylist(), part.column(place["h2"]).to_pylist()):
                    scan = Scan(text or b"")
                    states, counts = scan.tree.whole()
                    n = int(counts[0])
                    ends = [scan.chars_before(k) if k < n else code_points(scan.data) for k in targets((h1, h2), n)]
                    for column, value in zip(made, (n, found(states), *ends)):
                        column.append(value)
                new = [pa.array(x, kind) for x, kind in zip(made, (pa.int64(), pa.bool_(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "n", "marked", "cut1", "cut2"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {CUTS}")


def _cut_long(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """The same for texts of several chunks, which tasks share. Rows that repeat id and text are cut alike."""
    rows = rows.withColumn("rev", F.sha2("t", 256))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                text = one.column(0).cast(pa.binary())[0].as_py()
                own = [one.column(k).take(pa.array([0])) for k in range(1, 5)]
                for c, start in enumerate(range(0, len(text), chunk_bytes)):
                    piece = [pa.array([c], pa.int64()), pa.array([text[start : start + chunk_bytes]], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*own, *piece], names=["row", "rev", "h1", "h2", "chunk", "piece"])

    numbered = rows.select("t", F.monotonically_increasing_id().alias("row"), "rev", "h1", "h2")
    pieces = numbered.mapInArrow(deal, "row long, rev string, h1 long, h2 long, chunk long, piece binary")
    pieces = materialize(pieces.repartition("row", "chunk"), "pieces")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], []]
            for piece in batch.column(5):
                data = piece.as_py()
                states, counts = Scan(data).tree.whole()
                for column, value in zip(made, (code_points(data), states.tolist(), counts.tolist())):
                    column.append(value)
            new = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.list_(pa.int32())), pa.array(made[2], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *new], names=["row", "rev", "h1", "h2", "chunk", "chars", "states", "counts"])

    emitted = pieces.mapInArrow(functions, "row long, rev string, h1 long, h2 long, chunk long, chars long, states array<int>, counts array<long>")

    def resolve(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("chunk")
        tree = Tree(np.array(group["states"].to_pylist(), np.uint8), np.array(group["counts"].to_pylist(), np.int64))
        states, counts = tree.whole()
        n, before = int(counts[0]), np.concatenate([[0], np.cumsum(group["chars"].to_numpy())])
        row, rev, h1, h2 = (group[c][0].as_py() for c in ("row", "rev", "h1", "h2"))
        out = []
        for cut, k in enumerate(targets((h1, h2), n)):
            chunk, state, rest = tree.select(k) if k < n else (len(group), 0, 0)
            out.append((row, rev, h1, h2, n, found(states), cut, chunk, state, rest, int(before[chunk])))
        names = ("row", "rev", "h1", "h2", "n", "marked", "cut", "chunk", "state", "k", "before")
        return pa.table([pa.array(x, pa.string() if c == "rev" else pa.bool_() if c == "marked" else pa.int64()) for c, x in zip(names, zip(*out))], names=list(names))

    wanted = emitted.groupBy("row").applyInArrow(resolve, "row long, rev string, h1 long, h2 long, n long, marked boolean, cut long, chunk long, state long, k long, before long")
    # A cut at a text's end lies in no chunk.
    held = wanted.join(pieces.select("row", "chunk", "piece"), ["row", "chunk"], "left")
    held = held.select("rev", "h1", "h2", "n", "marked", "cut", "state", "k", "before", "piece")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for state, k, before, piece in zip(*(batch.column(i) for i in range(6, 10))):
                inner = Scan(piece.as_py()).chars_before(k.as_py(), state.as_py()) if piece.is_valid else 0
                at.append(before.as_py() + inner)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(at, pa.int64())], names=["rev", "h1", "h2", "n", "marked", "cut", "at"])

    placed = held.mapInArrow(place, "rev string, h1 long, h2 long, n long, marked boolean, cut long, at long")
    one = lambda i: F.max(F.when(F.col("cut") == i, F.col("at"))).alias(f"cut{i + 1}")
    cuts = placed.groupBy("rev", "h1", "h2").agg(F.max("n").alias("n"), F.max("marked").alias("marked"), one(0), one(1))
    return rows.join(cuts, ["rev", "h1", "h2"]).drop("rev")


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: int = SALT, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """All columns of docs, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null: plain) and output.

    Null and empty texts, those that hold a sentinel and all beyond ``rate`` per cent are plain; the output of a null
    text is empty. Draws depend on the id alone, so rows of one id are drawn alike and a null id counts as an empty one.
    Rows of an empty table: none. Columns of docs that are named like the five new ones give way to them.
    """
    ship(docs.sparkSession)
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    names = [c for c in docs.columns if c not in new]
    h = _draws(F.col(f"`{id_col}`"), salt)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # The text goes to Python once, as t; whether it was null is kept beside it.
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col]
    rows = docs.select(*own, F.col(f"`{text_col}`").isNull().alias("gone"), text.alias("t"), *(x.alias(f"h{i + 1}") for i, x in enumerate(h)))
    short = _cut_short(rows.where(F.octet_length("t") <= chunk_bytes))
    long = _cut_long(rows.where(F.octet_length("t") > chunk_bytes), chunk_bytes)
    cut = short.unionByName(long)
    plain = (F.col("t") == "") | F.col("marked") | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    cut = cut.withColumn("form", form).withColumn("middle", F.col("cut2") - F.col("cut1"))
    whole = F.col("t")
    prefix = whole.substr(F.lit(1), F.col("cut1").cast("int"))
    middle = whole.substr((F.col("cut1") + 1).cast("int"), F.col("middle").cast("int"))
    suffix = whole.substr((F.col("cut2") + 1).cast("int"), F.length(whole))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    kept = [(F.when(F.col("gone"), None).otherwise(whole) if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)]
    return cut.select(
        *kept,
        "n",
        "form",
        F.when(F.col("form") != "plain", F.col("cut1")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("middle")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(whole).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form; exact, as the parts hold no sentinel."""
    part = lambda i: F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
