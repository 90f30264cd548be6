"""The k texts that share most words with each query, without counting all pairs that share one.

The k-th best overlap so far bounds what can still matter: a text that reaches c of a query's n words holds, for any i up
to c, at least i of its n - c + i rarest words. So texts are first counted on a query's rarest words alone, which few
texts hold, and only those that pass are compared in full. A bound to begin with comes from the longest texts, and each
task raises its own. Queries go to the tasks in blocks of bounded size, each one pass over the texts and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.operators.nearest import Nearest
from orefield.session import ship

#: The words of ``functions.text.WORD``, which takes several times as long over whole texts.
WORD = re.compile(r"\w+")
#: Queries go to every task in blocks of about this many words.
BLOCK_WORDS = 1 << 20
#: The longest texts, compared with all queries for the first bound.
SEEDS = 256
#: A text passes if it holds this many (fewer, where the bound is lower) of the rarest words.
LEAST_SHARED = 3
#: Texts and words that a tile's table holds.
TILE_CELLS = 1 << 22
#: (full comparisons, pairs of a text and one of a query's rarest words), where a caller wants to know them.
Counters = tuple[Accumulator, Accumulator]


class Overlap:
    """Queries as lists of distinct words, with their running k best texts; scores are numbers of shared words."""

    def __init__(self, words: pa.Array, k: int, bound: np.ndarray | None = None):
        flat = words.flatten()
        vocabulary = flat.unique()
        self.place = {w: i for i, w in enumerate(vocabulary.to_pylist())}
        sizes = np.diff(np.asarray(words.offsets))
        self.n = len(sizes)
        self.code = np.asarray(pc.index_in(flat, vocabulary), dtype=np.int64) if len(flat) else np.zeros(0, np.int64)
        self.query = np.repeat(np.arange(self.n), sizes)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.bound = np.zeros(self.n, np.int64) if bound is None else bound
        self.best = Nearest(self.n, k)
        self.compared = self.met = 0

    def texts(self, ids: np.ndarray, texts: pa.Array) -> None:
        """Take in texts, tile by tile."""
        step = max(1, TILE_CELLS // max(1, len(self.place)))
        for start in range(0, len(ids), step):
            held = [[self.place[w] for w in self.place.keys() & WORD.findall(t.lower())] if t else [] for t in texts.slice(start, step).to_pylist()]
            text = np.repeat(np.arange(len(held)), [len(x) for x in held])
            self._tile(ids[start : start + step], text, np.fromiter(chain.from_iterable(held), np.int64, len(text)))

    def _tile(self, ids: np.ndarray, text: np.ndarray, code: np.ndarray) -> None:
        held = np.zeros((len(ids), len(self.place)), bool)
        held[text, code] = True
        frequency = held.sum(axis=0)
        live = frequency[self.code] > 0
        n_live = np.bincount(self.query[live], minlength=self.n)
        c = np.maximum(self.bound, np.maximum(self.best.score[:, -1], 1).astype(np.int64))
        need = np.minimum(LEAST_SHARED, c)
        rarest = np.where(n_live >= c, n_live - c + need, 0)
        # Each query's words that the tile holds, by frequency; its place in that order tells whether a word counts.
        q, w = self.query[live], self.code[live]
        order = np.lexsort((w, frequency[w], q))
        q, w = q[order], w[order]
        first = np.concatenate([[0], np.cumsum(n_live)])[:-1]
        counts = np.arange(len(q)) - first[q] < rarest[q]
        q, w = q[counts], w[counts]
        # Texts meet queries through these words only.
        order = np.argsort(w, kind="stable")
        q, w = q[order], w[order]
        lo, hi = np.searchsorted(w, code, "left"), np.searchsorted(w, code, "right")
        many = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)])[:-1], many) + np.arange(many.sum())
        pair, hits = np.unique(np.repeat(text, many) * self.n + q[at], return_counts=True)
        pair = pair[hits >= need[pair % self.n]]
        self.met += len(at)
        self.compared += len(pair)
        for some in np.array_split(pair, 1 + len(pair) // 65536):
            asking, row = some % self.n, some // self.n
            sizes = self.start[asking + 1] - self.start[asking]
            ends = np.cumsum(sizes)
            word = np.repeat(self.start[asking] - (ends - sizes), sizes) + np.arange(sizes.sum())
            shared = np.add.reduceat(held[np.repeat(row, sizes), self.code[word]].astype(np.int64), ends - sizes) if len(some) else np.zeros(0, np.int64)
            reach = shared >= c[asking]
            self.best.merge(asking[reach], shared[reach].astype(np.float64), ids[row[reach]])


def _scan(rows: DataFrame, asked: pa.Table, k: int, bound: np.ndarray | None, counters: Counters | None) -> DataFrame:
    """rows (id, t) -> each task's (q, id, shared), q the query's number in ``asked``."""
    words = asked["words"].combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Overlap(words, k, bound)
        for batch in batches:
            state.texts(np.asarray(batch.column(0)), batch.column(1))
        if counters:
            counters[0].add(state.compared)
            counters[1].add(state.met)
        q, found, shared = state.best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found), pa.array(shared.astype(np.int64))], names=["q", "id", "shared"])

    return rows.mapInArrow(run, "q long, id long, shared long")


def topk(queries: DataFrame, texts: DataFrame, k: int, counters: Counters | None = None) -> DataFrame:
    """queries (query_id, words), texts (id, t) -> (query_id, id, score): k or more of each query's best, by tasks' lists.

    score is the share of the query's distinct words; texts that share none don't appear. Null texts have no words and
    null words no matches; among equal shares a task keeps the smaller ids, so the best k by (score, id) are there.
    """
    ship(texts.sparkSession)
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", "words").where(F.size("words") > 0)
    total = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = 1 + total // BLOCK_WORDS
    rows = texts.where(F.col("id").isNotNull()).select("id", F.col("t").cast("string").alias("t"))
    longest = rows.orderBy(F.desc_nulls_last(F.octet_length("t")), "id").limit(SEEDS)
    longest = longest.repartition(texts.sparkSession.sparkContext.defaultParallelism, "id")
    out = None
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        bound = np.zeros(part.num_rows, np.int64)
        if part.num_rows:
            seeds = _scan(longest, part, k, None, counters).groupBy("q").agg(F.sort_array(F.collect_list("shared"), asc=False).alias("s")).where(F.size("s") >= k)
            for q, kth in seeds.select("q", F.get("s", F.lit(k - 1))).collect():  # a number for each query of the block
                bound[q] = kth
        found = _scan(rows, part, k, bound, counters)
        names = texts.sparkSession.createDataFrame(
            [(i, q, len(w)) for i, (q, w) in enumerate(zip(part["query_id"].to_pylist(), part["words"].to_pylist()))], f"q long, query_id {kind}, n long"
        )
        found = found.join(names, "q").select("query_id", "id", (F.col("shared") / F.col("n")).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out
