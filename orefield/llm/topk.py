"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Each task cuts its vectors into blocks and sorts every dimension of a block into a list. A tile of queries reads the lists
from the ends that its signs ask for, to growing depths; vectors seen for the first time in any list get their full
scores, and a query stops in a block as soon as its k-th score so far, which it brings along from earlier blocks, is
above the threshold: the score that a vector would have which stood just below the read part of every list. A tie could
still go to a smaller id, so an equal threshold doesn't stop. The task's k best of each query are merged by one window.

Queries are sent to the tasks in blocks of bounded size, each one pass over the vectors. Where the dimensions are many
and alike, as in the tables at hand, the threshold falls slowly and most vectors are seen: the result stays exact, the
work is then that of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.session import materialize, ship

SCALE = 256
#: Query vectors go to every task in blocks of about this many numbers.
BLOCK_NUMBERS = 4 << 20
#: Vectors that share lists, and queries that read them together.
LIST_ROWS, TILE_QUERIES = 4096, 256
#: Up to this, sums of products are exact as doubles; up to SMALL, as single floats.
EXACT, SMALL = 1 << 53, 1 << 24
LEAST = np.iinfo(np.int64).min


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); as Python integers where doubles don't hold the product."""
    if x.size == 0 or np.abs(x).max() < EXACT // SCALE:
        return np.floor(x * SCALE)
    whole = [int(v) * SCALE if abs(v) >= EXACT // SCALE else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(x.shape)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for integral a and b, exact, within the range of a long: beyond it, the nearest long."""
    most = max(map(abs, a.ravel().tolist()), default=0) * max(map(abs, b.ravel().tolist()), default=0) if object in (a.dtype, b.dtype) else np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most * max(1, a.shape[1]) < EXACT:
        kind = np.float32 if most * max(1, a.shape[1]) < SMALL else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    top = np.iinfo(np.int64).max
    return np.clip(exact(a) @ exact(b).T, -top, top).astype(np.int64)


class Best:
    """The k best of each query so far: scores, ids (null: has_id is 0) and rows; free places score LEAST."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LEAST)
        self.has_id, self.id, self.row = (np.zeros((n, k), np.int64) for _ in range(3))

    def least(self, q: np.ndarray) -> np.ndarray:
        return self.score[q, -1]

    def merge(self, q: np.ndarray, which: np.ndarray, score: np.ndarray, has_id: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates of the queries q[which]; ties go to the smaller id, null ids last, then to the smaller row."""
        old = np.repeat(np.arange(len(q)), self.k)
        of = np.concatenate([old, which])
        s, h, i, r = (np.concatenate([own[q].ravel(), new]) for own, new in ((self.score, score), (self.has_id, has_id), (self.id, ids), (self.row, rows)))
        order = np.lexsort((r, i, 1 - h, ~s, of))  # ~s falls where s rises, without overflow
        of = of[order]
        order = order[np.arange(len(of)) - np.searchsorted(of, of) < self.k]
        for own, x in ((self.score, s), (self.has_id, h), (self.id, i), (self.row, r)):
            own[q] = x[order].reshape(len(q), self.k)


class Lists:
    """A block of vectors with one sorted list for each dimension. Columns of a score matrix follow ids, so ties do too."""

    def __init__(self, vectors: np.ndarray, has_id: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.lexsort((rows, ids, 1 - has_id))
        self.vectors, self.has_id, self.id, self.row = vectors[order], has_id[order], ids[order], rows[order]
        self.rising = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.rising, axis=0)

    def threshold(self, q: np.ndarray, depth: int) -> np.ndarray:
        """For each query the most that a vector can score which none of its lists has shown in ``depth`` steps."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bound = np.concatenate([self.values[len(self.values) - 1 - depth], self.values[depth]])
        return product(np.concatenate([up, down], axis=1), bound[None])[:, 0]

    def shown(self, q: np.ndarray, depth: int) -> np.ndarray:
        """The vectors in the first ``depth`` steps of the lists, from the ends that the queries' signs ask for."""
        up, down = (q > 0).any(axis=0), (q < 0).any(axis=0)
        seen = np.zeros(len(self.vectors), bool)
        seen[self.rising[len(self.rising) - depth :, up]] = True
        seen[self.rising[:depth, down]] = True
        return seen

    def search(self, queries: np.ndarray, own_rows: np.ndarray, q: np.ndarray, best: Best) -> int:
        """Improve ``best`` of the queries numbered q; the number of scores that it took."""
        seen, scored, depth, n = np.zeros(len(self.vectors), bool), 0, 0, len(self.vectors)
        while len(q):
            if depth < n:
                q = q[best.least(q) <= self.threshold(queries[q], depth)]
                depth = min(n, max(4, 4 * depth))
                shown = self.shown(queries[q], depth) if depth < n else np.ones(n, bool)
            else:
                return scored
            if not len(q):
                return scored
            new = np.flatnonzero(shown & ~seen)
            seen |= shown
            scored += len(q) * len(new)
            if len(new):
                self._take(queries, own_rows, q, new, best)
        return scored

    def _take(self, queries: np.ndarray, own_rows: np.ndarray, q: np.ndarray, new: np.ndarray, best: Best) -> None:
        score = product(queries[q], self.vectors[new])
        wanted = (score >= best.least(q)[:, None]) & (own_rows[q][:, None] != self.row[new][None, :])
        k, m = best.k, len(new)
        if m > k and wanted.sum(axis=1).max() > 4 * k:
            # Of each query's wanted scores the k best, the earlier column first among equals.
            if np.abs(score).max() < EXACT // (2 * m):
                key = np.where(wanted, score * m + np.arange(m - 1, -1, -1), LEAST)
                wanted &= key >= np.partition(key, m - k, axis=1)[:, m - k, None]
            else:
                first = np.argsort(np.where(wanted, ~score, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
                few = np.zeros_like(wanted)
                np.put_along_axis(few, first, True, axis=1)
                wanted &= few
        which, at = np.nonzero(wanted)
        if len(which):
            best.merge(q, which, score[which, at], self.has_id[new][at], self.id[new][at], self.row[new][at])


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return integers(np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), size))


def _by_size(lists: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.diff(np.asarray(lists.offsets))
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def search(vectors: DataFrame, asked: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which ``asked`` holds, the k other rows of the highest scores.

    The score is the inner product of floor(256 * component), exact; beyond a long, the nearest long. Ties go to the
    smaller id, null ids last. Null vectors and those with a null or non-finite component take no part; vectors of other
    lengths than a query's aren't compared with it, and empty ones score 0 with each other. Rows are told apart even if
    they repeat: a copy of a query's row is a candidate, and each copy that is asked has k rows of its own. Fewer
    candidates: all of them; an empty table or nobody asked: none. Other columns are not read.
    """
    ship(vectors.sparkSession)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    table = materialize(rows.where(F.col("v").isNotNull() & ~odd), "vectors")
    wanted = table.where("asked").select("row", "id", "v")
    n, size = wanted.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = 1 + n * (size or 1) // BLOCK_NUMBERS
    found = None
    for b in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        made = _pass(table.select("row", "id", "v"), part.toArrow().combine_chunks(), k)
        found = made if found is None else found.unionByName(made)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(table: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """(query, query_id, row, vec_id, score): each task's k best of the queries in ``asked`` (row, id, v)."""
    query_rows, query_ids = asked["row"].to_numpy(), asked["id"]
    lists = asked["v"].combine_chunks() if asked.num_rows else pa.array([], pa.list_(pa.float64()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    tiles = [(size, at, _matrix(lists.take(pa.array(at)), size)) for size, at in _by_size(lists)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: Best(len(at), k) for size, at, _ in tiles}
        for batch in batches:
            for start in range(0, len(batch), LIST_ROWS):
                part = batch.slice(start, LIST_ROWS)
                own = part.column(2)
                where = dict(_by_size(own))
                for size, at, queries in tiles:
                    mine = where.get(size)
                    if mine is None:
                        continue
                    ids = part.column(1).take(pa.array(mine))
                    block = Lists(
                        _matrix(own.take(pa.array(mine)), size),
                        np.asarray(ids.is_valid()).astype(np.int64),
                        np.asarray(ids.fill_null(0), dtype=np.int64),
                        np.asarray(part.column(0).take(pa.array(mine)), dtype=np.int64),
                    )
                    for c in range(0, len(at), TILE_QUERIES):
                        block.search(queries, query_rows[at], np.arange(c, min(c + TILE_QUERIES, len(at))), best[size])
        for size, at, _ in tiles:
            b = best[size]
            q, place = np.nonzero(b.score != LEAST)
            ids = pa.array(b.id[q, place], mask=b.has_id[q, place] == 0)
            number = pa.array(at[q])
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_rows[at[q]]), query_ids.take(number).combine_chunks(), pa.array(b.row[q, place]), ids, pa.array(b.score[q, place])],
                names=["query", "query_id", "row", "vec_id", "score"],
            )

    return table.mapInArrow(run, "query long, query_id long, row long, vec_id long, score long")
