"""An inverted file over vectors: rows in cells around centroids, and searches that read only the cells near a query.

Centroids come from a bounded sample by rounds of sums and counts, all in integers, so that they depend on the rows and
neither on their order nor on how sums are merged. Every row is in the index. The number of cells to read is taken from
the recall that a sample of queries would have at each number, against the exact search; the exact way stays
``retrieval.vector_topk``. A filtered search looks at the cells' tag counts to decide for each query whether it filters
what an unfiltered search finds or searches the rows of the tag alone, and how many cells that takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.operators.nearest import Nearest
from orefield.operators.retrieval import BLOCK_NUMBERS, TILE_QUERIES, TILE_ROWS, rank, vector_topk
from orefield.session import materialize, scratch_path, ship

#: Unit vectors times this are cut to integers for the cells' sums and distances; scores are taken from the vectors.
GRID = 1 << 16
#: Centroids are fitted on about so many rows at most, and there are at most so many of them.
FIT_ROWS, MOST_CELLS = 1 << 18, 1 << 16
ROUNDS = 5
#: Queries on which the number of cells is settled.
PROBE_QUERIES = 256
#: The nearest cells among which a filtered search looks for rows of its tag.
REACH = 1024


@dataclass
class VectorIndex:
    """rows (id, v, tag, cell) lie in a folder for each cell; counts (cell, tag, n); centroids are on the grid."""

    rows: DataFrame
    counts: DataFrame
    centroids: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centroids)


def grid(lists: pa.Array, size: int) -> np.ndarray:
    v = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), size)
    norm = np.sqrt((v * v).sum(axis=1))[:, None]
    return np.floor(np.divide(v, norm, out=np.zeros_like(v), where=norm > 0) * GRID)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances less the vectors' own squares; whole numbers, exact as doubles."""
    return (centroids * centroids).sum(axis=1)[None, :] - 2 * (x @ centroids.T)


def _by_order(c: Column) -> list[Column]:
    return [F.md5(c.cast("string").cast("binary")), c]


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (id, v, tag) and their cell."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), TILE_ROWS):
                part = batch.slice(start, TILE_ROWS)
                cell = _distances(_checked(part.column(1), size), centroids).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], names=[*part.schema.names, "cell"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, cell int")


def _checked(lists: pa.Array, size: int) -> np.ndarray:
    if len(lists) and (np.diff(np.asarray(lists.offsets)) != size).any():
        raise ValueError(f"every vector needs {size} numbers")
    return grid(lists, size)


def _fit(sample: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd's rounds; a task sends one sum for each cell, an empty cell keeps its centroid."""
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
            for batch in batches:
                for start in range(0, len(batch), TILE_ROWS):
                    x = _checked(batch.column(1).slice(start, TILE_ROWS), centroids.shape[1])
                    cell = _distances(x, centroids).argmin(axis=1)
                    np.add.at(total, cell, x.astype(np.int64))
                    n += np.bincount(cell, minlength=len(n))
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit]), pa.array(total[hit].tolist(), pa.list_(pa.int64()))], names=["cell", "n", "total"])

        # Sums of a sample of bounded size: its tasks, and so these rows, are bounded too.
        made = sample.mapInArrow(sums, "cell long, n long, total array<long>").toArrow()
        total, n = np.zeros(centroids.shape), np.zeros(len(centroids))
        if made.num_rows:
            cell = made["cell"].to_numpy()
            np.add.at(total, cell, np.array(made["total"].to_pylist(), dtype=np.float64))
            np.add.at(n, cell, made["n"].to_numpy())
        centroids = np.where(n[:, None] > 0, np.floor(total / np.maximum(n, 1)[:, None]), centroids)
    return centroids


def build(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", tag_col: str | None = None, cells: int | None = None, rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> VectorIndex:
    """Index every row; ``cells`` defaults to the root of their number.

    Null and empty vectors and those with a null number are left out; vectors that differ in length are an error; a zero
    vector lies in the cell whose centroid is nearest to zero. A null tag is a tag that no query asks for. The rows of a
    cell, however many, are split over files by their ids. An empty table gives an index without rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    tag = F.col(f"`{tag_col}`").cast("string") if tag_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), tag.alias("tag")).where("v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    n = rows.count()
    cells = min(cells or max(1, int(n**0.5)), MOST_CELLS)
    first = rows.orderBy(*_by_order(F.col("id"))).limit(cells).select("v").toArrow()["v"].combine_chunks()
    size = len(first[0]) if len(first) else 1
    centroids = _checked(first, size) if len(first) else np.zeros((1, size))
    sample = rows
    if n > fit_rows:
        sample = rows.where(F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") < F.lit(int(fit_rows / n * 2**32)))
    centroids = _fit(materialize(sample, "sample"), centroids, rounds)
    path = scratch_path(spark, "cells")
    placed = _assigned(rows, centroids)
    # Ranges of (cell, hash of the id): a cell that holds a third of all rows is several ranges, each a task and a file.
    placed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.partitionBy("cell").parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    counts = materialize(stored.groupBy("cell", "tag").agg(F.count("*").alias("n")), "counts")
    return VectorIndex(stored, counts, centroids)


def nearest_cells(index: VectorIndex, queries: DataFrame, most: int | None = None, query_id: str = "query_id", vector: str = "embedding", tag: str | None = None) -> DataFrame:
    """(query_id, v, want, cells): the ``most`` cells of the nearest centroids of each query, nearest first."""
    centroids, size = index.centroids, index.centroids.shape[1]
    most = min(most or len(centroids), len(centroids))
    want = F.col(tag).cast("string") if tag else F.lit(None).cast("string")
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"), want.alias("want")).where("v is not null and size(v) > 0 and not exists(v, x -> x is null)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), TILE_QUERIES):
                part = batch.slice(start, TILE_QUERIES)
                near = np.argsort(_distances(_checked(part.column(1), size), centroids), axis=1, kind="stable")[:, :most]
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, most, dtype=np.int32)), pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], names=[*part.schema.names, "cells"])

    return asked.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, v array<double>, want string, cells array<int>")


def scan(index: VectorIndex, probes: DataFrame, k: int, filtered: bool = False, tags: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows by cosine in each query's cells; ``filtered``: only rows of its tag.

    With ``tags``, a column tag of the rows found.
    probes (query_id, v, want, cells) are sent to the tasks in blocks of bounded size, each one pass over those cells'
    folders that a query of the block names. Ties go to the smaller id; a zero query finds nothing.
    """
    kind = probes.schema["query_id"].dataType.simpleString()
    probes = materialize(probes, "probes")
    n, size = probes.agg(F.count("*"), F.max(F.size("v") + F.size("cells"))).first()
    blocks = 1 + n * (size or 1) // BLOCK_NUMBERS
    out = None
    for b in range(blocks):
        part = (probes if blocks == 1 else probes.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        ids = part["query_id"].combine_chunks() if part.num_rows else pa.array([], part["query_id"].type)
        q = np.array(part["v"].to_pylist(), dtype=np.float64).reshape(len(ids), -1 if len(ids) else 0)
        norm = np.sqrt((q * q).sum(axis=1))
        asked = part["cells"].to_pylist()
        who = np.repeat(np.arange(len(ids)), [len(c) for c in asked])
        where = np.array([c for cells in asked for c in cells], np.int64)
        who = who[(order := np.argsort(where, kind="stable"))]
        cells, starts = np.unique(where[order], return_index=True)
        of_cell = {int(c): x for c, x in zip(cells, np.split(who, starts[1:])) if len(x)}
        want = np.array(part["want"].to_pylist(), dtype=object)

        def run(batches: Iterator[pa.RecordBatch], q=q, norm=norm, ids=ids, of_cell=of_cell, want=want) -> Iterator[pa.RecordBatch]:
            best = Nearest(len(q), k)
            for batch in batches:
                cell = np.asarray(batch.column(3))
                edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]]) if len(cell) else np.zeros(1, np.int64)
                for lo, hi in zip(edges[:-1], edges[1:]):
                    for r in range(lo, hi, TILE_ROWS):
                        asking = of_cell.get(int(cell[lo]))
                        if asking is None:
                            continue
                        part = batch.slice(r, min(TILE_ROWS, hi - r))
                        v = np.asarray(part.column(1).flatten()).reshape(len(part), -1)
                        length = np.sqrt((v * v).sum(axis=1))
                        own, tags = np.asarray(part.column(0)), np.array(part.column(2).to_pylist(), dtype=object)
                        for c in range(0, len(asking), TILE_QUERIES):
                            some = asking[c : c + TILE_QUERIES]
                            score, lengths = q[some] @ v.T, norm[some, None] * length[None, :]
                            score = np.divide(score, lengths, out=np.zeros_like(score), where=lengths != 0)
                            if filtered:
                                score[want[some][:, None] != tags[None, :]] = -np.inf
                            best.offer(some, score, own)
            which, found, value = best.rows()
            keep = norm[which] > 0
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which[keep])), pa.array(found[keep]), pa.array(value[keep])], names=["query_id", "id", "score"])

        rows = index.rows.select("id", "v", "tag", "cell")
        if len(of_cell) < index.cells:  # prunes folders
            rows = rows.where(F.col("cell").isin([int(c) for c in of_cell]))
        found = rows.mapInArrow(run, f"query_id {kind}, id long, score double")
        out = found if out is None else out.unionByName(found)
    best = rank(out, F.desc("score"), F.col("id")).where(F.col("rank") <= k)
    return best.join(index.rows.select("id", "tag"), "id") if tags else best


def settle_probes(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.95, sample: int = PROBE_QUERIES, query_id: str = "query_id", vector: str = "embedding") -> int:
    """The smallest number of cells that holds ``target`` of the exact k nearest rows of a sample of the queries.

    One exact search tells the recall at every number: a result is found if its cell is among the first ones.
    """
    some = materialize(queries.orderBy(*_by_order(F.col(query_id))).limit(sample).select(F.col(query_id).alias("query_id"), F.col(vector).alias("embedding")), "settle")
    exact = vector_topk(some, index.rows, k, vector="embedding", corpus_vector="v")
    near = nearest_cells(index, some).select("query_id", F.posexplode("cells").alias("place", "cell"))
    held = exact.select("query_id", "id").join(index.rows.select("id", "cell"), "id").join(near, ["query_id", "cell"])
    share = held.groupBy("place").count().toArrow()  # a row for each cell at most
    if not share.num_rows:
        return index.cells
    order = np.argsort(share["place"].to_numpy())
    up = np.cumsum(share["count"].to_numpy()[order])
    return int(share["place"].to_numpy()[order][np.searchsorted(up, target * up[-1] - 1e-9)]) + 1


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the nearest rows among the ``probes`` cells nearest to each query."""
    return scan(index, nearest_cells(index, queries, probes, query_id, vector), k)


def recall(index: VectorIndex, queries: DataFrame, k: int, probes: int, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """One row (n_queries, recall, rows_read): of all queries, against the exact search; rows_read is the share scored."""
    exact = vector_topk(queries, index.rows, k, query_id=query_id, vector=vector, corpus_vector="v").select("query_id", "id")
    found = search(index, queries, k, probes, query_id, vector).select("query_id", "id", F.lit(1).alias("hit"))
    hits = exact.join(found, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    size = index.counts.groupBy("cell").agg(F.sum("n").alias("n"))
    read = nearest_cells(index, queries, probes, query_id, vector).select("query_id", F.explode("cells").alias("cell")).join(size, "cell")
    share = read.agg(F.sum("n").alias("read"), F.countDistinct("query_id").alias("asked"))
    total = index.counts.agg(F.sum("n").alias("rows"))
    # One row each.
    return hits.crossJoin(share).crossJoin(total).select("n_queries", "recall", (F.col("read") / (F.col("asked") * F.col("rows"))).alias("rows_read"))


def plan_filter(
    index: VectorIndex, queries: DataFrame, k: int, ef: int, probes: int, query_id: str = "query_id", vector: str = "embedding", tag: str = "tag", reach: int = REACH
) -> DataFrame:
    """(query_id, v, want, post_cells, pre_cells, mode): how each query is best filtered, from the cells' tag counts alone.

    post_cells are its ``probes`` nearest; mode is post if the ef best rows of these can be expected to hold twice k of
    its tag, else pre. pre_cells hold rows of the tag: those of the nearest ones, and further ones until ef such rows are
    at hand, among the ``reach`` nearest cells.
    """
    near = nearest_cells(index, queries, reach, query_id, vector, tag)
    steps = near.select("query_id", "want", F.posexplode("cells").alias("place", "cell"))
    all_rows = index.counts.groupBy("cell").agg(F.sum("n").alias("all"))
    own = index.counts.where(F.col("tag").isNotNull()).select("cell", F.col("tag").alias("want"), F.col("n").alias("own"))
    steps = steps.join(all_rows, "cell", "left").join(own, ["cell", "want"], "left").na.fill(0, ["all", "own"])
    steps = steps.withColumn("before", F.sum("own").over(Window.partitionBy("query_id").orderBy("place")) - F.col("own"))
    first = F.col("place") < probes
    pre = (F.col("own") > 0) & (first | (F.col("before") < ef))
    need = steps.groupBy("query_id").agg(
        F.sum(F.when(first, F.col("own"))).alias("tagged"),
        F.sum(F.when(first, F.col("all"))).alias("seen"),
        F.sort_array(F.collect_list(F.when(pre, F.struct("place", "cell")))).alias("pre"),
    )
    mode = F.when(F.col("tagged") * ef >= 2 * k * F.col("seen"), "post").otherwise("pre")
    out = near.join(need, "query_id").withColumn("mode", mode).withColumn("pre_cells", F.col("pre.cell"))
    return out.select("query_id", "v", "want", F.slice("cells", 1, probes).alias("post_cells"), "pre_cells", "mode")


def filtered_search(index: VectorIndex, plan: DataFrame, k: int, ef: int, mode: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of each query's tag, by its planned mode or all by ``mode``."""
    plan = materialize(plan if mode is None else plan.withColumn("mode", F.lit(mode)), "plan")
    asked = lambda kind: plan.where(F.col("mode") == kind).select("query_id", "v", "want", F.col(f"{kind}_cells").alias("cells"))
    pre = scan(index, asked("pre"), k, filtered=True)
    wide = scan(index, asked("post"), ef, tags=True).drop("rank")
    kept = wide.join(plan.select("query_id", "want"), "query_id").where("tag = want").select("query_id", "id", "score")
    post = rank(kept, F.desc("score"), F.col("id")).where(F.col("rank") <= k)
    return pre.unionByName(post)


def filter_recall(index: VectorIndex, queries: DataFrame, k: int, ef: int, probes: int, query_id: str = "query_id", vector: str = "embedding", tag: str = "tag") -> DataFrame:
    """(query_id, selectivity, mode, pre_recall, post_recall, recall_delta): both ways of filtering, through the index.

    Both are measured against the exact nearest rows of the tag, for which all cells are read; 1 where there are none.
    selectivity is the tag's share of all rows in per cent.
    """
    plan = materialize(plan_filter(index, queries, k, ef, probes, query_id, vector, tag), "plan")
    every = nearest_cells(index, queries, None, query_id, vector, tag)
    exact = materialize(scan(index, every, k, filtered=True).select("query_id", "id"), "exact")
    out = plan.select("query_id", "want", "mode").join(exact.groupBy("query_id").agg(F.count("*").alias("n_exact")), "query_id", "left")
    for mode in ("pre", "post"):
        hits = filtered_search(index, plan, k, ef, mode).join(exact, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias(f"n_{mode}"))
        out = out.join(hits, "query_id", "left")
    share = index.counts.where(F.col("tag").isNotNull()).groupBy(F.col("tag").alias("want")).agg(F.sum("n").alias("n"))
    total = index.counts.agg(F.sum("n")).first()[0] or 1
    out = out.join(share, "want", "left")
    recall = lambda mode: F.when(F.coalesce("n_exact", F.lit(0)) == 0, 1.0).otherwise(F.coalesce(f"n_{mode}", F.lit(0)) / F.col("n_exact"))
    return out.select(
        "query_id",
        (100.0 * F.coalesce("n", F.lit(0)) / F.lit(total)).alias("selectivity"),
        "mode",
        recall("pre").alias("pre_recall"),
        recall("post").alias("post_recall"),
        (recall("pre") - recall("post")).alias("recall_delta"),
    )
