"""Merkle manifest of a table: a digest for each row, a tree for each source, one root, and a proof for each row.

Leaves get their place in their source's order from a range partitioning: the running number within a partition plus the
leaves of the same source in earlier ones, so no source is ever in one task. Every 16 consecutive nodes have their hash
as parent. Blocks of 256 leaves that begin at multiples of 256 are whole subtrees: a task walks such a block recursively
in postorder, returns the subtree's digest and, while it unwinds, appends to each leaf below the siblings of its path.
The blocks' roots are the leaves of the next such traversal, over a table of 1/256 of the size, until each source has
one root; then the sources' roots are traversed alike. The way down hands each block its own siblings above.

The way up keeps only the digests, and blocks are walked again on the way down, as a leaf's siblings are far larger
than the leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.session import materialize, ship

FAN_OUT = 16
#: Levels that a block spans.
BLOCK_LEVELS = 2
BLOCK = FAN_OUT**BLOCK_LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before:string,after:string>>"


def leaf(values: list[Column]) -> Column:
    """sha256, as hex, of the values' UTF-8 texts, each after its byte count and a colon; a null is a dash."""
    text = (v.cast("string") for v in values)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest gives with its proof."""
    return F.aggregate(proof, digest, lambda own, step: F.sha2(F.concat(step["before"], own, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings, from the leaf to the root and from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN_OUT), levels + 1
    return levels


def walk(digests: list[str], levels: int, paths: list[list[tuple[str, str]]] | None = None, first: int = 0, last: int | None = None) -> str:
    """The digest of the subtree of so many levels over digests[first:last]; its leaves' paths grow from below."""
    last = len(digests) if last is None else last
    if not levels:
        return digests[first]
    width = FAN_OUT ** (levels - 1)
    starts = range(first, last, width)
    below = [walk(digests, levels - 1, paths, s, min(s + width, last)) for s in starts]
    if paths is not None:
        for i, s in enumerate(starts):
            step = "".join(below[:i]), "".join(below[i + 1 :])
            for path in paths[s : min(s + width, last)]:
                path.append(step)
    return hashlib.sha256("".join(below).encode()).hexdigest()


def _numbered(rows: DataFrame, order: list[Column], own: list[str]) -> DataFrame:
    """rows (tree, digest, own...) as (tree, n, pos, digest, own): places in each tree's order, and its size."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    # The upper bits of such a number are the partition, the lower 33 the row's number in it.
    placed = materialize(ranged.select("tree", "digest", *own, F.monotonically_increasing_id().alias("serial")).withColumn("part", F.shiftright("serial", 33)), "leaves")
    counts = placed.groupBy("tree", "part").agg(F.min("serial").alias("first"), F.count("*").alias("rows"))
    # A row for each partition that holds leaves of the tree; a partition's number bounds them, not the leaves'.
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part")) - F.col("rows")
    starts = counts.select("tree", "part", (F.col("first") - before).alias("zero"), F.sum("rows").over(tree).alias("n"))
    return placed.join(starts, ["tree", "part"]).select("tree", "n", (F.col("serial") - F.col("zero")).alias("pos"), "digest", *own)


def _blocks(nodes: DataFrame, own: list[str]) -> DataFrame:
    """A row for each block: (tree, block, n, nodes, root), nodes in order; at most BLOCK of them."""
    item = F.struct("pos", "digest", *own)
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(item)).alias("nodes"))
    kind = rows.schema["nodes"].dataType.simpleString()

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            digests = batch.column(4)
            for n, own_digests in zip(batch.column(2).to_pylist(), digests.to_pylist()):
                roots.append(walk(own_digests, BLOCK_LEVELS if n > BLOCK else height(n)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(roots, pa.string())], names=["tree", "block", "n", "nodes", "root"])

    rows = rows.withColumn("digests", F.col("nodes.digest"))
    return materialize(rows.mapInArrow(up, f"tree string, block long, n long, nodes {kind}, root string"), "blocks")


def _down(blocks: DataFrame, above: DataFrame, own: list[str]) -> DataFrame:
    """(tree, pos, digest, own, subroot, root, proof) of all nodes; above (tree, block, subroot, root, proof) is for blocks."""
    rows = blocks.select("tree", "block", "n", "nodes").join(above.withColumnRenamed("proof", "upper"), ["tree", "block"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["nodes"].dataType.elementType}
    names = list(kinds)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                n, nodes = row.column(1)[0].as_py(), row.column(2).flatten()
                digests = nodes.field(names.index("digest")).to_pylist()
                paths: list[list] = [[] for _ in digests]
                walk(digests, BLOCK_LEVELS if n > BLOCK else height(n), paths)
                upper = [(s["before"], s["after"]) for s in row.column(5)[0].as_py()]
                for path in paths:
                    path += upper
                steps = list(chain.from_iterable(paths))
                sides = [pa.array([s[k] for s in steps], pa.string()) for k in (0, 1)]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
                proof = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(sides, names=["before", "after"]))
                same = [row.column(k).take(pa.array(np.zeros(len(digests), np.int64))) for k in (0, 3, 4)]
                yield pa.RecordBatch.from_arrays([same[0], *nodes.flatten(), *same[1:], proof], names=["tree", *names, "subroot", "root", "proof"])

    fields = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    return rows.select("tree", "n", "nodes", "subroot", "root", "upper").mapInArrow(down, f"tree string, {fields}, subroot string, root string, proof {PROOF}")


def _climb(nodes: DataFrame, own: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks from the leaves up, and (tree, root) of all trees."""
    levels, roots = [_blocks(nodes, own)], None
    while True:
        blocks = levels[-1]
        done = blocks.where(F.col("n") <= BLOCK).select("tree", "root")
        roots = done if roots is None else roots.unionByName(done)
        most = blocks.agg(F.max("n")).first()[0]
        if most is None or most <= BLOCK:
            return levels, roots
        rest = blocks.where(F.col("n") > BLOCK)
        levels.append(_blocks(rest.select("tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), F.col("root").alias("digest")), []))


def _descend(levels: list[DataFrame], tops: DataFrame, own: list[str]) -> DataFrame:
    """``_down`` through all tables; tops (tree, subroot, root, proof) is for the trees' roots."""
    tops = tops.withColumn("block", F.lit(0).cast("long"))
    above = tops
    for i in range(len(levels) - 1, -1, -1):
        found = _down(levels[i], above, own if not i else [])
        if i:
            # A block's place above is its node there; a tree that ends below is its own block 0.
            ended = tops.join(levels[i - 1].where(F.col("n") <= BLOCK).select("tree"), "tree", "left_semi")
            found = found.select("tree", F.col("pos").alias("block"), "subroot", "root", "proof")
            above = materialize(found.unionByName(ended.select(found.columns)), "above")
    return found


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof, kept columns) of each row; proof holds the siblings before and after each node on
    the way from the leaf to the root, so ``fold(leaf, proof)`` is the root.

    Sources come in bytewise order, a null source first, and within one the rows by id, null ids first; rows of one id
    come by their leaf, and equal rows are leaves of their own. A null text's leaf differs from an empty one's. A table of
    one row has its leaf as root; an empty table has no rows. Columns of docs that aren't named are not read.
    """
    ship(docs.sparkSession)
    source = F.col(f"`{source_col}`").cast("string")
    own = {"id": F.col(f"`{id_col}`")} | {f"k{i}": c for i, c in enumerate((keep or {}).values())}
    tree = F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))
    leaves = docs.select(tree.alias("tree"), leaf([F.col(f"`{c}`") for c in columns]).alias("digest"), *(c.alias(n) for n, c in own.items()), F.monotonically_increasing_id().alias("row"))
    # Written before the range partitioning, which would read and hash the texts twice.
    leaves = materialize(leaves, "digests")
    levels, subroots = _climb(_numbered(leaves, [F.col("id"), F.col("digest"), F.col("row")], list(own)), list(own))
    sources = subroots.select(F.lit("").alias("tree"), F.col("root").alias("digest"), F.col("tree").alias("of"))
    tops, root = _climb(_numbered(sources, [F.col("of")], ["of"]), ["of"])
    start = root.select("tree", F.col("root").alias("subroot"), "root", F.array().cast(PROOF).alias("proof"))
    heads = _descend(tops, start, ["of"]).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", "proof")
    found = _descend(levels, materialize(heads, "heads"), list(own))
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col(f"k{i}").alias(n) for i, n in enumerate(keep or {})))
