"""Reading order, chunk packing, enrichment and indivisible spans."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions import chemistry as C
from orefield.functions import text as T
from orefield.session import ship

SOP_STEP = r"(?m)^(?:Step\s+)?\d+(?:\.\d+)*[:.]"


def pack_blocks(blocks: DataFrame, max_tokens: int = 550, page: str = "page_id", order: str = "n", text: str = "text") -> DataFrame:
    """(page, chunk_index, text, tokens, first, last): blocks in order, closed when the next would pass max_tokens.

    A block over the limit is a chunk of its own; blank blocks and null texts are left out. A task reads its pages' blocks
    in order and holds one open chunk, however long a page is.
    """
    ship(blocks.sparkSession)
    t = F.trim(F.col(text))
    rows = blocks.where(t != "").select(F.col(page).alias("p"), F.col(order).alias("n"), t.alias("t"), T.estimate_by_quarter(t).cast("long").alias("k"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in "pn"}
    names = ["p", "c", "t", "k", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, at, number, total = [], None, 0, 0
        for batch in batches:
            closed: list[tuple] = []
            for p, n, own, k in zip(*(c.to_pylist() for c in batch.columns)):
                fresh = chunk and p != at
                if chunk and (fresh or total + k > max_tokens):
                    closed.append((at, number, "\n\n".join(x[1] for x in chunk), total, chunk[0][0], chunk[-1][0]))
                    number = 0 if fresh else number + 1
                    chunk, total = [], 0
                chunk.append((n, own))
                at, total = p, total + k
            yield made(closed, batch.schema)
            schema = batch.schema
        if chunk:
            yield made([(at, number, "\n\n".join(x[1] for x in chunk), total, chunk[0][0], chunk[-1][0])], schema)

    def made(closed: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*closed)) or [()] * 6
        types = (schema.field(0).type, pa.int32(), pa.string(), pa.int64(), schema.field(1).type, schema.field(1).type)
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], names=names)

    packed = rows.repartition("p").sortWithinPartitions("p", "n").mapInArrow(run, f"p {kinds['p']}, c int, t string, k long, first {kinds['n']}, last {kinds['n']}")
    return packed.toDF(page, "chunk_index", "text", "tokens", "first", "last")


def enrich(raw: Column, title: Column, page: Column) -> Column:
    """struct<retrieval_text, chemicals, sop_steps, tokens> of a chunk."""
    names = F.array_distinct(F.transform(C.mentions(raw), lambda m: m["normalized"]))
    prefix = F.concat_ws(
        " ",
        F.concat(F.lit("[Document: "), title, F.lit("]")),
        F.concat(F.lit("[Page: "), page.cast("string"), F.lit("]")),
        F.when(F.size(names) > 0, F.concat(F.lit("[Chemicals: "), F.array_join(F.slice(names, 1, 5), ", "), F.lit("]"))),
    )
    full = F.concat(prefix, F.lit("\n\n"), raw)
    return F.struct(full.alias("retrieval_text"), names.alias("chemicals"), raw.rlike(SOP_STEP).alias("sop_steps"), T.estimate_by_quarter(full).alias("tokens"))


def merge_intervals(spans: DataFrame, by: str = "id", start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching intervals of each key as one."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(by, start, end).withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w))
    return marked.groupBy(by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


# What must not be split.
ATOMIC = (
    (r"InChI=1S?/[A-Za-z0-9()+\-,./;:?#]+", 0),
    (r"\b[A-Z]{14}-[A-Z]{10}-[A-Z\d]\b", 0),
    (r"\b[A-Z][A-Za-z0-9@+\-#$:/\\\[\]()=]{5,}\b", 0),
    (r"\$\$.*?\$\$", re.DOTALL),
    (r"\\\[.*?\\\]", re.DOTALL),
    (r"\\begin\{equation\}.*?\\end\{equation\}", re.DOTALL),
    (r"\b(?:DANGER|WARNING|CAUTION)\b[:\s].*?(?:\.|\n|$)", re.IGNORECASE),
    (r"\b[HP]\d{3}\b[:\s].*?(?:\.|\n|$)", 0),
    (r"^Row\s+\d+:.*?$", re.MULTILINE),
    (r"^(?:Step\s+)?\d+(?:\.\d+)*[:.]\s+.*?$", re.MULTILINE),
)


def atomic_spans(df: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, start, end): merged indivisible spans. Match offsets are no column function, so patterns run in Arrow batches."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        patterns = [re.compile(p, flags) for p, flags in ATOMIC]
        for batch in batches:
            ids, starts, ends = [], [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p in patterns:
                    for m in p.finditer(t):
                        ids.append(key)
                        starts.append(m.start())
                        ends.append(m.end())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema[0].type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["id", "start", "end"])

    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start long, end long")
    return merge_intervals(found)


def safe_split(index: Column, spans: Column) -> Column:
    """``index``, or the nearer end of the span that it would split; the start on ties."""
    hit = F.filter(spans, lambda s: (s["start"] < index) & (index < s["end"]))
    s = F.get(hit, F.lit(0))
    return F.when(F.size(hit) == 0, index).when(index - s["start"] > s["end"] - index, s["end"]).otherwise(s["start"])


def reading_order(blocks: DataFrame, width: Column | float = 612.0, page: str = "page_id") -> DataFrame:
    """blocks (page, block_id, x0, y0, x1) plus position: two columns one after the other if both have two blocks.

    A block over the middle by 30 points either side spans; it comes first if it starts above both columns, else last.
    """
    mid = (width if isinstance(width, Column) else F.lit(width)) / 2
    side = (
        F.when((F.col("x0") < mid - 30) & (F.col("x1") > mid + 30), "span").when(F.col("x1") <= mid + 30, "left").otherwise("right")
    )
    w = Window.partitionBy(page)
    rows = blocks.withColumn("side", side)
    count = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0)).over(w)
    top = F.min(F.when(F.col("side") != "span", F.col("y0"))).over(w)
    rows = rows.withColumns({"two": (count("left") >= 2) & (count("right") >= 2), "top": top})
    group = F.when(~F.col("two"), 0).when(F.col("side") == "left", 1).when(F.col("side") == "right", 2).when(F.col("y0") < F.col("top"), 0).otherwise(3)
    rows = rows.withColumn("g", group)
    order = Window.partitionBy(page).orderBy("g", "y0", "x0", "block_id")
    return rows.withColumn("position", F.row_number().over(order)).drop("side", "two", "top", "g")


def overlaps(a: Column, b: Column) -> Column:
    """Boxes with x0, y0, x1, y1 that share area."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def _sweep(tables: DataFrame, blocks: DataFrame, page: str, table_y: str, block_y: str) -> DataFrame:
    """Tables and blocks of a page as events (page, y, table_id, block_id): one pass in order of y meets their neighbours."""
    t = tables.select(F.col(page).alias("p"), F.col(table_y).cast("double").alias("y"), "table_id", F.lit(None).cast(blocks.schema["block_id"].dataType).alias("block_id"))
    return t.unionByName(blocks.select(F.col(page).alias("p"), F.col(block_y).cast("double").alias("y"), F.lit(None).cast(tables.schema["table_id"].dataType).alias("table_id"), "block_id"))


def nearest_caption(tables: DataFrame, blocks: DataFrame, reach: float = 60.0, page: str = "page_id") -> DataFrame:
    """(page, table_id, block_id, distance): the block that ends closest above each table, within ``reach`` points.

    Of blocks that end alike that of the smallest id; rows that repeat a table's id are one table. A sweep over the page, no pairs of its tables and blocks.
    """
    order = Window.partitionBy("p").orderBy("y", F.col("table_id").isNotNull(), F.desc("block_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.last(F.when(F.col("block_id").isNotNull(), F.struct("y", "block_id")), ignorenulls=True).over(order)
    met = _sweep(tables, blocks, page, "y0", "y1").withColumn("above", above).where(F.col("table_id").isNotNull() & F.col("above").isNotNull())
    near = met.select("p", "table_id", F.struct((F.col("y") - F.col("above.y")).alias("distance"), "above.block_id").alias("near")).where(F.col("near.distance") <= reach)
    return near.groupBy("p", "table_id").agg(F.min("near").alias("near")).select(F.col("p").alias(page), "table_id", "near.block_id", "near.distance")


def footnotes(tables: DataFrame, blocks: DataFrame, reach: float = 50.0, page: str = "page_id") -> DataFrame:
    """(page, table_id, notes array<block_id>): all blocks that begin under a table, closer than ``reach`` points, from the top
    down, equal ones by id; tables without one aren't told, and rows that repeat a
    table's id are tables of their own."""
    near = Window.partitionBy("p").orderBy("y").rangeBetween(0, math.ceil(reach))
    below = F.collect_list(F.when(F.col("block_id").isNotNull(), F.struct("y", "block_id"))).over(near)
    met = _sweep(tables, blocks, page, "y1", "y0").withColumn("below", below).where(F.col("table_id").isNotNull())
    notes = F.transform(F.array_sort(F.filter("below", lambda b: b["y"] - F.col("y") < reach)), lambda b: b["block_id"])
    return met.select(F.col("p").alias(page), "table_id", notes.alias("notes")).where(F.size("notes") > 0)
