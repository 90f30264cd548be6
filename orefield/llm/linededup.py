"""Line dedup over line-ID sequences: prefix doubling, longest-common-prefix intervals, later copies deleted.

Only DataFrame functions. Lines become 128-bit ids; a suffix is the sequence of ids from a line to its document's end.
Prefix doubling names the blocks of 1, 2, 4, ... lines from each line: equal names mean that the suffixes' longest
common prefix is at least that long, so the suffixes that share a name are one interval of the suffix array.
A block of any length n is named by the two blocks of the largest power of two within it, at its start and at its end.

A run of lines counts if it has ``min_words`` words. Every line of a run that occurs earlier lies in a shortest block
with that many words, from some line on or up to some line, that occurs earlier too; so the intervals of those blocks
suffice, and the union of their later members is the union of all repeated runs' later copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.session import discard, materialize

MIN_WORDS = 50


def count_words(line: Column) -> Column:
    """Runs of characters other than ASCII blanks."""
    for blank in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(blank), F.lit(" "))
    return F.size(F.array_remove(F.split(line, " "), ""))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, rev, line, a, b, words): a row for each \\n-split line; rev hashes the text, a and b the line."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("t"))
    lines = rows.select("row", "doc_id", F.xxhash64("t").alias("rev"), F.posexplode(F.split("t", "\n")).alias("line", "s"))
    return lines.select(
        "row",
        "doc_id",
        "rev",
        "line",
        F.xxhash64("s").alias("a"),
        F.xxhash64(F.lit(1), F.col("s")).alias("b"),
        count_words(F.col("s")).alias("words"),
    )


def _islands(lines: DataFrame, min_words: int) -> DataFrame:
    """Stretches of lines that each occur more than once somewhere; all other lines break every repeated run.

    Adds to each line c and s, the stretch's words up to and before it, and the ends of its two shortest blocks.
    """
    often = materialize(lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "often")
    live = materialize(lines.join(often, ["a", "b"]), "live")
    isles = live.withColumn("isle", F.col("line") - F.row_number().over(Window.partitionBy("row").orderBy("line")))
    isle = Window.partitionBy("row", "isle")
    whole = isle.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    isles = (
        isles.withColumn("c", F.sum("words").over(isle.orderBy("line")))
        .withColumn("s", F.col("c") - F.col("words"))
        .withColumn("total", F.sum("words").over(whole))
        .where(F.col("total") >= min_words)
    )
    beyond = F.min("line").over(isle.orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, -min_words)) - 1
    within = F.max("line").over(isle.orderBy("c").rangeBetween(Window.unboundedPreceding, -min_words)) + 1
    top = F.max("line").over(whole)
    low = F.min("line").over(whole)
    return (
        isles.withColumn("end", F.coalesce(beyond, F.when(F.col("s") + min_words <= F.col("total"), top)))
        .withColumn("begin", F.coalesce(within, F.when(F.col("c") >= min_words, low)))
        .select("row", "isle", "doc_id", "rev", "line", "a", "b", "end", "begin")
    )


def _blocks(isles: DataFrame) -> DataFrame:
    """(doc_id, rev, start, n, forth, l1, l2, r1, r2): both shortest blocks of each line under their names."""
    longest = isles.agg(F.max(F.greatest(F.col("end") - F.col("line"), F.col("line") - F.col("begin")) + 1)).first()[0] or 1
    levels = int(longest).bit_length()
    order = Window.partitionBy("row", "isle").orderBy("line")
    named = isles.withColumnsRenamed({"a": "a0", "b": "b0"})
    for k in range(levels - 1):
        a, b = F.lead(f"a{k}", 1 << k).over(order), F.lead(f"b{k}", 1 << k).over(order)
        named = named.withColumns(
            {
                f"a{k + 1}": F.when(a.isNotNull(), F.xxhash64(F.col(f"a{k}"), a)),
                f"b{k + 1}": F.when(b.isNotNull(), F.xxhash64(F.lit(k), F.col(f"b{k}"), b)),
            }
        )
    item = F.struct(
        "line", "end", "begin", F.array(*(F.col(f"a{k}") for k in range(levels))).alias("a"), F.array(*(F.col(f"b{k}") for k in range(levels))).alias("b")
    )
    stretch = named.groupBy("row", "isle", "doc_id", "rev").agg(F.sort_array(F.collect_list(item)).alias("x"))

    def block(start: Column, end: Column, forth: bool) -> Column:
        return F.struct(start.alias("start"), (end - start + 1).alias("n"), F.lit(forth).alias("forth"))

    spans = stretch.withColumn(
        "span",
        F.explode(
            F.concat(
                F.transform(F.filter("x", lambda v: v["end"].isNotNull()), lambda v: block(v["line"], v["end"], True)),
                F.transform(F.filter("x", lambda v: v["begin"].isNotNull()), lambda v: block(v["begin"], v["line"], False)),
            )
        ),
    )
    spans = spans.select("doc_id", "rev", "span.*", "x", (F.length(F.bin("span.n")) - 1).cast("int").alias("level"))
    spans = spans.withColumn("at", F.expr("start - x[0].line")).withColumn("tail", F.expr("at + n - shiftleft(1, level)"))
    return spans.selectExpr(
        "doc_id", "rev", "start", "n", "forth",
        "x[at].a[level] as l1", "x[at].b[level] as l2", "x[tail].a[level] as r1", "x[tail].b[level] as r2",
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rev, first, last): the maximal runs of lines of each document that are later copies.

    The first copy is that with the smallest (doc_id, text hash, line); null ids come last. Rows that repeat both id and
    text are one document, told once.
    """
    lines = materialize(line_table(docs, id_col, text_col), "lines")
    isles = materialize(_islands(lines, min_words), "isles")
    blocks = materialize(_blocks(isles), "blocks")
    name = ["forth", "n", "l1", "l2", "r1", "r2"]
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rev", "start")
    # An interval of suffixes with this longest common prefix; its first member stays.
    intervals = materialize(
        blocks.groupBy(*name).agg(F.min(place).alias("kept"), F.max(place).alias("top")).where("kept <> top").drop("top"), "intervals"
    )
    later = blocks.join(intervals, name).where(place != F.col("kept"))
    spans = later.select("doc_id", "rev", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last")).distinct()
    order = Window.partitionBy("doc_id", "rev").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("fresh", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("fresh").over(order))
    found = materialize(runs.groupBy("doc_id", "rev", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run"), "runs")
    for x in (lines, isles, blocks, intervals):
        discard(x)
    return found


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, the text without later copies of runs, and dropped_lines array<struct<first,last>>, n_lines.

    Null texts stay null and empty ones empty; a text of which every line goes becomes empty. Rows that repeat both id
    and text get the same result. Rows of an empty table: none. Columns of docs that are named like the two new ones give
    way to them; no other name clashes.
    """
    runs = repeated_runs(docs, min_words, id_col, text_col)
    runs = materialize(runs.groupBy("doc_id", "rev").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("dropped")), "dropped")
    names = [c for c in docs.columns if c not in ("dropped_lines", "n_lines")]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    own, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}").cast("string")
    # Merged at every size: the texts move once, and no table of runs is sent whole to every executor.
    joined = rows.join(runs.hint("merge"), own.eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("rev")), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda _, i: ~F.exists("dropped", lambda r: (i >= r["first"]) & (i <= r["last"])))
    cut = F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *((cut if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)),
        F.coalesce("dropped", F.array().cast("array<struct<first:int,last:int>>")).alias("dropped_lines"),
        F.size(F.coalesce(lines, F.array(F.lit("")))).alias("n_lines"),
    )
