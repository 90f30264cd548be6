"""Lexical reranking and packing of evidence into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions import text as T
from orefield.operators.retrieval import CAS, rank
from orefield.session import materialize

#: Its ends are those of ASCII words: a bare \b takes other letters for parts of a word in some Java versions and not in others.
FORMULA = r"(?<!\w)((?:[A-Z][a-z]?\d*){2,})(?!\w)"


def rerank_score(query: Column, text: Column, asked: Column | None = None, held: Column | None = None) -> Column:
    """A sigmoid of .5 recall + .3 Jaccard + .2 phrase + .4 per registry number + .25 per formula of the query.

    ``asked`` and ``held`` are the distinct words of query and text, where they are columns already.
    """
    q, t = T.tokens(query) if asked is None else asked, T.tokens(text) if held is None else held
    shared = F.size(F.array_intersect(q, t))
    hit = lambda pattern, weight: F.lit(weight) * F.size(F.filter(F.regexp_extract_all(query, F.lit(pattern), F.lit(1)), lambda x: F.contains(text, x)))
    score = 0.5 * shared / F.size(q) + 0.3 * shared / F.greatest(F.size(q) + F.size(t) - shared, F.lit(1))
    score = score + F.when(F.contains(F.lower(text), F.lower(query)), 0.2).otherwise(0.0) + hit(CAS, 0.4) + hit(FORMULA, 0.25)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.round(1 / (1 + F.exp(-2.5 * (score - 0.5))), 4))


def rerank(candidates: DataFrame, pool: int = 50, top: int = 10) -> DataFrame:
    """candidates (query_id, id, query, text, retrieval_score, rank) -> the pool's best by score, then by both ties."""
    pooled = candidates.where(F.col("rank") <= pool).withColumnRenamed("rank", "pre_rank")
    # Written with their words, so that the score names columns and no text is tokenised more than once for a query.
    words = materialize(pooled.withColumns({"_asked": T.tokens("query"), "_held": T.tokens("text")}), "pool")
    scored = words.withColumn("score", rerank_score(F.col("query"), F.col("text"), F.col("_asked"), F.col("_held"))).drop("_asked", "_held")
    return rank(scored, F.desc("score"), F.desc("retrieval_score"), F.col("id").cast("string")).where(F.col("rank") <= top)


def dedup_context(chunks: DataFrame, position: str = "position", text: str = "text", by: str = "query_id") -> DataFrame:
    """The first chunk, by position, of each squeezed and lower-cased content."""
    first = F.row_number().over(Window.partitionBy(by, T.content_hash(F.col(text))).orderBy(position))
    return chunks.withColumn("_n", first).where("_n = 1").drop("_n")


def header(number: Column, title: Column, section: Column, page: Column) -> Column:
    parts = F.concat_ws(
        " | ",
        F.concat(F.lit("Source ["), number.cast("string"), F.lit("]: "), title),
        F.when(T.non_empty(section).isNotNull(), F.concat(F.lit("Section: "), section)),
        F.when(page.isNotNull(), F.concat(F.lit("Page: "), page.cast("string"))),
    )
    return F.concat(F.lit("### "), parts, F.lit("\n"))


def pack_context(chunks: DataFrame, max_tokens: int = 4096, reserve: int = 1024, max_chunks: int = 10) -> DataFrame:
    """chunks (query_id, id, score, title, section, page, text), already distinct -> (query_id, id, used, number, tokens).

    Best scores first. A chunk that would pass the budget of max(128, max_tokens - reserve) is skipped and later ones are
    tried; a chunk's cost includes its header, which holds its number. Only costs are kept of a pool, and each round finds
    the next chunk of every query as a minimum over those that still fit, so a pool is never in one task; there are
    max_chunks rounds at most, and they end when nothing fits. tokens is what a chunk cost, or would have when it was passed.
    """
    budget = max(128, max_tokens - reserve)
    empty = F.concat(header(F.lit(""), F.coalesce(T.non_empty(F.col("title")), F.lit("Document")), F.col("section"), F.col("page")), F.trim("text"), F.lit("\n"))
    # Words and length without the number, whose digits make a word only longer.
    sized = chunks.withColumn("_block", empty)
    place = F.struct((-F.col("score")).alias("o"), F.col("id").alias("i"), F.monotonically_increasing_id().alias("row"))
    pool = materialize(sized.select("query_id", "id", place.alias("place"), T.word_count(F.col("_block")).alias("words"), F.length("_block").alias("chars")), "pool")

    def cost(number: Column) -> Column:
        size = F.greatest(F.col("words") * F.lit(1.3), (F.col("chars") + F.length(number.cast("string"))) / F.lit(3.8))
        return F.greatest(F.lit(1), F.floor(size).cast("int"))

    kind = pool.schema["place"].dataType.simpleString()
    state = materialize(pool.select("query_id").distinct().select("query_id", F.lit(0).alias("total"), F.array().cast(f"array<{kind}>").alias("chosen")), "chosen")
    for n in range(1, max_chunks + 1):
        last = F.col("chosen")[n - 2] if n > 1 else F.lit(None)
        open_ = state.where(F.size("chosen") == n - 1).select("query_id", "total", last.alias("last"))
        left = pool.join(open_, "query_id").withColumn("cost", cost(F.lit(n))).where(F.col("total") + F.col("cost") <= budget)
        if n > 1:
            left = left.where(F.col("place") > F.col("last"))
        found = left.groupBy("query_id").agg(F.min(F.struct("place", "cost")).alias("next"))
        joined = state.join(found, "query_id", "left")
        fresh = materialize(
            joined.select(
                "query_id",
                F.col("total") + F.coalesce(F.col("next.cost"), F.lit(0)),
                F.when(F.col("next").isNull(), F.col("chosen")).otherwise(F.array_append("chosen", F.col("next.place"))),
            ).toDF("query_id", "total", "chosen"),
            "chosen",
        )
        state = fresh
        if fresh.where(F.size("chosen") == n).isEmpty():
            break
    before = F.size(F.filter("chosen", lambda c: c < F.col("place")))
    used = F.array_contains("chosen", F.col("place"))
    out = pool.join(state, "query_id").select("query_id", "id", used.alias("used"), (before + 1).alias("number"), cost(before + 1).alias("tokens"))
    return out.withColumn("number", F.when(F.col("used"), F.col("number")))


def context_blocks(packed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context): the used chunks under their headers, in order of their numbers."""
    used = packed.where("used").join(chunks, ["query_id", "id"])
    block = F.concat(header(F.col("number"), F.coalesce(T.non_empty(F.col("title")), F.lit("Document")), F.col("section"), F.col("page")), F.trim("text"), F.lit("\n"))
    rows = used.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("number", block.alias("b")))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["b"]), "\n").alias("context"))
