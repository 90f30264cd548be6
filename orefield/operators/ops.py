"""Usage and cost, job progress, caches and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = "UPLOAD VALIDATE STORE CLASSIFY PARSE EXTRACT NORMALIZE CHUNK EMBED INDEX COMPLETE".split()
# Model, price of 1,000 input and output tokens.
PRICES = (
    ("gpt-4o", 0.0025, 0.0100),
    ("gpt-4o-mini", 0.00015, 0.0006),
    ("claude-3-5-sonnet", 0.0030, 0.0150),
    ("text-embedding-3-large", 0.00013, 0.0),
    ("cohere-rerank-v3", 0.0020, 0.0),
)


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price double, output_price double")


def usage_cost(usage: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """usage (task_type, model, prompt_tokens, completion_tokens, chunks, calls) -> one row of totals.

    The price table has five rows and is broadcast; usage of unknown models costs nothing.
    """
    priced = usage.join(F.broadcast(table or prices(usage.sparkSession)), "model", "left")
    cost = F.round(F.col("prompt_tokens") / 1000.0 * F.coalesce("input_price", F.lit(0.0)) + F.col("completion_tokens") / 1000.0 * F.coalesce("output_price", F.lit(0.0)), 6)
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("task_type") == kind, F.col(c))), F.lit(0))
    return priced.agg(
        of("llm", "prompt_tokens").alias("prompt_tokens"), of("llm", "completion_tokens").alias("completion_tokens"), of("embedding", "chunks").alias("chunks"),
        of("external_api", "calls").alias("calls"), F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 4).alias("cost"), F.count("*").alias("records"),
    )


def stage_index(stage: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, STAGES)), stage) - 1).cast("int")


def progress(stage: Column) -> Column:
    return F.round(stage_index(stage) / F.lit(len(STAGES) - 1) * 100.0, 1)


def next_stage(stage: Column) -> Column:
    return F.get(F.array(*map(F.lit, STAGES)), stage_index(stage) + 1)


def resume_point(done: Column) -> Column:
    """The first stage that isn't among the completed ones; null when all are."""
    return F.get(F.array_except(F.array(*map(F.lit, STAGES)), done), F.lit(0))


def fresh(cache: DataFrame, now: Column, hit_hours: int = 24, miss_hours: int = 1) -> DataFrame:
    """Cache rows (key, value, stored) that still hold: misses, whose value is null, for a shorter time."""
    hours = F.when(F.col("value").isNull(), miss_hours).otherwise(hit_hours)
    return cache.where(F.col("stored") + F.make_interval(hours=hours) > now)


def to_look_up(keys: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    return keys.join(fresh(cache, now).select("key").distinct(), "key", "left_anti")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def audit_rows(results: DataFrame, query_text: str = "query") -> tuple[DataFrame, DataFrame]:
    """A search's rows for the two audit tables: one for each query, one for each result."""
    q = results.groupBy("query_id").agg(F.first(query_text).alias("query_text"), F.count("*").alias("results_count"))
    return q, results.select("query_id", F.col("id").alias("chunk_id"), "rank", "score")


def index_statistics(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(documents, "documents").crossJoin(one(chunks, "chunks")).crossJoin(one(embeddings, "embeddings"))


# Of each provider the part of its keys before the identifier (None: the identifier's kind), and whether
# identifiers are trimmed and lower-cased; the others are hashes of queries.
CACHE_KEYS = {"pubchem": (None, True), "crossref": ("doi", True), "europepmc": ("query", False), "ncbi": ("", True), "semanticscholar": ("", False)}


def cache_key(provider: Column, kind: Column, identifier: Column, prefix: str) -> Column:
    """``prefix:provider:part:identifier``, without an empty part; null for unknown providers and null identifiers."""
    clean = F.lower(F.regexp_replace(identifier, r"^\s+|\s+$", ""))
    key = F.lit(None).cast("string")
    for name, (part, cleaned) in CACHE_KEYS.items():
        middle = F.concat(kind, F.lit(":")) if part is None else F.lit(f"{part}:" if part else "")
        key = F.when(provider == name, F.concat(F.lit(f"{prefix}:{name}:"), middle, clean if cleaned else identifier)).otherwise(key)
    return key
