"""A corpus clean-up in five stages: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; ``run``
writes each result as Parquet to the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm import decontaminate, linededup, piece, simhash, toxicity
from orefield.session import discard, load, scratch, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is at least 0.3 go. Null and empty texts have the lowest score and stay; rows that
    repeat score alike; an empty table stays empty; other columns are kept as they are."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 or more words go, and documents of which no word is left by that.

    n_chars is counted again where lines went. Null and empty texts lose nothing and stay; rows that repeat both id and
    text are one document, cut alike; an empty table stays empty; other columns are kept as they are.
    """
    plain = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"))
    done = linededup.dedup_lines(plain)
    changed = F.size("dropped_lines") > 0
    done = done.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("own.n_chars"))}
    return done.select(*((new[c] if c in new else F.col("own")[c]).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, also by five-word shingles of similarity 0.8, the document of the smallest id stays.

    Texts without a word, null ones too, are one group. Null ids come last; of rows that repeat, one stays; an empty table
    stays empty; other columns are kept as they are.
    """
    return simhash.keep_one(docs, similarity=0.8, width=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly so, go. Null and empty texts hold none; rows that repeat are judged
    alike; without items, all stay; an empty table stays empty; other columns are kept as they are."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of each document that is left; null and empty texts have no ids."""
    return piece.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: Trained scores and fingerprints can't be expressed in SQL; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote on their way is deleted as soon as the next result is written."""
    docs = load(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before is not None:
            discard(before)
        before = docs
    return docs
