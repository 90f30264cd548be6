"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm import decontaminate, infill, licenses, linededup, merkle, pii, piece, quality, simhash, sql, tokencount, topk, toxicity, warc
from orefield.session import load


#: A fixed edit script for op1: an insertion, a deletion and a replacement at places that the text's length gives.
OP1_EDITS = """array(
  named_struct('start', n div 3, 'end', n div 3, 'new', ' a note, added in 2024. '),
  named_struct('start', n div 2, 'end', n div 2 + 40, 'new', ''),
  named_struct('start', greatest(n - 60, 0), 'end', greatest(n - 60, 0) + 9, 'new', 'an edited end'))"""


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = "cast(char_length(coalesce(text, '')) as bigint)"
    trees = tokencount.build_trees(load(spark, sf_dir, "documents"))
    edits = F.expr(OP1_EDITS.replace("n div", f"{length} div").replace("n - 60", f"{length} - 60"))
    return tokencount.apply_edits(trees, edits, with_text=False)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(load(spark, sf_dir, "documents")).drop("found")


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive(spark, load(spark, sf_dir, "pages"), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (toxicity.remainder() == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(load(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.encode(load(spark, sf_dir, "documents"), with_ids=False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(load(spark, sf_dir, "documents"))
    runs = F.transform("dropped_lines", lambda r: F.concat_ws("-", r["first"], r["last"]))
    dropped = F.aggregate("dropped_lines", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return done.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
        F.array_join(runs, ",").alias("dropped"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(load(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {c: F.col(c) for c in merkle.COLUMNS}
    lowered = merkle.leaf(list((values | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}).values()))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered)
    made = merkle.manifest(load(spark, sf_dir, "documents"), keep={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    made = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_pii": op2_pii,
        "op3_warc_index": op3_warc_index,
        "op4_simhash": op4_simhash,
        "op5_decontamination": op5_decontamination,
        "op6_toxicity": op6_toxicity,
        "op7_license_scan": op7_license_scan,
        "op8_quality_rules": op8_quality_rules,
        "op9_piece_encoding": op9_piece_encoding,
        "op10_line_dedup": op10_line_dedup,
        "op11_infill": op11_infill,
        "op12_topk_search": op12_topk_search,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_index": sql.OP3_SQL,
        "op7_license_scan": licenses.sql(),
        "op8_quality_rules": sql.OP8_SQL,
        "op10_line_dedup": sql.OP10_SQL,
        "op11_infill": sql.OP11_SQL,
        "op12_topk_search": sql.OP12_SQL,
        "op13_merkle_manifest": sql.op13_sql(),
    }
