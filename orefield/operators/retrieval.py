"""Top-k retrieval: vectors, token overlap, chemical identity, and filters."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions import text as T
from orefield.operators import overlap
from orefield.operators.nearest import Nearest
from orefield.session import ship

#: Query vectors go to every task in blocks of at most this many numbers.
BLOCK_NUMBERS = 4 << 20
#: Scores are computed for so many vectors and queries at a time.
TILE_ROWS, TILE_QUERIES = 4096, 256
METRICS = ("cosine", "l2", "ip")


def rank(df: DataFrame, *order: Column, by: str = "query_id", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def vector_topk(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id", id_col: str = "id", vector: str = "embedding", corpus_vector: str | None = None
) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors of each query; larger scores are nearer, ties go by id.

    Each task multiplies its vectors with a bounded block of queries, tile by tile, and passes on its k best for each
    query; one window over these few rows ranks them. Vectors that differ in length from the block's queries are an
    error; null and empty vectors and those with a null number are left out. Unknown metrics mean cosine, zero vectors score 0 under it, and a
    query whose vector is zero has no result under it. Filter ``corpus`` first: that is pre-filtering, with full recall.
    """
    metric = metric if metric in METRICS else "cosine"
    held = "v is not null and size(v) > 0 and not exists(v, x -> x is null)"
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v")).where(held)
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(corpus_vector or vector).cast("array<double>").alias("v")).where(held)
    shape = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = 1 + (shape[0] * (shape[1] or 0)) // BLOCK_NUMBERS
    kind = asked.schema["query_id"].dataType.simpleString()
    out = None
    ship(corpus.sparkSession)
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = part.toArrow()
        ids = found.column("query_id").combine_chunks()
        q = np.array(found.column("v").to_pylist(), dtype=np.float64).reshape(len(ids), -1 if len(ids) else 0)

        def run(batches: Iterable[pa.RecordBatch], q=q, ids=ids):
            norms = np.sqrt((q * q).sum(axis=1))
            best = Nearest(len(q), k)
            for batch in batches:
                lists = batch.column(1)
                if len(q) and len(batch) and (np.diff(np.asarray(lists.offsets)) != q.shape[1]).any():
                    raise ValueError(f"every vector needs the {q.shape[1]} numbers of the queries")
                for r in range(0, len(batch), TILE_ROWS):
                    own = np.asarray(batch.column(0).slice(r, TILE_ROWS))
                    v = np.asarray(lists.slice(r, TILE_ROWS).flatten()).reshape(len(own), -1)
                    for c in range(0, len(q), TILE_QUERIES):
                        part = q[c : c + TILE_QUERIES]
                        if metric == "l2":
                            score = -np.stack([np.sqrt(((v - x) ** 2).sum(axis=1)) for x in part])
                        else:
                            score = part @ v.T
                        if metric == "cosine":
                            length = norms[c : c + TILE_QUERIES, None] * np.sqrt((v * v).sum(axis=1))[None, :]
                            score = np.divide(score, length, out=np.zeros_like(score), where=length != 0)
                        best.offer(np.arange(c, c + len(part)), score, own)
            which, where, value = best.rows()
            keep = (norms[which] > 0) | (metric != "cosine")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which[keep])), pa.array(where[keep]), pa.array(value[keep])], names=["query_id", "id", "score"])

        found = rows.mapInArrow(run, f"query_id {kind}, id long, score double")
        out = found if out is None else out.unionByName(found)
    return rank(out, F.desc("score"), F.col("id")).where(F.col("rank") <= k)


def token_overlap_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_text: str = "text",
    id_col: str = "id",
    text_col: str = "text",
    boost: float = 2.0,
    counters: overlap.Counters | None = None,
) -> DataFrame:
    """(query_id, id, score, rank) by |q and d| / |q| over distinct words, and ``boost`` if a query identifier is in the text.

    The best overlaps come from ``overlap.topk``. Identifiers are registry numbers and equipment codes, compared without
    case; a text holds one from a word's start on. Texts that hold one are scored besides.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("q"))
    q = q.select("query_id", T.tokens("q").alias("words"), identifiers(F.col("q")).alias("idents"))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    best = overlap.topk(q, d, k, counters)
    named = q.select("query_id", "words", F.explode("idents").alias("ident"))
    if not named.isEmpty():
        # Identifiers are words or words joined by dashes; each is looked up through its first word.
        posted = d.select("id", F.explode(T.tokens("t")).alias("w"))
        first = named.withColumn("w", F.regexp_extract(F.lower("ident"), T.WORD, 1))
        held = first.join(posted, "w").join(d, "id").where(F.lower("t").contains(F.lower("ident")))
        shared = F.size(F.array_intersect("words", T.tokens("t"))) / F.greatest(F.size("words"), F.lit(1))
        held = held.select("query_id", "id", (shared + boost).alias("score")).dropDuplicates(["query_id", "id"])
        best = best.join(held, ["query_id", "id"], "left_anti").unionByName(held)
    return rank(best, F.desc("score"), F.col("id")).where(F.col("rank") <= k)


CAS = r"(?<!\w)(\d{2,7}-\d{2}-\d)(?!\w)"
EQUIPMENT = r"\b([A-Z]{2,8}-\d{1,6})\b"


def identifiers(c: Column) -> Column:
    """Registry numbers and equipment codes of a query, distinct, in that order."""
    return F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(CAS), F.lit(1)), F.regexp_extract_all(c, F.lit(EQUIPMENT), F.lit(1))))


def visible(df: DataFrame, current: str = "is_current", deleted: str = "deleted_at") -> DataFrame:
    return df.where(F.col(current) & F.col(deleted).isNull())


def filter_chunks(
    df: DataFrame,
    tenant: str | None = None,
    documents: list | DataFrame | None = None,
    sections: list | None = None,
    chunk_types: list | None = None,
    date_from=None,
    date_to=None,
    has_entities: bool | None = None,
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """All retrieval filters; an empty or missing list, date or flag filters nothing. Dates are inclusive.

    ``documents`` may be a frame of ids, which becomes a semi-join. ``columns`` renames the filtered columns.
    """
    c = {"tenant": "organization_id", "document": "document_id", "section": "section_id", "type": "chunk_type", "date": "created_at", "entities": "contains_chemical_entities"} | (columns or {})
    if tenant is not None:
        df = df.where(F.col(c["tenant"]) == tenant)
    if isinstance(documents, DataFrame):
        ids = documents.select(F.col(documents.columns[0]).alias(c["document"])).distinct()
        df = df.join(ids, c["document"], "left_semi")
    elif documents:
        df = df.where(F.col(c["document"]).isin(documents))
    if sections:
        df = df.where(F.col(c["section"]).isin(sections))
    if chunk_types:
        df = df.where(F.col(c["type"]).isin(chunk_types))
    if date_from is not None:
        df = df.where(F.col(c["date"]) >= F.lit(date_from))
    if date_to is not None:
        df = df.where(F.col(c["date"]) <= F.lit(date_to))
    return df if has_entities is None else df.where(F.col(c["entities"]) == has_entities)


def contains_text(c: Column, part: str) -> Column:
    """Substring test without case in which % and _ stand for themselves."""
    return F.contains(F.lower(c), F.lower(F.lit(part)))


def equals_text(c: Column, value: Column) -> Column:
    return F.lower(c) == F.lower(value)


def identity_match(entity: dict[str, Column], query: Column) -> Column:
    """InChIKey or canonical SMILES equal to the query, or, if it has two dashes, the registry number."""
    dashes = F.length(query) - F.length(F.replace(query, F.lit("-"), F.lit("")))
    return (entity["inchi_key"] == query) | (entity["smiles"] == query) | ((dashes == 2) & (entity["cas"] == query))


def chemical_union(identity: DataFrame, names: DataFrame, similar: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, id, score, source, similarity): identity (1.0) before name (0.9) before similarity of ``least`` or more.

    The first source keeps a pair; a similarity found besides only adds its value.
    """
    close = similar.where(F.col("score") >= least).select("query_id", "id", "score")
    parts = (
        identity.select("query_id", "id").withColumns({"score": F.lit(1.0), "source": F.lit("identity"), "p": F.lit(1)}),
        names.select("query_id", "id").withColumns({"score": F.lit(0.9), "source": F.lit("name"), "p": F.lit(2)}),
        close.withColumns({"source": F.lit("similarity"), "p": F.lit(3)}),
    )
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("query_id", "id").agg(
        F.min_by("score", "p").alias("score"), F.min_by("source", "p").alias("source"), F.max(F.when(F.col("p") == 3, F.col("score"))).alias("similarity")
    )
