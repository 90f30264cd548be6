"""Table access, upserts, listings, upload checks and prompt-side projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions import text as T
from orefield.session import ship

#: Texts are split into words in slices of about so many characters.
SLICE_CHARS = 1 << 20
MAX_UPLOAD = 50 * 1024 * 1024
UPLOAD_TYPES = ("application/pdf", "application/x-pdf", "application/octet-stream")


def get(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def matching(df: DataFrame, filters: dict | None) -> DataFrame:
    """Equality filters; names that are no columns are ignored."""
    for name, value in (filters or {}).items():
        if name in df.columns:
            df = df.where(F.col(name) == value)
    return df


def page(df: DataFrame, key: str, skip: int = 0, limit: int = 100, filters: dict | None = None) -> DataFrame:
    """A page in key order."""
    return matching(df, filters).orderBy(key).offset(skip).limit(limit)


def count(df: DataFrame, filters: dict | None = None) -> DataFrame:
    return matching(df, filters).agg(F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key by ``order``; new rows win ties. A key's history is reduced by map-side maxima."""
    columns = [c for c in old.columns if c not in keys]
    rows = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    latest = F.max(F.struct(F.col(order).alias("_o"), "_p", *(F.col(c).alias(f"_{c}") for c in columns))).alias("r")
    return rows.groupBy(*keys).agg(latest).select(*keys, *(F.col(f"r._{c}").alias(c) for c in columns))


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def _first(df: DataFrame, keys: dict[str, Column], rank: Column, largest: bool = False) -> DataFrame:
    """One whole row of df for each key, that of the least rank; partial results merge, so no key is sorted in one task."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    pick = (F.max_by if largest else F.min_by)(row, rank)
    return df.groupBy(*(c.alias(f"_{n}") for n, c in keys.items())).agg(pick.alias("r")).select("r.*")


def latest(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The whole latest row of each key; ``tie`` settles equal order values, nulls are oldest."""
    return _first(df, {k: F.col(k) for k in keys}, F.struct(order, tie), largest=True)


def with_child_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """parents plus a count of each kind of child, 0 where there is none; children are counted before the join."""
    out = parents
    for name, (child, fk) in children.items():
        n = child.groupBy(F.col(fk).alias(key)).agg(F.count("*").alias(name))
        out = out.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def with_children(parents: DataFrame, child: DataFrame, key: str, fk: str, name: str) -> DataFrame:
    """parents plus an array of their child rows, sorted; empty where there is none."""
    fields = [c for c in child.columns if c != fk]
    nested = child.groupBy(F.col(fk).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    kind = nested.schema[name].dataType.simpleString()
    return parents.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def join_pages(pages: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """The non-empty page texts of each document in order, with an empty line between."""
    rows = pages.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), F.col(text).alias("t")))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda p: p["t"]), "\n\n").alias("text"))


def chunk_title(title: Column, filename: Column) -> Column:
    return F.coalesce(T.non_empty(title), T.non_empty(filename), F.lit("Scientific Paper"))


def sanitize_filename(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    clean = F.regexp_replace(base, r"[^\p{L}\p{N}_.\-]", "_")
    return F.when(clean == "", F.lit("unnamed_file")).otherwise(clean)


def storage_key(org: Column, content: Column, filename: Column) -> Column:
    """{org}/{first two digits}/{sha256}_{name}."""
    sha = F.sha2(content, 256)
    return F.concat_ws("/", org, F.substring(sha, 1, 2), F.concat(sha, F.lit("_"), sanitize_filename(filename)))


def check_uploads(uploads: DataFrame, existing: DataFrame, max_bytes: int = MAX_UPLOAD) -> DataFrame:
    """uploads (upload_id, org, filename, content_type, content) -> (upload_id, sha, status, duplicate_of).

    status is the first failed check, or duplicate, or accepted. A duplicate is a live document of the same tenant with
    the same hash (existing: org, sha, document_id), or an earlier upload of this batch.
    """
    size, name = F.octet_length("content"), F.lower("filename")
    wrong = (
        F.when(~F.endswith(name, F.lit(".pdf")), "extension")
        .when(size > max_bytes, "too_large")
        .when(size == 0, "empty")
        .when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "magic")
        .when(F.col("content_type").isNotNull() & (F.col("content_type") != "") & ~F.col("content_type").isin(*UPLOAD_TYPES), "content_type")
    )
    rows = uploads.select("upload_id", "org", F.sha2("content", 256).alias("sha"), wrong.alias("wrong"))
    first = rows.where("wrong is null").groupBy("org", "sha").agg(F.min("upload_id").alias("first_upload"))
    known = existing.groupBy("org", "sha").agg(F.min("document_id").alias("document_id"))
    out = rows.join(known, ["org", "sha"], "left").join(first, ["org", "sha"], "left")
    again = F.col("document_id").isNotNull() | (F.col("first_upload") < F.col("upload_id"))
    status = F.coalesce("wrong", F.when(again, "duplicate"), F.lit("accepted"))
    return out.select("upload_id", "sha", status.alias("status"), F.when(status == "duplicate", F.col("document_id")).alias("duplicate_of"))


def confidence(blocked: Column, n_chunks: Column, n_facts: Column) -> Column:
    """1.0 if blocked, else by retrieved chunks, else .85 with calculations or entities, else .5."""
    return F.when(blocked, 1.0).when(n_chunks > 0, F.least(F.lit(1.0), 0.6 + 0.08 * n_chunks)).when(n_facts > 0, 0.85).otherwise(0.5)


def chat_confidence(value: Column, n_citations: Column) -> Column:
    return F.when(value > 0, value).when(n_citations > 0, 0.95).otherwise(0.80)


def chat_citations(cits: Column) -> Column:
    """An array of citation structs (title, page, score, snippet) under the literal ids CIT-00n."""
    return F.transform(
        cits,
        lambda c, i: F.struct(
            F.concat(F.lit("CIT-00"), (i + 1).cast("string")).alias("citation_id"),
            F.coalesce(T.non_empty(c["title"]), F.lit("Scientific Literature Reference")).alias("title"),
            F.coalesce(F.nullif(c["page"], F.lit(0)), F.lit(1)).alias("page"),
            F.coalesce(c["score"], F.lit(0.95)).alias("score"),
        ),
    )


def answer_markdown(summary: Column, lines: Column, cits: Column) -> Column:
    """A template answer: summary, listed findings, the first five citations."""
    shown = F.transform(F.slice(cits, 1, 5), lambda c: F.concat(F.lit("- ["), c["citation_id"], F.lit("] "), c["title"]))
    bullets = F.transform(lines, lambda x: F.concat(F.lit("- "), x))
    return F.concat_ws("\n", summary, F.when(F.size(bullets) > 0, F.array_join(bullets, "\n")), F.when(F.size(shown) > 0, F.concat(F.lit("### Citations\n"), F.array_join(shown, "\n"))))


def prompt(question: Column, evidence: Column) -> Column:
    """A prompt with numbered evidence, or one that says that there is none."""
    listed = F.array_join(F.transform(evidence, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e)), "\n")
    return F.when(F.size(evidence) > 0, F.concat(F.lit("Evidence:\n"), listed, F.lit("\n\nQuestion: "), question)).otherwise(F.concat(F.lit("No evidence was found.\n\nQuestion: "), question))


def map_lines(m: Column, drop: tuple[str, ...] = ("synonyms", "cid")) -> Column:
    """'Key Name: value, ...' of a map without the dropped keys, in key order."""
    kept = F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: ~k.isin(*drop))))
    return F.array_join(F.transform(kept, lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), e["value"])), ", ")


def inverted_index(df: DataFrame, text: str = "text") -> DataFrame:
    """df's other columns and index, the word -> positions map of each text between single spaces; null text, null index.

    Words are grouped within their own batch, so no word leaves its row and nothing is shuffled.
    """
    ship(df.sparkSession)
    kept = [f for f in df.schema if f.name != text]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "index map<string, array<int>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < len(batch):
                words, sizes, stop, chars = [], [], start, 0
                while stop < len(batch) and chars < SLICE_CHARS:
                    t = batch.column(len(kept))[stop].as_py()
                    own = [] if t is None else t.split(" ")
                    words += own
                    sizes.append(None if t is None else len(own))
                    stop, chars = stop + 1, chars + len(t or "")
                many = np.array([n or 0 for n in sizes])
                row, place = np.repeat(np.arange(len(many)), many), np.concatenate([np.arange(n) for n in many])
                coded = pa.array(words, pa.string()).dictionary_encode()
                code = np.asarray(coded.indices)
                order = np.lexsort((place, code, row))
                code, row, place = code[order], row[order], place[order]
                fresh = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(row, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(fresh, len(code)).astype(np.int32)), pa.array(place.astype(np.int32)))
                first = np.searchsorted(row[fresh], np.arange(len(many) + 1)).tolist()
                offsets = pa.array([None if n is None else o for n, o in zip([*sizes, 0], first)], pa.int32())
                index = pa.MapArray.from_arrays(offsets, coded.dictionary.take(pa.array(code[fresh])), lists)
                yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns[: len(kept)]), index], names=[*(f.name for f in kept), "index"])
                start = stop

    return df.select(*(f.name for f in kept), text).mapInArrow(run, fields)


def inverted_abstract(index: Column) -> Column:
    """The text of a word -> positions map."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def year_of(date: Column) -> Column:
    y = F.substring(date, 1, 4)
    return F.when(y.rlike("^[0-9]{4}$"), y.try_cast("int"))


def bare_title(title: Column) -> Column:
    return F.lower(F.trim(title))


def first_by_title(records: DataFrame, order: str = "provider_order") -> DataFrame:
    """One record for each lower-cased and trimmed title, from the first provider."""
    return _first(records, {"title": bare_title(F.col("title"))}, F.struct(order, "title"))


def first_hit(keys: DataFrame, providers: list[DataFrame], key: str, value: str) -> DataFrame:
    """keys plus the value of the first provider that has one; of several rows of a provider its least value counts."""
    out, found = keys, []
    for i, p in enumerate(providers):
        out = out.join(p.groupBy(key).agg(F.min(value).alias(f"_v{i}")), key, "left")
        found.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*(f"_v{i}" for i in range(len(providers))))
